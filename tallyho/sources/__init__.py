from tallyho.sources.tables import TABLES, nan_to_null, read_table, students, table_path

__all__ = ["TABLES", "nan_to_null", "read_table", "students", "table_path"]
