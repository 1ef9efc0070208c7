"""Completion parsing cases and prompt text pieces."""

from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators.prompts import build_prompts, explode_recommendations, factors_text, parse_completions

REC = '{"priority": 1, "category": "GPA", "action": "a", "reason": "r", "timeline": "t"}'
CASES = [
    ("fenced", f'Here:\n```json\n{{"recommendations": [{REC}], "summary": "s"}}\n```\nbye', "ok", 1, "s"),
    ("plain_fence", f'```\n{{"recommendations": [{REC}, {REC}]}}\n```', "ok", 2, spec.DEFAULT_SUMMARY),
    ("bare", f'{{"recommendations": [{REC}, {{"priority": 2}}], "summary": "x"}}', "ok", 1, "x"),
    ("missing_list", '{"summary": "no list"}', "fallback_error", 1, spec.FALLBACK_OTHER["summary"]),
    ("not_list", '{"recommendations": "text"}', "fallback_error", 1, spec.FALLBACK_OTHER["summary"]),
    ("not_json", "I think you should study more.", "fallback_invalid_json", 1,
     spec.FALLBACK_INVALID_JSON["summary"]),
    ("empty", "   ", "fallback_error", 1, spec.FALLBACK_OTHER["summary"]),
]


def test_parse_completion_cases(spark):
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "case string, completion string")
    got = {r.case: r for r in parse_completions(df).collect()}
    for name, _, status, n, summary in CASES:
        r = got[name]
        assert r.status == status, name
        assert len(r.recommendations) == n, name
        assert r.summary == summary, name
    assert got["fenced"].recommendations[0].category == "GPA"
    assert got["not_json"].recommendations[0].action == spec.FALLBACK_INVALID_JSON["action"]


def test_chat_envelope(spark):
    env = '{"choices": [{"message": {"content": "```json\\n{\\"recommendations\\": []}\\n```"}}]}'
    df = spark.createDataFrame([(env,)], "completion string")
    r = parse_completions(df, envelope=True).first()
    assert r.status == "ok" and len(r.recommendations) == 0


def test_factor_and_condition_text(spark):
    df = spark.createDataFrame([(1,)], "id int").select(F.array(
        F.struct(F.lit("study_hours").alias("feature"), F.lit(0.1234).alias("impact"),
                 F.lit("positive").alias("direction"), F.lit(None).cast("string").alias("description"))).alias("f"))
    t = df.select(factors_text(F.col("f")).alias("t")).first().t
    assert t == spec.FACTOR_HEADER + "\n- study_hours: positive impact (+0.123) - " + spec.IMPACT_POSITIVE
    empty = df.select(factors_text(F.array().cast(
        "array<struct<feature:string,impact:double,direction:string,description:string>>")).alias("t")).first().t
    assert empty == ""


def test_build_prompts_routes(spark):
    row = dict(row_ix=1, age=16, grade=10, attendance_rate=0.9, study_hours=2.5, extracurricular=1,
               part_time_job=0, parent_support=1, internet_access=1, free_time=3, go_out=2,
               parental_education="HS", school_type="Public", locale="City", ses_quartile=2)
    df = spark.createDataFrame([{**row, "prediction": 0}, {**row, "row_ix": 2, "prediction": 1}])
    out = {r.row_ix: r for r in build_prompts(df).collect()}
    assert out[1].route == "at_risk" and out[1].max_tokens == 800
    assert "- Attendance Rate: 90.0% (Target: 85%)" in out[1].prompt
    assert spec.CONDITION_HEADER + spec.CONDITION_TEXTS["test_score"] in out[1].prompt
    assert out[2].route == "good_standing" and out[2].max_tokens == 600
    assert "(Excellent: above 85%)" in out[2].prompt and out[2].system_prompt == spec.GOOD_STANDING_SYSTEM


def test_explode_recommendations_query_matches_duckdb(spark, tmp_path):
    """The registered T7 query and its DuckDB twin on completions that parse."""
    import duckdb
    import pandas as pd

    from __spark_entry__ import oracle_sql, queries

    ok = ('```json\n{"recommendations": [{"priority": 2, "category": "Study", "action": "a", '
          '"reason": "r", "timeline": "t"}, {"priority": 9, "category": "X", "action": "b", '
          '"reason": "r2", "timeline": "t2"}, {"category": "no priority"}], "summary": "S"}\n```')
    bare = '{"recommendations": [{"priority": 1, "category": "C", "action": "x", "reason": null, "timeline": "now"}]}'
    rows = [(1, 1, "assistant", ok), (2, 1, "assistant", bare), (3, 1, "assistant", "not json"),
            (4, 1, "assistant", '{"summary": "no list"}'), (5, 1, "assistant", "   "), (6, 0, "user", ok)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = queries()["explode_recommendations"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = con.execute(oracle_sql()["explode_recommendations"]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = ["conv_id", "turn", "position"]
    g = got[cols].sort_values(key).reset_index(drop=True)
    w = want[cols].sort_values(key).reset_index(drop=True)
    assert len(g) == 6   # 2 kept items + 1 bare item + 3 fallbacks
    assert g.astype(str).values.tolist() == w.astype(str).values.tolist()


def test_every_step_of_parsing_is_computed_once(spark):
    """Expressions that repeat inside one another grew to hundreds of parses of each text; an explode added as many in a filter."""
    env = '{"text": "```json\\n{\\"recommendations\\": [' + REC.replace('"', '\\"') + ', {\\"priority\\": 2}, 3, null]}\\n```"}'
    df = spark.createDataFrame([(1, env), (2, '{"recommendations": []}'), (3, None)], "k int, completion string")
    df = df.withColumn("completion", F.concat("completion", F.lit(" ")))
    out = explode_recommendations(parse_completions(df, envelope=True), ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 4 and plan.count("parseJson(") == 1 and plan.count("from_json(") == 2
    assert sorted((r.k, r.status, r.position, r.category) for r in out.collect()) == [
        (1, "ok", 1, "GPA"), (3, "fallback_error", 1, spec.FALLBACK_OTHER["category"])]
