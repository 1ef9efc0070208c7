"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.llm import (bit_planes, cover_tree, hash_forest, jaccard_join, line_dedup, mixing, packing, pitman_yor, pivot_index,
                         quality, sharding, substring_dedup, vantage_clusters)
from tallyho.session import delete_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the visible text of every page, judged within its host."""
    pages = _read(spark, sf_dir, "pages").select(
        "page_id", line_dedup.host_of(F.col("url")).alias("host"),
        line_dedup.visible_lines(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", "text")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text, learnt from four fifths of the documents."""
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return pitman_yor.score(_read(spark, sf_dir, "documents"), F.coalesce(train, F.lit(True)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    names = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    return sharding.place(_read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word 3-grams of 0.9 or more."""
    return jaccard_join.jaccard_groups(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that has not seen the held-out fifth."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(part != 0).select("doc_id", "quality")
    model = quality.train(docs, labels)
    held = F.coalesce(part == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with cosine 0.95 or more."""
    return pivot_index.near_duplicates(_read(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", "kept")


def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = _read(spark, sf_dir, "embeddings")
    return hash_forest.search(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector counts as of the next label."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return cover_tree.mine(rows, F.col("vec_id") % 100 == 0)


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to bit-plane files and read back."""
    import public_tokenizers
    path = bit_planes.new_dataset(spark)
    bit_planes.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = bit_planes.digests(spark, path)
    delete_path(spark, path)
    return out


def op13_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the vectors after ten rounds."""
    return vantage_clusters.cluster(_read(spark, sf_dir, "embeddings"))


LLM_QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_pivot_index": op9_pivot_index,
    "op10_hash_forest": op10_hash_forest,
    "op11_cover_tree": op11_cover_tree,
    "op12_bit_planes": op12_bit_planes,
    "op13_vantage_clusters": op13_vantage_clusters,
}

_HIDDEN_SQL = "html"
for _p in line_dedup.HIDDEN:
    _HIDDEN_SQL = f"regexp_replace({_HIDDEN_SQL}, '{_p}', '', 'g')"

_FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _cluster_sql(k: int = vantage_clusters.K, rounds: int = vantage_clusters.ROUNDS) -> str:
    """The rounds one after the other: distances of components, the least (distance, number), floors of exact means."""
    ctes = [f"""
        v AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id,
                 list_transform(embedding, lambda x: CAST(floor({vantage_clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = {vantage_clusters.DIMS} AND {_FINITE_SQL}),
        e AS MATERIALIZED (SELECT rid, unnest(range(len(v))) AS j, unnest(v) AS x FROM v),
        s AS (SELECT v, row_number() OVER (ORDER BY sha256('{vantage_clusters.SEED}:' || vec_id)) - 1 AS c FROM v WHERE vec_id IS NOT NULL),
        k0 AS MATERIALIZED (SELECT c, unnest(range(len(v))) AS j, unnest(v) AS x FROM s WHERE c < {k})"""]
    for r in range(rounds + 1):
        ctes.append(f"""
        a{r} AS MATERIALIZED (
          SELECT rid, min({{'d': d, 'c': c}}) AS m
          FROM (SELECT e.rid, k.c, CAST(sum((e.x - k.x) * (e.x - k.x)) AS BIGINT) AS d
                FROM e JOIN k{r} k USING (j) GROUP BY e.rid, k.c) GROUP BY rid)""")
        if r < rounds:
            ctes.append(f"""
        t{r} AS (SELECT m.c AS c, j, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY m.c, j),
        k{r + 1} AS MATERIALIZED (
          SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM t{r}
          UNION ALL SELECT c, j, x FROM k{r} WHERE c NOT IN (SELECT m.c FROM a{r}))""")
    return f"""
        WITH {','.join(ctes)},
        h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM k{rounds} GROUP BY c)
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance,
               CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (rid) JOIN h ON h.c = m.c"""


LLM_ORACLE = {
    "op11_cover_tree": f"""
        WITH r AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor({cover_tree.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE_SQL}),
        s AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {cover_tree.POSITIVES}),
        n AS (
          SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND {cover_tree.LOW} * positive_score <= 100 * score AND 100 * score <= {cover_tree.HIGH} * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= {cover_tree.NEGATIVES}""",
    "op13_vantage_clusters": _cluster_sql(),
    "op2_line_dedup": f"""
        WITH p AS (
          SELECT page_id, lower(coalesce(regexp_extract(url, '{line_dedup.HOST}', 1), '')) AS host,
                 regexp_replace(regexp_replace({_HIDDEN_SQL}, '{line_dedup.BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
          FROM pages),
        l AS (
          SELECT page_id, host, line, trim(translate(line, chr(9) || chr(13) || chr(12), '   ')) AS bare, pos
          FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line,
                       unnest(range(len(string_split(text, chr(10))))) AS pos FROM p)),
        c AS (SELECT host, bare, count(DISTINCT page_id) AS pages FROM l WHERE bare <> '' GROUP BY host, bare),
        h AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
        bad AS (SELECT c.host, c.bare FROM c JOIN h USING (host)
                WHERE pages >= {line_dedup.MIN_PAGES} AND pages > {line_dedup.RATIO} * host_pages),
        kept AS (
          SELECT page_id, count(*) FILTER (l.bare <> '') AS n_lines, count(bad.bare) AS n_dropped,
                 coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (bad.bare IS NULL), '') AS text
          FROM l LEFT JOIN bad ON l.host = bad.host AND l.bare = bad.bare GROUP BY page_id)
        SELECT p.page_id, p.host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text
        FROM p LEFT JOIN kept USING (page_id)""",
}
