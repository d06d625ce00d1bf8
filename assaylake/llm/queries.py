"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import bpe, hardneg, lattice, mixing, mtree, ptolemy, rabitq, tokencounts, tokenfile, toolcalls, toxicity, warc
from assaylake.llm.simhash import simhash_components

#: The tokenizer file of the queries; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"
#: The piece vocabulary of the lattice.
PIECES = "piece_bpe_32k.model"


def _tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer())


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mtree.top_k(rows, rows.where("vec_id % 50 = 0"))


def op4_rabitq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer(PIECES))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer())


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemy.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after another; a vector's distance and cluster travel as one number, distance * k + cluster."""
    near = """near{r} AS MATERIALIZED (
            SELECT n, min(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {k} + c) AS best FROM v, c{r} c GROUP BY n
        )"""
    moved = """sums{r} AS (
            SELECT best % {k} AS c, j, sum(e[j]) AS s, count(*) AS m FROM near{r} JOIN v USING (n), range(1, 65) t(j) GROUP BY ALL
        ), means{r} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) / m AS BIGINT) ORDER BY j) AS e FROM sums{r} GROUP BY c
        ), c{next} AS MATERIALIZED (SELECT old.c, coalesce(new.e, old.e) AS e FROM c{r} old LEFT JOIN means{r} new USING (c))"""
    steps = ", ".join(part.format(r=r, next=r + 1, k=k) for r in range(rounds) for part in (near, moved))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), starts AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL
        ), c0 AS MATERIALIZED (SELECT c, e FROM starts WHERE c < {k}
        ), {steps}, {near.format(r=rounds, k=k)},
        found AS (SELECT vec_id, best % {k} AS cluster, best // {k} AS distance FROM near{rounds} JOIN v USING (n))
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM found JOIN c{rounds} c ON c.c = found.cluster
    """


SQL = {
    "op12_ptolemaic_clusters": _clusters_sql(),
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
    "op2_tool_calls": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn, text, if(role = 'system', 'configure', 'ask') AS name, (conv_id + turn) % 11 AS fault,
                   row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth
            FROM conversations WHERE role IN ('system', 'user')
        ), ids AS (SELECT DISTINCT conv_id, turn FROM calls
        ), needs AS (
            SELECT a.conv_id, a.turn, b.turn AS need FROM ids a JOIN ids b ON a.conv_id = b.conv_id
            AND (b.turn = 0 AND a.turn > 0 OR b.turn = a.turn - 2 AND a.turn % 64 >= 2 OR a.turn = 2 AND b.turn = 6 AND a.conv_id % 16 = 5)
        ), walks AS (
            SELECT conv_id, turn, 0 AS depth FROM ids
            UNION SELECT n.conv_id, n.turn, w.depth + 1 FROM walks w JOIN needs n ON n.conv_id = w.conv_id AND n.need = w.turn WHERE w.depth < 70
        ), levels AS (SELECT conv_id, turn, if(max(depth) < 70, 2 * max(depth), NULL) AS level FROM walks GROUP BY ALL
        ), results AS (
            SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth
            FROM conversations WHERE role = 'assistant'
        ), met AS (
            SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, name, c.text, content, fault,
                   CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'open' ELSE 'linked' END AS status, l.level,
                   CASE WHEN c.conv_id IS NOT NULL THEN fault NOT IN (4, 7, 9) AND if(name = 'configure', length(c.text) >= 20, length(c.text) BETWEEN 1 AND 300) END AS valid
            FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = r.nth
            LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
        ), told AS (
            SELECT *, '{"arguments":' || if(status = 'orphan' OR fault IN (4, 7), 'null', '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || if(fault = 9, -1 - turn, turn) || '}')
                   || ',"call_id":"' || call_id || '","content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"name":' || coalesce('"' || name || '"', 'null')
                   || ',"status":"' || status || '","valid":' || coalesce(CAST(valid AS VARCHAR), 'null') || '}' AS json
            FROM met
        )
        SELECT conv_id, call_id, name, status, valid, CAST(level AS INTEGER) AS level, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 1073741824), turn, status, json) AS position, json FROM told
    """,
    "op3_mtree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op4_rabitq_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
        ), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id
        JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
