"""Queries: features of contents, derived features, similarity."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from assaylake.functions import content, generators
from assaylake.operators import derive, similarity
from assaylake.plans.registry import register
from assaylake.sources import views
from assaylake.sources.scratch import cut
from assaylake.sources.views import blobs, samples, sections, sql, table


@register("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    return content.content_hash(blobs(spark, d))


def _grams(n: int, step: int = 1) -> str:
    return f"g AS (SELECT doc_id, i AS pos, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * n}) AS gram FROM (SELECT doc_id, h, unnest(range(0, n - {n} + 1, {step})) AS i FROM blobs WHERE n >= {n}))"


_ENTROPY = "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)"


@register(sql(f"WITH {_grams(1)}, c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2) SELECT doc_id, {_ENTROPY} AS entropy FROM c GROUP BY 1", "blobs"))
def file_entropy(spark, d):
    return content.file_entropy(blobs(spark, d))


@register(sql(f"WITH {_grams(2, 2)}, c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS k FROM c) SELECT doc_id, round(sum(-(n / a) * log2(n / a)), 6) AS entropy FROM r WHERE k <= 64 GROUP BY 1", "blobs"))
def ngram_entropy(spark, d):
    return content.ngram_entropy(blobs(spark, d), 2, 2, 64)


@register(sql(f"WITH {_grams(1)}, c AS (SELECT doc_id, pos // 256 AS block, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), e AS (SELECT doc_id, block, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e, max(n) / sum(n) AS top FROM c GROUP BY 1, 2) SELECT doc_id, count(*) AS blocks, round(avg(e), 6) AS avg_entropy, round(max(e), 6) AS max_entropy FROM e WHERE top < 0.5 GROUP BY 1", "blobs"))
def block_entropy(spark, d):
    return content.block_entropy(blobs(spark, d))


@register(sql("SELECT hash, round(sum(entropy * raw_size) / sum(raw_size) + 1e-9, 6) AS entropy FROM sections WHERE entropy > 0 AND raw_size > 0 GROUP BY 1", "sections"))
def weighted_section_entropy(spark, d):
    return content.weighted_entropy(sections(spark, d)).withColumn("entropy", F.round(F.col("entropy") + 1e-9, 6))


@register(sql(f"WITH {_grams(1)}, c AS (SELECT doc_id, pos // 512 AS part, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER w AS a, row_number() OVER (PARTITION BY doc_id, part ORDER BY n DESC, gram) AS k FROM c WINDOW w AS (PARTITION BY doc_id, part)), e AS (SELECT doc_id, part, round(sum(-(n / a) * log2(n / a)), 6) AS e FROM r WHERE k <= 16 GROUP BY 1, 2) SELECT doc_id, round(avg(e) + 1e-9, 5) AS entropy FROM e WHERE e > 0 GROUP BY 1", "blobs"))
def topk_section_entropy(spark, d):
    return content.topk_part_entropy(blobs(spark, d), 512, 16).withColumn("entropy", F.round(F.col("entropy") + 1e-9, 5))


@register("""
    WITH b AS (SELECT page_id, page_id % 10 AS site, hex(encode(html)) AS h, strlen(html) AS n FROM pages WHERE html IS NOT NULL), g AS (SELECT page_id, site, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS gram FROM (SELECT *, unnest(range(0, n)) AS i FROM b)),
    c AS (SELECT site, page_id, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), j AS (SELECT site, gram, sum(n) AS n FROM c GROUP BY 1, 2)
    SELECT a.site, joint, mean FROM (SELECT site, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS joint FROM j GROUP BY 1) a
    JOIN (SELECT site, round(avg(e), 5) AS mean FROM (SELECT site, page_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS e FROM c GROUP BY 1, 2) GROUP BY 1) b USING (site)""")
def joint_section_entropy(spark, d):
    pages = table(spark, d, "pages").where("html is not null").select("page_id", (F.col("page_id") % 10).alias("site"), F.col("html").cast("binary").alias("content"))
    return content.joint_entropy(pages, "site", "page_id")


@register(sql(f"WITH {_grams(1)} SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2", "blobs"))
def byte_histogram(spark, d):
    return content.gram_counts(blobs(spark, d))


@register(sql(f"WITH {_grams(3)} SELECT gram, count(*) AS n FROM g GROUP BY 1", "blobs"))
def ngram_counts(spark, d):
    return content.gram_counts(blobs(spark, d), 3).groupBy("gram").agg(F.sum("n").alias("n"))


@register(sql(f"WITH {_grams(2)}, c AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE gram <> '2020' GROUP BY 1, 2) SELECT doc_id, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS k FROM c) WHERE k BETWEEN 3 AND 12", "blobs"))
def ngram_distribution(spark, d):
    return content.gram_distribution(blobs(spark, d), 2, 10, 2, ("2020",))


def _words(offset: int, n: int, width: int) -> str:
    return f"list_transform(range({n}), lambda i: CAST(('0x' || substr(rpad(substr(h, {2 * offset + 1}, {2 * n * width}), {2 * n * width}, '0'), CAST(i * {2 * width} + 1 AS BIGINT), {2 * width})) AS INTEGER))"


@register(sql(f"SELECT doc_id, array_to_string({_words(8, 16, 1)}, ',') AS bytes FROM blobs", "blobs"))
def bytes_after_offset(spark, d):
    return blobs(spark, d).select("doc_id", F.array_join(content.bytes_after(F.col("content"), 8, 16), ",").alias("bytes"))


@register(sql(f"SELECT doc_id, array_to_string({_words(8, 8, 2)}, ',') AS words FROM blobs", "blobs"))
def bigrams_after_offset(spark, d):
    return blobs(spark, d).select("doc_id", F.array_join(content.words_after(F.col("content"), 8, 8, 2), ",").alias("words"))


@register(sql(f"SELECT doc_id, array_to_string({_words(4, 8, 3)}, ',') AS words FROM blobs", "blobs"))
def trigrams_after_offset(spark, d):
    return blobs(spark, d).select("doc_id", F.array_join(content.words_after(F.col("content"), 4, 8, 3), ",").alias("words"))


@register(sql("SELECT doc_id, array_to_string(list_transform(range(4), lambda i: substr(h, CAST(2 * (16 + i * 32) + 1 AS BIGINT), 64)), ',') AS first, array_to_string(list_transform(range(1, 4), lambda i: CASE WHEN n >= i * 32 THEN substr(h, CAST(2 * (n - i * 32) + 1 AS BIGINT), 64) ELSE '' END), ',') AS last FROM blobs", "blobs"))
def fragments(spark, d):
    c = F.col("content")
    return blobs(spark, d).select("doc_id", F.array_join(content.fragments(c, 4, 32, 16), ",").alias("first"), F.array_join(content.fragments(c, 3, 32, from_end=True), ",").alias("last"))


@register(sql(f"WITH w AS (SELECT doc_id, {_words(0, 16, 1)} AS b FROM blobs) SELECT doc_id, array_to_string(list_transform(range(1, 16), lambda i: (b[i] + b[i + 1]) % 256), ',') AS lrc FROM w", "blobs"))
def lrc_fragments(spark, d):
    return blobs(spark, d).select("doc_id", F.array_join(content.lrc(content.bytes_after(F.col("content"), 0, 16)), ",").alias("lrc"))


@register("SELECT doc_id, len(regexp_extract_all(text, '[ -~]{5,}')) AS n, md5(array_to_string(regexp_extract_all(text, '[ -~]{5,}'), chr(10))) AS digest FROM documents")
def strings(spark, d):
    found = content.strings(F.col("content"))
    return blobs(spark, d).select("doc_id", found.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("digest"))


@register("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS n FROM documents")
def strings_match(spark, d):
    found = content.matches(content.strings(F.col("content"), 1), "[A-Z][a-z]{3,}")
    return blobs(spark, d).select("doc_id", F.size(found).cast("long").alias("n"))


@register("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[ -~]{5,}'), lambda s: len(s) >= 20)) AS long, len(regexp_extract_all(text, '[ -~]{5,}')) AS n FROM documents")
def strings_count(spark, d):
    rows = blobs(spark, d).select("doc_id", content.strings(F.col("content")).alias("s"))
    return rows.select("doc_id", F.size(F.filter("s", lambda s: F.length(s) >= 20)).cast("long").alias("long"), F.size("s").cast("long").alias("n"))


@register("SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || html, '(?i)https?://[a-z0-9./?=_%:-]+')) AS url FROM pages")
def urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit(content.URL), F.lit(0)))).alias("url"))
    return pages


@register("SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || html, '/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+')) AS path FROM pages")
def paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit(content.PATH), F.lit(0)))).alias("path"))


@register()
def randomness_profile(spark, d):
    return content.randomness_profile(blobs(spark, d))


@register(sql("SELECT hash, count(*) AS n, count(*) FILTER (name IN ('.text', '.data', '.rsrc')) AS n_standard, round(avg(CAST(name IN ('.text', '.data', '.rsrc') AS INTEGER)), 6) AS standard_ratio, count(*) FILTER (w) AS n_w, count(*) FILTER (x) AS n_x, count(*) FILTER (w AND x) AS n_wx, count(*) FILTER (raw_size = 0) AS n_empty, count(*) FILTER (virtual_size > raw_size) AS n_grown FROM sections GROUP BY 1", "sections"))
def section_counts(spark, d):
    return content.section_counts(sections(spark, d), [".text", ".data", ".rsrc"])


@register(sql("SELECT hash, CAST(sum(greatest(0, raw_size - virtual_size)) AS BIGINT) AS slack, count(*) FILTER (virtual_size - raw_size >= 10) AS n_slack, bool_or(virtual_size - raw_size >= 10) AS has_slack FROM sections GROUP BY 1", "sections"))
def slack_space(spark, d):
    return content.slack(sections(spark, d), 10)


@register(sql("SELECT hash, idx, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (CASE WHEN w AND x THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN raw_size < 5 THEN 0.125 ELSE 0 END + CASE WHEN virtual_size > 50 THEN 0.25 ELSE 0 END + CASE WHEN name = '.upx' THEN 0.375 ELSE 0 END))), 3) AS portability FROM sections", "sections"))
def portability_score(spark, d):
    rules = {"w and x": 0.5, "raw_size < 5": 0.125, "virtual_size > 50": 0.25, "name = '.upx'": 0.375}
    return sections(spark, d).select("hash", "idx", content.portability(rules).alias("portability"))


_OPS = "ops AS (SELECT user_id AS hash, list(event_type ORDER BY event_id) AS ops FROM events GROUP BY 1)"


@register(f"WITH {_OPS}, g AS (SELECT hash, array_to_string(ops[i:i + 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ops))) AS i FROM ops)) SELECT hash, gram, count(*) AS n FROM g GROUP BY 1, 2")
def opcode_ngram_histogram(spark, d):
    ordered = table(spark, d, "events").groupBy(F.col("user_id").alias("hash")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return content.sequence_grams(ordered.select("hash", F.col("e.event_type").alias("ops")), "ops", 2, "hash")


@register(sql("SELECT doc_id, CAST(i AS INTEGER) AS place, substr(h, CAST(2 * (16 + i * 32) + 1 AS BIGINT), 64) AS fragment FROM blobs, range(4) r(i) WHERE h IS NOT NULL", "blobs"))
def fragments_from_sql(spark, d):
    generators.register(spark)
    return spark.sql("SELECT * FROM fragments(TABLE(SELECT doc_id, content FROM {blobs}), 4, 32, 16)", blobs=blobs(spark, d))


@register(f"WITH {_OPS}, g AS (SELECT hash, array_to_string(ops[i:i + 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ops))) AS i FROM ops)) SELECT hash, gram, count(*) AS n FROM g GROUP BY 1, 2")
def opcode_grams_from_sql(spark, d):
    generators.register(spark)
    events = table(spark, d, "events").select(F.col("user_id").alias("hash"), "event_id", F.col("event_type").alias("token"))
    return spark.sql("SELECT hash, gram, count(*) AS n FROM token_grams(TABLE(SELECT * FROM {events}) PARTITION BY hash ORDER BY (event_id), 2) GROUP BY hash, gram", events=events)


@register("WITH t AS (SELECT p_size AS hash, unnest(string_split_regex(p_name || ' ' || p_type, '[,+*\\[\\]\\- ]+')) AS t FROM part) SELECT hash, count(*) FILTER (t IN ('small', 'red', 'blue', 'hot')) AS adjectives, count(*) FILTER (t IN ('ring', 'widget', 'bolt', 'gear')) AS nouns FROM t GROUP BY 1")
def token_group_counts(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("hash"), F.concat_ws(" ", "p_name", "p_type").alias("operands"))
    return content.token_groups(rows, "operands", {"adjectives": ["small", "red", "blue", "hot"], "nouns": ["ring", "widget", "bolt", "gear"]}, "hash")


@register(sql("SELECT hash, count(*) FILTER (mnemonic IN ('1-URGENT', '2-HIGH')) AS n_jumps, count(*) FILTER (mnemonic IN ('1-URGENT', '2-HIGH') AND size % 2 = 1) AS n_indirect FROM blocks GROUP BY 1", "blocks"))
def jump_counts(spark, d):
    operand = F.when(F.col("size") % 2 == 0, F.concat(F.lit("0x"), F.hex("addr"))).otherwise("eax")
    return content.jumps(views.blocks(spark, d).withColumn("operand", operand), "mnemonic", "operand", ["1-URGENT", "2-HIGH"], "hash")


@register(sql("WITH c AS (SELECT mnemonic, coalesce(size, 0) AS size, count(*) AS c FROM blocks GROUP BY 1, 2) SELECT mnemonic, string_agg(size || ':' || c, ',' ORDER BY c DESC, size DESC) AS histogram FROM c GROUP BY 1", "blocks"))
def block_size_histogram(spark, d):
    from assaylake.operators.aggregate import sorted_histogram

    return sorted_histogram(views.blocks(spark, d).withColumn("size", F.coalesce("size", F.lit(0))), "size", "mnemonic")


def _elf_sql() -> str:
    def number(offset: int, size: int) -> str:
        low = " || ".join(f"substr(h, {2 * (offset + i) + 1}, 2)" for i in reversed(range(size)))
        return f"CAST(CASE WHEN substr(h, 11, 2) = '02' THEN CAST('0x' || substr(h, {2 * offset + 1}, {2 * size}) AS UBIGINT) ELSE CAST('0x' || {low} AS UBIGINT) END AS DOUBLE)"

    out, narrow, wide = [], 16, 16
    for name, a, b in content.ELF:
        out.append(f"CASE WHEN substr(h, 9, 2) = '01' THEN {number(narrow, a)} ELSE {number(wide, b)} END AS {name}")
        narrow, wide = narrow + a, wide + b
    byte = lambda i: f"CAST('0x' || substr(h, {2 * i - 1}, 2) AS INTEGER)"
    return f"SELECT doc_id, {' + '.join(byte(i) for i in range(1, 17))} AS e_ident, {byte(5)} AS ei_class, {byte(6)} AS ei_data, {byte(7)} AS ei_version, {', '.join(out)} FROM headers"


_HEADERS = """headers AS (SELECT doc_id, rpad(CASE doc_id % 4 WHEN 0 THEN '7F454C4602' || '01' || substr(h, 13) WHEN 1 THEN '7F454C4601' || '01' || substr(h, 13) WHEN 2 THEN '7F454C4602' || '02' || substr(h, 13) ELSE '7F454C4601' || '02' || substr(h, 13) END, CAST(greatest(128, 2 * n) AS INTEGER), '0') AS h FROM blobs)"""


@register(sql(f"WITH {_HEADERS} {_elf_sql()}", "blobs"))
def elf_header_fields(spark, d):
    """The texts' bytes behind an ELF ident of either class and byte order, by doc_id; a content shorter than a header goes on with zeros, a null one has null fields."""
    ident = F.when(F.col("doc_id") % 4 == 0, "7F454C460201").when(F.col("doc_id") % 4 == 1, "7F454C460101").when(F.col("doc_id") % 4 == 2, "7F454C460202").otherwise("7F454C460102")
    behind = F.concat(F.unhex(ident), F.substring("content", F.lit(7), F.octet_length("content")))
    whole = F.when(F.octet_length(behind) < 64, F.rpad(behind, 64, F.lit(b"\0"))).otherwise(behind)
    return blobs(spark, d).select("doc_id", whole.alias("content")).select("doc_id", *content.elf_header(F.col("content")))


@register("SELECT vec_id, CAST(CASE WHEN label % 3 = 0 THEN NULL ELSE embedding[1] END AS FLOAT) AS v0, embedding[64] AS v63 FROM embeddings")
def raw_vector_unpack(spark, d):
    raw = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, F.concat(F.array(F.lit(-1.0).cast("float")), F.slice("embedding", 2, 63))).otherwise(F.col("embedding")).alias("v"))
    return raw.select("vec_id", content.unpacked(F.col("v")).alias("v")).select("vec_id", F.element_at("v", 1).cast("float").alias("v0"), F.element_at("v", 64).cast("float").alias("v63"))


# ---------------------------------------------------------------- derived features


def per_sample(spark, d):
    rows = sections(spark, d).groupBy("hash").agg(F.count("*").alias("n"), F.sum("raw_size").alias("raw"), F.sum("virtual_size").alias("virtual"), F.round(F.avg("entropy"), 6).alias("entropy"), F.count_if("x").alias("n_x"))
    return rows.withColumn("format", F.when(F.col("hash") % 3 == 0, "PE32").when(F.col("hash") % 3 == 1, "PE64").otherwise("ELF32"))


_PER = "p AS (SELECT hash, count(*) AS n, CAST(sum(raw_size) AS BIGINT) AS raw, CAST(sum(virtual_size) AS BIGINT) AS virtual, round(avg(entropy), 6) AS entropy, count(*) FILTER (x) AS n_x, CASE hash % 3 WHEN 0 THEN 'PE32' WHEN 1 THEN 'PE64' ELSE 'ELF32' END AS format FROM sections GROUP BY 1)"
FEATURES = {"is_dense": "ratio > 0.5", "ratio": "raw / virtual", "score": "ratio + share", "share": "n_x / n", "mixed": "round((raw + virtual) / (n * (n_x - 1)), 6)", "lost": "unknown_column + 1"}


@register(sql(f"WITH {_PER} SELECT hash, raw / nullif(virtual, 0) AS ratio, n_x / n AS share, raw / nullif(virtual, 0) > 0.5 AS is_dense, raw / nullif(virtual, 0) + n_x / n AS score, round((raw + virtual) / nullif(n * (n_x - 1), 0), 6) AS mixed, CAST(NULL AS DOUBLE) AS lost FROM p", "sections"))
def derive_features(spark, d):
    """Features of features, with divisions by zero and one that reads a column that is not there."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return derive.derive(per_sample(spark, d), FEATURES, fail="warning").select("hash", "ratio", "share", "is_dense", "score", "mixed", "lost")


@register(sql(f"WITH {_PER} SELECT hash, 2 * n + 1 AS a, 2 * n + 1 + raw AS b, (2 * n + 1 + raw) * (2 * n + 1) AS c FROM p", "sections"))
def feature_dag(spark, d):
    chain = {"c": "b * a", "b": "a + raw", "a": "2 * n + 1", "loop": "knot + 1", "knot": "loop + 1"}
    return derive.derive(per_sample(spark, d), chain).select("hash", "a", "b", "c")


@register(sql("SELECT hash, " + ", ".join(f"count(*) FILTER (raw_size > {t} AND {f}) AS n_{f}_{t}" for f in ("w", "x") for t in (10, 20, 40)) + " FROM sections GROUP BY 1", "sections"))
def template_features(spark, d):
    made = derive.expand_templates({"n_{flag}_{size}": "count_if(raw_size > {size} and {flag})"}, {"flag": ["w", "x"], "size": [10, 20, 40]})
    return sections(spark, d).groupBy("hash").agg(*(F.expr(e).alias(n) for n, e in made.items()))


@register(sql(f"WITH {_PER} SELECT hash, format, coalesce(CASE format WHEN 'PE64' THEN NULL WHEN 'PE32' THEN raw * 2 ELSE raw END, -1) AS size FROM p", "sections"))
def format_override(spark, d):
    value = derive.override({"All": "raw", "PE": "raw * 2", "PE64": None}, "format", {"PE": ["PE32", "PE64"]})
    return per_sample(spark, d).select("hash", "format", F.coalesce(value, F.lit(-1)).alias("size"))


@register(sql(f"WITH {_PER} SELECT hash, raw / nullif(virtual, 0) > 0.5 AS is_dense FROM p", "sections"))
def prune_features(spark, d):
    return derive.derive(per_sample(spark, d), {"is_dense": "ratio > 0.5", "ratio": "raw / virtual"}, only_boolean=True).select("hash", "is_dense")


@register(sql(f"WITH {_PER} SELECT hash, entropy > 0.04 AS is_high FROM p", "sections"))
def entropy_threshold_feature(spark, d):
    return derive.derive(per_sample(spark, d), {"is_high": "entropy > 0.04"}).select("hash", "is_high")


@register(sql(f"WITH {_PER} SELECT hash, raw % 4 = 0 AS is_aligned, nullif(virtual, 0) IS NULL AS is_null, coalesce(n_x / n >= 0.9, false) AS has_code, n IN (1, 3, 5) AS is_listed, raw BETWEEN 50 AND 100 AS is_ranged, raw >= 120 AS is_large FROM p", "sections"))
def header_bool_features(spark, d):
    made = {"is_aligned": "raw % 4 = 0", "is_null": "nullif(virtual, 0) is null", "has_code": "n_x / n >= 0.9", "is_listed": "n in (1, 3, 5)", "is_ranged": "raw between 50 and 100", "is_large": "raw >= 120"}
    return derive.derive(per_sample(spark, d), made).select("hash", *made)


@register("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS byte_{i}_after_ep" for i in range(64)) + " FROM embeddings")
def raw_alias_features(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", *(F.element_at("embedding", i + 1).alias(f"byte_{i}_after_ep") for i in range(64)))


@register(sql(f"""WITH {_grams(1)}, c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), e AS (SELECT doc_id, {_ENTROPY} AS entropy FROM c GROUP BY 1),
    k AS (SELECT doc_id, pos // 256 AS block, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), l AS (SELECT doc_id, block, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e, max(n) / sum(n) AS top FROM k GROUP BY 1, 2),
    b AS (SELECT doc_id, count(*) AS blocks, round(avg(e), 6) AS avg_entropy, round(max(e), 6) AS max_entropy FROM l WHERE top < 0.5 GROUP BY 1)
    SELECT doc_id, n AS size, CAST(len(regexp_extract_all(text, '[ -~]{{5,}}')) AS INTEGER) AS n_strings, text IS NULL AS failed, entropy, blocks, avg_entropy, max_entropy, entropy > 4.2 AS is_high,
           CAST(len(regexp_extract_all(text, '[ -~]{{5,}}')) AS DOUBLE) / blocks AS per_block FROM blobs LEFT JOIN e USING (doc_id) LEFT JOIN b USING (doc_id)""", "blobs"))
def compute_all_features(spark, d):
    """All features of each document in one row; a document without content has failed set and nulls."""
    docs = blobs(spark, d)
    text = F.col("content")
    parts = docs.select("doc_id", F.octet_length("content").alias("size").cast("long").alias("size"), F.when(text.isNotNull(), F.size(content.strings(text))).alias("n_strings"), text.isNull().alias("failed"))
    joined = parts.join(content.file_entropy(docs), "doc_id", "left").join(content.block_entropy(docs), "doc_id", "left")
    return derive.derive(joined, {"is_high": "entropy > 4.2", "per_block": "n_strings / blocks"})


# ---------------------------------------------------------------- similarity


@register()
def fuzzy_signature(spark, d):
    """The MinHash signature of each text as 64 numbers: the share of equal places of two signatures estimates the texts' similarity."""
    items = cut(table(spark, d, "documents").where("text is not null").select("doc_id", similarity.hashes(F.col("text")).alias("items")))
    return items.select("doc_id", F.array_join(similarity.signature(F.col("items")).cast("array<string>"), ":").alias("signature"))


SHINGLES = """
    t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS items FROM t),
    c AS (SELECT items, min(doc_id) AS doc_id FROM s GROUP BY 1), e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM c),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
    pairs AS (SELECT a, b, round(100 * k / (na + nb - k), 6) AS score FROM p WHERE 100 * k / (na + nb - k) >= 80)"""


def _pairs(spark, d):
    return similarity.similar_pairs(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@register(f"WITH {SHINGLES} SELECT * FROM pairs")
def similar_pairs(spark, d):
    return _pairs(spark, d)


@register(f"WITH {SHINGLES} SELECT s.doc_id, t.doc_id AS other, round(100 * len(list_intersect(s.items, t.items)) / len(list_distinct(list_concat(s.items, t.items))), 6) AS score FROM s JOIN s t ON t.doc_id = s.doc_id + 1 JOIN documents x ON x.doc_id = s.doc_id JOIN documents y ON y.doc_id = t.doc_id AND y.lang = x.lang")
def pair_similarity(spark, d):
    """Each document and the next one, where both are of one language, as only samples of one format are compared."""
    sets = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", similarity.hashes(F.col("text")).alias("items"))
    after = sets.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("items").alias("other_items"))
    return sets.join(after, ["doc_id", "lang"]).select("doc_id", (F.col("doc_id") + 1).alias("other"), similarity.jaccard(F.col("items"), F.col("other_items")).alias("score"))


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha256' ELSE '?' END AS kind FROM documents")
def digest_format(spark, d):
    n = F.col("doc_id") % 3
    digest = F.when(n == 0, F.md5(F.col("text").cast("binary"))).when(n == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("none")
    return table(spark, d, "documents").select("doc_id", similarity.digest_kind(digest).alias("kind"))


@register(f"""WITH RECURSIVE {SHINGLES}, todo AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id FROM c),
    kept AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ids UNION ALL
        SELECT t.k, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = t.doc_id AND list_contains(kept.ids, p.a)) THEN kept.ids ELSE list_append(kept.ids, t.doc_id) END FROM kept JOIN todo t ON t.k = kept.k + 1)
    SELECT unnest(ids) AS doc_id FROM (SELECT ids FROM kept ORDER BY k DESC LIMIT 1)""")
def near_dedup(spark, d):
    sets, _ = similarity.classes(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return similarity.keep_greedily(sets, "doc_id")


@register("""
    WITH t AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
    s AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(1, len(w)) + 1), lambda i: w[i])) AS items FROM t), r AS (SELECT items AS ri FROM s WHERE item_id = 0)
    SELECT item_id, score FROM (SELECT item_id, round(100 * len(list_intersect(items, ri)) / len(list_distinct(list_concat(items, ri))), 6) AS score FROM s, r) WHERE score >= 5""")
def similar_to_reference(spark, d):
    items = table(spark, d, "benchmark").select("item_id", similarity.shingles(F.col("text"), 1).alias("items"))
    reference = items.where("item_id = 0").select(F.col("items").alias("ri"))
    scored = items.join(F.broadcast(reference)).select("item_id", similarity.jaccard(F.col("items"), F.col("ri")).alias("score"))  # one row
    return scored.where("score >= 5").orderBy(F.col("score").desc(), "item_id")


@register(f"WITH {SHINGLES} SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT b FROM (SELECT * FROM pairs ORDER BY score DESC, a, b LIMIT 15))")
def drop_most_similar(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return similarity.drop_most_similar(docs, _pairs(spark, d), "doc_id", 15).select("doc_id")
