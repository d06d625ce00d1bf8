"""Queries: scores and repairs of datasets, votes and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from assaylake.functions import content
from assaylake.operators import aggregate, history, quality, similarity, voting
from assaylake.plans.content import SHINGLES
from assaylake.plans.registry import register
from assaylake.plans.tables import _distinct_samples
from assaylake.sources import views
from assaylake.sources.scratch import new_folder, written
from assaylake.sources.views import samples, sql, table

_GAPS = "gaps AS (SELECT hash, doc_id, CASE WHEN doc_id % 7 <> 0 THEN format END AS format, CASE WHEN doc_id % 11 <> 0 THEN size END AS size, CASE WHEN doc_id % 5 <> 0 THEN label END AS label FROM samples)"


def gaps(spark, d):
    """samples with nulls."""
    return samples(spark, d).select("hash", "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("format")).alias("format"), F.when(F.col("doc_id") % 11 != 0, F.col("size")).alias("size"), F.when(F.col("doc_id") % 5 != 0, F.col("label")).alias("label"))


COLUMNS = ["hash", "doc_id", "format", "size", "label"]
_NULLS = "(CAST(format IS NULL AS INTEGER) + CAST(size IS NULL AS INTEGER) + CAST(label IS NULL AS INTEGER)) / 5"


@register(sql(f"WITH {_GAPS} SELECT round(1 - avg({_NULLS}), 6) AS completeness FROM gaps", "samples"))
def completeness(spark, d):
    return quality.completeness(gaps(spark, d), COLUMNS)


@register(sql(f"WITH {_GAPS} SELECT round((avg(CAST(hash IN (SELECT hash FROM samples WHERE doc_id % 10 < 9) AS INTEGER)) + avg(CAST(coalesce(format IN ('PE32', 'PE64', 'ELF64'), false) AS INTEGER)) + avg(CAST(label IS NOT NULL AS INTEGER))) / 3, 6) AS consistency FROM gaps", "samples"))
def consistency(spark, d):
    return quality.consistency(gaps(spark, d), samples(spark, d).where("doc_id % 10 < 9"), ["PE32", "PE64", "ELF64"])


def _balance_sql(column: str, margin: float, where: str = "") -> str:
    return f"SELECT round(1 - greatest(0, max(n) / sum(n) - min(n) / sum(n) - {2 * margin}), 6) AS balance FROM (SELECT {column}, count(*) AS n FROM samples {where} GROUP BY 1)"


@register(sql(_balance_sql("format", 0.2), "samples"))
def balance(spark, d):
    return quality.balance(samples(spark, d), "format", 0.2)


@register(sql("WITH l AS (SELECT 'format' AS f, format AS v FROM samples UNION ALL SELECT 'signature', signature FROM samples UNION ALL SELECT 'size', CAST(size AS VARCHAR) FROM samples), c AS (SELECT f, v, count(*) AS n FROM l GROUP BY 1, 2), b AS (SELECT f, 1 - greatest(0, max(n) / sum(n) - min(n) / sum(n) - 0.4) AS b FROM c GROUP BY 1) SELECT round(avg(b), 6) AS file_balance FROM b", "samples"))
def file_balance(spark, d):
    return quality.file_balance(samples(spark, d))


@register(sql(_balance_sql("label", 0.1, "WHERE label <> '?'"), "samples"))
def label_balance(spark, d):
    return quality.balance(samples(spark, d), "label", 0.1)


_EARLIER = "(SELECT count(*) FROM s) - (SELECT count(*) FROM c) + (SELECT count(DISTINCT b) FROM pairs)"


def _similarity(spark, d):
    sets, members = similarity.classes(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return quality.similarity_score(table(spark, d, "documents"), members, similarity.with_earlier(sets, "doc_id"), "doc_id")


@register(f"WITH {SHINGLES} SELECT round(1 - ({_EARLIER}) / count(*), 6) AS similarity FROM documents")
def similarity_score(spark, d):
    return _similarity(spark, d)


#: What takes from a sample's portability, and how much.
RULES = {"format = 'ELF32'": 0.25, "size > 5000": 0.125, "label like 'fam%'": 0.5, "signature like '%3 sections'": 0.25}
_PORTABLE = "round(greatest(0, least(1, 1 - (" + " + ".join(f"CASE WHEN {rule} THEN {penalty} ELSE 0 END" for rule, penalty in RULES.items()) + "))), 3)"


@register(sql(f"SELECT round(avg({_PORTABLE}), 6) AS portability FROM samples", "samples"))
def portability(spark, d):
    return quality.portability_score(samples(spark, d), content.portability(RULES))


@register(sql("SELECT round((avg(CAST(size BETWEEN 1024 AND 104857600 AS INTEGER)) + avg(CAST(year(mtime) >= 2000 AS INTEGER))) / 2, 6) AS outliers FROM samples", "samples"))
def outlier_score(spark, d):
    return quality.outlier_score(samples(spark, d))


@register(sql("SELECT round(count(*) / sum(n), 6) AS uniqueness FROM (SELECT hash, count(*) AS n FROM samples GROUP BY 1)", "samples"))
def uniqueness(spark, d):
    return quality.uniqueness(samples(spark, d))


_SCORED = "g AS (SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN format END AS format, CASE WHEN doc_id % 5 <> 0 THEN label END AS label) FROM samples)"


@register(sql(f"""
    WITH {SHINGLES}, {_SCORED}, l AS (SELECT 'format' AS f, format AS v FROM g UNION ALL SELECT 'signature', signature FROM g UNION ALL SELECT 'size', CAST(size AS VARCHAR) FROM g),
    n AS (SELECT f, v, count(*) AS n FROM l GROUP BY 1, 2), b AS (SELECT f, 1 - greatest(0, max(n) / sum(n) - min(n) / sum(n) - 0.4) AS b FROM n GROUP BY 1), lb AS (SELECT label, count(*) AS n FROM g WHERE label <> '?' GROUP BY 1),
    x AS (SELECT (SELECT round(1 - avg({_NULLS}), 6) FROM g) AS completeness,
        (SELECT round((avg(CAST(hash IS NOT NULL AS INTEGER)) + avg(CAST(coalesce(format IN ('PE32', 'PE64', 'ELF64'), false) AS INTEGER)) + avg(CAST(label IS NOT NULL AS INTEGER))) / 3, 6) FROM g) AS consistency,
        (SELECT round((avg(CAST(size BETWEEN 1024 AND 104857600 AS INTEGER)) + avg(CAST(year(mtime) >= 2000 AS INTEGER))) / 2, 6) FROM g) AS outliers,
        (SELECT round(avg({_PORTABLE}), 6) FROM g) AS portability,
        (SELECT round(avg(b), 6) FROM b) AS file_balance,
        (SELECT round(1 - greatest(0, max(n) / sum(n) - min(n) / sum(n) - 0.2), 6) FROM lb) AS label_balance,
        (SELECT round(count(*) / sum(n), 6) FROM (SELECT hash, count(*) AS n FROM g GROUP BY 1)) AS uniqueness,
        (SELECT round(1 - ({_EARLIER}) / count(*), 6) FROM documents) AS similarity)
    SELECT *, round((completeness + consistency + outliers + portability + file_balance + label_balance + uniqueness + similarity) / 8, 6) AS overall FROM x""", "samples"))
def overall_quality(spark, d):
    rows = samples(spark, d).withColumns({"format": F.when(F.col("doc_id") % 7 != 0, F.col("format")), "label": F.when(F.col("doc_id") % 5 != 0, F.col("label"))})
    return quality.overall_scores(written(rows, "scored"), COLUMNS, ["PE32", "PE64", "ELF64"], content.portability(RULES), _similarity(spark, d))


@register(sql("WITH n AS (SELECT count(*) AS n FROM samples) SELECT repair, CAST(floor(round(n * 0.1 * share, 6)) AS BIGINT) AS budget FROM n, (VALUES ('similarity', 0.4), ('portability', 0.1), ('label_balance', 0.15), ('file_balance', 0.2), ('outliers', 0.05), ('completeness', 0.1)) s(repair, share)", "samples"))
def fix_budget(spark, d):
    return quality.budgets(samples(spark, d))


_GAPS_ONE = f"{_GAPS}, one AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS k FROM gaps) WHERE k = 1)"


def gaps_one(spark, d):
    return gaps(spark, d).join(_distinct_samples(spark, d).select("hash", "doc_id"), ["hash", "doc_id"])


@register(sql(f"WITH {_GAPS_ONE} SELECT hash, doc_id FROM one WHERE hash NOT IN (SELECT hash FROM one WHERE {_NULLS} > 0 ORDER BY {_NULLS} DESC, hash LIMIT 40)", "samples"))
def fix_completeness(spark, d):
    return quality.fix_completeness(gaps_one(spark, d), COLUMNS, 40).select("hash", "doc_id")


@register(sql(f"WITH {_GAPS} SELECT hash, doc_id FROM gaps WHERE format IN ('PE32', 'ELF64') AND label IS NOT NULL AND hash IN (SELECT hash FROM samples WHERE doc_id % 10 < 9)", "samples"))
def fix_consistency(spark, d):
    return quality.fix_consistency(gaps(spark, d), samples(spark, d).where("doc_id % 10 < 9"), ["PE32", "ELF64"]).select("hash", "doc_id")


_ONE = "one AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS k FROM samples) WHERE k = 1)"


@register(sql(f"WITH {_ONE}, s AS (SELECT avg(CAST(label <> '-' AS INTEGER)) AS s FROM one WHERE label <> '?') SELECT hash, label FROM one WHERE hash NOT IN (SELECT hash FROM one, s WHERE abs(s - 0.5) > 0.1 AND CASE WHEN s > 0.5 THEN label NOT IN ('-', '?') ELSE label = '-' END ORDER BY hash LIMIT 30)", "samples"))
def fix_label_balance(spark, d):
    return quality.fix_label_balance(_distinct_samples(spark, d), 30).select("hash", "label")


@register(sql(f"""
    WITH {_ONE}, l AS (SELECT hash, 'format' AS f, format AS v FROM one UNION ALL SELECT hash, 'label', label FROM one), c AS (SELECT f, v, count(*) AS n FROM l GROUP BY 1, 2),
    t AS (SELECT f, max(struct_pack(n := n, v := v)).v AS v FROM c GROUP BY 1 HAVING (max(n) - min(n)) / sum(n) > 0.1)
    SELECT hash, format FROM one WHERE hash NOT IN (SELECT DISTINCT hash FROM l JOIN t USING (f, v) ORDER BY hash LIMIT 50)""", "samples"))
def fix_file_balance(spark, d):
    return quality.fix_file_balance(_distinct_samples(spark, d), ("format", "label"), 50).select("hash", "format")


@register(sql(f"WITH {_ONE} SELECT hash, doc_id FROM one WHERE hash NOT IN (SELECT hash FROM one WHERE size % 10 <> 9 ORDER BY size % 10, hash LIMIT 25)", "samples"))
def fix_portability(spark, d):
    rows = _distinct_samples(spark, d).withColumn("portability", F.when(F.col("size") % 10 != 9, F.col("size") % 10))
    return quality.fix_portability(rows, 25).select("hash", "doc_id")


@register(sql(f"WITH {_ONE} SELECT hash, doc_id FROM one WHERE hash NOT IN (SELECT hash FROM one WHERE NOT (size BETWEEN 1024 AND 104857600 AND year(mtime) >= 2000) ORDER BY hash LIMIT 60)", "samples"))
def fix_outliers(spark, d):
    return quality.fix_outliers(_distinct_samples(spark, d), 60).select("hash", "doc_id")


@register(sql(f"WITH {_ONE} SELECT hash, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(hash || '42'), hash) AS k FROM one) WHERE k <= 8", "samples"))
def balance_sampling(spark, d):
    return quality.balanced(_distinct_samples(spark, d), 8).select("hash", "label")


@register(sql("SELECT round(avg(CAST(hash IN (SELECT hash FROM samples WHERE doc_id % 6 = 0) AS INTEGER)), 6) AS altered FROM (SELECT DISTINCT hash FROM samples)", "samples"))
def altered_share(spark, d):
    return quality.altered_share(samples(spark, d), samples(spark, d).where("doc_id % 6 = 0"))


def _changed(spark, d):
    """A table's history: a snapshot before each of five changes, each of which drops some rows; and one more that finds nothing changed. (folder, last table)."""
    rows, folder = samples(spark, d).select("hash", "doc_id", "label"), new_folder(spark, "history")
    rows = written(rows, "table")
    for k in range(2, 7):
        history.take(rows, folder)
        rows = rows.where(F.col("doc_id") % 7 != k)
    history.take(spark.read.parquet(f"{folder}/v4"), folder)
    return folder, rows


@register(sql(" UNION ALL ".join(f"SELECT {k} AS number, count(*) AS n FROM samples WHERE doc_id % 7 NOT BETWEEN 2 AND {k + 1}" for k in (0, 2, 3, 4)), "samples"))
def snapshot(spark, d):
    """The snapshots that are kept, with their rows: the first and the last three of five."""
    folder, _ = _changed(spark, d)
    kept = [spark.read.parquet(f"{folder}/v{n}").agg(F.lit(n).alias("number"), F.count("*").alias("n")) for n in history.numbers(spark, folder)]
    return reduce(lambda a, b: a.unionByName(b), kept)


@register(sql("SELECT 'initial' AS target, hash, doc_id, label FROM samples UNION ALL SELECT 'last', hash, doc_id, label FROM samples WHERE doc_id % 7 NOT BETWEEN 2 AND 5", "samples"))
def revert(spark, d):
    folder, _ = _changed(spark, d)
    back = [history.revert(spark, folder, to).select(F.lit(to).alias("target"), "hash", "doc_id", "label") for to in ("initial", "last")]
    return back[0].unionByName(back[1])


# ---------------------------------------------------------------- votes

ALIASES = {"brand#1": "brand1", "brand#2": "brand2", "brand#23": "brand23", "brand#3": "brand3", "steel": "steel"}


@register("""
    WITH a(p, f) AS (VALUES ('brand#1', 'brand1'), ('brand#2', 'brand2'), ('brand#23', 'brand23'), ('brand#3', 'brand3'), ('steel', 'steel')),
    lines AS (SELECT p_size AS hash, regexp_replace(lower(p_brand || ' ' || p_type), '\\s+', '', 'g') AS line, p_partkey FROM part),
    c AS (SELECT hash, f, count(*) AS n FROM lines JOIN a ON regexp_matches(line, p) GROUP BY 1, 2), t AS (SELECT hash, f FROM (SELECT *, max(n) OVER (PARTITION BY hash) AS m FROM c) WHERE n = m),
    g AS (SELECT hash, (list(f ORDER BY length(f) DESC, f))[1] AS long, list(f) AS fs FROM t GROUP BY 1)
    SELECT h.hash, coalesce(CASE WHEN long IS NULL THEN NULL WHEN len(list_filter(fs, lambda x: NOT contains(long, x))) = 0 THEN long ELSE '?' END, 'unknown') AS label
    FROM (SELECT DISTINCT hash FROM lines) h LEFT JOIN g USING (hash)""")
def normalize_output(spark, d):
    lines = table(spark, d, "part").select(F.col("p_size").alias("hash"), F.concat_ws(" ", "p_brand", "p_type").alias("line"))
    return voting.normalise_output(lines, ALIASES)


#: As many aliases as an automaton takes: every brand, and finishes of every metal.
MANY = {f"brand#{i}(?![0-9])": f"brand{i}" for i in range(1, 100)} | {f"(anodized|burnished|plated|polished|brushed){m}": m for m in ("brass", "copper", "nickel", "steel", "tin")} | {"small": "small", "^brand#5": "fifth"}
_MANY = ", ".join(f"('{p.replace('(?![0-9])', '([^0-9]|$)')}', '{f}')" for p, f in MANY.items())


@register(f"""
    WITH a(p, f) AS (VALUES {_MANY}),
    lines AS (SELECT p_size AS hash, regexp_replace(lower(p_brand || ' ' || p_type), '\\s+', '', 'g') AS line, p_partkey FROM part),
    c AS (SELECT hash, f, count(*) AS n FROM lines JOIN a ON regexp_matches(line, p) GROUP BY 1, 2), t AS (SELECT hash, f FROM (SELECT *, max(n) OVER (PARTITION BY hash) AS m FROM c) WHERE n = m),
    g AS (SELECT hash, (list(f ORDER BY length(f) DESC, f))[1] AS long, list(f) AS fs FROM t GROUP BY 1)
    SELECT h.hash, coalesce(CASE WHEN long IS NULL THEN NULL WHEN len(list_filter(fs, lambda x: NOT contains(long, x))) = 0 THEN long ELSE '?' END, 'unknown') AS label
    FROM (SELECT DISTINCT hash FROM lines) h LEFT JOIN g USING (hash)""")
def normalize_output_many(spark, d):
    lines = table(spark, d, "part").select(F.col("p_size").alias("hash"), F.concat_ws(" ", "p_brand", "p_type").alias("line"))
    return voting.normalise_output(lines, MANY)


@register("SELECT DISTINCT p_partkey AS hash, unnest([p_type, p_brand]) AS detection, regexp_matches(p_type, '^(SMALL|PROMO)') AS weak FROM part")
def extract_detections(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("hash"), F.concat("p_type", F.lit(" ["), "p_type", F.lit(" or "), "p_brand", F.lit("]")).alias("line"))
    return voting.extract_detections(lines, r"\[([^\]]*)\]", "^(SMALL|PROMO)")


@register(sql("SELECT hash, detector_rank, detector, label FROM (SELECT v.*, CASE hash % 2 WHEN 0 THEN 'PE32' ELSE 'ELF32' END AS format FROM votes v) WHERE detector IN ('det0', 'det1') OR (detector = 'det2' AND format = 'PE32')", "votes"))
def applicable_detectors(spark, d):
    votes = views.votes(spark, d).withColumn("format", F.when(F.col("hash") % 2 == 0, "PE32").otherwise("ELF32"))
    rows = [("det0", ["PE32", "ELF32"], True, True), ("det1", ["PE32", "ELF32"], True, True), ("det2", ["PE32"], True, True), ("det3", ["PE32"], False, True), ("det4", ["PE32", "ELF32"], True, False)]
    detectors = spark.createDataFrame(rows, "detector string, formats array<string>, multiclass boolean, vote boolean")
    return voting.applicable(votes, detectors, "format", True).select("hash", "detector_rank", "detector", "label")


_COUNTS = "c AS (SELECT hash, label, count(*) AS n, min(detector_rank) AS first_rank FROM votes GROUP BY 1, 2), t AS (SELECT hash, count(*) AS voters FROM votes GROUP BY 1), k AS (SELECT c.hash, label, CASE WHEN label = 'unknown' THEN n - voters ELSE n END AS n, first_rank, voters FROM c JOIN t USING (hash))"


@register(sql(f"WITH {_COUNTS} SELECT hash, label, n, first_rank FROM k", "votes"))
def vote_counts(spark, d):
    return voting.vote_counts(views.votes(spark, d))


_DECIDED = f"""{_COUNTS}, b AS (SELECT hash, max(n) AS best, any_value(voters) AS voters FROM k GROUP BY 1), top AS (SELECT k.hash, label, first_rank FROM k JOIN b ON k.hash = b.hash AND k.n = b.best),
    g AS (SELECT hash, list(label ORDER BY first_rank) AS fs FROM top GROUP BY 1), l AS (SELECT *, list_filter(fs, lambda x: length(x) = list_max(list_transform(fs, lambda y: length(y))))[1] AS long FROM g),
    decided AS (SELECT b.hash, CASE WHEN best < voters // 2 + 1 THEN '-' WHEN len(fs) = 1 THEN fs[1] WHEN len(list_filter(fs, lambda x: NOT contains(long, x))) = 0 THEN long ELSE '?' END AS label, best FROM b JOIN l USING (hash))"""


@register(sql(f"WITH {_DECIDED} SELECT * FROM decided", "votes"))
def majority_decision(spark, d):
    return voting.decide(views.votes(spark, d))


@register(sql(f"WITH {_DECIDED} SELECT CASE label WHEN '?' THEN -1 WHEN '-' THEN 0 ELSE 1 END AS decision, count(*) AS n FROM decided GROUP BY 1", "votes"))
def binary_decision(spark, d):
    return voting.decide(views.votes(spark, d)).groupBy(voting.binary(F.col("label")).alias("decision")).agg(F.count("*").alias("n"))


_EXPECTED = f"{_DECIDED}, e AS (SELECT hash, label AS decided, CASE hash % 4 WHEN 0 THEN '-' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE '?' END AS expected FROM decided)"


def _expected(spark, d):
    wanted = F.when(F.col("hash") % 4 == 0, "-").when(F.col("hash") % 4 == 1, "view").when(F.col("hash") % 4 == 2, "purchase").otherwise("?")
    return voting.decide(views.votes(spark, d)).select("hash", F.col("label").alias("decided"), wanted.alias("expected"))


_CONFUSION = f"{_EXPECTED}, cm AS (SELECT count(*) FILTER (expected <> '-' AND decided = expected) AS tp, count(*) FILTER (expected = '-' AND decided = '-') AS tn, count(*) FILTER (decided <> '-' AND decided <> expected) AS fp, count(*) FILTER (expected <> '-' AND decided = '-') AS fn FROM e WHERE expected <> '?')"


@register(sql(f"WITH {_CONFUSION} SELECT * FROM cm", "votes"))
def detector_confusion(spark, d):
    return voting.confusion(_expected(spark, d))


@register(sql(f"WITH {_CONFUSION} SELECT *, CASE WHEN tp + tn + fp + fn = 0 THEN -1 ELSE round((tp + tn) / (tp + tn + fp + fn), 6) END AS accuracy, CASE WHEN tp + fp = 0 THEN -1 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN -1 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN -1 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f FROM cm", "votes"))
def detector_metrics(spark, d):
    return voting.metrics(voting.confusion(_expected(spark, d)))


@register(sql(f"WITH {_EXPECTED} SELECT * FROM e WHERE decided <> expected", "votes"))
def failures_only(spark, d):
    return _expected(spark, d).where("decided <> expected")


@register(sql(f"WITH {_DECIDED} SELECT s.doc_id, s.size, v.label FROM samples s JOIN decided v ON s.doc_id = v.hash WHERE v.label <> '?'", "votes", "samples"))
def surrogate_labels(spark, d):
    found = voting.decide(views.votes(spark, d)).where("label <> '?'").select(F.col("hash").alias("doc_id"), "label")
    return samples(spark, d).select("doc_id", "size").join(found, "doc_id")


@register(sql("SELECT hash, 'Is it packed?' || chr(10) || 'quantity of items: ' || printf('%.4f', quantity) || chr(10) || 'part number: ' || CASE WHEN part % 3 = 0 THEN 'N/A' ELSE CAST(part AS VARCHAR) END AS prompt FROM features", "features"))
def prompt_render(spark, d):
    rows = views.features(spark, d).withColumn("part", F.when(F.col("part") % 3 != 0, F.col("part")))
    return voting.render_prompt(rows, {"quantity": "quantity of items", "part": "part number"}, "Is it packed?\n{features}")


@register("SELECT conv_id, turn, CASE WHEN regexp_matches(answer, '\\b(not.packed|unpacked|benign|no)\\b') THEN 0 WHEN regexp_matches(answer, '\\b(packed|malicious|yes)\\b') THEN 1 ELSE -1 END AS answer FROM (SELECT conv_id, turn, lower(CASE conv_id % 4 WHEN 0 THEN text || ' It is NOT packed.' WHEN 1 THEN 'Packed: ' || text ELSE text END) AS answer FROM conversations)")
def response_parse(spark, d):
    """The turns' texts as answers; some are given a verdict before or after what they say."""
    n = F.col("conv_id") % 4
    text = F.when(n == 0, F.concat("text", F.lit(" It is NOT packed."))).when(n == 1, F.concat(F.lit("Packed: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", voting.parse_response(text).alias("answer"))
