"""Queries: scans, sinks, projections, joins, aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions import content
from assaylake.operators import aggregate, joins, project
from assaylake.plans.registry import register
from assaylake.sources import io, views
from assaylake.sources.scratch import new_folder, written
from assaylake.sources.views import samples, sections, sql, table

SAMPLE_SCHEMA = "hash string, realpath string, format string, signature string, size long, mtime date, doc_id long, label string"


def _distinct_samples(spark, d) -> DataFrame:
    """One sample for each hash: the one with the smallest doc_id."""
    w = Window.partitionBy("hash").orderBy("doc_id")
    return samples(spark, d).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_ONE = "one AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS k FROM samples) WHERE k = 1)"


@register()
def scan_files(spark, d):
    """The table files as samples: those of the scope, with their hashes."""
    return io.scan_files(spark, d, "*.parquet", {"parquet": "PE32"}, ["PE"]).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "size", "hash", "format")


@register(sql("SELECT hash, realpath, format, signature, size, CAST(mtime AS VARCHAR) AS mtime, doc_id, label FROM samples", "samples"))
def read_samples(spark, d):
    io.write_samples(samples(spark, d), path := new_folder(spark, "samples-csv"), "csv", sep=";", header=True, dateFormat="yyyy-MM-dd")
    schema = "hash string, realpath string, format string, signature string, size long, mtime date, doc_id long, label string"
    return io.read_samples(spark, path, schema).select("hash", "realpath", "format", "signature", "size", F.col("mtime").cast("string").alias("mtime"), "doc_id", "label")


@register(sql("SELECT hash, format, size, label, row_number() OVER (ORDER BY hash, doc_id) AS place FROM samples", "samples"))
def write_samples(spark, d):
    io.write_samples(samples(spark, d), path := new_folder(spark, "samples"))
    back = spark.read.parquet(path)
    # A running place over a sorted file set: the counts of 256 hash ranges, then the place in each range.
    back = back.withColumn("range", F.substring("hash", 1, 2))
    before = back.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("hash", "doc_id"))
    return back.withColumn("inside", inside).join(before, "range").select("hash", "format", "size", "label", (F.col("before") + F.col("inside")).alias("place"))


_ENTROPY = "e AS (SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS gram FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM blobs)) GROUP BY 1, 2) GROUP BY 1)"


def _featured(spark, d):
    """samples with computed features, without contents."""
    docs = views.blobs(spark, d)
    return samples(spark, d).select("hash", "doc_id", "size", "label").join(content.file_entropy(docs), "doc_id", "left").join(docs.select("doc_id", F.size(content.strings(F.col("content"))).alias("n_strings")), "doc_id", "left")


_FEATURED = f"{_ENTROPY}, t AS (SELECT s.hash, s.doc_id, s.size, s.label, entropy, CAST(len(regexp_extract_all(text, '[ -~]{{5,}}')) AS INTEGER) AS n_strings FROM samples s LEFT JOIN e USING (doc_id) JOIN blobs USING (doc_id))"


@register(sql(f"WITH {_FEATURED} SELECT format, t.* FROM t, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(format)", "samples", "blobs"))
def export_features(spark, d):
    """The featured table written in each format and read back."""
    rows = written(_featured(spark, d), "featured").select("hash", "doc_id", "size", "label", "entropy", "n_strings")
    folder, out = new_folder(spark, "export"), None
    for kind, options in {"csv": {"header": True}, "json": {}, "orc": {}, "parquet": {}}.items():
        rows.write.options(**options).format(kind).save(f"{folder}/{kind}")
        back = spark.read.schema(rows.schema).options(**options).format(kind).load(f"{folder}/{kind}").select(F.lit(kind).alias("format"), *rows.columns)
        out = back if out is None else out.unionByName(back)
    return out


@register(sql("WITH f AS (SELECT label || '_' || doc_id AS file, min(hash) AS hash FROM samples WHERE label NOT IN ('?', '-') GROUP BY 1) SELECT file, hash FROM f ORDER BY md5(hash || '42'), hash, file LIMIT 20", "samples"))
def export_packed_sample(spark, d):
    return project.limited(io.export_names(samples(spark, d)), 20)


@register(sql("SELECT s.hash, s.doc_id, s.size, l.label FROM samples s JOIN (SELECT DISTINCT hash, label FROM samples) l ON s.hash = l.hash", "samples"))
def read_feature_csv(spark, d):
    samples(spark, d).select("hash", "doc_id", "size", "label").write.option("sep", ";").option("header", True).csv(path := new_folder(spark, "features"))
    data = io.read_samples(spark, path, "hash string, doc_id long, size long, label string")
    rest, labels = io.split_label(data)
    return rest.join(labels.distinct(), "hash")


@register(sql("SELECT hash, CASE WHEN label = '?' THEN '-' ELSE label END AS label FROM samples", "samples"))
def read_labels(spark, d):
    pairs = samples(spark, d).select("hash", F.when(F.col("label") == "?", " ").otherwise(F.col("label")).alias("label"))
    pairs.select(F.to_json(F.create_map("hash", "label")).alias("value")).write.text(path := new_folder(spark, "labels"))
    return io.labels_from_json(spark.read.text(path))


@register(sql("SELECT regexp_extract(realpath, '^(.*)/[^/]*$', 1) AS parent, count(*) AS n FROM samples GROUP BY 1 HAVING count(*) BETWEEN 5 AND 100000", "samples"))
def ingest_leaf_groups(spark, d):
    return io.leaf_groups(samples(spark, d), 5, 100_000)


@register("SELECT DISTINCT lower(trim(split_part(p_type || ' # ' || p_name, '#', 1))) AS value FROM part WHERE trim(split_part(p_type, '#', 1)) <> ''")
def load_ref_lists(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws(" # ", "p_type", "p_name").alias("value"))
    return io.ref_list(lines).select(F.lower("value").alias("value")).distinct()


@register(sql("""
    WITH c AS (SELECT format AS dataset, label, count(*) AS c FROM samples GROUP BY 1, 2)
    SELECT dataset, CAST(sum(c) AS BIGINT) AS n, string_agg(label || '{' || c || '}', ',' ORDER BY c DESC, label) AS labels FROM c GROUP BY 1""", "samples"))
def catalog_summary(spark, d):
    return io.catalog(samples(spark, d), "format").withColumnRenamed("format", "dataset")


@register(sql(f"WITH {_FEATURED} SELECT doc_id, hash, label, entropy, n_strings, round(sum(octet_length(encode(coalesce(hash, '') || coalesce(label, '')))) OVER () / sum(size) OVER (), 6) AS ratio FROM t", "samples", "blobs"))
def convert_fileless(spark, d):
    """The featured table materialised without contents, with the ratio of its bytes of text to those of the contents."""
    rows = written(_featured(spark, d), "fileless")
    ratio = rows.agg(F.round(F.sum(F.octet_length(F.concat(F.coalesce("hash", F.lit("")), F.coalesce("label", F.lit(""))))) / F.sum("size"), 6).alias("ratio"))
    return rows.select("doc_id", "hash", "label", "entropy", "n_strings").join(F.broadcast(ratio))  # one row


# ---------------------------------------------------------------- projections and filters


@register(sql("SELECT hash, size, label FROM samples WHERE label = 'fam1' AND size > 1000 OR format IN ('PE64', 'ELF32')", "samples"))
def filter_query(spark, d):
    return project.filter_query(samples(spark, d), 'label == "fam1" and size > 1000 or format in ["PE64", "ELF32"]').select("hash", "size", "label")


@register(sql("SELECT hash, realpath, format, size, CAST(mtime AS VARCHAR) AS mtime, doc_id, label FROM samples", "samples"))
def project_features(spark, d):
    return project.project_features(samples(spark, d), ["doc_id"]).withColumn("mtime", F.col("mtime").cast("string"))


@register("SELECT l_extendedprice, l_linenumber, l_linestatus, l_returnflag, l_suppkey FROM lineitem")
def wildcard_features(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(*project.wildcard_features(lines.columns, ["l_line*", "*flag", "l_ext*", "l_s*key"]))


@register(sql("SELECT hash, doc_id, label FROM samples WHERE label <> '?' ORDER BY md5(hash || '42'), hash, doc_id LIMIT 50", "samples"))
def filter_sample_limit(spark, d):
    rows = _distinct_or_all(samples(spark, d).where("label <> '?'"))
    return rows.orderBy(F.md5(F.concat("hash", F.lit("42"))), "hash", "doc_id").limit(50).select("hash", "doc_id", "label")


def _distinct_or_all(df):
    return project.filter_query(df, "all")


@register(sql("SELECT hash, CASE WHEN starts_with(realpath, '/src0/') THEN '[0]' || substr(realpath, 6) WHEN starts_with(realpath, '/src1/') THEN '[1]' || substr(realpath, 6) ELSE '-1' END AS path, size, strftime(mtime, '%d/%m/%y') AS mtime, label FROM samples WHERE format = 'PE64'", "samples"))
def view_samples(spark, d):
    return samples(spark, d).where("format = 'PE64'").select("hash", project.path_to_source(F.col("realpath"), ["/src0", "/src1"]).alias("path"), "size", F.date_format("mtime", "dd/MM/yy").alias("mtime"), "label")


_FORMAT_SQL = "formats(leaf, grp) AS (VALUES ('ELF32','ELF'),('ELF64','ELF'),('Mach-O32','Mach-O'),('Mach-O64','Mach-O'),('Mach-Ou','Mach-O'),('.NET','PE'),('MSDOS','PE'),('PE32','PE'),('PE64','PE'))"


@register(sql(f"WITH {_FORMAT_SQL} SELECT DISTINCT leaf FROM formats JOIN (SELECT DISTINCT CASE WHEN format LIKE 'ELF%' THEN 'ELF' ELSE format END AS format FROM samples) s ON s.format IN (leaf, grp)", "samples"))
def expand_formats(spark, d):
    asked = samples(spark, d).select(F.when(F.col("format").like("ELF%"), "ELF").otherwise(F.col("format")).alias("format")).distinct()
    return project.expand_formats(asked, spark)


@register(sql(f"WITH {_FORMAT_SQL}, own AS (SELECT DISTINCT leaf, grp FROM formats JOIN samples ON format = leaf), n AS (SELECT grp, count(*) AS n FROM own GROUP BY 1), t AS (SELECT grp, count(*) AS t FROM formats GROUP BY 1) SELECT DISTINCT CASE WHEN n = t THEN own.grp ELSE leaf END AS format FROM own JOIN n USING (grp) JOIN t USING (grp)", "samples"))
def collapse_formats(spark, d):
    return project.collapse_formats(samples(spark, d).select(F.col("format").alias("leaf")), spark)


@register(sql(f"WITH {_FORMAT_SQL} SELECT DISTINCT leaf FROM formats WHERE grp IN (SELECT grp FROM formats JOIN samples ON format = leaf)", "samples"))
def aggregate_formats(spark, d):
    groups = samples(spark, d).select(project.format_group(F.col("format")).alias("format")).distinct()
    return project.expand_formats(groups, spark)


@register(sql("SELECT CASE WHEN format LIKE 'ELF%' THEN 'ELF' ELSE 'PE' END AS grp, count(*) AS n FROM samples GROUP BY 1", "samples"))
def format_group(spark, d):
    return samples(spark, d).groupBy(project.format_group(F.col("format")).alias("grp")).agg(F.count("*").alias("n"))


@register(sql("SELECT doc_id, signature, format AS detected FROM samples", "samples"))
def classify_signature(spark, d):
    return samples(spark, d).select("doc_id", "signature", project.classify_signature(F.col("signature")).alias("detected"))


@register(sql("SELECT doc_id, CASE WHEN starts_with(realpath, '/src1/') THEN '[0]' || substr(realpath, 6) WHEN starts_with(realpath, '/src12/') THEN '[1]' || substr(realpath, 7) ELSE '-1' END AS path FROM samples", "samples"))
def path_to_source(spark, d):
    return samples(spark, d).select("doc_id", project.path_to_source(F.col("realpath"), ["/src1", "/src12"]).alias("path"))


@register(sql("SELECT regexp_replace(signature, ', [0-9]+ sections?$', '') AS signature, count(*) AS n FROM samples GROUP BY 1", "samples"))
def clean_signature(spark, d):
    return samples(spark, d).groupBy(project.clean_signature(F.col("signature")).alias("signature")).agg(F.count("*").alias("n"))


@register(sql("SELECT doc_id, CASE label WHEN '?' THEN -1 WHEN '-' THEN 0 ELSE 1 END AS num FROM samples", "samples"))
def label_to_num(spark, d):
    return samples(spark, d).select("doc_id", project.label_to_num(F.col("label")).alias("num"))


@register(sql("SELECT doc_id, CASE label WHEN '?' THEN 'not labelled' WHEN '-' THEN 'not packed' ELSE label END AS label FROM samples", "samples"))
def readable_label(spark, d):
    return samples(spark, d).select("doc_id", project.readable_label(F.col("label")).alias("label"))


@register("SELECT p_partkey, p_brand || '-v' || (p_size % 10) || '.' || p_size AS label, p_brand AS family FROM part")
def strip_version(spark, d):
    label = F.concat("p_brand", F.lit("-v"), (F.col("p_size") % 10).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), project.strip_version(label).alias("family"))


@register("SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def slugify_name(spark, d):
    return table(spark, d, "part").select("p_partkey", project.slug(F.col("p_type")).alias("slug"))


_SIZE_SQL = "CASE WHEN size < 20480 THEN '<20kB' WHEN size < 51200 THEN '20-50kB' WHEN size < 102400 THEN '50-100kB' WHEN size < 512000 THEN '100-500kB' WHEN size < 1048576 THEN '500kB-1MB' ELSE '>1MB' END"


@register(sql(f"SELECT {_SIZE_SQL} AS class, count(*) AS n FROM samples GROUP BY 1", "samples"))
def size_class(spark, d):
    return samples(spark, d).groupBy(project.size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"))


@register(sql("SELECT doc_id, CASE label WHEN '?' THEN -1 WHEN 'fam1' THEN 1 ELSE 0 END AS target FROM samples", "samples"))
def true_class_target(spark, d):
    return samples(spark, d).select("doc_id", project.true_class_target(F.col("label"), "fam1").alias("target"))


@register("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), 0) AS num FROM events")
def numeric_coerce(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", project.numeric_coerce(text).alias("num"))


@register("SELECT event_id, coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, -1) AS value, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '?') AS label FROM events")
def ml_fillna(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("label"))
    return project.ml_view(rows, ["value"])


@register(sql("SELECT doc_id, signature FROM samples WHERE signature LIKE '%(GUI)%'", "samples"))
def file_kind_filter(spark, d):
    return project.file_kind(samples(spark, d), "gui").select("doc_id", "signature")


@register("""
    WITH own AS (SELECT source AS label, source || '_' || (doc_id // 20) AS name, source || '_' AS prefix FROM documents WHERE source IN ('src0', 'src1', 'src2') AND doc_id % 13 <> 0)
    SELECT substr(name, length(prefix) + 1) AS stem, count(DISTINCT label) AS n FROM own GROUP BY 1 HAVING count(DISTINCT label) >= 2""")
def variant_match(spark, d):
    names = table(spark, d, "documents").where("source in ('src0', 'src1', 'src2') and doc_id % 13 <> 0")
    names = names.select(F.col("source").alias("label"), F.concat("source", F.lit("_"), F.floor(F.col("doc_id") / 20).cast("string")).alias("name"))
    return project.variants(names, ["src0", "src1", "src2"], missing=1)


# ---------------------------------------------------------------- joins and upserts


@register(sql("SELECT doc_id, hash FROM samples WHERE hash IN (SELECT hash FROM samples WHERE label = 'fam1')", "samples"))
def contains_samples(spark, d):
    rows = samples(spark, d)
    return joins.contains(rows, rows.where("label = 'fam1'")).select("doc_id", "hash")


@register(sql("SELECT doc_id, hash FROM samples WHERE NOT coalesce(size > 2000, false) AND hash NOT IN (SELECT hash FROM samples WHERE label = 'fam1')", "samples"))
def remove_samples(spark, d):
    rows = samples(spark, d)
    return joins.remove(rows, "size > 2000", rows.where("label = 'fam1'")).select("doc_id", "hash")


@register(sql(f"""
    WITH {_ONE}, o AS (SELECT hash, size, CASE WHEN doc_id % 3 <> 0 THEN label END AS label FROM one WHERE doc_id % 2 = 0), n AS (SELECT hash, size + 1 AS size, 'new' AS label FROM one WHERE doc_id % 5 < 3)
    SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN o.hash IS NULL OR (n.hash IS NOT NULL AND o.label IS NULL) THEN n.size ELSE o.size END AS size,
           CASE WHEN o.hash IS NULL OR (n.hash IS NOT NULL AND o.label IS NULL) THEN n.label ELSE o.label END AS label FROM o FULL JOIN n ON o.hash = n.hash""", "samples"))
def upsert_samples(spark, d):
    one = _distinct_samples(spark, d)
    old = one.where("doc_id % 2 = 0").select("hash", "size", F.when(F.col("doc_id") % 3 != 0, F.col("label")).alias("label"))
    new = one.where("doc_id % 5 < 3").select("hash", (F.col("size") + 1).alias("size"), F.lit("new").alias("label"))
    return joins.upsert(old, new)


@register(sql("""
    WITH u AS (SELECT hash, doc_id, CASE WHEN doc_id % 4 <> 0 THEN label END AS label, 0 AS s FROM samples WHERE doc_id % 3 < 2 UNION ALL SELECT hash, doc_id, label, 1 FROM samples WHERE doc_id % 3 > 0)
    SELECT hash, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY label IS NULL, s, doc_id) AS k FROM u) WHERE k = 1""", "samples"))
def merge_datasets(spark, d):
    rows = samples(spark, d).select("hash", "doc_id", "label")
    first = rows.where("doc_id % 3 < 2").withColumn("label", F.when(F.col("doc_id") % 4 != 0, F.col("label")))
    return joins.merge(first, rows.where("doc_id % 3 > 0"))


@register(sql(f"""
    WITH {_ONE} SELECT hash, coalesce(CASE WHEN doc_id % 11 = 0 THEN 'given' END, nullif(label, '?'), CASE WHEN doc_id % 3 = 0 THEN 'found' END, '?') AS label FROM one""", "samples"))
def apply_labels(spark, d):
    one = _distinct_samples(spark, d)
    given, found = one.where("doc_id % 11 = 0").select("hash", F.lit("given").alias("label")), one.where("doc_id % 3 = 0").select("hash", F.lit("found").alias("label"))
    return joins.apply_labels(one.select("hash", "label"), given, found)


@register(sql("SELECT (SELECT count(*) FROM (SELECT hash, label FROM samples EXCEPT ALL SELECT hash, label FROM samples WHERE doc_id % 9 <> 0)) AS only_left, (SELECT count(*) FROM (SELECT hash, label FROM samples WHERE doc_id % 9 <> 0 EXCEPT ALL SELECT hash, label FROM samples)) AS only_right", "samples"))
def dataset_equal(spark, d):
    rows = samples(spark, d)
    return joins.differing(rows.select("hash", "label"), rows.where("doc_id % 9 <> 0").select("hash", "label"))


@register(sql("SELECT if(label = 'fam1', 'in', 'out') AS part, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, array_to_string(list_sort(list(DISTINCT regexp_extract(realpath, '^/([^/]+)/', 1))), ',') AS sources FROM samples GROUP BY 1", "samples"))
def select_split(spark, d):
    a, b = joins.split(samples(spark, d), "label = 'fam1'")
    both = a.withColumn("part", F.lit("in")).unionByName(b.withColumn("part", F.lit("out")))
    source = F.regexp_extract("realpath", "^/([^/]+)/", 1)
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


@register(sql("SELECT hash, count(*) FILTER (name IN ('.text', '.data', '.rsrc')) AS n_standard, count(*) FILTER (name = '.upx') AS n_packer, count(*) FILTER (name = '.odd') AS n_unknown FROM sections GROUP BY 1", "sections"))
def ref_membership(spark, d):
    return joins.section_lists(sections(spark, d), [".text", ".data", ".rsrc"], [".upx"])


@register("WITH u AS (SELECT user_id AS hash, list(DISTINCT event_type) AS used FROM events GROUP BY 1) SELECT hash, len(list_intersect(used, ['click', 'signup', 'view'])) AS n_common, len(list_intersect(used, ['error', 'purchase'])) AS n_malicious, array_to_string(list_sort(list_filter(used, lambda x: x NOT IN ('click', 'signup', 'view', 'error', 'purchase'))), ',') AS unknown FROM u")
def ref_api_membership(spark, d):
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("hash")).agg(F.collect_set("event_type").alias("used"))
    return joins.api_lists(used, "used", {"common": ["click", "signup", "view"], "malicious": ["error", "purchase"]})


_PAIRED = "m AS (SELECT dataset, part, avg(quantity) AS quantity, avg(price) AS price FROM features GROUP BY 1, 2), df AS (SELECT m.part, m.quantity - r.quantity AS quantity, m.price - r.price AS price FROM m JOIN m r ON m.part = r.part WHERE m.dataset = 'F' AND r.dataset = 'O')"


def paired(spark, d):
    means = views.features(spark, d).groupBy("dataset", "part").agg(F.avg("quantity").alias("quantity"), F.avg("price").alias("price"))
    return means.where("dataset = 'F'"), means.where("dataset = 'O'")


@register(sql(f"WITH {_PAIRED} SELECT part, round(quantity, 6) AS quantity, round(price, 6) AS price FROM df", "features"))
def ref_dataset_diff(spark, d):
    a, b = paired(spark, d)
    return joins.diff_from(a, b, "part", ["quantity", "price"])


@register(sql("SELECT e.event_id, s.label FROM events e LEFT JOIN samples s ON e.user_id = s.doc_id", "samples"))
def label_lookup(spark, d):
    known = samples(spark, d).select(F.col("doc_id").alias("user_id"), "label")
    return table(spark, d, "events").select("event_id", "user_id").join(known, "user_id", "left").select("event_id", "label")


@register("SELECT depth, impurity, r_name AS region FROM (VALUES (2), (4), (6)) a(depth), (VALUES ('gini'), ('entropy')) b(impurity), region")
def param_grid(spark, d):
    base = joins.grid(spark, depth=[2, 4, 6], impurity=["gini", "entropy"])
    return base.crossJoin(table(spark, d, "region").select(F.col("r_name").alias("region")))


@register(sql("SELECT * FROM (SELECT hash, addr, size, lead(addr) OVER w AS next_addr, lead(size) OVER w AS next_size FROM blocks WINDOW w AS (PARTITION BY hash ORDER BY addr, size)) WHERE next_addr < addr + size", "blocks"))
def interval_overlap(spark, d):
    return joins.overlaps(views.blocks(spark, d))


# ---------------------------------------------------------------- aggregations


@register(sql("SELECT label, count(*) AS n FROM samples WHERE label <> '?' GROUP BY 1", "samples"))
def label_counts(spark, d):
    return aggregate.label_counts(samples(spark, d))


@register(sql(f"""
    WITH k AS (SELECT {_SIZE_SQL} AS class, label FROM samples), c AS (
        SELECT coalesce(class, 'Total') AS class, count(*) FILTER (label = '?') AS unlabelled, count(*) FILTER (label = '-') AS clean, count(*) FILTER (label NOT IN ('?', '-')) AS packed, count(*) AS n FROM k GROUP BY ROLLUP (class)),
    t AS (SELECT * FROM c WHERE class = 'Total')
    SELECT c.*, round(100 * c.unlabelled / CASE WHEN c.class = 'Total' THEN t.n ELSE nullif(t.unlabelled, 0) END, 6) AS unlabelled_pct, round(100 * c.clean / CASE WHEN c.class = 'Total' THEN t.n ELSE nullif(t.clean, 0) END, 6) AS clean_pct,
           round(100 * c.packed / CASE WHEN c.class = 'Total' THEN t.n ELSE nullif(t.packed, 0) END, 6) AS packed_pct FROM c, t""", "samples"))
def size_overview(spark, d):
    return aggregate.size_overview(samples(spark, d))


@register(sql("SELECT round(100 * avg(CAST(label <> '?' AS INTEGER)), 6) AS labelled_pct FROM samples", "samples"))
def labelling_rate(spark, d):
    return aggregate.labelling_rate(samples(spark, d))


@register(sql("SELECT label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM votes GROUP BY 1", "votes"))
def decision_stats(spark, d):
    return aggregate.decision_stats(views.votes(spark, d))


@register(sql("""
    WITH c AS (SELECT format, size % 4 AS low, count(*) FILTER (label = '?') AS unlabelled, count(*) FILTER (label = '-') AS clean, count(*) FILTER (label NOT IN ('?', '-')) AS packed, count(*) AS total FROM samples GROUP BY 1, 2)
    SELECT *, round(100 * total / sum(total) OVER (), 6) AS pct FROM c ORDER BY total DESC, format, low LIMIT 10""", "samples"))
def feature_value_counts(spark, d):
    return aggregate.value_counts(samples(spark, d).withColumn("low", F.col("size") % 4), ["format", "low"], 10)


@register(sql("""
    WITH w AS (SELECT max(quantity) - min(quantity) AS q, max(price) - min(price) AS p FROM features)
    SELECT 'quantity' AS a, 'quantity' AS b, round(covar_pop(quantity, quantity) / (any_value(q) * any_value(q)), 6) AS cov FROM features, w UNION ALL
    SELECT 'quantity', 'price', round(covar_pop(quantity, price) / (any_value(q) * any_value(p)), 6) FROM features, w UNION ALL
    SELECT 'price', 'price', round(covar_pop(price, price) / (any_value(p) * any_value(p)), 6) FROM features, w""", "features"))
def feature_covariance(spark, d):
    return aggregate.scaled_covariance(views.features(spark, d), ["quantity", "price"])


@register(sql("SELECT hash, CASE y WHEN 1 THEN 'true' ELSE 'false' END AS is_r, '0x' || lpad(lower(hex(CAST(quantity AS BIGINT))), 2, '0') AS byte_q, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity FROM features WHERE quantity = floor(quantity)", "features"))
def value_display_cast(spark, d):
    rows = views.features(spark, d).where("quantity = floor(quantity)")
    return rows.select("hash", aggregate.display(F.col("y"), "is_r").alias("is_r"), aggregate.display(F.col("quantity"), "byte_q").alias("byte_q"), aggregate.display(F.col("quantity"), "quantity").alias("quantity"))


@register(sql("SELECT count(*) AS n, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT format AS f FROM samples)) AS formats, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT label AS f FROM samples WHERE label NOT IN ('?', '-'))), '') AS families, CAST(sum(size) AS BIGINT) AS size, round(100 * avg(CAST(label <> '?' AS INTEGER)), 6) AS labelled_pct FROM samples", "samples"))
def dataset_header(spark, d):
    return aggregate.header(samples(spark, d))


@register(sql("WITH c AS (SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT label, 1 AS n FROM samples WHERE label NOT IN ('-') UNION ALL VALUES ('?', 0), ('-', 0)) GROUP BY 1) SELECT label, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM c", "samples"))
def label_share(spark, d):
    return aggregate.label_share(samples(spark, d).where("label <> '-'"))


@register(sql("WITH l AS (SELECT 'x' AS attr, CAST(x AS VARCHAR) AS value FROM sections UNION ALL SELECT 'w', CAST(w AS VARCHAR) FROM sections), c AS (SELECT attr, value, count(*) AS n FROM l GROUP BY 1, 2) SELECT attr, value, n FROM (SELECT *, sum(n) OVER (PARTITION BY attr) AS a FROM c) WHERE n >= 0.5 * a", "sections"))
def majority_default(spark, d):
    return aggregate.majority_defaults(sections(spark, d), ["x", "w"], 0.5)


@register(sql("SELECT hash, label, tax FROM (SELECT *, row_number() OVER (PARTITION BY label, part, round(discount, 1), round(tax, 1) ORDER BY hash) AS k FROM features) WHERE k = 1", "features"))
def dedup_rows(spark, d):
    return aggregate.dedup_rounded(views.features(spark, d), ["label", "part"], ["discount", "tax"], "hash", 1).select("hash", "label", "tax")


@register(sql("SELECT hash, quantity FROM features WHERE quantity > 45", "features"))
def top_entropy(spark, d):
    return aggregate.top_over(views.features(spark, d).select("hash", "quantity"), "quantity", 45)


@register(sql("WITH c AS (SELECT hash, size, count(*) AS c FROM blocks GROUP BY 1, 2) SELECT hash, string_agg(size || ':' || c, ',' ORDER BY c DESC, size DESC) AS histogram FROM c GROUP BY 1", "blocks"))
def sorted_histogram(spark, d):
    return aggregate.sorted_histogram(views.blocks(spark, d), "size")


@register("SELECT doc_id, hex(encode(text))[1:2] AS b1, hex(encode(text))[3:4] AS b2, hex(encode(text))[5:6] AS b3, hex(encode(text))[7:8] AS b4 FROM documents")
def sorted_by_bytes(spark, d):
    rows = views.blobs(spark, d)
    out = rows.select("doc_id", *(F.hex(F.substring("content", i, 1)).alias(f"b{i}") for i in range(1, 5)))
    return out.orderBy("b1", "b2", "b3", "b4", "doc_id")


@register(sql("WITH m AS (SELECT dataset || label AS run, 'quantity' AS feature, avg(quantity) / 50 AS impact FROM features GROUP BY 1 UNION ALL SELECT dataset || label, 'discount', avg(discount) * 10 FROM features GROUP BY 1 UNION ALL SELECT dataset || label, 'tax', avg(tax) * 12.5 FROM features GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY impact DESC, feature) AS rank FROM m) SELECT feature, round(avg(rank), 6) AS mean_rank, round(stddev_samp(rank), 6) AS std_rank, CAST(min(rank) AS INTEGER) AS min_rank, CAST(max(rank) AS INTEGER) AS max_rank FROM r GROUP BY 1", "features"))
def rank_stability(spark, d):
    runs = views.features(spark, d).groupBy(F.concat("dataset", "label").alias("run")).agg((F.avg("quantity") / 50).alias("quantity"), (F.avg("discount") * 10).alias("discount"), (F.avg("tax") * 12.5).alias("tax"))
    long = runs.select("run", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in ("quantity", "discount", "tax")))).alias("p")).select("run", "p.*")
    return aggregate.rank_stability(long, "feature", "run", "impact")


_MODELS = "m AS (SELECT label AS model, dataset, round(avg(quantity), 3) AS accuracy, round(avg(discount), 6) AS recall FROM features GROUP BY 1, 2)"


def _models(spark, d):
    return views.features(spark, d).groupBy(F.col("label").alias("model"), "dataset").agg(F.round(F.avg("quantity"), 3).alias("accuracy"), F.round(F.avg("discount"), 6).alias("recall"))


@register(sql(f"WITH {_MODELS} SELECT *, accuracy = max(accuracy) OVER () AS best_accuracy, recall = max(recall) OVER () AS best_recall FROM m", "features"))
def best_per_column(spark, d):
    return aggregate.mark_best(_models(spark, d), ["accuracy", "recall"])


@register(sql(f"WITH {_MODELS} SELECT *, accuracy = max(accuracy) OVER (PARTITION BY dataset) AS best_accuracy FROM m WHERE dataset = 'O'", "features"))
def compare_models(spark, d):
    logs = _models(spark, d)
    union = logs.where("model < 'N'").unionByName(logs.where("model >= 'N'"), allowMissingColumns=True)
    return aggregate.mark_best(union.where("dataset = 'O'"), ["accuracy"], ["dataset"]).orderBy("model", "dataset")
