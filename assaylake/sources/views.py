"""The sample corpus as views of the test tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FORMATS = {"en": "PE32", "de": "PE64", "fr": "ELF64"}
_SIGNATURES = {"en": "PE32 executable (console) Intel 80386, for MS Windows", "de": "PE32+ executable (GUI) x86-64, for MS Windows", "fr": "ELF 64-bit LSB executable, x86-64"}


def _case(column, table: dict[str, str], other: str):
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(other)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, doc_id, realpath, format, signature, size, mtime, label): a document as a sample; labels ? (none), - (clean), fam0, fam1."""
    docs = table(spark, sf_dir, "documents").alias("d")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    label = F.when(F.col("l_id").isNull(), "?").when(F.col("toxic") == 0, "-").otherwise(F.concat(F.lit("fam"), F.col("quality").cast("string")))
    signature = F.concat(_case(F.col("lang"), _SIGNATURES, "ELF 32-bit LSB executable, Intel 80386"), F.lit(", "), (F.col("doc_id") % 7).cast("string"), F.lit(" sections"))
    return docs.join(labels, F.col("doc_id") == F.col("l_id"), "left").select(
        F.md5(F.col("text").cast("binary")).alias("hash"),
        "doc_id",
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("realpath"),
        _case(F.col("lang"), _FORMATS, "ELF32").alias("format"),
        signature.alias("signature"),
        F.octet_length("text").cast("long").alias("size"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") * 37 % 12000).cast("int")).alias("mtime"),
        label.alias("label"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "-").when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("hash"), F.col("event_id").alias("detector_rank"), F.concat(F.lit("det"), (F.col("event_id") % 5).cast("string")).alias("detector"), label.alias("label"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hash"),
        F.row_number().over(order).cast("long").alias("idx"),
        F.concat(F.lit("."), _case(F.col("l_partkey") % 5, {0: "text", 1: "data", 2: "rsrc", 3: "upx"}, "odd")).alias("name"),
        F.floor("l_quantity").cast("long").alias("raw_size"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("virtual_size"),
        (F.col("l_returnflag") == "R").alias("w"),
        (F.col("l_linestatus") == "O").alias("x"),
        F.col("l_tax").alias("entropy"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("addr"), (F.col("o_orderkey") % 60 + 30).alias("size"), F.col("o_orderpriority").alias("mnemonic"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("hash"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


#: Numeric columns of the feature table, and its classes.
FEATURES = ("quantity", "price", "discount", "tax")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, quantity, price, discount, tax, label, dataset, y): lines as feature rows; label by return flag, y 1 for R."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hash"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("dataset"),
        F.col("l_partkey").alias("part"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def _sql_case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


SQL = {
    "samples": f"""SELECT md5(d.text) AS hash, d.doc_id, '/' || d.source || '/' || d.doc_id AS realpath, {_sql_case("d.lang", _FORMATS, "ELF32")} AS format,
        {_sql_case("d.lang", _SIGNATURES, "ELF 32-bit LSB executable, Intel 80386")} || ', ' || (d.doc_id % 7) || ' sections' AS signature,
        CAST(strlen(d.text) AS BIGINT) AS size, CAST(DATE '1995-01-01' + CAST(d.doc_id * 37 % 12000 AS INTEGER) AS DATE) AS mtime,
        CASE WHEN l.doc_id IS NULL THEN '?' WHEN l.toxic = 0 THEN '-' ELSE 'fam' || l.quality END AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "blobs": "SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, text FROM documents",
    "votes": "SELECT user_id AS hash, event_id AS detector_rank, 'det' || (event_id % 5) AS detector, CASE event_type WHEN 'click' THEN '-' WHEN 'error' THEN 'unknown' ELSE event_type END AS label FROM events",
    "sections": f"""SELECT l_orderkey AS hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx,
        '.' || {_sql_case("l_partkey % 5", {0: "text", 1: "data", 2: "rsrc", 3: "upx"}, "odd")} AS name,
        CAST(floor(l_quantity) AS BIGINT) AS raw_size, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS virtual_size, l_returnflag = 'R' AS w, l_linestatus = 'O' AS x, l_tax AS entropy FROM lineitem""",
    "blocks": "SELECT o_custkey AS hash, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS addr, o_orderkey % 60 + 30 AS size, o_orderpriority AS mnemonic FROM orders",
    "preds": "SELECT doc_id AS hash, quality AS y_true, toxic AS y_pred FROM labels",
    "features": """SELECT l_orderkey * 10 + l_linenumber AS hash, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount,
        CAST(l_tax AS DOUBLE) AS tax, l_returnflag AS label, l_linestatus AS dataset, l_partkey AS part, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem""",
}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    """query with the named views before it."""
    body = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    rest = query.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {body}, {rest[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{body} {rest}"
