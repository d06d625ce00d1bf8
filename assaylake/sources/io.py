"""Sources and sinks of sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators.project import FORMATS
from assaylake.sources import ranges

METADATA = ("realpath", "format", "signature", "size", "ctime", "mtime")


#: Bytes of a file that Spark reads as one row, and that a row can hold, for stores that only Spark reads.
LARGEST, ROW = 1 << 27, (1 << 31) - 1024


def scan_files(spark: SparkSession, folder: str, glob: str = "*", formats: dict[str, str] | None = None, scope: list[str] | None = None, hashed: bool = True, limit: int = 0, seed: int = 42) -> DataFrame:
    """(path, size, modified, hash, format) of the files below folder.

    formats maps file extensions to formats ('?' for others). scope: formats, groups of formats or 'All'; only files of those stay. hashed=False leaves hash
    null and reads no contents, as does a query that does not use it, but for files over LARGEST. limit: so many files in an order drawn by seed, 0 for all.
    Files over LARGEST are read by ranges, each in a task of its own, see ranges.digests(); in a store that pyarrow does not open, only those over ROW.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind: Column = F.lit("?") if not formats else F.coalesce(F.create_map(*(F.lit(x) for kv in formats.items() for x in kv))[ext], F.lit("?"))
    listed = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if hashed:
        one = files.where(F.col("length") > LARGEST).agg(F.min("path")).head()[0]
        most = LARGEST if one is None or ranges.reachable(one) else max(LARGEST, ROW)
        rows = files.where(F.col("length") <= most).select(*listed, F.sha2("content", 256).alias("hash"))
        if one is not None:
            rows = rows.unionByName(ranges.digests(files.where(F.col("length") > most).select(*listed)))
    else:
        rows = files.select(*listed, F.lit(None).cast("string").alias("hash"))
    rows = rows.withColumn("format", kind)
    if scope is not None and "All" not in scope:
        rows = rows.where(F.col("format").isin([leaf for name in scope for leaf in FORMATS.get(name, [name])]))
    return rows if limit <= 0 else rows.orderBy(F.md5(F.concat("path", F.lit(str(seed)))), "path").limit(limit)


def ordered_columns(columns: list[str]) -> list[str]:
    """hash, metadata, features by name, label."""
    features = sorted(c for c in columns if c not in (*METADATA, "hash", "label"))
    return [c for c in ("hash", *METADATA) if c in columns] + features + [c for c in ("label",) if c in columns]


def write_samples(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Writes a sample table sorted by hash, columns in order; range partitions keep files apart by hash."""
    df.select(*ordered_columns(df.columns)).repartitionByRange("hash").sortWithinPartitions("hash").write.options(**options).format(fmt).save(path)


def read_samples(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """A sample table from CSV with header; an empty field is null."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def append_log(rows: DataFrame, folder: str) -> DataFrame:
    """Appends rows to the table in folder, and the table as it then is. Columns that earlier rows, or these, do not have are null in them."""
    rows.coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.read.option("mergeSchema", True).parquet(folder)


def split_label(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data without label, hash and label)."""
    return df.drop("label"), df.select("hash", "label")


def labels_from_pairs(df: DataFrame) -> DataFrame:
    """(hash, label) with the empty label as '-' and white space cut."""
    return df.select("hash", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("-")).alias("label"))


def labels_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """(hash, label) from rows that each hold a JSON object {hash: label}."""
    return labels_from_pairs(df.select(F.explode(F.from_json(column, "map<string,string>")).alias("hash", "label")))


def export_names(df: DataFrame) -> DataFrame:
    """(file, hash) of labelled samples: label_filename, the first by hash for each name."""
    named = df.where(~F.col("label").isin("?", "-")).select(F.concat_ws("_", "label", F.element_at(F.split("realpath", "/"), -1)).alias("file"), "hash")
    return named.groupBy("file").agg(F.min("hash").alias("hash"))


def leaf_groups(df: DataFrame, least: int, most: int) -> DataFrame:
    """(parent, n) of the leaf folders of realpath with at least `least` samples, and at most `most` where most > least."""
    parents = df.groupBy(F.regexp_extract("realpath", "^(.*)/[^/]*$", 1).alias("parent")).agg(F.count("*").alias("n"))
    up = parents.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/")) - 1), lambda i: F.array_join(F.slice(F.split("parent", "/"), 1, i), "/"))).alias("parent")).distinct()
    fits = F.col("n").between(least, most) if most > least else F.col("n") >= least
    return parents.join(up, "parent", "left_anti").where(fits)


def ref_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct entries of a list file: comments from # on cut, white space trimmed, empty ones dropped."""
    return lines.select(F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1))).alias("value")).where("value <> ''").distinct()


def catalog(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, n, labels): labels as label{count}, the most frequent first."""
    counts = df.groupBy(dataset, "label").agg(F.count("*").alias("c"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "label")))
    text = F.array_join(F.transform(listed, lambda s: F.concat(s["label"], F.lit("{"), (-s["k"]).cast("string"), F.lit("}"))), ",")
    return counts.groupBy(dataset).agg(F.sum("c").alias("n"), text.alias("labels"))
