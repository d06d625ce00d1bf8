"""Projections, filters and predicates over sample tables."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The format groups, and file-type patterns of each leaf format.
FORMATS = {"ELF": ["ELF32", "ELF64"], "Mach-O": ["Mach-O32", "Mach-O64", "Mach-Ou"], "PE": [".NET", "MSDOS", "PE32", "PE64"]}
PATTERNS = {"ELF32": "^(set[gu]id )?ELF 32-bit ", "ELF64": "^(set[gu]id )?ELF 64-bit ", "PE32": "^PE32 executable ", "PE64": "^PE32\\+ executable ", "MSDOS": "^MS-DOS executable"}
#: Bounds of the size classes in bytes.
SIZES = ((20 << 10, "<20kB"), (50 << 10, "20-50kB"), (100 << 10, "50-100kB"), (500 << 10, "100-500kB"), (1 << 20, "500kB-1MB"))


def to_sql(query: str) -> str:
    """A data-frame query string as SQL: == to =, != to <>, double quotes to single ones, `in [..]` to IN (..)."""
    out = query.replace("==", "=").replace("!=", "<>")
    out = re.sub(r'"([^"]*)"', r"'\1'", out)
    out = re.sub(r"(?i)\b(in)\s*\[([^\]]*)\]", r"IN (\2)", out)
    return re.sub(r"&", " AND ", re.sub(r"\|", " OR ", out))


def filter_query(df: DataFrame, query: str | None = None) -> DataFrame:
    """Rows for which the query holds; None and 'all' keep every row."""
    return df if query is None or query.strip().lower() == "all" else df.where(to_sql(query))


def project_features(df: DataFrame, features: list[str]) -> DataFrame:
    keep = [c for c in ("hash", "realpath", "format", "size", "mtime") if c in df.columns]
    return df.select(*keep, *features, "label")


def wildcard_features(columns: list[str], patterns: list[str]) -> list[str]:
    """The columns that match any of the patterns (*), sorted."""
    return sorted({c for p in patterns for c in columns if fnmatch.fnmatchcase(c, p)})


def limited(df: DataFrame, n: int, seed: int = 42, key: str = "hash") -> DataFrame:
    """n rows by the order of md5(key, seed); all rows where n is not positive. The same rows whatever the partitions."""
    if n <= 0:
        return df
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def path_to_source(path: Column, sources: list[str]) -> Column:
    """[i]/rest for the first source that path begins with, else '-1'."""
    out = F.lit("-1")
    for i, source in reversed(list(enumerate(sources))):
        out = F.when(path.startswith(source + "/"), F.concat(F.lit(f"[{i}]"), F.substring(path, len(source) + 1, 1 << 30))).otherwise(out)
    return out


def format_table(df_session) -> DataFrame:
    return df_session.createDataFrame([(leaf, group) for group, leaves in FORMATS.items() for leaf in leaves], "leaf string, grp string")


def expand_formats(formats: DataFrame, spark) -> DataFrame:
    """Distinct leaf formats of a column `format` of leaves, groups or 'All'."""
    known = F.broadcast(format_table(spark))  # nine rows
    return formats.join(known, (F.col("format") == F.col("leaf")) | (F.col("format") == F.col("grp")) | (F.col("format") == "All")).select("leaf").distinct()


def collapse_formats(leaves: DataFrame, spark) -> DataFrame:
    """Leaves with complete groups replaced by the group; column `format`."""
    known = format_table(spark)
    sizes = known.groupBy("grp").agg(F.count("*").alias("total"))
    own = leaves.select("leaf").distinct().join(F.broadcast(known), "leaf").join(F.broadcast(sizes), "grp").withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    return own.select(F.when(F.col("n") == F.col("total"), F.col("grp")).otherwise(F.col("leaf")).alias("format")).distinct()


def format_group(fmt: Column) -> Column:
    return F.create_map(*(F.lit(x) for g, leaves in FORMATS.items() for leaf in leaves for x in (leaf, g)))[fmt]


def classify_signature(signature: Column) -> Column:
    """The format whose pattern fits, the longest pattern first; null if none does."""
    return F.coalesce(*(F.when(signature.rlike(p), f) for f, p in sorted(PATTERNS.items(), key=lambda x: -len(x[1]))))


def clean_signature(signature: Column) -> Column:
    return F.regexp_replace(signature, r", \d+ sections?$", "")


def label_to_num(label: Column) -> Column:
    """-1 not labelled, 0 not packed, 1 packed; true and false in any case count as labels."""
    low = F.lower(label)
    return F.when(label.isNull() | (label == "?"), -1).when((label == "-") | low.isin("false", "f", "no", "0"), 0).otherwise(1)


def readable_label(label: Column) -> Column:
    return F.when(label == "-", "not packed").when(label.isNull() | (label == "?"), "not labelled").when(F.lower(label) == "true", "packed").otherwise(label)


def strip_version(label: Column) -> Column:
    """label without its last -token where that looks like a version."""
    return F.regexp_replace(label, r"-v?\d+(\.\d+)*[a-z]?$", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-")


def size_class(size: Column) -> Column:
    out = F.lit(">1MB")
    for bound, name in reversed(SIZES):
        out = F.when(size < bound, name).otherwise(out)
    return out


def true_class_target(label: Column, true_class: str | None = None, unlabelled: bool = False) -> Column:
    """Binary target: 1 for true_class (or any family), 0 for '-' (or other labels), -1 for '?'."""
    if unlabelled:
        return F.lit(-1)
    if true_class is not None:
        return F.when(label == "?", -1).when(label == true_class, 1).otherwise(0)
    return label_to_num(label)


def numeric_coerce(value: Column) -> Column:
    return F.coalesce(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"), F.lit(0.0))


def ml_view(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls as a model reads them: -1 in features, ? in label."""
    return df.fillna(-1, features).fillna("?", ["label"])


#: Named filters of files by format and extension.
KINDS = {"exe": "format in ('PE32', 'PE64') and ext = 'exe'", "elf": "format in ('ELF32', 'ELF64')", "pe": "format in ('PE32', 'PE64')", "dll": "format in ('PE32', 'PE64') and (ext = 'dll' or signature like '%(DLL)%')", "gui": "signature like '%(GUI)%'"}


def file_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("ext", F.lower(F.regexp_extract("realpath", r"\.([A-Za-z0-9]+)$", 1))).where(KINDS[kind]).drop("ext")


def variants(df: DataFrame, labels: list[str], missing: int = 0) -> DataFrame:
    """(stem, n): names that, each label's most common prefix cut, stand under at least all but `missing` of the labels.

    Columns: label, name. The prefix of a name is its part up to the first underscore.
    """
    own = df.where(F.col("label").isin(labels)).withColumn("prefix", F.regexp_extract("name", "^[^_]*_", 0))
    common = own.groupBy("label", "prefix").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("prefix", F.struct("c", "prefix")).alias("top"))
    stem = F.when(F.startswith("name", "top"), F.expr("substring(name, length(top) + 1)")).otherwise(F.col("name"))
    return own.join(common, "label").groupBy(stem.alias("stem")).agg(F.count_distinct("label").alias("n")).where(F.col("n") >= len(labels) - missing)
