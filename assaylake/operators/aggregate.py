"""Aggregations, rankings and tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.project import label_to_num, size_class


def label_counts(df: DataFrame, drop: tuple[str, ...] = ("?",)) -> DataFrame:
    return df.where(~F.col("label").isin(*drop)).groupBy("label").agg(F.count("*").alias("n"))


def size_overview(df: DataFrame) -> DataFrame:
    """Per size class, and in total: counts of the label kinds and their share of the kind's total; the total row's share is of all rows."""
    kind = label_to_num(F.col("label"))
    counts = df.select(size_class(F.col("size")).alias("class"), kind.alias("k")).rollup("class").agg(*(F.count_if(F.col("k") == v).alias(n) for v, n in ((-1, "unlabelled"), (0, "clean"), (1, "packed"))), F.count("*").alias("n"))
    named = counts.withColumn("class", F.coalesce("class", F.lit("Total")))
    whole = Window.partitionBy()
    total = lambda c: F.max(F.when(F.col("class") == "Total", F.col(c))).over(whole)
    return named.select("class", "unlabelled", "clean", "packed", "n", *(F.round(100 * F.col(c) / F.when(F.col("class") == "Total", total("n")).otherwise(F.nullif(total(c), F.lit(0))), 6).alias(f"{c}_pct") for c in ("unlabelled", "clean", "packed")))


def labelling_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.round(100 * F.avg((F.col("label") != "?").cast("int")), 6).alias("labelled_pct"))


def with_share(counts: DataFrame, n: str = "n", name: str = "pct", digits: int = 6) -> DataFrame:
    """counts with each row's percentage of the sum."""
    return counts.withColumn(name, F.round(100 * F.col(n) / F.sum(n).over(Window.partitionBy()), digits))


def decision_stats(df: DataFrame, column: str = "label") -> DataFrame:
    return with_share(df.groupBy(column).agg(F.count("*").alias("n")))


def value_counts(df: DataFrame, features: list[str], k: int | None = None) -> DataFrame:
    """Counts of each combination of feature values by label kind, with the total's share; the k most frequent only, if k is given."""
    kind = label_to_num(F.col("label"))
    out = df.groupBy(*features).agg(F.count_if(kind == -1).alias("unlabelled"), F.count_if(kind == 0).alias("clean"), F.count_if(kind == 1).alias("packed"), F.count("*").alias("total"))
    out = with_share(out, "total")
    return out if k is None else out.orderBy(F.col("total").desc(), *features).limit(k)


def scaled_covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov): population covariance of the columns after min-max scaling, each pair once; one pass for all."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    width = lambda c: F.max(c) - F.min(c)
    row = df.agg(*(F.round(F.covar_pop(a, b) / (width(a) * width(b)), 6).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs))).alias("p")).select("p.*")


def display(value: Column, name: str) -> Column:
    """A feature value as text: 0/1 of is_ and has_ as booleans, byte_ as hex, integral floats as integers."""
    if name.startswith(("is_", "has_")):
        return F.when(value == 1, "true").when(value == 0, "false")
    if name.startswith("byte_"):
        return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value.cast("long"))), 2, "0"))
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def header(df: DataFrame) -> DataFrame:
    """One row: samples, formats and families present, total size, labelled share."""
    return df.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("label").isin("?", "-"), F.col("label")))), ",").alias("families"), F.sum("size").alias("size"), F.round(100 * F.avg((F.col("label") != "?").cast("int")), 6).alias("labelled_pct"))


def label_share(df: DataFrame) -> DataFrame:
    """Share of each label; '?' and '-' are there even without rows."""
    forced = df.sparkSession.createDataFrame([("?",), ("-",)], "label string")
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    both = counts.unionByName(forced.withColumn("n", F.lit(0).cast("long"))).groupBy("label").agg(F.sum("n").alias("n"))
    return with_share(both)


def majority_defaults(df: DataFrame, columns: list[str], share: float = 0.7) -> DataFrame:
    """(attr, value): values that at least `share` of the rows have."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*")
    counts = long.groupBy("attr", "value").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("attr")))
    return counts.where(F.col("n") >= share * F.col("all")).select("attr", "value", "n")


def dedup_rounded(df: DataFrame, keys: list[str], numbers: list[str], order: str, digits: int = 3) -> DataFrame:
    """The first row by order of each group that agrees on keys and on numbers rounded to digits."""
    w = Window.partitionBy(*keys, *(F.round(c, digits) for c in numbers)).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_over(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) > threshold).orderBy(F.col(score).desc())


def sorted_histogram(df: DataFrame, value: str, by: str = "hash") -> DataFrame:
    """(hash, histogram): 'value:count' of each group, the most frequent and largest first."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("c"))
    listed = F.sort_array(F.collect_list(F.struct("c", F.col(value).alias("v"))), asc=False)
    return counts.groupBy(by).agg(F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["v"].cast("string"), s["c"].cast("string"))), ",").alias("histogram"))


def rank_stability(df: DataFrame, item: str, run: str, impact: str) -> DataFrame:
    """Per item: mean, spread, lowest and highest of its ranks over the runs."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(F.col(impact).desc(), item)))
    return ranked.groupBy(item).agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.stddev_samp("rank"), 6).alias("std_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"))


def mark_best(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """df with a flag best_<metric> on the rows that hold the largest value."""
    w = Window.partitionBy(*(by or []))
    return df.withColumns({f"best_{m}": F.col(m) == F.max(m).over(w) for m in metrics})
