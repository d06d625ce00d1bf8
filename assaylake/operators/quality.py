"""Scores of a dataset's quality, and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the overall score; margins of the balances; bounds of plausible files.
WEIGHTS = {"completeness": 1.0, "consistency": 1.0, "file_balance": 1.0, "label_balance": 1.0, "outliers": 1.0, "portability": 1.0, "similarity": 1.0, "uniqueness": 1.0}
FILE_MARGIN, LABEL_MARGIN = 0.2, 0.1
LEAST_SIZE, MOST_SIZE, FIRST_YEAR = 1 << 10, 100 << 20, 2000
#: Shares of the deletions that a repair may make, in all at most BUDGET of the rows.
BUDGET = 0.1
SHARES = {"similarity": 0.4, "portability": 0.1, "label_balance": 0.15, "file_balance": 0.2, "outliers": 0.05, "completeness": 0.1}


def null_share(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns)) / len(columns)


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """1 - the mean over columns of their share of nulls, in one pass."""
    return df.agg(F.round(1 - F.avg(null_share(columns or df.columns)), 6).alias("completeness"))


def consistency(df: DataFrame, blobs: DataFrame, formats: list[str]) -> DataFrame:
    """Mean of three shares: content present (hash in blobs), format valid, label present."""
    have = blobs.select("hash").distinct().withColumn("__there", F.lit(1))
    joined = df.join(have, "hash", "left")
    parts = [F.avg(F.coalesce("__there", F.lit(0))), F.avg(F.coalesce(F.col("format").isin(formats), F.lit(False)).cast("int")), F.avg(F.col("label").isNotNull().cast("int"))]
    return joined.agg(F.round(reduce(lambda a, b: a + b, parts) / 3, 6).alias("consistency"))


def balance(df: DataFrame, column: str, margin: float) -> DataFrame:
    """1 - max(0, largest share - smallest share - 2 * margin) of a column's values; '?' labels do not count."""
    rows = df.where(F.col(column) != "?") if column == "label" else df
    shares = rows.groupBy(column).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("hi"), (F.min("n") / F.sum("n")).alias("lo"))
    return shares.select(F.round(1 - F.greatest(F.lit(0.0), F.col("hi") - F.col("lo") - 2 * margin), 6).alias("balance"))


def file_balance(df: DataFrame, columns: tuple[str, ...] = ("format", "signature", "size"), margin: float = FILE_MARGIN) -> DataFrame:
    """Mean balance over columns; the three counts come from one pass over the unpivoted columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in columns))).alias("p")).select("p.*")
    shares = long.groupBy("f", "v").agg(F.count("*").alias("n")).groupBy("f").agg((F.max("n") / F.sum("n")).alias("hi"), (F.min("n") / F.sum("n")).alias("lo"))
    return shares.agg(F.round(F.avg(1 - F.greatest(F.lit(0.0), F.col("hi") - F.col("lo") - 2 * margin)), 6).alias("file_balance"))


def plausible() -> tuple[Column, Column]:
    """(size plausible, date plausible) of a sample."""
    return F.coalesce(F.col("size").between(LEAST_SIZE, MOST_SIZE), F.lit(False)), F.coalesce(F.year("mtime") >= FIRST_YEAR, F.lit(False))


def outlier_score(df: DataFrame) -> DataFrame:
    size, date = plausible()
    return df.agg(F.round((F.avg(size.cast("int")) + F.avg(date.cast("int"))) / 2, 6).alias("outliers"))


def uniqueness(df: DataFrame, columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """Share of distinct values of the columns: hash, or all features where there are no files. Counted by groups, not in one task."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.round(F.count("*") / F.sum("n"), 6).alias("uniqueness"))


def similarity_score(df: DataFrame, classes: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """1 - the share of rows with an earlier similar one (a smaller key).

    classes: (key, first), the row that stands for rows of equal content; later: (key) of those that are similar to an earlier one. Rows that classes does not hold are
    similar to none.
    """
    copies = classes.where(F.col(key) != F.col("first")).agg(F.count("*").alias("c"))
    similar = later.agg(F.count("*").alias("l"))
    row = df.agg(F.count("*").alias("n")).join(copies).join(similar)  # one row each
    return row.select(F.round(1 - (F.col("c") + F.col("l")) / F.col("n"), 6).alias("similarity"))


def portability_score(df: DataFrame, portability: Column) -> DataFrame:
    """Mean portability of the samples."""
    return df.agg(F.round(F.avg(portability), 6).alias("portability"))


def overall_scores(df: DataFrame, columns: list[str], formats: list[str], portability: Column, similarity: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of all scores of a sample table and their weighted mean: completeness, consistency, file and label balance, outliers, portability, similarity, uniqueness.

    Means come from one aggregate; balances and uniqueness from one grouping of (column, value), pre-aggregated before the shuffle.
    """
    size, date = plausible()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    means = df.agg(
        F.round(1 - F.avg(null_share(columns)), 6).alias("completeness"),
        F.round((share(F.col("hash").isNotNull()) + share(F.col("format").isin(formats)) + share(F.col("label").isNotNull())) / 3, 6).alias("consistency"),
        F.round((share(size) + share(date)) / 2, 6).alias("outliers"),
        F.round(F.avg(portability), 6).alias("portability"),
    )
    counted = ("format", "signature", "size", "label", "hash")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in counted))).alias("p")).select("p.*")
    spread = long.where("f <> 'label' or v <> '?'").groupBy("f", "v").agg(F.count("*").alias("n")).groupBy("f").agg((F.max("n") / F.sum("n") - F.min("n") / F.sum("n")).alias("gap"), (F.count("*") / F.sum("n")).alias("distinct"))
    even = lambda margin: 1 - F.greatest(F.lit(0.0), F.col("gap") - 2 * margin)
    others = spread.agg(
        F.round(F.avg(F.when(F.col("f").isin("format", "signature", "size"), even(FILE_MARGIN))), 6).alias("file_balance"),
        F.round(F.max(F.when(F.col("f") == "label", even(LABEL_MARGIN))), 6).alias("label_balance"),
        F.round(F.max(F.when(F.col("f") == "hash", F.col("distinct"))), 6).alias("uniqueness"),
    )
    return overall([means, others, similarity], weights)


def overall(scores: list[DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """All one-row scores beside each other, and their weighted mean; a null score drops out with its weight."""
    weights = weights or WEIGHTS
    row = reduce(lambda a, b: a.join(b), scores)  # one row each
    used = [c for c in row.columns if c in weights]
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * weights[c], F.lit(0.0)) for c in used))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), weights[c]).otherwise(0.0) for c in used))
    return row.withColumn("overall", F.round(total / F.nullif(weight, F.lit(0.0)), 6))


def budgets(df: DataFrame, shares: dict[str, float] | None = None, most: float = BUDGET) -> DataFrame:
    """(repair, budget): how many rows each repair may delete."""
    shares = shares or SHARES
    rows = F.array(*(F.struct(F.lit(k).alias("repair"), F.lit(v).alias("share")) for k, v in shares.items()))
    return df.agg(F.count("*").alias("n")).select(F.explode(rows).alias("s"), "n").select("s.repair", F.floor(F.round(F.col("n") * most * F.col("s.share"), 6)).cast("long").alias("budget"))


def drop_first(df: DataFrame, candidates: Column, order: list[Column], k: int) -> DataFrame:
    """df without the k candidates that come first by order: a top-k on the candidates, then an anti-join."""
    first = df.where(candidates).orderBy(*order, "hash").limit(k).select("hash")
    return df.join(first, "hash", "left_anti")


def fix_completeness(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    share = null_share(columns)
    return drop_first(df, share > 0, [share.desc()], k)


def fix_consistency(df: DataFrame, blobs: DataFrame, formats: list[str]) -> DataFrame:
    return df.where(F.col("format").isin(formats) & F.col("label").isNotNull()).join(blobs.select("hash"), "hash", "left_semi")


def fix_label_balance(df: DataFrame, k: int, margin: float = LABEL_MARGIN) -> DataFrame:
    """Where the packed share is off one half by more than margin: df without the first k rows, by hash, of the larger class."""
    known = df.where("label <> '?'")
    share = known.agg(F.avg((F.col("label") != "-").cast("double")).alias("s"))
    larger = df.join(F.broadcast(share)).where(F.abs(F.col("s") - 0.5) > margin).where(F.when(F.col("s") > 0.5, ~F.col("label").isin("-", "?")).otherwise(F.col("label") == "-"))
    return df.join(larger.orderBy("hash").limit(k).select("hash"), "hash", "left_anti")


def fix_file_balance(df: DataFrame, columns: tuple[str, ...], k: int, spread: float = 0.1) -> DataFrame:
    """df without the first k rows, by hash, that have the dominant value of a column whose shares differ by more than spread."""
    long = df.select("hash", F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in columns))).alias("p")).select("hash", "p.*")
    counts = long.groupBy("f", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("f").agg(F.max_by("v", F.struct("n", "v")).alias("v"), ((F.max("n") - F.min("n")) / F.sum("n")).alias("spread")).where(F.col("spread") > spread).select("f", "v")
    gone = long.join(F.broadcast(top), ["f", "v"]).select("hash").distinct().orderBy("hash").limit(k)
    return df.join(gone, "hash", "left_anti")


def fix_portability(df: DataFrame, k: int, column: str = "portability") -> DataFrame:
    return drop_first(df, F.col(column).isNotNull(), [F.col(column).asc()], k)


def fix_outliers(df: DataFrame, k: int) -> DataFrame:
    """df without the first k rows, by hash, of implausible size or date."""
    size, date = plausible()
    return drop_first(df, ~(size & date), [], k)


def balanced(df: DataFrame, per_class: int, seed: int = 42, column: str = "label") -> DataFrame:
    """At most per_class rows of each class, by the order of md5(hash, seed)."""
    w = Window.partitionBy(column).orderBy(F.md5(F.concat(F.col("hash"), F.lit(str(seed)))), "hash")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_class).drop("__n")


def altered_share(df: DataFrame, log: DataFrame) -> DataFrame:
    """Share of samples whose hash is in the alteration log."""
    hit = df.select("hash").distinct().join(log.select("hash").distinct().withColumn("__hit", F.lit(1)), "hash", "left")
    return hit.agg(F.round(F.avg(F.coalesce("__hit", F.lit(0))), 6).alias("altered"))
