"""Similarity of contents by word shingles: signatures, pair scores, near-duplicate removal."""

from __future__ import annotations

from functools import reduce
from itertools import count, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.sources.scratch import cut, new_folder, passing, remove, written, written_at

#: Words of a shingle, hash rows of a signature, rounding that bounds allow for.
WORDS, ROWS, SLACK = 5, 64, 1e-6
#: Keys of an item that meet in one task.
PART = 1024
#: Parts of the sets, and of the items, by remainder, that are handled one after another.
PARTS = 4
#: Rounds of greedy_keep between looks at what is open, and the similar pairs that the driver settles.
EARLY, FEW = 8, 100_000


def bound(value: Column, make) -> Column:
    """make(value), value computed once: inside a lambda Spark would compute it anew for each element."""
    return F.transform(F.array(value), make)[0]


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct runs of `words` words of the lower-cased text; a shorter text is one shingle."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    return bound(parts, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - (words - 1))), lambda i: F.array_join(F.slice(p, i, words), " "))))


def hashes(text: Column) -> Column:
    """The 64-bit hashes of the shingles of a text, sorted and distinct."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    # Words are hashed one after another, without joining them; a missing word of a short text changes nothing.
    run = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(p) - WORDS)), lambda i: F.xxhash64(*(F.get(p, i + n) for n in range(WORDS))))
    return F.sort_array(F.array_distinct(bound(parts, run)))


def _factors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(64)
    return rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, rows, dtype=np.uint64)


def signature(items: Column, rows: int = ROWS) -> Column:
    """MinHash signature of an array of hashes: for each row the smallest value of a seeded linear hash; null or empty: null."""

    @F.pandas_udf("array<long>")
    def signed(sets: pd.Series) -> pd.Series:
        mult, add = _factors(rows)
        out = []
        for one in sets:
            if one is None or not len(one):
                out.append(None)
                continue
            one = np.asarray(one, np.int64).view(np.uint64)
            low = np.full(rows, np.iinfo(np.uint64).max, np.uint64)
            for start in range(0, len(one), 65_536):  # bounded memory for very long texts
                part = one[start : start + 65_536]
                mixed = part[None, :] * mult[:, None] + add[:, None]
                low = np.minimum(low, (mixed ^ mixed >> np.uint64(29)).min(1))
            out.append(low.view(np.int64))
        return pd.Series(out)

    return signed(items)


def jaccard(a: Column, b: Column) -> Column:
    """100 * Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b))
    return F.round(100 * both / (F.size(a) + F.size(b) - both), 6)


def digest_kind(digest: Column) -> Column:
    """Kind of a similarity digest by its form."""
    return F.when(digest.rlike(r"^\d+:[A-Za-z0-9+/]+:[A-Za-z0-9+/]+$"), "ssdeep").when(digest.rlike("^(T1)?[0-9A-Fa-f]{70}$"), "tlsh").when(digest.rlike("^[0-9a-f]{64}$"), "sha256").when(digest.rlike("^[0-9a-f]{32}$"), "md5").otherwise("?")


def _needed(n: Column, threshold: float) -> Column:
    """The least number of items that a set of n shares with any set of that similarity or more."""
    return F.greatest(F.lit(1), F.ceil(n * (threshold / 100) - SLACK))


def shared_items(sets: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """(key, n, item, held): the items that several sets hold, n being the size of the set and held the sets of the item.

    The items of one remainder are counted and looked up before those of the next, and a part's shuffle files go when it is done. So the disk holds a
    PARTS-th of all items at once, and items of one set alone, which most are, are never written. With a threshold, a set goes as soon as the parts done hold more of
    its own items than any similar set leaves it: it has no partner, so that most sets move a PARTS-th of their items. What is told of sets that went is not whole.
    """
    found, left, folder = [], sets, None
    for part in range(PARTS):
        mine = left.select(key, F.size("items").alias("n"), F.explode("items").alias("item")).where(F.pmod("item", F.lit(PARTS)) == part)
        with passing(mine.groupBy("item").agg(F.count("*").alias("held")).where("held > 1"), "common-items") as common:
            found.append(written(mine.join(common, "item"), "shared-items"))
        if threshold is not None and part < PARTS - 1:
            keys = written(_with_room(left, reduce(DataFrame.unionByName, found), key, threshold, part), "sets-with-room")
            if 2 * keys.count() < left.count():  # else they are not worth writing
                before, folder = folder, new_folder(sets.sparkSession, "open-sets")
                left = written_at(left.join(keys, key, "left_semi").select(key, "items"), folder)
                if before is not None:
                    remove(sets.sparkSession, before)
    if folder is not None:
        remove(sets.sparkSession, folder)
    return reduce(DataFrame.unionByName, found)


def _with_room(sets: DataFrame, shared: DataFrame, key: str, threshold: float, part: int) -> DataFrame:
    """(key) of the sets that may have a similar one, by what of their items of the parts up to `part` others hold."""
    sizes = sets.select(key, F.size("items").alias("n"), F.size(F.filter("items", lambda i: F.pmod(i, F.lit(PARTS)) <= part)).alias("seen"))
    met = shared.groupBy(key).agg(F.count("*").alias("met"))
    return sizes.join(met, key, "left").where(F.col("n") - F.col("seen") + F.coalesce("met", F.lit(0)) >= _needed(F.col("n"), threshold)).select(key)


def rare_items(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, item, place, n): the items under which a set is looked up, so that sets of that similarity share one at least.

    Items are ordered from rare to common. Two sets that share o items share one of the first n - o + 1 of either, and o is at least threshold * n. Items of one set only
    stand first and meet nothing: they are counted and not listed, and a set of which they leave too little has no partner.
    """
    shared = shared_items(sets, key, threshold)
    over = Window.partitionBy(key)
    placed = shared.withColumn("left", F.count("*").over(over)).where(F.col("left") >= _needed(F.col("n"), threshold))
    placed = placed.withColumn("place", F.row_number().over(over.orderBy("held", "item")) + F.col("n") - F.col("left"))
    return placed.where(F.col("place") <= F.col("n") - _needed(F.col("n"), threshold) + 1).select(key, "item", "place", "n")


def _may_meet(threshold: float) -> Column:
    """Of two index rows of one item (n, place and m, other): whether sizes and what follows in either set leave room for the similarity."""
    n, m, share = F.col("n"), F.col("m"), threshold / 100
    room = 1 + F.least(n - F.col("place"), m - F.col("other"))
    return (F.least(n, m) >= share * F.greatest(n, m) - SLACK) & (room >= share / (1 + share) * (n + m) - SLACK)


def candidates(index: DataFrame, key: str, threshold: float, part: int = PART) -> DataFrame:
    """(a, b), a < b: distinct pairs of keys that share an indexed item and may be similar. An item of more than part keys is split by a hash of the key, and its parts are met pair by pair."""
    sizes = index.groupBy("item").count().where("count > 1").select("item", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = index.join(sizes, "item").withColumn("own", F.pmod(F.xxhash64(key), "parts").cast("int"))
    spread = own.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("item", F.least("own", "side").alias("l"), F.greatest("own", "side").alias("r"), "own", key, "place", "n")
    one, two = spread.withColumnRenamed(key, "a"), spread.withColumnsRenamed({key: "b", "own": "own_b", "place": "other", "n": "m"})
    met = one.join(two, ["item", "l", "r"]).where((F.col("a") < F.col("b")) & ((F.col("own") != F.col("own_b")) | (F.col("l") == F.col("r"))) & _may_meet(threshold))
    return met.select("a", "b").distinct()


def scored(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, score) of the pairs (a, b) with score >= threshold. Only the sets that pairs name move."""
    return _scored(written(pairs, "candidates"), sets, key, threshold)


def _scored(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """As scored(), of pairs that are written."""
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "keys-in-pairs")
    sets = written(sets.join(keys, key, "left_semi").select(key, "items"), "sets-in-pairs")
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col(key).alias("b"), F.col("items").alias("ib")), "b")
    return both.select("a", "b", jaccard(F.col("ia"), F.col("ib")).alias("score")).where(F.col("score") >= threshold)


def classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((key, items) of one row for each distinct set of shingles, that of the smallest key; (key, first) for each row: the key that stands for it)."""
    # Numbered as written, so that what stands for a set is chosen by small columns, and sets move a part at a time, if at all: a part goes when its distinct sets are written.
    given = docs.select(key, hashes(F.col(text)).alias("items")).withColumns({"h": F.xxhash64("items"), "g": F.xxhash64(F.lit(1), "items"), "row": F.monotonically_increasing_id()})
    path = new_folder(docs.sparkSession, "sets")
    named = written_at(given.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")), path, "part")
    keys = written(named.select(key, "h", "g", "row"), "set-keys")
    least = F.min(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("first"), "row")))
    firsts = written(keys.groupBy("h", "g").agg(least.alias("f")).select("h", "g", "f.first", "f.row"), "set-firsts")
    chosen = written(firsts.where(F.col("first").isNotNull()).groupBy("first").agg(F.min("row").alias("row")).select("row"), "chosen-rows")
    found = []
    for part in range(PARTS):
        found.append(written(named.where(F.col("part") == part).join(chosen, "row", "left_semi").select(key, "items"), "distinct-sets"))
        remove(docs.sparkSession, f"{path}/part={part}")
    distinct = reduce(DataFrame.unionByName, found)
    return distinct, keys.select(key, "h", "g").join(firsts.select("h", "g", "first"), ["h", "g"])


def similar_pairs(docs: DataFrame, key: str, text: str, threshold: float = 80.0) -> DataFrame:
    """(a, b, score): all pairs of different texts with score >= threshold.

    Rows with equal shingles are one class first, named by its smallest key, so that a group of copies gives no pairs;
    exact_classes() says which row stands for which.
    """
    return pairs_of(classes(docs, key, text)[0], key, threshold)


def pairs_of(sets: DataFrame, key: str, threshold: float = 80.0) -> DataFrame:
    """As similar_pairs, of the classes (key, items)."""
    return scored(candidates(written(rare_items(sets, key, threshold), "rare-items"), key, threshold), sets, key, threshold)


def with_earlier(sets: DataFrame, key: str, threshold: float = 80.0) -> DataFrame:
    """(key) of the sets that are similar to one with a smaller key, found without all pairs.

    A set first meets the smallest key alone of each item that it is indexed by: of a template's near copies nearly all are settled there, by one pair for
    each set and item. Only sets that find nothing so meet all smaller keys of their items.
    """
    return _earlier(written(rare_items(sets, key, threshold), "rare-items"), sets, key, threshold)


def _earlier(index: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """As with_earlier(), of the sets that index, which is written, lists."""
    firsts = index.groupBy("item").agg(F.min(F.struct(F.col(key).alias("a"), "place", "n")).alias("f")).select("item", "f.a", F.col("f.place").alias("other"), F.col("f.n").alias("m"))
    tried = index.withColumnRenamed(key, "b").join(firsts, "item").where((F.col("a") < F.col("b")) & _may_meet(threshold)).select("a", "b").distinct()
    tried = written(tried, "first-pairs")
    settled = written(_scored(tried, sets, key, threshold).select(F.col("b").alias(key)).distinct(), "settled")
    open_ = index.join(settled, key, "left_anti").select(F.col(key).alias("b"), "item", F.col("place").alias("other"), F.col("n").alias("m"))
    more = open_.join(index.withColumnRenamed(key, "a"), "item").where((F.col("a") < F.col("b")) & _may_meet(threshold)).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    return settled.unionByName(scored(more, sets, key, threshold).select(F.col("b").alias(key)).distinct())


def keep_greedily(sets: DataFrame, key: str, threshold: float = 80.0, rounds: int = 2) -> DataFrame:
    """(key) of the sets kept when each, in ascending order of keys, stays unless an earlier kept one is similar.

    A set without an earlier similar one is kept, and what is similar to it and later goes: a round of that settles whole groups around a template without
    their pairs. What is open after the rounds is settled by its own pairs, see greedy_keep(). The sets are indexed once: the order of items that the index rests on
    serves any choice of its sets.
    """
    index, kept, open_ = written(rare_items(sets, key, threshold), "rare-items"), None, sets.select(key)
    for _ in range(rounds):
        later = written(_earlier(index, sets, key, threshold), "later")
        first = open_.join(later, key, "left_anti")
        kept = first if kept is None else kept.unionByName(first)
        if later.isEmpty():
            return kept
        mine = index.join(later, key, "left_semi").select(F.col(key).alias("b"), "item", F.col("place").alias("other"), F.col("n").alias("m"))
        met = mine.join(index.join(later, key, "left_anti").withColumnRenamed(key, "a"), "item").where((F.col("a") < F.col("b")) & _may_meet(threshold)).select("a", "b").distinct()
        gone = scored(met, sets, key, threshold).select(F.col("b").alias(key)).distinct()
        open_ = written(later.join(gone, key, "left_anti"), "open")
        index = written(index.join(open_, key, "left_semi"), "open-items")
    return kept.unionByName(greedy_keep(open_, scored(candidates(index, key, threshold), sets, key, threshold), key))


def exact_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first): the smallest key of the rows with the same set of shingles."""
    return classes(docs, key, text)[1]


def greedy_keep(keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Keys kept when each key, in ascending order, stays unless an earlier kept one is similar: rounds of joins until all are settled.

    A key all of whose smaller similar keys are dropped is kept; one with a kept smaller similar key is dropped. Each round settles the
    smallest open key of each group at least; what a chain leaves open after EARLY rounds is settled in one go once it is small.
    """
    edges = cut(pairs.select(F.col("a").alias("small"), F.col("b").alias("large")).distinct())
    state = cut(keys.select(key).distinct().join(edges.select(F.col("large").alias(key)).distinct(), key, "left_anti").select(key, F.lit(True).alias("kept")))
    for turn in count():
        open_ = edges.join(state.select(F.col(key).alias("large")), "large", "left_anti")
        seen = open_.join(state.select(F.col(key).alias("small"), "kept"), "small", "left")
        if turn % EARLY == EARLY - 1 and (seen := cut(seen)).limit(FEW + 1).count() <= FEW:
            found: dict = {}
            for large, rows in groupby(seen.orderBy("large").collect(), lambda r: r["large"]):  # FEW rows at most; the smaller keys come first
                before = [found.get(r["small"]) if r["kept"] is None else r["kept"] for r in rows]
                found[large] = False if True in before else None if None in before else True
            settled = [(k, kept) for k, kept in found.items() if kept is not None]
            state = cut(state.unionByName(state.sparkSession.createDataFrame(settled, state.schema)))
            break
        votes = seen.groupBy("large").agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("hit"), F.count_if(F.col("kept").isNull()).alias("unknown"))
        new = votes.where("hit or unknown = 0").select(F.col("large").alias(key), (~F.col("hit")).alias("kept"))
        new = cut(new)
        if new.limit(1).count() == 0:
            break
        state = cut(state.unionByName(new))
    return state.where("kept").select(key)


def drop_most_similar(docs: DataFrame, pairs: DataFrame, key: str, n: int) -> DataFrame:
    """docs without the second members of the n most similar pairs."""
    gone = pairs.orderBy(F.col("score").desc(), "a", "b").limit(n).select(F.col("b").alias(key))
    return docs.join(gone, key, "left_anti")
