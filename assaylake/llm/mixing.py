"""Mixing sources to target weights, with DataFrame operations only.

Plan: each source is one stream of words, in a fixed order of its documents, cut into blocks of `block` words; what is left
over is a short last block. Targets are shares of the mix by weight, held at `most` times the source's size. The slots of
each output shard draw their source (a multinomial draw by hash); the few slots drawn above a source's target are dealt to
the sources drawn below theirs. The k-th slot of a source takes the block that a pseudorandom permutation of the source's
full block numbers gives for k, the short block coming last; each turn through the blocks has its own permutation. A source's
last slot takes only the words that its target still lacks, so that even a source of a few words comes to its target.
Slots and blocks join by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.shared import blocks_for, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, slots in an output shard, seed of the draws, rounds of the permutation.
BLOCK, SHARD, SEED, ROUNDS = 256, 1024, 20, 12
#: Rows of a bucket of positions, numbers that a running sum takes together, shards made by one task.
BUCKET, SPAN, TOGETHER = 1024, 4096, 128


def _keys(id_col: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of a row's id, source and text; nulls differ from empty strings."""
    told = [x for c in (id_col, source, text) for x in (c, c.isNull())]
    return F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, two, doc_id, source, size) for each row: key and two are hashes of the row, size counts its words (null text: 0)."""
    key, two = _keys(F.col(id_col), F.col(source_col), F.col(text_col))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(key.alias("key"), two.alias("two"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def _numbered(rows: DataFrame, key: str = "key", two: str = "two", rep: str = "rep") -> DataFrame:
    """rows with rep, which tells rows of one key apart: different rows by their second hash, equal ones in any order."""
    return rows.withColumn(rep, F.row_number().over(Window.partitionBy(key).orderBy(two)))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, sid, source_size, target): sources by code point, null last, take the weights in turn.

    The sum of targets is share times all sizes; a target stops at most times its source's size and the excess goes to
    the others by weight. Sources stop in the order of limit / weight, so one running sum finds the level at which
    the rest share. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    limit = most * F.col("source_size")
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    placed = (
        listed.withColumns({"weight": weight, "limit": limit.cast("double")})
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumns({"total": F.sum("source_size").over(whole) * F.lit(float(share)), "weights": F.sum("weight").over(whole)})
        .withColumn("level", level)
    )
    settled = placed.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
    return settled.select("source", "sid", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def before(totals: DataFrame, by: list[str], at: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """totals, one row for each (by, at), with name: the sum of value over the smaller numbers at.

    Sums run within stretches of span numbers, and then over the stretches, so that no task holds more than a span or a
    span-th of the numbers.
    """
    part = totals.withColumn("__part", F.floor(F.col(at) / span))
    sums = part.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    over = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(over(*by).orderBy("__part")), F.lit(0))).drop("__sum")
    inside = part.withColumn("__inside", F.coalesce(F.sum(value).over(over(*by, "__part").orderBy(at)), F.lit(0)))
    return inside.join(sums, [*by, "__part"]).withColumn(name, F.col("__base") + F.col("__inside")).drop("__part", "__base", "__inside")


def positions(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """The rows of sized with words, with rep, sid, source_size, target and start: the words of the source before the row, in a fixed order.

    Running sums go over buckets of about BUCKET rows and then over the bucket totals, so that a source with a third of all rows is no single task.
    """
    named = _numbered(sized.where("size > 0")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(blocks_for(rows, BUCKET)))).join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "rep")
    totals = named.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = before(totals, ["sid"], "bucket", "bucket_size", "offset").drop("bucket_size")
    return named.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("within")).drop("bucket", "offset", "within", "two")


def permuted(index: Column, count: Column, *salts: Column | int) -> Column:
    """A pseudorandom permutation of 0..count-1, applied to index: swap-or-not rounds keyed by the salts.

    A round pairs x with (key - x) mod count and a hash of the pair says whether the two change places, so each
    round is a permutation for any count.
    """
    salt = [s if isinstance(s, Column) else F.lit(s) for s in salts]

    def turn(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*salt, r), count) - x, count)
        return F.when(F.xxhash64(*salt, r, F.greatest(x, mate)).bitwiseAND(F.lit(1)) == 1, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def _wanted(sources: DataFrame, block: int) -> DataFrame:
    """(sid, full, each, turns, rest, slots): a source's full blocks, its blocks with the short one, whole turns through them, the words left for one more turn, and all slots."""
    each = F.col("full") + (F.col("source_size") % block > 0).cast("long")
    last = F.when(F.col("rest") <= F.col("full") * block, F.ceil(F.col("rest") / block)).otherwise(F.col("full") + 1)
    return (
        sources.where("source_size > 0")
        .select("sid", "source_size", F.floor(F.col("source_size") / block).alias("full"), F.round("target").cast("long").alias("want"))
        .withColumns({"each": each, "turns": F.floor(F.col("want") / F.col("source_size"))})
        .withColumn("rest", F.col("want") - F.col("turns") * F.col("source_size"))
        .select("sid", "full", "each", "turns", "rest", (F.col("turns") * F.col("each") + last).cast("long").alias("slots"))
        .where("slots > 0")
    )


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, sid, k, turn, number, limit): the slots of each output shard, the block that each takes and the words it takes of it.

    k counts a source's slots, number is the block's number in the source and turn how often the source has been gone through
    before. A source's slots take its target in all, to the word: the last one stops at `limit` words of its block.
    """
    spark = sources.sparkSession
    wanted = written(_wanted(sources, block), "wanted")
    all_slots = int(wanted.agg(F.sum("slots")).first()[0] or 0)
    shards = blocks_for(all_slots, shard)
    bins = shards  # both sides of a draw meet in bins; there are as many as shards, so a bin holds about a shard's draws
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each source
    ranged = wanted.withColumn("low", F.coalesce(F.sum("slots").over(ahead), F.lit(0)))
    bin_of = lambda lot: F.floor(lot * F.lit(bins) / F.lit(max(1, all_slots)))
    shares = ranged.select("sid", "low", (F.col("low") + F.col("slots")).alias("high"), F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("low") + F.col("slots") - 1))).alias("bin"))
    slot = F.explode(F.sequence(F.col("shard") * shard, F.least((F.col("shard") + 1) * shard, F.lit(all_slots)) - 1))
    drawn = (
        spark.range(0, shards if all_slots else 0, 1, blocks_for(shards, TOGETHER))
        .withColumnRenamed("id", "shard")
        .select("shard", slot.alias("slot"))
        .select("shard", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, all_slots))).alias("lot"))
        .withColumn("bin", bin_of(F.col("lot")))
    )
    counts = drawn.hint("merge").join(shares.hint("merge"), "bin").where("lot >= low and lot < high").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    # What a source draws above its slots is free for those that drew too few.
    kept = before(written(counts, "draws"), ["sid"], "shard", "n", "first").join(wanted.select("sid", "slots"), "sid").withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("first"))))
    kept = written(kept, "kept")
    taken = kept.groupBy("sid").agg(F.sum("kept").alias("had"))
    lacking = wanted.join(taken, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("lack", F.col("slots") - F.col("had")).where("lack > 0")
    lacking = lacking.withColumn("low", F.coalesce(F.sum("lack").over(ahead), F.lit(0))).select("sid", "had", "low", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("lack") - 1)).alias("x"))
    free = kept.where("n > kept").groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free"))
    free = before(free, [], "shard", "free", "low").select("shard", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("free") - 1)).alias("x"))
    dealt = free.join(lacking, "x").select("shard", "sid", (F.col("had") + F.col("x") - F.col("low")).alias("k"))
    # Few rows grow to many here, which AQE cannot know: shards stay together, TOGETHER of them in a partition.
    own = kept.where("kept > 0").repartition(blocks_for(shards, TOGETHER), "shard").select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("k"))
    numbered = own.unionByName(dealt).join(wanted.drop("slots"), "sid").withColumns({"turn": F.floor(F.col("k") / F.col("each")), "index": F.col("k") % F.col("each")})
    number = F.when(F.col("index") < F.col("full"), permuted(F.col("index"), F.greatest(F.col("full"), F.lit(1)), F.lit(seed), F.col("sid"), F.col("turn"))).otherwise(F.col("full"))
    limit = F.when(F.col("turn") < F.col("turns"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("index") * block))
    return numbered.select("shard", "sid", "k", "turn", number.alias("number"), limit.cast("long").alias("limit"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, number, key, rep, skip, at, words): the part of each document in each block of its source; skip counts the document's words before it, at the block's."""
    end = F.col("start") + F.col("size")
    spread = placed.where("size > 0").select("sid", "key", "rep", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("number"))
    first = F.greatest(F.col("start"), F.col("number") * block)
    return spread.select("sid", "number", "key", "rep", (first - F.col("start")).alias("skip"), (first - F.col("number") * block).alias("at"), (F.least(end, (F.col("number") + 1) * block) - first).alias("words"))


def _within(limit: Column) -> Column:
    """The words of a piece among the first `limit` words of its block."""
    return F.greatest(F.lit(0), F.least(F.col("words"), limit - F.col("at")))


def _plan(docs: DataFrame, block: int, shard: int, seed: int, **rule) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, positions, slots)."""
    sized = written(sizes(docs), "sizes")
    sources = written(targets(sized, **rule).coalesce(1), "sources")
    return sized, sources, written(positions(sized, sources, sized.count()), "positions"), slots(sources, block, shard, seed)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **rule) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs; taken counts the words the mix takes, repeats too.

    A source's words taken are its target, rounded. No row gives more than twice its words: a source is gone through at most `most` = 2 times.
    Null text and text without words have size and taken 0. A null source is a source of its own. A null doc_id is a row like
    any other, and repeated rows are rows of their own, those of equal id, source and text being numbered in one task. No rows give no
    rows. Other columns, whatever their names, are not read.
    rule: weights, share, most as in targets(). The same rows give the same mix, whatever their order or partitions.
    """
    sized, sources, placed, taken = _plan(docs, block, shard, seed, **rule)  # merge joins below: Spark's size of an exploded table is that before it
    whole = F.col("limit") == block
    times = taken.groupBy("sid", "number").agg(F.count(F.when(whole, 1)).alias("times"), F.sum(F.when(~whole, F.col("limit"))).alias("limit"))  # one slot of a source at most is not whole
    used = F.col("words") * F.col("times") + F.when(F.col("limit").isNotNull(), _within(F.col("limit"))).otherwise(0)
    words = pieces(placed, block).hint("merge").join(times.hint("merge"), ["sid", "number"]).groupBy("key", "rep").agg(F.sum(used).alias("taken"))
    out = placed.join(words, ["key", "rep"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = sized.where("size = 0").join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none)


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **rule) -> DataFrame:
    """The mix itself: (shard, sid, k, turn, number, key, rep, skip, words), one row for each part of a document in each slot."""
    _, _, placed, taken = _plan(docs, block, shard, seed, **rule)
    joined = taken.hint("merge").join(pieces(placed, block).hint("merge"), ["sid", "number"]).withColumn("words", _within(F.col("limit"))).where("words > 0")
    return joined.select("shard", "sid", "k", "turn", "number", "key", "rep", "skip", "words")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **rule) -> DataFrame:
    """The mix as rows with the columns of docs: for each turn through a source, each document's text cut to the words taken.

    A document taken whole twice is there twice; one taken in part keeps those of its words (with the white space after them), and
    one not taken goes, as do null texts and texts without words. n_chars, where docs has it, is counted anew. Null ids and sources,
    repeated rows and no rows: as mix(). Other columns stay as they are.
    """
    _, _, placed, taken = _plan(docs, block, shard, seed, **rule)
    parts = taken.hint("merge").join(pieces(placed, block).hint("merge"), ["sid", "number"]).withColumn("words", _within(F.col("limit"))).where("words > 0")
    key_, two_, rep_, words_, parts_ = unused(docs, "__key", "__two", "__rep", "__words", "__parts")
    parts = parts.groupBy("key", "rep", "turn").agg(F.sum("words").alias(words_), F.array_sort(F.collect_list(F.struct("skip", "words"))).alias(parts_))
    parts = parts.join(placed.select("key", "rep", "size"), ["key", "rep"]).select(F.col("key").alias(key_), F.col("rep").alias(rep_), words_, F.when(F.col(words_) < F.col("size"), F.col(parts_)).alias(parts_))
    key, two = _keys(F.col("doc_id"), F.col("source"), F.col("text"))
    named = _numbered(docs.withColumns({key_: key, two_: two}).where(F.col("text").rlike(WORD)), key_, two_, rep_)
    # The words are bound once for each text: inside the lambda over parts Spark would find them anew for each part.
    spelled = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut_text = F.transform(F.array(spelled), lambda s: F.array_join(F.transform(parts_, lambda p: F.array_join(F.slice(s, (p["skip"] + 1).cast("int"), p["words"].cast("int")), "")), ""))[0]
    joined = named.join(parts, [key_, rep_])
    out = joined.withColumn("text", F.when(F.col(parts_).isNull(), F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
