"""Features of contents: (id, content binary) tables to counts, entropies, strings and fragments.

Bytes and n-grams are counted inside a row, by numpy over Arrow batches: what leaves a row is its distinct grams or its entropies, and
nothing is shuffled but where counts of several rows are added up. Each row is counted by itself; null contents, and those without a gram,
have no row. Grams are upper-case hex.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import count
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a batch that a row function gives back, and blocks that are counted together.
BATCH, BLOCKS = 100_000, 2048


def content_hash(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def per_content(df: DataFrame, keys: list[str], make: Callable[[np.ndarray], dict[str, list]], fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """(keys..., fields...): the rows that make gives for the bytes of each content (a list for each field, all of one length), beside its keys."""
    kinds = dict(df.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, held, count = [], {f: [] for f in fields}, 0

            def flushed() -> pa.RecordBatch:
                columns = [batch.column(i).take(pa.array(np.concatenate(place) if place else np.zeros(0, np.int64))) for i in range(len(keys))]  # noqa: B023
                made = [pa.array(np.concatenate(v) if v else [], t) for v, t in zip(held.values(), fields.values(), strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, *made], [*keys, *fields])

            for n, content in enumerate(batch.column(len(keys))):
                if content.is_valid and len(data := np.frombuffer(content.as_buffer(), np.uint8)):
                    found = make(data)
                    rows = len(next(iter(found.values())))
                    place.append(np.full(rows, n))
                    for f in fields:
                        held[f].append(np.asarray(found[f]))
                    count += rows
                    if count >= BATCH:
                        yield flushed()
                        place, held, count = [], {f: [] for f in fields}, 0
            yield flushed()

    return df.select(*keys, "content").mapInArrow(each, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def codes(data: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """The n-grams (n at most 3) of bytes as integers, one from every step-th place on."""
    places = len(data) - n + 1
    if places <= 0:
        return np.zeros(0, np.int64)
    return sum(data[i : i + places : step].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))


def tallied(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, their counts)."""
    if n == 1 or len(code) > 1 << 14 and n == 2:
        count = np.bincount(code, minlength=1 << 8 * n)
        return np.flatnonzero(count), count[count > 0]
    return np.unique(code, return_counts=True)


def _hexed(code: np.ndarray, n: int) -> np.ndarray:
    return np.array([f"{c:0{2 * n}X}" for c in code.tolist()], object)


def gram_counts(df: DataFrame, n: int = 1, step: int = 1, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """(key, extra..., gram, n): how often each n-gram stands in a content."""

    def make(data: np.ndarray) -> dict:
        code, count = tallied(codes(data, n, step), n)
        return {"gram": _hexed(code, n), "n": count}

    return per_content(df, [key, *(extra or [])], make, {"gram": pa.string(), "n": pa.int64()}, "gram string, n long")


def shannon(counts: np.ndarray) -> np.ndarray:
    """Entropies (base 2) of rows of counts."""
    total = counts.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log2(total) - np.nansum(counts * np.log2(counts), axis=-1) / total


def top_entropy(counts: np.ndarray, k: int) -> np.ndarray:
    """As shannon, over the k largest counts of each row; shares are of all counts."""
    share = -np.sort(-counts, axis=-1)[..., :k] / counts.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(-share * np.log2(share), axis=-1)


def _numbers(df: DataFrame, keys: list[str], make: Callable[[np.ndarray], dict], *names: str) -> DataFrame:
    return per_content(df, keys, make, {n: pa.float64() for n in names}, ", ".join(f"{n} double" for n in names))


def file_entropy(df: DataFrame, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """(key, extra..., entropy) of the bytes of each content."""
    made = _numbers(df, [key, *(extra or [])], lambda data: {"entropy": [shannon(np.bincount(data, minlength=256))]}, "entropy")
    return made.withColumn("entropy", F.round("entropy", 6))


def ngram_entropy(df: DataFrame, n: int, step: int = 1, k: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, entropy) of the n-grams of each content, over the k most frequent ones where k is given."""

    def make(data: np.ndarray) -> dict:
        count = tallied(codes(data, n, step), n)[1]
        return {"entropy": [] if not len(count) else [shannon(count) if k is None else top_entropy(count, k)]}

    return _numbers(df, [key], make, "entropy").withColumn("entropy", F.round("entropy", 6))


def _by_block(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Counts of the byte values in each block of `size` bytes, BLOCKS blocks at a time."""
    for start in range(0, len(data), size * BLOCKS):
        part = data[start : start + size * BLOCKS]
        blocks = -(-len(part) // size)
        yield np.bincount(np.arange(len(part)) // size * 256 + part, minlength=blocks * 256).reshape(blocks, 256)


def block_entropy(df: DataFrame, size: int = 256, skip_uniform: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, blocks, avg_entropy, max_entropy) over blocks of `size` bytes; blocks of which one byte fills half or more are skipped."""

    def make(data: np.ndarray) -> dict:
        found = []
        for counts in _by_block(data, size):
            used = counts[counts.max(1) < 0.5 * counts.sum(1)] if skip_uniform else counts
            found.append(shannon(used))
        each = np.concatenate(found)
        return {"blocks": [len(each)], "avg_entropy": [each.mean()], "max_entropy": [each.max()]} if len(each) else {"blocks": [], "avg_entropy": [], "max_entropy": []}

    made = _numbers(df, [key], make, "blocks", "avg_entropy", "max_entropy")
    return made.select(key, F.col("blocks").cast("long").alias("blocks"), F.round("avg_entropy", 6).alias("avg_entropy"), F.round("max_entropy", 6).alias("max_entropy"))


def weighted_entropy(sections: DataFrame) -> DataFrame:
    """(hash, entropy): mean of section entropies weighted by size, without zero and null ones."""
    used = sections.where((F.col("entropy") > 0) & (F.col("raw_size") > 0))
    return used.groupBy("hash").agg((F.sum(F.col("entropy") * F.col("raw_size")) / F.sum("raw_size")).alias("entropy"))


def topk_part_entropy(df: DataFrame, size: int, k: int, key: str = "doc_id") -> DataFrame:
    """(key, entropy): mean over parts of `size` bytes, those above 0, of the entropy of their k most frequent bytes, each to six places."""

    def make(data: np.ndarray) -> dict:
        each = np.floor(np.concatenate([top_entropy(counts, k) for counts in _by_block(data, size)]) * 1e6 + 0.5) / 1e6
        each = each[each > 0]
        return {"entropy": [each.mean()] if len(each) else []}

    return _numbers(df, [key], make, "entropy")


def joint_entropy(df: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """(group, joint, mean): entropy of the members' bytes taken together, and the mean of their entropies."""
    counts = gram_counts(df, key=key, extra=[group]).groupBy(group, "gram").agg(F.sum("n").alias("n"))
    joint = counts.groupBy(group).agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("joint"))
    mean = file_entropy(df, key, [group]).groupBy(group).agg(F.round(F.avg("entropy"), 5).alias("mean"))
    return joint.join(mean, group)


def gram_distribution(df: DataFrame, n: int, k: int, skip: int = 0, exclude: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """(key, gram, n): the k most common grams of each content after the first `skip`, without the excluded ones; ties by gram."""
    out = np.array(sorted(int(g, 16) for g in exclude), np.int64)

    def make(data: np.ndarray) -> dict:
        code, count = tallied(codes(data, n), n)
        code, count = code[~np.isin(code, out)], count[~np.isin(code, out)]
        chosen = np.lexsort((code, -count))[skip : skip + k]
        return {"gram": _hexed(code[chosen], n), "n": count[chosen]}

    return per_content(df, [key], make, {"gram": pa.string(), "n": pa.int64()}, "gram string, n long")


def bytes_after(content: Column, offset: int, n: int) -> Column:
    """n bytes from offset on as integers, zeros beyond the end."""
    return words_after(content, offset, n, 1)


def words_after(content: Column, offset: int, n: int, width: int) -> Column:
    """n words of `width` bytes each from offset on, the first byte highest; bytes beyond the end are zero."""
    part = F.rpad(F.hex(F.substring(content, offset + 1, n * width)), 2 * n * width, "0")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(part, 2 * width * i + 1, F.lit(2 * width)), 16, 10).cast("int"))


def fragments(content: Column, n: int, size: int, header: int = 0, from_end: bool = False) -> Column:
    """n slices of `size` bytes after the header, or backwards from the end; hex. Slices beyond the content are empty."""
    length = F.octet_length(content)
    if from_end:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(length >= i * size, F.hex(F.substring(content, length - i * size + 1, F.lit(size)))).otherwise(""))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.hex(F.substring(content, header + i * size + 1, F.lit(size))))


def lrc(values: Column) -> Column:
    """Sums, modulo 256, of neighbouring bytes."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: (x + y) % 256)


def strings(content: Column, least: int = 5) -> Column:
    """Runs of at least `least` printable ASCII characters, as they are and in UTF-16LE."""
    text = F.decode(content, "ISO-8859-1")
    plain = F.regexp_extract_all(text, F.lit(f"[ -~]{{{least},}}"), F.lit(0))
    wide = F.regexp_extract_all(text, F.lit(f"(?:[ -~]\\x00){{{least},}}"), F.lit(0))
    return F.concat(plain, F.transform(wide, lambda s: F.replace(s, F.lit("\x00"), F.lit(""))))


def matches(found: Column, pattern: str, distinct: bool = True) -> Column:
    """All matches of pattern in an array of strings."""
    out = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))))
    return F.array_distinct(out) if distinct else out


URL = r"(?i)https?://[a-z0-9./?=_%:-]+"
PATH = r"/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"


def huffman(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Code lengths of symbols by their counts. pairs: (symbol, count) in the order of first appearance, which breaks ties; what has been joined comes after all symbols, the
    earlier joined first. A symbol alone has length 1."""
    heap = [(n, place, (s,)) for place, (s, n) in enumerate(pairs)]
    depth = dict.fromkeys((s for s, _ in pairs), int(len(pairs) == 1))
    heapq.heapify(heap)
    for place in count(len(pairs)):
        if len(heap) < 2:
            return depth
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], place, (*a[2], *b[2])))
    return depth


def by_appearance(data: np.ndarray) -> list[tuple[int, int]]:
    """(byte, count) of the bytes, in the order in which they first stand in data."""
    first = np.full(256, len(data), np.int64)
    first[data[::-1]] = np.arange(len(data) - 1, -1, -1)  # the last one written is the first place
    found = np.bincount(data, minlength=256)
    return [(int(b), int(found[b])) for b in np.argsort(first, kind="stable") if found[b]]


def window_sums(data: np.ndarray, window: int = 32, skip: int = 32) -> np.ndarray:
    """Sums of the Huffman code lengths of bytes over whole windows, one from every skip-th byte on; one sum where there is no whole window."""
    bits = np.zeros(256, np.int64)
    for s, depth in huffman(by_appearance(data)).items():
        bits[s] = depth
    run = np.r_[0, np.cumsum(bits[data])]
    start = np.arange(0, len(data) - window + 1, skip)
    return run[start + window] - run[start] if len(start) else run[-1:]


def _trunk(score: np.ndarray, keep: int) -> np.ndarray:
    """The first and the last values, halves of keep; an odd half goes to the nearest even number."""
    head, tail = round(keep / 2 + 0.5), round(keep / 2)
    return np.r_[np.arange(min(head, len(score))), np.arange(max(0, len(score) - tail) if tail else 0, len(score))]


#: How a profile is pruned to `keep` values: which places of the scaled sums stay, in which order.
PRUNINGS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "first": lambda score, keep: np.arange(min(keep, len(score))),
    "smallest": lambda score, keep: np.argsort(score, kind="stable")[:keep],
    "ordered_smallest": lambda score, keep: np.lexsort((np.arange(len(score)), score))[:keep],
    "trunk": _trunk,
}


def randomness_profile(df: DataFrame, window: int = 32, skip: int = 32, keep: int = 50, pruning: str = "trunk", key: str = "doc_id") -> DataFrame:
    """(key, place, window, score): window sums of Huffman code lengths, scaled by the largest, pruned to `keep`; place counts what stays from 0.

    first: the first windows. trunk: about keep / 2 of the first and of the last, which overlap in a short profile. smallest: the smallest values in ascending
    order. ordered_smallest: the same, those of one value in the order of the windows.
    """
    prune = PRUNINGS[pruning]

    def make(data: np.ndarray) -> dict:
        sums = window_sums(data, window, skip)
        score = sums / sums.max()
        chosen = prune(score, keep)
        return {"place": np.arange(len(chosen)), "window": chosen, "score": score[chosen]}

    made = per_content(df, [key], make, {"place": pa.int64(), "window": pa.int64(), "score": pa.float64()}, "place long, window long, score double")
    return made.withColumn("score", F.round("score", 6))


def one_list(values: np.ndarray) -> np.ndarray:
    """values as the one element of an array of lists."""
    out = np.empty(1, object)
    out[0] = values.tolist()
    return out


def profile_vector(df: DataFrame, keep: int = 50, key: str = "doc_id") -> DataFrame:
    """(key, profile): the trunk of the randomness profile as an array of keep + 1 values, zeros after a short one."""

    def make(data: np.ndarray) -> dict:
        score = (sums := window_sums(data)) / sums.max()
        found = score[PRUNINGS["trunk"](score, keep)]
        return {"profile": one_list(np.r_[found, np.zeros(keep + 1 - len(found))])}

    return per_content(df, [key], make, {"profile": pa.list_(pa.float64())}, "profile array<double>")


def bigram_bins(df: DataFrame, bins: int = 5000, key: str = "doc_id") -> DataFrame:
    """(key, bins, shares): the bigram histogram in hashed bins, as sparse arrays."""

    def make(data: np.ndarray) -> dict:
        hashed = codes(data, 2) * 2_654_435_761 % (1 << 32) % bins
        place, count = np.unique(hashed, return_counts=True)
        return {"bins": one_list(place), "shares": one_list(count / max(1, len(hashed)))}

    return per_content(df, [key], make, {"bins": pa.list_(pa.int32()), "shares": pa.list_(pa.float64())}, "bins array<int>, shares array<double>")


def section_counts(sections: DataFrame, standard: list[str]) -> DataFrame:
    """Per sample: sections, standard ones and their share, by flags, without size, larger in memory than on disk."""
    named = F.col("name").isin(standard)
    return sections.groupBy("hash").agg(
        F.count("*").alias("n"), F.count_if(named).alias("n_standard"), F.round(F.avg(named.cast("int")), 6).alias("standard_ratio"),
        F.count_if("w").alias("n_w"), F.count_if("x").alias("n_x"), F.count_if(F.col("w") & F.col("x")).alias("n_wx"),
        F.count_if(F.col("raw_size") == 0).alias("n_empty"), F.count_if(F.col("virtual_size") > F.col("raw_size")).alias("n_grown"),
    )


def slack(sections: DataFrame, least: int) -> DataFrame:
    """Per sample: bytes of slack (raw over virtual size), sections that grow by at least `least`, any of them."""
    return sections.groupBy("hash").agg(F.sum(F.greatest(F.lit(0), F.col("raw_size") - F.col("virtual_size"))).alias("slack"), F.count_if(F.col("virtual_size") - F.col("raw_size") >= least).alias("n_slack"), F.bool_or(F.col("virtual_size") - F.col("raw_size") >= least).alias("has_slack"))


def portability(rules: dict[str, float]) -> Column:
    """1 minus the penalties of the rules that hold, within [0, 1]."""
    total = reduce(lambda a, b: a + b, (F.when(F.expr(rule), penalty).otherwise(0.0) for rule, penalty in rules.items()))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total)), 3)


def sequence_grams(df: DataFrame, values: str, n: int, key: str) -> DataFrame:
    """(key, gram, n): n-grams of an array column, joined by spaces, counted."""
    spread = df.where(F.size(values) >= n).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(values) - (n - 1)), lambda i: F.array_join(F.slice(F.col(values), i, n), " "))).alias("gram"))
    return spread.groupBy(key, "gram").agg(F.count("*").alias("n"))


def token_groups(df: DataFrame, column: str, groups: dict[str, list[str]], key: str, split: str = r"[,+*\[\]\- ]+") -> DataFrame:
    """(key, one count for each group): tokens of a text column that belong to each group."""
    tokens = df.select(key, F.explode(F.split(F.col(column), split)).alias("t"))
    return tokens.groupBy(key).agg(*(F.count_if(F.col("t").isin(v)).alias(k) for k, v in groups.items()))


def jumps(df: DataFrame, mnemonic: str, operand: str, names: list[str], key: str) -> DataFrame:
    """(key, n_jumps, n_indirect): jumps, and those whose operand is no fixed address."""
    jump = F.col(mnemonic).isin(names)
    return df.groupBy(key).agg(F.count_if(jump).alias("n_jumps"), F.count_if(jump & ~F.startswith(F.col(operand), F.lit("0x"))).alias("n_indirect"))


#: Fixed values of the ELF header after its 16 ident bytes: field, and its size in the 32-bit and the 64-bit layout.
ELF = (("e_type", 2, 2), ("e_machine", 2, 2), ("e_version", 4, 4), ("e_entry", 4, 8), ("e_phoff", 4, 8), ("e_shoff", 4, 8), ("e_flags", 4, 4), ("e_ehsize", 2, 2), ("e_phentsize", 2, 2), ("e_phnum", 2, 2), ("e_shentsize", 2, 2), ("e_shnum", 2, 2), ("e_shstrndx", 2, 2))


def elf_header(content: Column) -> list[Column]:
    """The ident bytes' class, byte order and version, their sum, and the header's fields, as doubles.

    Byte 5 of a header says which layout it has (1: 32-bit, else 64-bit), byte 6 its byte order (2: the highest byte first, else the lowest).
    """
    byte = lambda i: F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int")

    def number(offset: int, size: int, high_first: bool) -> Column:
        raw = F.hex(F.substring(content, offset + 1, size))
        if not high_first:
            raw = F.concat(*(F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))))
        return F.conv(raw, 16, 10).cast("decimal(20,0)").cast("double")

    def field(place: int) -> Column:
        narrow, wide = (16 + sum(f[k] for f in ELF[:place]) for k in (1, 2))
        order = lambda offset, size: F.when(byte(6) == 2, number(offset, size, True)).otherwise(number(offset, size, False))
        return F.when(byte(5) == 1, order(narrow, ELF[place][1])).otherwise(order(wide, ELF[place][2]))

    ident = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), lambda a, i: a + F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("int"))
    return [ident.alias("e_ident"), byte(5).alias("ei_class"), byte(6).alias("ei_data"), byte(7).alias("ei_version"), *(field(n).alias(f[0]) for n, f in enumerate(ELF))]


def unpacked(vector: Column) -> Column:
    """A raw vector with -1 as null."""
    return F.transform(vector, lambda x: F.nullif(x, F.lit(-1.0)))


