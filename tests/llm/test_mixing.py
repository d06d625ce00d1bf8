"""Source mixing against a layout of every word in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, key string"


def corpus(spark):
    """A source of a third of all rows, tiny sources, repeated rows, null ids and texts, texts that tie in id, size and source."""
    rows = [(i, "w " * (i * 53 % 300), "big" if i % 3 == 0 else f"s{i % 5}", 0, "x") for i in range(90)]
    rows += [(100 + i, "one two three", f"tiny{i}", 0, "x") for i in range(4)]
    rows += [(7, "a b c d", "s1", 0, "x"), (7, "e f g h", "s1", 0, "x"), (7, "e f g h", "s1", 0, "x"), (None, None, None, 0, "x"), (None, None, None, 0, "x"), (None, "n u l l", None, 0, "x"), (8, "", "s2", 0, "x"), (9, " \t\n", "s2", 0, "x"), (9, "word " * 5000, "s3", 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_taken_equals_a_layout_of_all_words(spark):
    docs, block = corpus(spark), 16
    sized = mixing.written(mixing.sizes(docs), "sizes")
    sources = mixing.written(mixing.targets(sized), "sources")
    placed = [r.asDict() for r in mixing.positions(sized, sources, sized.count()).collect()]
    slots = [r.asDict() for r in mixing.slots(sources, block, 4).collect()]
    streams = defaultdict(list)  # each source's words, by the row they belong to
    for r in sorted(placed, key=lambda r: (r["sid"], r["start"])):
        assert len(streams[r["sid"]]) == r["start"]
        streams[r["sid"]] += [(r["doc_id"], r["size"], r["key"], r["rep"])] * r["size"]
    taken, by_source = Counter(), defaultdict(list)
    for s in slots:
        by_source[s["sid"]].append(s)
        taken.update(streams[s["sid"]][s["number"] * block :][:block][: s["limit"]])
    want = Counter((i, size, n) for (i, size, _, _), n in taken.items())
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, block=block, shard=4).where("taken > 0").collect())
    assert got == want
    for r in sources.collect():
        mine = sorted(by_source[r["sid"]], key=lambda s: s["k"])
        assert [s["k"] for s in mine] == list(range(len(mine)))
        stream, blocks = streams[r["sid"]], -(-r["source_size"] // block)
        assert sum(len(stream[s["number"] * block :][:block][: s["limit"]]) for s in mine) == round(r["target"])
        for turn in {s["turn"] for s in mine}:
            numbers = [s["number"] for s in mine if s["turn"] == turn]
            assert len(set(numbers)) == len(numbers) and set(numbers) <= set(range(blocks))
            assert len(numbers) == blocks or turn == max(s["turn"] for s in mine)


def test_small_sources_come_to_their_targets(spark):
    rows = [(i, "a b c d e f g h i j", f"s{i}", 0, "x") for i in range(4)]
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(abs(target - taken) <= 0.5 for target, taken in got.values()) and sum(t for _, t in got.values()) == 60


def test_documents_of_the_mix_hold_the_words_taken(spark):
    docs = corpus(spark)
    got = mixing.mixed_documents(docs, block=16, shard=4)
    assert got.columns == docs.columns
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"], r["source"]].append(words(r["text"]))
    rows = got.collect()
    count = Counter()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and words(r["text"])
        count[r["doc_id"]] += len(words(r["text"]))
        assert any(Counter(words(r["text"])) <= Counter(t) for t in texts[r["doc_id"], r["source"]])
    want = Counter()
    for r in mixing.mix(docs, block=16, shard=4).collect():
        want[r["doc_id"]] += r["taken"]
    assert count == Counter({k: v for k, v in want.items() if v})
    again = mixing.mixed_documents(docs.repartition(5, F.rand(3)), block=16, shard=4).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_running_sums_over_stretches(spark):
    rows = [(g, n, n % 7) for g in range(3) for n in range(50)]
    got = mixing.before(spark.createDataFrame(rows, "g long, n long, v long"), ["g"], "n", "v", "sum", span=8).collect()
    assert len(got) == 150 and all(r["sum"] == sum(x % 7 for x in range(r["n"])) for r in got)
