"""Many patterns at once, against one after another; generators from SQL."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import content, generators
from assaylake.operators import patterns, voting


@pytest.mark.parametrize(
    ("pattern", "held"),
    [("upx", "upx"), ("upx[0-9]+packer", "packer"), ("a|b", ""), ("(abc)+d", "abc"), ("(abc)*de", "de"), ("x?yz", "yz"), ("(?i)abc", ""), ("a.bcd.e", "bcd"), ("^themida$", "themida"), ("", ""), ("(?:as)pack", "aspack"), (r"mew\.11", "mew.11"), ("a{2,3}bc", "bc"), ("(?!no)yes", "yes")],
)
def test_literals_of_patterns(pattern, held):
    assert patterns.literal(pattern) == held


def test_a_thousand_aliases_equal_the_chain(spark, monkeypatch):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdex"), rng.integers(2, 5)))
    forms = [lambda: word(), lambda: f"{word()}[0-9]+", lambda: f"^{word()}", lambda: f"({word()}|{word()}){word()}", lambda: f"{word()}.{word()}", lambda: "[0-9]{3}" + word(), lambda: f"{word()}|{word()}1"]
    aliases = {}
    while len(aliases) < 1000:
        aliases[forms[len(aliases) % len(forms)]()] = f"f{rng.integers(0, 40)}"
    lines = [(int(rng.integers(0, 30)), " ".join(word() + str(rng.integers(0, 999)) for _ in range(rng.integers(0, 6)))) for _ in range(400)] + [(77, None), (78, " "), (79, "zzz")]
    told = patterns.Patterns(aliases)
    for _, line in lines:
        if line is not None:
            want = list(dict.fromkeys(name for p, name in aliases.items() if re.search(p, line)))
            assert told.names(line) == want
    df = spark.createDataFrame(lines, "hash int, line string")
    few = dict(list(aliases.items())[:60])
    got = sorted(map(tuple, voting.normalise_output(df, few).collect()))
    monkeypatch.setattr(voting, "MANY", 10_000)
    assert got == sorted(map(tuple, voting.normalise_output(df, few).collect())) and {r[0]: r[1] for r in got}[78] == "-"


def test_cost_does_not_grow_with_the_aliases():
    text = "the quick brown fox jumps over the lazy dog " * 20

    def spent(n):
        told = patterns.Patterns({f"packer{k}v[0-9]": f"p{k}" for k in range(n)})
        best = 9.0
        for _ in range(5):
            began = time.perf_counter()
            for _ in range(50):
                told.names(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert spent(2000) < 5 * spent(20)


def test_generators_from_sql(spark):
    generators.register(spark)
    rows = [(1, bytes(range(40))), (2, b""), (3, None), (4, b"abc")]
    df = spark.createDataFrame(rows, "doc_id long, content binary")
    got = spark.sql("SELECT doc_id, place, fragment FROM fragments(TABLE(SELECT * FROM {df}), 3, 16, 2)", df=df).collect()
    want = df.where("content is not null").select("doc_id", F.posexplode(content.fragments(F.col("content"), 3, 16, 2)).alias("place", "fragment")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 9
    tokens = spark.createDataFrame([(h, n, f"t{(n * 7 + h) % 3}") for h in (1, 2, 3) for n in range(5 if h < 3 else 1)], "hash long, n int, token string").orderBy("token")
    got = spark.sql("SELECT hash, gram FROM token_grams(TABLE(SELECT * FROM {t}) PARTITION BY hash ORDER BY (n), 2)", t=tokens).collect()
    assert sorted(map(tuple, got)) == sorted((h, f"t{(n * 7 + h) % 3} t{((n + 1) * 7 + h) % 3}") for h in (1, 2) for n in range(4))
