"""Operator 12 against runs found period by period."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from casebook.llm import periods
from casebook.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, min_length, min_exponent):
    """Stretches by period: for each q the maximal stretches whose words repeat q later."""
    smallest = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                smallest.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items() if e - s >= max(min_length, min_exponent * q))


def left_over(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["ab", "abc", "a", "abcdefgh"])
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
        if words and rng.random() < 0.6:
            words += words[-rng.randint(1, len(words)):] * rng.randint(1, 6)
            words += [rng.choice(alphabet) for _ in range(rng.randint(0, 5))]
        yield " ".join(words)


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_random_texts(min_length, min_exponent):
    texts = list(random_texts(min_exponent, 1500))
    for at in range(0, len(texts), 7):
        part = texts[at:at + 7]
        for t, (n, runs, rest) in zip(part, periods.runs_of(part, min_length, min_exponent)):
            assert n == len(t.split()) and runs == plain_runs(t.split(), min_length, min_exponent), t
            assert rest == left_over(t.split(), runs)


def test_fibonacci_and_long_repeats():
    a, b = "a", "a b"
    for _ in range(12):
        a, b = b, f"{b} {a}"
    nested = " ".join((["x", "x", "y"] * 5 + ["z"]) * 40)
    for t in (b, nested, "w " * 3000, "one two three " * 2000 + "end"):
        words = t.split()[:3000]
        got = periods.runs_of([" ".join(words)], 2, 2)[0][1]
        assert got == plain_runs(words, 2, 2)


def test_query_against_plain(spark):
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        words = [w.decode() for w in words]
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue
        runs = plain_runs(words, 6, 4)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left_over(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 7), (4, "a " * 7), (None, "b c " * 5), (5, "a a a a a"),
            (6, "a\x0bb\x0ca\x0bb a b a b  x"), (7, "long text of words " * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("runs", "words", "n", "h", "a", "p", "g", "collapsed", "n_words")])
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs.repartition(3)).collect())
    assert got == [(0, [(0, 10, 2)], "b c"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 7, 1)], "a"), (4, [(0, 7, 1)], "a"),
                   (5, [], "a a a a a"), (6, [(0, 8, 2)], "a b  x"), (7, [(0, 400000, 4)], "long text of words")]
    assert periods.digests(periods.periodic_runs(periods.looped(docs))).count() == len(rows)
    assert periods.digests(periods.periodic_runs(periods.looped(docs.limit(0)))).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, min_exponent=1)
