"""Cases in which an operator did less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

from casebook.llm import extract, fingerprints, jaccard, linededup, mixing
from test_llm_operators import edit_distance, mutate


# -- operator 8: the threshold grows with the line ---------------------------------

@pytest.mark.parametrize("per", [20])
def test_line_threshold_grows(spark, per):
    rng = random.Random(per)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "z"
            for n in (6, 7, 8, 12, 19, 39, 40, 99, 160, 200, 260)]
    texts = [mutate(rng, x, e, "abcdefgh ").strip() or "z" for x in base
             for e in (0, 1, 2, len(x) // per, len(x) // per, len(x) // per + 1, len(x) // per + 2)]
    got = linededup.grown_links(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), per, "doc_id", "text")
    key = {r["key"]: r["line"] for r in linededup.lines_of(spark.createDataFrame([(0, "\n".join(texts))], "doc_id long, text string"),
                                                            "doc_id", "text").collect()}
    got = {tuple(sorted((key[r["a"]], key[r["b"]]))) for r in got.collect()}
    some = sorted(set(texts))
    want = set()
    for i, a in enumerate(some):
        for b in some[i + 1:]:
            n = min(len(a), len(b))
            k = 0 if n < 8 else max(1, n // per)
            if abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k:
                want.add((a, b))
    assert got == want and {len(a) >= 4 * per for a, _ in want} == {True, False}


def line_families(rng, per):
    """Lines in families of variants: chains of edits, words changed, several lengths."""
    out = []
    for n in (9, 30, 150, 210, 330, 540, 820):
        words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))) for _ in range(n // 6)]
        base = " ".join(words)[:n].strip()
        for _ in range(6):
            base = mutate(rng, base, rng.randint(1, max(1, len(base) // per)), "abcdefgh ").strip() or "z"
            out.append(base)
        for _ in range(4):
            other = list(words)
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = "zz" + str(rng.randint(0, 99))
            out.append(" ".join(other)[:n].strip())
    return out


@pytest.mark.parametrize("per", [100, 20])
def test_line_classes_of_families(spark, per):
    """The registered setting and a closer one, with all links and with those that the
    components need, against the edit distance of all pairs."""
    rng = random.Random(per + 1)
    texts = [x for _ in range(3) for x in line_families(rng, per)] + ["same line here"] * 5 + ["", "a", "b"]
    some = sorted({x for x in texts if x})
    root = {x: x for x in some}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, a in enumerate(some):
        for b in some[i + 1:]:
            n = min(len(a), len(b))
            k = 0 if n < 8 else max(1, n // per)
            if k and abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k:
                root[find(b)] = find(a)
                linked += 1
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    first = {}
    for i, x in enumerate(texts):
        if x:
            first.setdefault(find(x), i)
    got = {r["doc_id"]: r["class_doc"] for r in linededup.dedup_lines(docs, per=per).collect()}
    assert linked > 20 and got == {i: first[find(x)] for i, x in enumerate(texts) if x}
    assert linededup.grown_links(docs, per, "doc_id", "text").count() == linked


def test_line_edges(spark):
    long = "a very long line of words that goes on " * 3000
    rows = [(1, None), (2, ""), (3, " \n\n \t"), (4, long + "\nshort"), (5, long[:-7] + "x" + long[-6:]), (6, "Read more of it >\nRead more of it >>"),
            (6, "Read more of it >\nRead more of it >>"), (None, "no id at all here now"), (7, "no id at all here no"), (8, "ünïcode ß Σας 中文 \U0001f600 end"),
            (9, "ünïcode ß Σας 中文 \U0001f600 enb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit("x").alias(c) for c in ("line", "n", "key", "k", "sig", "less", "class", "h0")])
    got = sorted((r["doc_id"] or 0, r["line_no"], r["class_doc"] or 0, r["class_line"], r["kept"]) for r in linededup.dedup_lines(docs.repartition(3)).collect())
    assert got == [(0, 0, 0, 0, True), (3, 2, 3, 2, True), (4, 0, 4, 0, True), (4, 1, 4, 1, True), (5, 0, 4, 0, False), (6, 0, 6, 0, True), (6, 0, 6, 0, True),
                   (6, 1, 6, 0, False), (6, 1, 6, 0, False), (7, 0, 0, 0, False), (8, 0, 8, 0, True), (9, 0, 8, 0, False)]


def test_band_of_a_column_threshold(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        pairs.append((a, mutate(rng, a, rng.randint(0, 14), "abcd") if rng.random() < 0.8 else a[::-1], rng.choice([1, 2, 5, 12, 30])))
    got = spark.createDataFrame(pairs, "x string, y string, k int").select("x", "y", "k", linededup.within("x", "y", "k").alias("near")).collect()
    for r in got:
        assert r["near"] == (edit_distance(r["x"], r["y"]) <= r["k"]), r


def spread(text, k, mark):
    """``text`` with k characters replaced by ``mark``, at equal distances: k edits away."""
    out = list(text)
    for i in range(1, k + 1):
        out[i * len(out) // (k + 1)] = mark
    return "".join(out)


def test_long_lines_at_the_threshold(spark):
    """Lines of 31 to 64 allowed edits, at a power of two as well, moved by their edits or
    with runs as short as edits can leave them."""
    rng = random.Random(8)
    docs, want = [], {}
    for n in (3100, 3199, 6399, 6400):
        base, k = "".join(rng.choice("abcdefgh \u00e9") for _ in range(n - 1)) + "z", n // 100
        base = "y" + base[1:]
        first = len(docs)
        near = [base, "\U0001f600" * k + base, spread(base, k, "\u4e2d")]
        far = ["\u00df" * (k + 3) + base, spread(base, 2 * k + 3, "\u00f1")]
        for i, x in enumerate(near + far):
            want[len(docs)] = first if i < len(near) else len(docs)
            docs.append((len(docs), x))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["class_doc"] for r in got} == want


def test_long_lines_of_a_common_phrase_do_not_meet(spark, monkeypatch):
    """A phrase that stands in all long lines makes no pairs of them."""
    rng = random.Random(9)
    lines = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
        lines.append(" ".join(w + (" the terms of use apply" if i % 10 == 0 else "") for i, w in enumerate(words)))
    met, put = [], linededup.store

    def counted(df, name):
        out = put(df, name)
        met.append(out.count() if name == "lines-met" else 0)
        return out

    monkeypatch.setattr(linededup, "store", counted)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert linededup.grown_links(docs, linededup.PER, "doc_id", "text", False).count() == 0 and sum(met) == 0


def test_notices_and_short_lines_are_near_copies(spark):
    notice = "Published on day 10 of the month, all rights reserved, see the terms on page 20. " * 3 + "Sold at a price of 30 only here"
    docs = [(1, notice + "\nRead more >"), (2, notice.replace("10", "47", 1) + "\nRead more >>"), (3, "Read less")]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("kept").collect()
    assert sorted((r["doc_id"], r["line_no"]) for r in got) == [(1, 0), (1, 1), (3, 0)]


# -- operator 5: whole articles -----------------------------------------------------

FIRST = "<h1>Head</h1><p>" + "first part of a long enough text " * 6 + "</p>"
SECOND = "<p>" + "second part that goes on with more words " * 4 + "</p>"
COMMENTS = "<div class='comments'><p>" + "I do not agree with any of that " * 40 + "</p></div>"


@pytest.mark.parametrize("page", [
    f"<article>{FIRST}</article><article>{SECOND}</article>",
    f"<article>{FIRST}</article><div>{SECOND}</div>",
    f"<div class='layout with-sidebar'>{FIRST}{SECOND}<div class='sidebar'>left out</div></div>",
    f"<form action='/x'><div class='has-banner'><div id='no-comments'>{FIRST}{SECOND}</div></div></form>",
    f"<head><title>t</title><body>{FIRST}{SECOND}",
    f"{FIRST}{SECOND}{COMMENTS}",
    f"<svg class='x'/><title-bar></title-bar>{FIRST}<svg viewBox='0'/>{SECOND}",
])
def test_main_text_is_whole(page):
    text = extract.main_text(f"<html><body><nav><a>menu</a></nav>{page}</body></html>", extract.Weights())
    assert text.split() == ("Head " + "first part of a long enough text " * 6 + "second part that goes on with more words " * 4).split()


@pytest.mark.parametrize("name,kept", [("social-proof", True), ("related-work", True), ("notice-board", True), ("search-results", True),
                                       ("social", False), ("comments-area", False), ("cookie-notice", False), ("ad", False),
                                       ("box ad", False), ("sidebar-left", False), ("site-footer", False)])
def test_class_names_count_whole(name, kept):
    inside = f"<blockquote class='{name}'>a quoted passage of some words here</blockquote>"
    page = f"<html><body><article>{FIRST}{inside}{SECOND}</article></body></html>"
    assert ("quoted passage" in extract.main_text(page, extract.Weights())) == kept


def test_weights_are_learnt_within_bounds(spark):
    page = "<html><body><nav><a>menu</a></nav><article><p>" + "words in it " * 50 + "</p></article></body></html>"
    rows = [(i, page) for i in range(5)] + [(None, page)] + [(9, page + "<!-- " + "x" * 50_000 + " -->")] + [(7, page)] * 400
    pages = spark.createDataFrame(rows, "page_id long, html string")
    whole = extract.fit(pages)
    assert whole.tags and extract.fit(pages, train_chars=2 * len(page)).tags == extract.learn([page] * 2).tags
    assert extract.fit(pages, train_chars=10) == extract.Weights()
    assert extract.fit(pages.repartition(7)) == whole


def test_very_long_page(spark):
    page = f"<html><body><nav>menu</nav><article>{FIRST * 5000}</article></body></html>"
    got = extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), extract.Weights()).first()
    assert got["text"].count("Head") == 5000 and got["text"].count("\n\n") == 9999


# -- pipeline: rows of a NULL or repeated id ------------------------------------------

def test_copies_of_rows_without_an_id(spark):
    rows = ([(None, f"w{i} " * 50, "a") for i in range(30)] + [(7, f"v{i} " * 50, "b") for i in range(20)] + [(8, "same text " * 25, "c")] * 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per_doc = mixing.mix(docs, block_words=8).documents
    want = sum(round(r["taken"] / max(r["size"], 1)) for r in per_doc.collect())
    got = mixing.copies(docs, per_doc)
    assert got.columns == docs.columns and got.count() == want
    # all but one row are taken once: none may take the others with it
    taken = per_doc.selectExpr("doc_id", "source", "digest", "size", "if(row_number() over (order by digest) = 1, 0, size) as taken")
    assert mixing.copies(docs, taken).count() == len(rows) - 1


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, near), (2, near), (2, "a clean text of its own that nobody else has at all"), (2, near), (3, "something else again, also with an own text"),
            (3, "and a second text under the same id, unlike all others")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], rows[2], rows[4], rows[5]])


# -- operator 10: texts without blanks ------------------------------------------------

def test_fingerprints_of_texts_without_blanks(spark):
    rng = random.Random(10)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))
    texts = [han, "。 ".join(han[i:i + 20] for i in range(0, 600, 20)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600)),
             "\t".join(f"w{i}" for i in range(300)), "\n".join(f"w{i}" for i in range(300))]
    df = spark.createDataFrame([(t, t[:-30] + t[:30], han[::-1]) for t in texts], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.fingerprints(df, c, f"f{c}")
    for r in df.select(fingerprints.likeness("fa", "fb").alias("near"), fingerprints.likeness("fa", "fc").alias("far"),
                       F.size(F.array_distinct("fa")).alias("n")).collect():
        assert r["near"] > 0.5 and r["far"] < 0.2 and r["n"] > 40


# -- pipeline: near copies among rows without an id ------------------------------------

def test_one_of_each_compares_rows_without_an_id(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(None, near), (None, near), (None, near + " seventeen"), (3, near + " eighteen"), (None, "a text of its own that nobody else has at all"), (None, None)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[3], rows[4], rows[5]], key=str)
