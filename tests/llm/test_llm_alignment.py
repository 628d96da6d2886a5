"""Operator 11 against a plain alignment, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casebook.llm import alignment
from casebook.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(aligner, library, text):
    """(ids of A, ids of B, groups, links) by the definition."""
    if not text:
        return [], [], [], Counter()
    a, b = library[0].encode(" " + text, add_special_tokens=False).ids, library[1].encode(text)
    raw = (" " + text).encode()
    if b"".join(aligner.bytes_a[i] for i in a) != raw or b"".join(aligner.bytes_b[i] for i in b) != raw:
        return [], [], [], Counter()

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at = out[-1][1]
        return out

    sa, sb = spans(a, aligner.bytes_a), spans(b, aligner.bytes_b)
    groups, low = [], 0
    for e in sorted({x[1] for x in sa} & {x[1] for x in sb}):
        groups.append(tuple(",".join(str(i) for _, z, i in s if low < z <= e) for s in (sa, sb)))
        low = e
    links, j0 = Counter(), 0
    for s, e, i in sa:
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links[i, sb[j][2]] += 1
            j += 1
    return a, b, groups, links


def texts():
    rng = random.Random(11)
    alphabet = "ab é 中文\U0001f600 \n\t'’sS12.,!  ▁<|>ｆ"
    return (["", None, " ", "<|endoftext|> hi", "<s></s><0x41>", "▁x", "a" * 300, " " * 5000 + "x", "word  " * 3, "x" * 3000 + " y"]
            + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)])


def test_alignment_of_odd_texts(aligner, library):
    some = [t or "" for t in texts()]
    for _ in range(2):  # new windows, then remembered ones
        for at in range(0, len(some), 50):
            part = some[at:at + 50]
            n_a, n_b, n_groups, n_links, groups, pair, times, cuts = aligner.align(part)
            for k, t in enumerate(part):
                a, b, g, links = plain(aligner, library, t)
                assert (n_a[k], n_b[k], n_groups[k], n_links[k]) == (len(a), len(b), len(g), sum(links.values())), t
                assert groups[k] == ";".join("|".join(x) for x in g)
                mine = slice(cuts[k], cuts[k + 1])
                assert dict(zip(pair[mine].tolist(), times[mine].tolist())) == {x * 32000 + y: n for (x, y), n in links.items()}


def test_memory_of_windows_is_bounded(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 20)
    some = [f"w{i} other x{i * 7} words" for i in range(300)]
    first = aligner.align(some)[4]
    assert len(aligner.new) < 20 + 4 * 300 and aligner.align(some)[4] == first
    for t in some:
        aligner.align([t])
        assert len(aligner.new) < 40


def test_both_libraries_cut_alike(library, aligner):
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    some = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1'll" for c in points]
    assert aligner.quick is not None
    assert aligner._encode_a(some) == [e.ids for e in library[0].encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("hot", [1 << 18, 20, 0])
def test_scored_against_plain(spark, aligner, library, monkeypatch, hot):
    """Counts over the corpus, with all, some and no pairs met by broadcast."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(3, "the the cat"), (None, "no id"), (None, "no id")]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 400").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("pair", F.lit(1))
    got = Counter(tuple(r) for r in alignment.scored(docs.repartition(3), A, B).collect())
    each = [(i, *plain(aligner, library, t)) for i, t in rows]
    count = Counter()
    for *_, links in each:
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    want = Counter()
    for i, a, b, g, links in each:
        sha = hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if a else ""
        want[i, len(a), len(b), len(g), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[1]]),
             sum(n * count[p] for p, n in links.items()), sha] += 1
    assert got == want


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "word and other words, " * 40000)], "doc_id long, text string")
    got = alignment.scored(docs, A, B).first()
    assert got["n_groups"] >= 5 * 40000 and got["n_links"] >= got["n_groups"]
    assert alignment.scored(docs.limit(0), A, B).collect() == []
