"""Operator 6: benchmark decontamination by an FM-index per training shard.

Words of the benchmark are an alphabet; all other words are one symbol that no
phrase holds, so only runs of alphabet words as long as the shortest phrase can
hold an occurrence.  The runs of a shard's documents, with a border after each,
are one text: its suffix array gives the Burrows-Wheeler transform, kept as a
wavelet matrix with rank directories, and every n-th suffix position.  All test
phrases are searched backwards at once; each occurrence walks back to a sampled
position.  Spans of a document that touch or overlap are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import LOWER_ALNUM, bounded_batches, pick, text_or_empty

WINDOW = 13
#: Symbols of a shard's text; a longer run makes a larger shard.
SHARD_SYMBOLS = 1 << 20
#: Benchmark words searched in one pass over the documents.
PASS_WORDS = 2_000_000
#: Stands for a missing item id while the search runs.
NO_ID = -(1 << 63)


def words(text: str) -> list[bytes]:
    """Lower-case A-Z, then maximal runs of 0-9, a-z and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split()


class WaveletMatrix:
    """Rank over a sequence of symbols below 2**levels, one bit vector a level,
    with a count of ones before each 64 positions."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n, self.bits, self.before, self.zeros = levels, len(seq), [], [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = (cur >> level) & 1
            padded = np.zeros(-(-(len(seq) + 1) // 64) * 64, np.uint8)
            padded[:len(seq)] = bit
            word = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).astype(np.int64)
            self.bits.append(word)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(seq) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at >> 6] + np.bitwise_count(self.bits[level][at >> 6] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position at[i]."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            l1, h1 = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + l1, lo - l1)
            hi = np.where(one, self.zeros[k] + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            one = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, at)
            out = out << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of 1, 2, 4 ... symbols until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        key = (rank * (n + 1) + second)[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, k = new, 2 * k
        if rank.max() == n - 1 or k >= n:
            return order


class FMIndex:
    """Of a text of symbols from 1; a 0, the smallest, is put at its end."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        text = np.concatenate([text, [0]]).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.marked = sa % sample == 0
        self.sampled = np.where(self.marked, sa, 0)[self.marked]
        self.mark_rank = np.cumsum(self.marked) - self.marked

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases of one length (a row each)."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.wavelet.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = phrases[live, j]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[at[left]]
            got = left[done]
            out[got] = self.sampled[self.mark_rank[at[got]]] + steps[got]
            left = left[~done]
            if len(left):
                c = self.wavelet.access(at[left])
                at[left] = self.first[c] + self.wavelet.rank(c, at[left])
                steps[left] += 1
        return out


def _phrases(items: pd.DataFrame, window: int):
    """Alphabet, and by length the distinct phrases with the items that have them."""
    alphabet: dict[bytes, int] = {}
    found: dict[tuple, set[int]] = {}
    for i, text in zip(items["item_id"], items["text"]):
        seq = [alphabet.setdefault(w, len(alphabet) + 2) for w in words(text or "")]  # 1: a border
        if seq:
            size = min(window, len(seq))
            for k in range(len(seq) - size + 1):
                found.setdefault(tuple(seq[k:k + size]), set()).add(int(i))
    by_size: dict[int, tuple[list, list]] = {}
    for phrase, owners in found.items():
        a, b = by_size.setdefault(len(phrase), ([], []))
        a.append(phrase)
        b.append(sorted(owners))
    return alphabet, {k: (np.array(a, np.int64), b) for k, (a, b) in by_size.items()}


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [x[0] for x in out], [x[1] for x in out]


SPANS = "row long, doc_id long, text_hash long, n_words long, starts array<long>, ends array<long>, items array<long>"


def _search(docs: DataFrame, items: pd.DataFrame, window: int, shard_symbols: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_phrases(items, window))

    def shard(held, alphabet, phrases):
        """held: (row, doc_id, text_hash, n_words, runs of (first word, symbols))."""
        starts = {k: ([], [], []) for k in range(len(held))}
        parts, origin, where = [], [], []
        for k, (*_, runs) in enumerate(held):
            for first, symbols in runs:
                parts += [symbols, [1]]
                origin.append((k, first))
                where.append(len(symbols) + 1)
        if parts:
            text = np.concatenate(parts).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(where)])
            fm = FMIndex(text, len(alphabet) + 1)
            for size, (rows, owners) in phrases.items():
                lo, hi = fm.search(rows)
                hit = np.flatnonzero(hi > lo)
                count = (hi - lo)[hit]
                sa_rows = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                places = fm.locate(sa_rows)
                run = np.searchsorted(begin, places, side="right") - 1
                for p, r, which in zip(places.tolist(), run.tolist(), np.repeat(hit, count).tolist()):
                    k, first = origin[r]
                    at = first + p - int(begin[r])
                    s = starts[k]
                    s[0].append(at)
                    s[1].append(at + size)
                    s[2].append((size, which))
        rows_out = []
        for k, (row, doc, text_hash, n, _) in enumerate(held):
            a, b, which = starts[k]
            a, b = _merge(np.array(a, np.int64), np.array(b, np.int64)) if a else ([], [])
            hit_items = sorted({i for size, w in set(which) for i in phrases[size][1][w]})
            rows_out.append((row, doc, text_hash, n, a, b, hit_items))
        return pd.DataFrame(rows_out, columns=["row", "doc_id", "text_hash", "n_words", "starts", "ends", "items"]).astype({"doc_id": "Int64"})

    def run(batches):
        alphabet, phrases = shared.value
        least = min(phrases, default=1)
        get = alphabet.get
        held, symbols = [], 0
        for pdf in batches:
            for row, doc, text, text_hash in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["text_hash"]):
                ws = words(text)
                seq = np.array([get(w, 0) for w in ws], np.int64)
                runs = []
                if len(seq) >= least:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], seq > 0, [0]]).astype(np.int8)))
                    runs = [(int(a), seq[a:b]) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]
                held.append((row, None if pd.isna(doc) else int(doc), text_hash, len(ws), runs))
                symbols += sum(len(s) + 1 for _, s in runs) + 8
                if symbols >= shard_symbols:
                    yield shard(held, alphabet, phrases)
                    held, symbols = [], 0
        if held:
            yield shard(held, alphabet, phrases)

    return docs.mapInPandas(run, SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS, pass_words: int = PASS_WORDS,
                  keep_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, starts, ends (merged word
    spans to remove), items (ids of the benchmark items with an occurring window),
    n_hit, n_items, items_sha256, contaminated.

    An item's windows are its runs of ``window`` words; an item of fewer words is
    one window; items and documents without words have none.  NULL texts are
    empty; a NULL doc_id is kept; repeated rows are rows of their own.  Items without
    an id are one item: it counts in n_hit and n_items, is NULL in items and has no
    name in items_sha256.  The benchmark is searched in passes of about ``pass_words`` words, each small enough
    to send to every task, so it may be of any size; an empty one hits nothing.
    """
    items = pick(benchmark, item_id="item_id", text="text").select(
        F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), text_or_empty().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // (5 * pass_words)))
    bounded_batches(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        (F.xxhash64(text_or_empty()) if keep_hash else F.lit(0).cast("long")).alias("text_hash"))
    found = None
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toPandas()
        one = _search(base, part, window, shard_symbols)
        found = one if found is None else found.unionAll(one)
    if passes > 1:
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
                                         F.flatten(F.collect_list("starts")).alias("starts"),
                                         F.flatten(F.collect_list("ends")).alias("ends"),
                                         F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        # merge the spans of the passes: a running end over the spans in order
        spans = F.expr("""aggregate(array_sort(arrays_zip(starts, ends)), cast(array() as array<struct<starts:bigint,ends:bigint>>),
            (acc, s) -> if(size(acc) > 0 and s.starts <= get(acc, size(acc) - 1).ends,
                concat(slice(acc, 1, size(acc) - 1), array(named_struct('starts', get(acc, size(acc) - 1).starts,
                    'ends', greatest(s.ends, get(acc, size(acc) - 1).ends)))),
                concat(acc, array(s))))""")
        found = found.withColumn("spans", spans).withColumn("starts", F.col("spans.starts")).withColumn("ends", F.col("spans.ends"))
    found = found.withColumn("items", F.transform("items", lambda x: F.when(x != NO_ID, x)))
    hit = F.expr("aggregate(arrays_zip(starts, ends), 0L, (n, s) -> n + s.ends - s.starts)")
    names = F.array_join(F.array_sort(F.transform(F.array_compact("items"), lambda x: x.cast("string"))), ",")
    return (found.withColumn("n_hit", hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(names, 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    "starts", "ends", "items", *["text_hash"] * keep_hash))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated (rows go by id and text)."""
    bad = (contamination(docs, benchmark, id_col, text_col, keep_hash=True, **options).where("contaminated")
           .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
                     & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("__hash")), "left_anti")
