"""Operator 12: periodic runs of words, by an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  The words of a slice of documents become one suffix array (prefix
doubling; documents never share an interval) with its inverse ISA and its LCP
table.  At each border of an LCP interval of depth d the suffixes of the smaller
child look up ISA[i + d] and ISA[i - d]: a place among the other children is a
square of period d whose next word differs.  The square, rotated to the left as
far as its words repeat, is the run that it closes; squares of multiples of the
period give the same stretch and are merged into the smallest.  Children are
ranges of the suffix array, found by range minima of the LCP table: there are no
tree nodes.

A word of a run of e periods occurs e times in its document, so rarer words cut
documents into stretches first, and stretches too short for a run are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import SPACE_WORD, bounded_batches, pick, slices, text_or_empty

#: Characters of the documents whose suffix array is built together (one longer
#: document stands alone), and look-ups made together.
SLICE_CHARS, LOOKUPS = 1 << 21, 1 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _stretches(codes: np.ndarray, doc: np.ndarray, least: int, min_length: int) -> np.ndarray:
    """Places (ascending) of words in stretches of at least ``min_length`` words that
    each occur ``least`` times or more in their stretch; the cut is repeated while
    it takes off a tenth."""
    at, part = np.arange(len(codes)), doc
    while len(at):
        key, _ = pd.factorize(part * (int(codes.max()) + 1) + codes[at])
        often = np.bincount(key)[key] >= least
        kept, of = at[often], part[often]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (of[1:] != of[:-1])
        number = np.cumsum(new) - 1
        long = np.bincount(number, minlength=1)[number] >= min_length if len(kept) else np.zeros(0, bool)
        before, at, part = len(at), kept[long], number[long]
        if len(at) > 0.9 * before:
            break
    return at


def _suffixes(words: np.ndarray, part: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the parts and, for each level j with equal ones, the rank of
    every suffix by its first 2**j words (equal ranks: equal words)."""
    n = len(words)
    key = part * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ks = key[order]
    head = np.zeros(n, np.int64)
    head[1:] = np.where(ks[1:] != ks[:-1], np.arange(1, n), 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(head)
    tied = order[np.bincount(rank, minlength=n)[rank[order]] > 1]
    levels, h = [], 1
    while len(tied):
        levels.append(rank.astype(np.int32))
        ahead = tied + h
        inside = ahead < end[tied]
        key = rank[tied] * (n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        t, ks, old = tied[o], key[o], rank[tied[o]]
        index = np.arange(len(t))
        first, differs = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        first[1:] = np.where(old[1:] != old[:-1], index[1:], 0)
        differs[1:] = np.where(ks[1:] != ks[:-1], index[1:], 0)
        rank = rank.copy()
        rank[t] = new = old + np.maximum.accumulate(differs) - np.maximum.accumulate(first)
        single = np.ones(len(t) + 1, bool)
        single[1:-1] = new[1:] != new[:-1]
        tied = t[~(single[:-1] & single[1:])]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j (of one part) have in common."""
    n, out = len(end), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + out, j + out
        same = (a < end[i]) & (b < end[j])
        same &= levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        out += same.astype(np.int64) << level
    return out


def find_runs(words: np.ndarray, part: np.ndarray, min_length: int, min_exponent: int):
    """Runs of at least ``min_length`` words and ``min_exponent`` (2 or more) periods in
    ``words``, whose part numbers ascend: (start, length, period), by start and period."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if not n:
        return none, none, none
    edge = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    sizes = np.diff(edge, append=n)
    begin, end = np.repeat(edge, sizes), np.repeat(edge + sizes, sizes)
    sa, levels = _suffixes(words, part, end)
    if not levels:
        return none, none, none
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    # depth[k]: words that the k-th suffix shares with the one before it
    depth = np.zeros(n, np.int64)
    k = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    depth[k] = _common(levels, sa[k - 1], sa[k], end)
    # minima of depth over 2**j places, as far as no document has a wider interval
    stretch = np.flatnonzero(np.diff(np.concatenate([[0], depth > 0, [0]]).astype(np.int8)))
    widest = int((stretch[1::2] - stretch[::2]).max())
    minima = [depth]
    while 1 << len(minima) <= widest:
        low, half = minima[-1], 1 << (len(minima) - 1)
        up = np.zeros(n, np.int64)
        if half < n:
            up[:n - half] = np.minimum(low[:n - half], low[half:])
        minima.append(up)
    k = k[depth[k] * min_exponent <= (end - begin)[sa[k]]]
    d = depth[k]
    left, right = k.copy(), k + 1
    for j in range(len(minima) - 1, -1, -1):
        step = 1 << j
        ok = left >= step
        ok &= minima[j][np.maximum(left - step, 0)] >= d
        left -= ok * step
        ok = right < n
        ok &= minima[j][np.minimum(right, n - 1)] > d
        right += ok * step
    left -= 1  # the children before the border are left..k-1, the one after it k..right-1
    small = k - left <= right - k
    lo, count = np.where(small, left, k), np.where(small, k - left, right - k)
    other_lo, other_hi = np.where(small, k, left), np.where(small, right, k)
    upto = np.cumsum(count)
    at_parts, period_parts, row = [], [], 0
    while row < len(k):
        to = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + LOOKUPS, "right")))
        c = count[row:to]
        which = np.repeat(np.arange(row, to), c)
        i = sa[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)]
        q = d[which]
        for place, inside in ((i + q, i + q < end[i]), (i - q, i - q >= begin[i])):
            there = isa[np.clip(place, 0, n - 1)]
            hit = inside & (there >= other_lo[which]) & (there < other_hi[which])
            at_parts.append(np.minimum(i, place)[hit])
            period_parts.append(q[hit])
        row = to
    at, period = np.concatenate(at_parts or [none]), np.concatenate(period_parts or [none])
    # rotate: as many words before the square repeat a period later
    back = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        p = at - back - (1 << level)
        same = (p >= begin[at]) & (levels[level][np.maximum(p, 0)] == levels[level][np.maximum(p, 0) + period])
        back += same.astype(np.int64) << level
    start, stop = at - back, at + 2 * period
    o = np.lexsort((period, stop, start))
    start, stop, period = start[o], stop[o], period[o]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    keep &= stop - start >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[keep], (stop - start)[keep], period[keep]
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def runs_of(texts: list[str], min_length: int, min_exponent: int) -> list[tuple]:
    """For each text: number of words, its runs and what is left when each run keeps
    only its first period, joined by single blanks."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    found: dict[int, list] = {}
    if sizes.sum():
        codes, _ = pd.factorize(np.array([x for w in words for x in w], dtype=object))
        doc = np.repeat(np.arange(len(words)), sizes)
        at = _stretches(codes, doc, min_exponent, min_length)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
        for s, length, q in zip(*(x.tolist() for x in find_runs(codes[at], np.cumsum(new), min_length, min_exponent))):
            place = int(at[s])
            d = int(doc[place])
            found.setdefault(d, []).append((place - int(first[d]), length, q))
    out = []
    for d, w in enumerate(words):
        runs = found.get(d, [])
        if runs:
            kept = np.ones(len(w), bool)
            for s, length, q in runs:
                kept[s + q:s + length] = False
            w = [w[i] for i in np.flatnonzero(kept).tolist()]
        out.append((int(sizes[d]), runs, b" ".join(w).decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  min_exponent: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length and period, in
    words, by start and then period) and collapsed, the text's words without those
    that a run holds after its first period, joined by single blanks.

    Words are separated by ASCII white space.  NULL and empty texts have no words, no
    runs and the empty collapsed text; NULL ids and repeated rows are rows like all
    others; an empty table gives no rows.  A document is handled whole, whatever its
    length.  ``min_exponent`` is at least 2."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once: min_exponent >= 2")
    bounded_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            for part in slices(pdf, SLICE_CHARS):
                got = runs_of(part["text"].tolist(), min_length, min_exponent)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "n_words": [g[0] for g in got],
                    "runs": [[{"start": s, "length": m, "period": q} for s, m, q in g[1]] for g in got],
                    "collapsed": [g[2] for g in got]})

    base = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.mapInPandas(run, RUNS)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``docs`` in which a tenth of the documents repeat a passage to
    their end: with h = crc32 of the decimal id and h % 10 = 0, word i >= a of n becomes
    word a + (i - a) % p, where g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    Other texts, and those of NULL ids, stay as they are."""
    words = F.expr(f"regexp_extract_all(text, r'{SPACE_WORD}', 0)")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    base = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(h, F.lit(-1)).alias("h"))
    base = base.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    base = base.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    base = base.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    base = base.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")).withColumn("a", F.col("a").cast("int"))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, a + (i - a) % p + 1))), ' ')")
    return base.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` as figures: number of runs, the greatest one
    (ties: smallest start, then period) and hashes of the runs and of what is left."""
    def of(field: str) -> Column:
        return F.col(f"top.{field}")

    top = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-of("start")).alias("start"), of("length").alias("length"),
        (-of("period")).alias("period"), F.expr("cast(1000 * top.length div -top.period as long)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
