"""Operator 11: alignment of two tokenizers' tokens, by whitespace-token anchors.

Both tokenizers encode the whole text, behind one blank.  Where the joined bytes of
both are that text again, byte offsets at which a token of each ends and the next
tokens begin with a blank are anchors: they cut the document into windows, one per
word as a rule.  A window is known by its two tuples of token ids, and what is worked
out for it - groups between shared ends, pairs of tokens whose bytes overlap - is kept
for the next window of the same ids.  Counts of the pairs over the corpus follow from
the pairs of each document.
"""

from __future__ import annotations

import json
import os
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import bounded_batches, pick, store
from casebook.llm.tokens import _byte_letters

#: Windows a worker remembers (when so many new ones have come, the older half goes),
#: tokens of a window worth remembering, and characters encoded together.
MEMO, MEMO_TOKENS, SLICE_CHARS = 150_000, 64, 1 << 20
#: White space of so many characters is too long for the faster library.
LONG_BLANK = 2_000
WIDE = re.compile(r"\s{%d}" % LONG_BLANK)
#: Pairs whose counts are sent to every task at most; the others are joined.
HOT_PAIRS = 1 << 18

#: FIXED VALUES: the pre-token rule of byte-level files.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: FIXED VALUES (end)

SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<long>, times array<long>")


class Aligner:
    """Tokens of both tokenizers and their alignment; one per worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes([byte_of[c] for c in token])
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank_a, self.blank_b = (np.array([x.startswith(b" ") for x in t]) for t in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.small = "<u2" if max(n_a, n_b) < 1 << 16 else "<u4"
        # ids as text, within a group and at the end of its A and B part
        self.spelt = [f"{i}{c}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)]
        self.spelt_size = np.array([len(x) for x in self.spelt], np.int64)
        self.quick = self._quick(json.loads(self.a.to_str()))
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def _quick(self, spec: dict):
        """The same tokenizer for the faster library, where the file has the plain
        byte-level form: each merge makes the next id.  None for other files."""
        vocab, merges, pre = spec["model"]["vocab"], spec["model"].get("merges", []), spec.get("pre_tokenizer") or {}
        plain = [i for t, i in vocab.items() if len(t) == 1]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if (spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
                or pre.get("add_prefix_space") or sorted(plain) != list(range(256)) or made != list(range(256, 256 + len(made)))):
            return None
        import tiktoken
        return tiktoken.Encoding("A", pat_str=PIECE, mergeable_ranks={self.bytes_a[i]: i for i in range(256 + len(made))}, special_tokens={})

    def _encode_a(self, spaced: list[str]) -> list[list[int]]:
        """Ids by A; texts with very long white space go to the slower library."""
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return [self.a.encode(t, add_special_tokens=False).ids if len(t) > LONG_BLANK and WIDE.search(t)
                else self.quick.encode_ordinary(t) for t in spaced]

    def work_out(self, a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray) -> list[tuple[int, str, bytes]]:
        """For each window - the next ``many_a`` ids of ``a``, the next ``many_b`` of ``b`` -
        (number of groups, the groups as text, the linked pairs as 64-bit integers
        a * (size of B's vocabulary) + b).  Between two ends of tokens one token of each
        covers the bytes: that is one link."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros(int(end_a[-1]) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = mark[mark > 0]
        is_a, is_b = ends & 1, ends >> 1
        of_a = (np.cumsum(is_a, dtype=np.int64) - is_a).astype(np.int64)
        of_b = (np.cumsum(is_b, dtype=np.int64) - is_b).astype(np.int64)
        pairs = (a[of_a] * len(self.bytes_b) + b[of_b]).tobytes()
        window_of_a = np.repeat(np.arange(len(many_a)), many_a)
        upto_links = (8 * np.cumsum(np.bincount(window_of_a[of_a], minlength=len(many_a)))).tolist()
        last_a, last_b = mark[end_a] == 3, mark[end_b] == 3  # the last tokens of their groups
        n_groups = np.bincount(window_of_a[last_a], minlength=len(many_a)).tolist()
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        piece = np.empty(len(a) + len(b), np.int64)  # a group's ids of A, then its ids of B
        piece[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + last_a * len(self.bytes_a)
        piece[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)
        text = "".join(map(self.spelt.__getitem__, piece.tolist()))
        upto_text = np.cumsum(self.spelt_size[piece])[np.cumsum(many_a + many_b) - 1].tolist()
        out, at, c = [], 0, 0
        for g, to, d in zip(n_groups, upto_links, upto_text):
            out.append((g, text[c:d - 1], pairs[at:to]))
            at, c = to, d
        return out

    def _fill(self, found: list, keys: list[bytes], a, stop_a, b, stop_b) -> None:
        """Work out the windows that ``found`` lacks, each distinct one once, and keep them."""
        fresh: dict[bytes, int] = {}
        lacking = [i for i, got in enumerate(found) if got is None]
        for i in lacking:
            if keys[i] not in self.new and keys[i] not in fresh:
                got = self.old.get(keys[i])
                if got is None:
                    fresh[keys[i]] = i
                else:
                    self.new[keys[i]] = got
        some = {}
        if fresh:
            at = np.fromiter(fresh.values(), np.int64, len(fresh))
            ids, many = [], []
            for x, stop in ((a, stop_a), (b, stop_b)):
                start = np.concatenate([[0], stop[:-1]])[at]
                many.append(stop[at] - start)
                ids.append(x[np.repeat(start - np.cumsum(many[-1]) + many[-1], many[-1]) + np.arange(int(many[-1].sum()))])
            some = dict(zip(fresh, self.work_out(ids[0], many[0], ids[1], many[1])))
        for i in lacking:
            got = some.get(keys[i])
            found[i] = self.new[keys[i]] if got is None else got
        width = MEMO_TOKENS * (2 if self.small == "<u2" else 4)
        self.new.update({k: v for k, v in some.items() if len(k) <= width})
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}

    def align(self, texts: list[str]) -> tuple:
        """(n_a, n_b, n_groups, n_links: arrays; groups: texts; pair, times: arrays; cuts:
        where each text's pairs begin) of the texts; all 0 for those that aren't aligned."""
        n = len(texts)
        spaced = [" " + t for t in texts]
        got_a = self._encode_a(spaced)
        got_b = self.b.encode(texts, out_type=int, num_threads=1)
        ok = []
        for i, t in enumerate(spaced):
            raw = t.encode("utf-8", "surrogatepass")
            if (len(t) > 1 and b"".join(map(self.bytes_a.__getitem__, got_a[i])) == raw
                    and b"".join(map(self.bytes_b.__getitem__, got_b[i])) == raw):
                ok.append(i)
        n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
        groups, cuts = [""] * n, np.zeros(n + 1, np.int64)
        empty = np.zeros(0, np.int64)
        if not ok:
            return n_a, n_b, n_groups, n_links, groups, empty, empty, cuts
        a = np.concatenate([np.array(got_a[i], np.int64) for i in ok])
        b = np.concatenate([np.array(got_b[i], np.int64) for i in ok])
        n_a[ok], n_b[ok] = [len(got_a[i]) for i in ok], [len(got_b[i]) for i in ok]
        # ends in bytes over all texts: both tokenizers fill the same bytes of each
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends_b = np.zeros(int(end_b[-1]) + 1, bool)
        ends_b[end_b] = True
        blank = np.zeros(len(ends_b), bool)  # a token of B that begins with a blank begins here
        blank[(end_b - self.size_b[b])[self.blank_b[b]]] = True
        next_blank = np.append(self.blank_a[a][1:], True)
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a[ok]) - 1] = True
        anchor_a = ends_b[end_a] & (last | next_blank & blank[end_a])
        is_anchor = np.zeros(len(ends_b), bool)
        is_anchor[end_a[anchor_a]] = True
        stop_a, stop_b = np.flatnonzero(anchor_a) + 1, np.flatnonzero(is_anchor[end_b]) + 1
        of_doc = np.searchsorted(np.cumsum(n_a[ok]), stop_a)  # the place in ok of each window's text
        # a window's key: its ids of A, an id that no token has, its ids of B
        windows = len(stop_a)
        start_b = np.concatenate([[0], stop_b[:-1]])
        of_a, of_b = np.repeat(np.arange(windows), np.diff(stop_a, prepend=0)), np.repeat(np.arange(windows), stop_b - start_b)
        ids = np.full(len(a) + len(b) + windows, -1, np.int64).astype(self.small)
        ids[np.arange(len(a)) + start_b[of_a] + of_a] = a
        ids[np.arange(len(b)) + stop_a[of_b] + of_b + 1] = b
        stops = ((stop_a + stop_b + np.arange(1, windows + 1)) * ids.itemsize).tolist()
        keys = list(map(ids.tobytes().__getitem__, map(slice, [0, *stops[:-1]], stops)))
        found = list(map(self.new.get, keys))
        self._fill(found, keys, a, stop_a, b, stop_b)
        parts = list(map(itemgetter(2), found))
        links, text_of = b"".join(parts), list(map(itemgetter(1), found))
        size = np.fromiter(map(len, parts), np.int64, windows) // 8
        for name, values in ((n_groups, np.fromiter(map(itemgetter(0), found), np.int64, windows)), (n_links, size)):
            name[ok] = np.bincount(of_doc, values, len(ok)).astype(np.int64)
        stops = np.searchsorted(of_doc, np.arange(len(ok)), "right").tolist()
        at = 0
        for i, to in zip(ok, stops):
            groups[i] = ";".join(text_of[at:to])
            at = to
        span = len(self.bytes_a) * len(self.bytes_b)
        both, times = np.unique(np.repeat(of_doc, size) * span + np.frombuffer(links, np.int64), return_counts=True)
        per_doc = np.zeros(n, np.int64)
        per_doc[ok] = np.bincount(both // span, minlength=len(ok))
        cuts[1:] = np.cumsum(per_doc)
        return n_a, n_b, n_groups, n_links, groups, both % span, times.astype(np.int64), cuts


_ALIGNER: dict[tuple, Aligner] = {}


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``: ids between shared ends), pair (the linked pairs, each as
    a * (size of B's vocabulary) + b) and times (how often the text links each).

    ``path_a`` is a byte-level tokenizers file, ``path_b`` a sentencepiece model that adds
    a blank in front; special tokens' names are plain text.  NULL and empty texts, and
    those whose joined token bytes are not the text behind one blank, have no tokens:
    zeros, no groups, no pairs.  NULL ids and repeated rows are rows like all others."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        key = (path_a, path_b)
        if key not in _ALIGNER:
            _ALIGNER[key] = Aligner(path_a, path_b)
        for batch in batches:
            upto = pc.cumulative_sum(pc.utf8_length(batch.column(1)).cast(pa.int64())).to_numpy()
            start = 0
            while start < len(upto):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_CHARS, "right")))
                n_a, n_b, n_groups, n_links, groups, pair, times, cuts = _ALIGNER[key].align(batch.column(1).slice(start, stop - start).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64())) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), *[pa.array(x) for x in (n_a, n_b, n_groups, n_links)], pa.array(groups, pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "times"])
                start = stop

    base = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    return base.mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame, vocab_b: int) -> DataFrame:
    """(pair, count, best) over all rows of ``alignments``: how many links hold the pair,
    and whether no other pair of its B id has more."""
    counts = (aligned.select(F.inline(F.arrays_zip("pair", "times"))).groupBy("pair").agg(F.sum("times").alias("count"))
              .withColumn("b", F.col("pair") % vocab_b))
    # one row for each id of B at most
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``alignments`` with corpus-wide counts, one row per row: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose pair no other pair of its B id outnumbers), count_sum
    (the counts of its links together), groups_sha256 ('' without tokens).

    The most frequent pairs, whose number is bounded, meet the documents in a broadcast
    join, so no task gets all documents of one pair; the others in a shuffle join, and
    none of them is in more documents than the least of the first."""
    import sentencepiece
    vocab_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = alignments(docs, path_a, path_b, id_col, text_col)
    found = store(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links",
                               F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pair", "times"), "aligned")
    counts = store(pair_counts(found, vocab_b), "pair-counts")
    # the least power of two that at most HOT_PAIRS counts reach; one row for each power of two
    sizes = sorted(counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).count().collect(), key=lambda r: -r["k"])
    least, taken = 63, 0
    for r in sizes:
        taken += r["count"]
        if taken > HOT_PAIRS:
            break
        least = r["k"]
    hot = F.floor(F.log2("count")).cast("int") >= least
    pairs = found.select("row", F.inline(F.arrays_zip("pair", "times")))
    met = pairs.join(F.broadcast(counts.where(hot)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    often = met.where("count is not null").groupBy("row").agg(*sums)
    seldom = met.where("count is null").select("row", "pair", "times").join(counts.where(~hot), "pair").groupBy("row").agg(*sums)
    both = often.unionAll(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.drop("pair", "times").join(both, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
