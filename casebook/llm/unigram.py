"""Operator 7: token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word (run of non-white space) with the word mark before it.  A
trie of the pre-tokens met holds, at each node, the best unigram score of the
path to it and the number of tokens on that best segmentation, computed once from
the nodes above it; a word's count is stored where it ends.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import pick, text_or_empty

MARK = "▁"
#: A character that no piece covers scores so much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Nodes and words a worker keeps before it starts anew.
TRIE_NODES, CACHE_WORDS = 400_000, 400_000


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities by Zipf's law on their
    rank (the files hold ranks, not probabilities); control, unknown and byte
    pieces are not matched."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(kept))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(kept)}


class Trie:
    """Children by node, and the forward state of each node."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Insert ``word`` and return the tokens of its best segmentation."""
        if len(self.best) > TRIE_NODES:
            self.clear()
        node, path = 0, [0]
        for d, ch in enumerate(word, 1):
            nxt = self.child[node].get(ch)
            if nxt is None:
                nxt = self._grow(node, ch, word, d, path)
            node = nxt
            path.append(node)
        return self.tokens[node]

    def _grow(self, parent: int, ch: str, word: str, d: int, path: list[int]) -> int:
        best, tokens = -math.inf, 0
        scores = self.scores
        for size in range(min(self.longest, d), 0, -1):
            s = scores.get(word[d - size:d])
            if s is None:
                if size > 1:
                    continue
                s, cost = self.unknown, len(ch.encode("utf-8", "surrogatepass"))
            else:
                cost = 1
            above = path[d - size]
            if self.best[above] + s > best:
                best, tokens = self.best[above] + s, self.tokens[above] + cost
        node = len(self.best)
        self.child[parent][ch] = node
        self.child.append({})
        self.best.append(best)
        self.tokens.append(tokens)
        return node


def token_counts(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.  An uncovered
    character costs a token per UTF-8 byte.  NULL and empty texts have 0 of both;
    a NULL doc_id is kept; repeated rows are rows of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        trie, known = Trie(shared.value), {}
        for pdf in batches:
            words, tokens = [], []
            for text in pdf["text"]:
                own, n = text.split(), 0
                for w in own:
                    c = known.get(w)
                    if c is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[w] = c = trie.count(MARK + w)
                    n += c
                words.append(len(own))
                tokens.append(n)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": words, "n_tokens": tokens})

    base = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.mapInPandas(run, "doc_id long, n_words long, n_tokens long")
