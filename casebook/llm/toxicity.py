"""Operator 9: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of the weights of its words and of their beginnings; the document's is
their noisy-or, 1 - prod(1 - p), over the sentences with a weighted word.  The others
together count as one more, whose probability rises with their number to at most the
share of toxic documents among those without any evidence, and to no more than
``MOST_REST``, so that no text is toxic for its length.  Weights are trained from document labels alone,
through the noisy-or, and then also tell which sentences offend.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import bounded_batches, pick, text_or_empty

#: Labelled documents the model is trained on at most (the first in md5 order of
#: their ids), and characters of them together: a text that doesn't fit any more is left out.
TRAIN_DOCS, TRAIN_CHARS = 8_000, 40_000_000
#: A feature occurs in as many toxic training documents, and in them as many
#: times as often as in the others, in proportion.
LEAST_DOCS, LEAST_LIFT = 5, 3.0
BEGINNINGS = (3, 4, 5)
CACHE_WORDS = 300_000
#: Greatest probability of a text without evidence, and the sentences that give half of it.
MOST_REST, HALF_REST = 0.1, 20

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    rest: float = 0.0  # probability of a text of many sentences without evidence

    def scorer(self):
        """text -> (probability, [(start, end, probability) of each sentence that has a weight])."""
        known: dict[str, float] = {}
        weights, bias, rest = self.weights, self.bias, self.rest

        def word_weight(w: str) -> float:
            if len(known) > CACHE_WORDS:
                known.clear()
            known[w] = x = sum(weights.get(f, 0.0) for f in features(w))
            return x

        def score(text: str):
            total, quiet, found, lower = 0.0, 0, [], text.lower()
            if len(lower) != len(text):  # a letter whose lower case is longer: keep the places
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for m in SENTENCE.finditer(lower):
                z = 0.0
                for w in WORD.findall(m[0]):
                    x = known.get(w)
                    z += word_weight(w) if x is None else x
                if z:
                    total -= np.logaddexp(0.0, bias + z)
                    found.append((m.start(), m.end(), float(1 / (1 + np.exp(-(bias + z))))))
                else:
                    quiet += 1
            return 0.0 - float(np.expm1(total + np.log1p(-rest * quiet / (quiet + HALF_REST)))), found
        return score


def train(texts: list[str], labels: np.ndarray, rounds: int = 400) -> Model:
    """Fit bias and non-negative weights to document labels by gradient steps
    (Adam) on the log-loss of the noisy-or.  Without documents of both labels,
    the score is the share of toxic ones (0 without any)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(30.0 if share else -30.0, {})
    in_toxic, in_clean = Counter(), Counter()
    for text, y in zip(texts, labels):
        (in_toxic if y else in_clean).update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    toxic = int(labels.sum())
    clean = len(labels) - toxic
    chosen = sorted(f for f, n in in_toxic.items()
                    if n >= LEAST_DOCS and n / toxic >= LEAST_LIFT * (in_clean[f] + 1) / clean)
    index = {f: i for i, f in enumerate(chosen)}
    of_word: dict[str, list[int]] = {}
    doc_of, row, col = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text.lower()):
            before = len(col)
            for w in WORD.findall(m[0]):
                if w not in of_word:
                    of_word[w] = [index[f] for f in features(w) if f in index]
                col.extend(of_word[w])
            if len(col) > before:
                row.extend([len(doc_of)] * (len(col) - before))
                doc_of.append(d)
    doc_of, row, col = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (doc_of, row, col))
    y, n = labels.astype(float), len(texts)
    bias, w = -6.0, np.full(len(chosen), 0.1)
    m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], len(doc_of))
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc_of, -np.logaddexp(0.0, z), n)  # log of "no sentence offends"
        some = np.maximum(-np.expm1(none), 1e-9)
        # d loss / d none, then through each sentence: d none / d z = -p
        slope = y * np.exp(none) / some - (1 - y)
        g = -slope[doc_of] * p
        grad = np.concatenate([[g.sum()], np.bincount(col, g[row], len(chosen))]) / n
        grad[1:] += 1e-4 * w + 2e-5
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        step = 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        bias -= step[0]
        w = np.maximum(0.0, w - step[1:])
    heard = np.zeros(n, bool)
    heard[doc_of[row[w[col] > 1e-3]]] = True
    rest = float(y[~heard].mean()) if not heard.all() else 0.0
    return Model(float(bias), {f: float(x) for f, x in zip(chosen, w) if x > 1e-3}, min(MOST_REST, rest))


def _held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out, chosen by id
    and length before any text is fetched.  Labels of one id that differ count as toxic;
    of the texts of one id the shortest is taken; NULL labels and ids are left out."""
    ids = (pick(labels, doc_id="doc_id", y=label_col).where("doc_id is not null and y is not null")
           .where(~_held_out()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
           .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_docs))
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    known = (base.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y")
             .agg(F.min(F.struct(F.length("text").alias("chars"), F.xxhash64("text").alias("hash"))).alias("t"))
             .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").collect())
    chosen, left = [], train_chars
    for r in known:
        if r["t"]["chars"] <= left:
            chosen.append((r["doc_id"], r["t"]["hash"], r["y"]))
            left -= r["t"]["chars"]
    if not chosen:
        return train([], np.zeros(0, np.int64))
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(base.dtypes)['doc_id']}, hash long, y int")
    got = (base.join(F.broadcast(wanted), "doc_id").where(F.xxhash64("text") == F.col("hash"))
           .groupBy("doc_id", "y").agg(F.first("text").alias("text")))
    pdf = got.toPandas().sort_values(["doc_id", "text"])
    return train(pdf["text"].tolist(), pdf["y"].to_numpy(dtype=np.int64))


SCORES = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, offending
    (places, in characters, and probabilities of the sentences at or above the
    threshold).  NULL and empty texts have no sentence and score 0; a text of any length
    without a weighted word scores at most ``MOST_REST``; NULL ids are not held out; repeated rows are rows of
    their own; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for pdf in batches:
            got = [of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [g[0] for g in got],
                                "offending": [[{"start": a, "end": b, "score": p} for a, b, p in g[1] if p >= threshold]
                                              for g in got]})

    base = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return (base.mapInPandas(run, SCORES)
            .select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                    "offending"))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, in the same pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            import pyarrow as pa
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.filter(pa.array([of(t.as_py() or "")[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
