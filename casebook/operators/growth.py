"""Forests from distinct rows.

Rows that are alike in all features reach the same nodes, so a tree needs of them only
how often they occur, per class.  Spark counts the rows per feature vector, cuts the
numbers into bins (as Spark's own learner does) and counts again per vector of bins;
what is left grows with the number of bins and not with the rows.  This table is sent to
the tasks behind a size check, a task grows one tree from it level by level, and the
trees come back as node rows.

A bag draws each row a Poisson(1) number of times, so n equal rows a Poisson(n) number of
times: the bag of the counts has the distribution that the bag of the rows has.

``counted`` gives None where the table passes the bound (many features of many values);
such rows go to Spark's learner, which keeps all of them apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import cut_lineage

#: Bytes of the table that a task holds: its distinct rows times the features.
MAX_CELLS = 1 << 26
#: Distinct values of all features together, as the driver cuts them into bins.
MAX_VALUES = 100_000
MAX_BINS = 32
#: Features that a node's number has room for.
MAX_FEATURES = 1 << 16
#: Distinct rows that are sent as one row.
BLOCK = 1 << 15

_NODES = ("tree int, id int, prediction double, impurity double, s0 double, s1 double, n long, gain double, `left` int, `right` int, "
          "feature int, split int, threshold double")


def distinct_rows(df: DataFrame, keep: Sequence[str], features: str = "features", out: str = "n") -> DataFrame:
    """(``keep``, features, n): rows alike in all of them, and their number."""
    return df.groupBy(*keep, features).agg(F.count(F.lit(1)).alias(out))


def cut_points(counts: Sequence[tuple], bins: int = MAX_BINS) -> list[float]:
    """Thresholds of a feature from its (value, weight) pairs: midway between all of its
    values if there are at most ``bins``, else between those nearest to the quantiles."""
    counts = sorted(counts)
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(counts) <= bins:
        return middle
    stride = sum(n for _, n in counts) / bins
    out, target, below = [], stride, 0.0
    for (_, n), (_, more), cut in zip(counts, counts[1:], middle):
        below += n
        if abs(below - target) < abs(below + more - target):
            out.append(cut)
            target += stride
    return out


@dataclass
class Counted:
    """Distinct rows of bins, the number of rows of each class that they stand for, and
    what tells how they were made."""

    table: DataFrame              # code (a byte per feature), n0, n1
    groups: int
    cuts: list                    # thresholds of each feature
    weights: dict                 # label -> weight of a row


def counted(train: DataFrame, label: str = "label", features: str = "features", weight: str | None = None,
            count: str | None = None) -> Counted | None:
    """The table of ``train`` (0/1 labels, one weight per label; ``count``: how many rows
    a row stands for), or None beyond the bound."""
    n = F.col(count) if count else F.lit(1)
    w = F.col(weight) if weight else F.lit(1.0)
    of = {y: F.col(label) == y for y in (0, 1)}
    rows = cut_lineage(train.groupBy(F.col(features).alias("features")).agg(
        *[F.sum(F.when(of[y], n).otherwise(0)).cast("long").alias(f"n{y}") for y in (0, 1)],
        *[f(F.when(of[y], w)).alias(f"{name}{y}") for y in (0, 1) for name, f in (("least", F.min), ("most", F.max))]))
    about = rows.agg(F.max(F.size(vector_to_array("features"))).alias("d"), *[F.sum(f"n{y}").alias(f"n{y}") for y in (0, 1)],
                     *[f(f"{name}{y}").alias(f"{name}{y}") for y in (0, 1) for name, f in (("least", F.min), ("most", F.max))]).first()
    if about["d"] is None:
        raise ValueError("no rows to fit")
    if any(about[f"least{y}"] != about[f"most{y}"] for y in (0, 1)):
        raise ValueError("rows of one label must have one weight")
    weights = {y: float(about[f"least{y}"] or 0.0) for y in (0, 1)}
    weighed = F.col("n0") * weights[0] + F.col("n1") * weights[1]
    # values other than 0; what they leave of the total is the 0
    values = (rows.select(weighed.alias("w"), F.posexplode(vector_to_array("features")).alias("pos", "value")).where("value != 0")
              .groupBy("pos", "value").agg(F.sum("w").alias("w")).limit(MAX_VALUES + 1).collect())
    if len(values) > MAX_VALUES or about["d"] > MAX_FEATURES:
        return None
    total = sum(about[f"n{y}"] * weights[y] for y in (0, 1))
    per: list = [[] for _ in range(about["d"])]
    for r in values:
        per[r["pos"]].append((r["value"], r["w"]))
    for found in per:
        rest = total - sum(n for _, n in found)
        if rest > 1e-9 * total:
            found.append((0.0, rest))
    cuts = [cut_points(found) for found in per]
    table = cut_lineage(coded(rows, cuts, ["n0", "n1"]).groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    groups = table.count()
    return Counted(table, groups, cuts, weights) if groups * len(cuts) <= MAX_CELLS else None


def coded(rows: DataFrame, cuts: list, names: Sequence[str], features: str = "features") -> DataFrame:
    """(code, ``names``): each feature's bin as a byte, the number of its thresholds below
    the value."""
    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            code = _binned(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts)), cuts)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(cuts)
            packed = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(code)])
            yield pa.RecordBatch.from_arrays([packed, *[b.column(i + 1) for i in range(len(names))]], names=["code", *names])

    kinds = dict(rows.dtypes)
    return rows.select(vector_to_array(features).alias("_x"), *names).mapInArrow(
        encode, ", ".join(["code binary", *[f"`{c}` {kinds[c]}" for c in names]]))


def subset_size(strategy: str, d: int) -> int:
    """Features that a node may split on, by the name Spark gives the number."""
    named = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3)}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit() and int(strategy) > 0:
        return min(int(strategy), d)
    return math.ceil(float(strategy) * d)


def bootstrap_trees(table: Counted, params) -> DataFrame:
    """Node rows of ``params.num_trees`` trees, each of its own bag of the rows."""
    cuts, weights = table.cuts, table.weights
    # in order, as a tree's draws must not depend on how the rows were dealt
    block = F.pmod(F.xxhash64("code"), F.lit(-(-table.groups // BLOCK))).cast("int")
    blocks = table.table.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("code", "n0", "n1"))).alias("rows"))

    def trees(batches):
        parts: dict = {}
        for b in batches:
            for i, (t, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                parts.setdefault(t, {})[at] = b.column(2)[i].values.flatten()
        for t, found in parts.items():
            found = [found[at] for at in sorted(found)]
            n = np.concatenate([_numbers(columns[1:]) for columns in found], axis=1)
            rng = np.random.default_rng([params.seed, t])
            times = rng.poisson(n) if params.bootstrap else n
            while not times.any():                        # a bag of nothing, of a few rows
                times = rng.poisson(n)
            code = np.concatenate([_codes(columns[0], len(cuts)) for columns in found], axis=1)
            yield _batch(t, grow(code, times, None, cuts, weights, params, rng))

    one = table.table.sparkSession.range(0, params.num_trees, numPartitions=params.num_trees).select(F.col("id").cast("int").alias("tree"))
    # bound: MAX_CELLS
    return one.crossJoin(F.broadcast(blocks)).select("tree", "block", "rows").mapInArrow(trees, _NODES)


def bag_trees(bags: DataFrame, table: Counted, params) -> DataFrame:
    """Node rows of the trees of given bags: (tree, code, times0, times1, held), how often
    the bag holds the rows of a code, per class, and how many of them it holds."""
    cuts, weights = table.cuts, table.weights

    def one(key, rows):
        t = key[0].as_py()
        rows = rows.combine_chunks()
        n = _numbers([rows[c].chunk(0) for c in ("times0", "times1", "held")])
        nodes = grow(_codes(rows["code"].chunk(0), len(cuts)), n[:2], n[2], cuts, weights, params, np.random.default_rng([params.seed, t]))
        return pa.Table.from_batches([_batch(t, nodes)])

    # bound: a tree has a row per code (MAX_CELLS)
    return bags.groupBy("tree").applyInArrow(one, _NODES)


def _codes(column, d: int) -> np.ndarray:
    """Features x rows of a column of codes."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.ascontiguousarray(np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(column), d).T)


def _numbers(columns) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64)


def _batch(tree: int, nodes: dict):
    n = len(nodes["id"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), *[pa.array(c) for c in nodes.values()]],
                                      names=["tree", *nodes])


def _bundles(code: np.ndarray, narrow: np.ndarray) -> list:
    """The one-threshold features in sets of which a row has one at most above its
    threshold, as the indicators of one column are."""
    together = np.zeros((len(narrow), len(narrow)), bool)
    for at in range(0, code.shape[1], 1 << 16):
        x = code[narrow, at:at + (1 << 16)].astype(np.float32)
        together |= (x @ x.T) > 0
    sets: list = []
    for i in range(len(narrow)):
        for of in sets:
            if len(of) < 255 and not together[i, of].any():
                of.append(i)
                break
        else:
            sets.append([i])
    return [narrow[of] for of in sets]


class _Sums:
    """Whole numbers of rows per class (and more), added up exactly for each (node, bin):
    two of them in one double where their sums fit."""

    def __init__(self, numbers: np.ndarray):
        self.base = float(1 << (int(numbers[0].sum()) + 1).bit_length())
        self.paired = self.base * (numbers[1].sum() + 1) < 2.0 ** 53
        self.columns = [numbers[0] + numbers[1] * self.base, *numbers[2:]] if self.paired else list(numbers)

    def keep(self, rows: np.ndarray) -> None:
        self.columns = [c[rows] for c in self.columns]

    def by(self, index: np.ndarray, n: int) -> np.ndarray:
        found = [np.bincount(index, c, n) for c in self.columns]
        if self.paired:
            second = np.floor(found[0] / self.base)
            found[:1] = [found[0] - second * self.base, second]
        return np.stack(found)


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(a + b, 1e-300)
    return 1.0 - (a / n) ** 2 - (b / n) ** 2


def grow(code: np.ndarray, times: np.ndarray, held: np.ndarray | None, cuts: list, weights: dict, params, rng) -> dict:
    """A tree's nodes, left to right and a parent before its children, from coded rows
    (features x rows), how often the bag holds them per class (2 x rows) and how many rows
    of the bag they stand for (as many, if not given).  Rules as in Spark's learner: Gini
    impurity of the weighted classes, a random subset of the features per node,
    ``min_leaf`` rows on both sides, a gain above 0, and leaves of one parent and one class
    are merged.  Nodes of fewer than ``min_split`` rows stay leaves."""
    d = len(cuts)
    some = times.sum(axis=0) > 0
    code = code.compress(some, axis=1)                    # a feature's bytes stay side by side
    numbers = (times if held is None else np.vstack([times, held]))[:, some].astype(float)
    sums, total = _Sums(numbers), numbers.sum(axis=1)[:, None]
    w = np.array([weights[0], weights[1]])
    sizes = np.array([len(c) for c in cuts])
    starts = np.cumsum(sizes) - sizes
    of_split = np.repeat(np.arange(d), sizes)             # feature of each split, and its place there
    place = np.arange(len(of_split)) - np.repeat(starts, sizes)
    wide, sets = np.flatnonzero(sizes > 1), _bundles(code, np.flatnonzero(sizes == 1))
    # bins of a set: no feature of it, or one
    packed = np.zeros((len(sets), code.shape[1]), np.uint8)
    for i, of in enumerate(sets):
        for at, j in enumerate(of):
            packed[i] += code[j] * np.uint8(at + 1)
    chosen = min(subset_size(params.feature_subset, d), d)
    # node of each row; rows that have reached a leaf are at k, until enough of them are there to be left out
    at, k, levels = np.zeros(code.shape[1], np.int64), 1, []
    while True:
        stats, n = total[:2] * w[:, None], total[2] if held is not None else total.sum(axis=0)
        here = {"s0": stats[0], "s1": stats[1], "n": n, "impurity": _gini(stats[0], stats[1]), "gain": np.full(k, -1.0),
                "feature": np.full(k, -1), "split": np.full(k, -1)}
        levels.append(here)
        if len(levels) > params.max_depth or not len(of_split):
            break
        left = np.empty((len(total), k, len(of_split)))
        for j in wide:
            bins = sizes[j] + 1
            left[:, :, starts[j]:starts[j] + sizes[j]] = np.cumsum(
                sums.by(at * bins + code[j], (k + 1) * bins).reshape(-1, k + 1, bins)[:, :k], axis=2)[:, :, :-1]
        for of, c in zip(sets, packed):
            bins = len(of) + 1
            left[:, :, starts[of]] = total[:, :, None] - sums.by(at * bins + c, (k + 1) * bins).reshape(-1, k + 1, bins)[:, :k, 1:]
        gain = _gains(left, total, w, here["impurity"], params.min_leaf)
        gain[n < params.min_split] = -np.inf
        if chosen < d:
            mine = np.zeros((k, d), bool)
            np.put_along_axis(mine, np.argpartition(rng.random((k, d)), chosen - 1, axis=1)[:, :chosen], True, axis=1)
            gain[~mine[:, of_split]] = -np.inf
        best = gain.argmax(axis=1)
        most = gain[np.arange(k), best]
        ok = most > 0
        if not ok.any():
            break
        here["gain"][ok], here["feature"][ok], here["split"][ok] = most[ok], of_split[best[ok]], place[best[ok]]
        got = left[:, np.flatnonzero(ok), best[ok]]
        total = np.stack([got, total[:, ok] - got], axis=2).reshape(len(total), -1)
        # the rows of split nodes go on
        on = np.append(ok, False)
        keep = on.take(at)
        if keep.sum() < 0.6 * len(at):
            code, packed, at = code.compress(keep, axis=1), packed.compress(keep, axis=1), at[keep]
            sums.keep(keep)
        # each node's feature, its bin and its first child in one number
        k, first = total.shape[1], 2 * (np.cumsum(on) - 1)
        to = np.where(on, (first << 24) | (np.append(here["feature"], 0) << 8) | np.append(here["split"], 0), (k << 24) | 255).take(at)
        at = (to >> 24) + (code.ravel().take(((to >> 8) & 0xFFFF) * len(at) + np.arange(len(at))) > (to & 255))
    return _numbered(levels, cuts)


def _gains(left, total, w, impurity, min_leaf: int) -> np.ndarray:
    """Gain of each split (nodes x splits), -inf where a side has too few rows."""
    right = total[:, :, None] - left
    l0, l1, r0, r1 = left[0] * w[0], left[1] * w[1], right[0] * w[0], right[1] * w[1]
    nl, nr = l0 + l1, r0 + r1
    gain = impurity[:, None] - (nl * _gini(l0, l1) + nr * _gini(r0, r1)) / np.maximum(nl + nr, 1e-300)
    for side in (left, right):
        gain[(side[2] if len(side) > 2 else side[0] + side[1]) < max(min_leaf, 1)] = -np.inf
    return gain


def _numbered(levels: list, cuts: list) -> dict:
    """The nodes in one table, after leaves of one parent and one class were merged."""
    size: list = [None] * len(levels)
    for i in range(len(levels) - 1, -1, -1):
        here = levels[i]
        here["class"] = (here["s1"] > here["s0"]).astype(int)
        split = here["feature"] >= 0
        size[i] = np.ones(len(split), np.int64)
        if not split.any():
            continue
        below, below_size = levels[i + 1], size[i + 1]
        a, b = np.arange(0, 2 * split.sum(), 2), np.arange(1, 2 * split.sum(), 2)
        here["first"] = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        same = (below_size[a] == 1) & (below_size[b] == 1) & (below["class"][a] == below["class"][b])
        kept = np.flatnonzero(split)
        here["feature"][kept[same]] = -1
        size[i][kept[~same]] = 1 + below_size[a[~same]] + below_size[b[~same]]
    out: dict = {c: [] for c in ("id", "prediction", "impurity", "s0", "s1", "n", "gain", "left", "right", "feature", "split", "threshold")}
    ids = np.zeros(1, np.int64)                           # -1: merged away
    for i, here in enumerate(levels):
        split = (here["feature"] >= 0) & (ids >= 0)
        there = ids >= 0
        left, right = np.full(len(ids), -1), np.full(len(ids), -1)
        threshold = np.full(len(ids), np.nan)
        if i + 1 < len(levels):
            below = np.full(len(levels[i + 1]["n"]), -1)
            a = here["first"][split]
            left[split] = ids[split] + 1
            right[split] = ids[split] + 1 + size[i + 1][a]
            below[a], below[a + 1] = left[split], right[split]
            threshold[split] = [cuts[f][s] for f, s in zip(here["feature"][split], here["split"][split])]
        for c, v in (("id", ids), ("prediction", here["class"].astype(float)), ("impurity", here["impurity"]), ("s0", here["s0"]),
                     ("s1", here["s1"]), ("n", here["n"].astype(np.int64)), ("gain", np.where(split, here["gain"], -1.0)), ("left", left),
                     ("right", right), ("feature", here["feature"]), ("split", np.where(split, here["split"], -1)), ("threshold", threshold)):
            out[c].append(v[there])
        if i + 1 < len(levels):
            ids = below
    kinds = {"n": np.int64} | dict.fromkeys(("id", "left", "right", "feature", "split"), np.int32)
    table = {c: np.concatenate(v).astype(kinds.get(c, float)) for c, v in out.items()}
    order = np.argsort(table["id"])
    return {c: v[order] for c, v in table.items()}


class GrownForest:
    """A forest as its node rows, which scores rows as Spark's model of the same nodes
    does: the mean of the trees' shares of class 1.  What a task needs of the nodes is sent
    to it, as large as the model."""

    def __init__(self, nodes: DataFrame, cuts: list):
        self.nodes, self.cuts = cut_lineage(nodes), cuts
        share = (F.col("s1") / (F.col("s0") + F.col("s1"))).alias("share")
        table = self.nodes.select("tree", "id", "left", "right", "feature", "split", share).toArrow()
        table = {c: table[c].to_numpy() for c in table.column_names}
        table = {c: v[np.lexsort((table["id"], table["tree"]))] for c, v in table.items()}
        first = np.flatnonzero(table["id"] == 0)
        start = np.repeat(first, np.diff([*first, len(table["id"])]))
        leaf, own = table["left"] < 0, table["id"] + start
        # a leaf leads to itself
        below = np.stack([np.where(leaf, own, table["left"] + start), np.where(leaf, own, table["right"] + start)], axis=1).astype(np.int32)
        # a node's feature and bin in one number
        test = np.where(leaf, 255, (table["feature"] << 8) | table["split"]).astype(np.int32)
        self._sent = self.nodes.sparkSession.sparkContext.broadcast((first, below.ravel(), test, table["share"]))
        self.getNumTrees, self.totalNumNodes = len(first), len(own)

    @property
    def featureImportances(self):
        """Per tree, each feature's share of the weighted gains; their mean (I16)."""
        from pyspark.ml.linalg import Vectors
        gains = (self.nodes.where("`left` >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("s0") + F.col("s1"))).alias("g"))
                 .collect())                              # <= trees x features rows
        of_tree: dict = {}
        for r in gains:
            of_tree[r["tree"]] = of_tree.get(r["tree"], 0.0) + r["g"]
        out = np.zeros(len(self.cuts))
        for r in sorted(gains, key=lambda r: (r["tree"], r["feature"])):
            out[r["feature"]] += r["g"] / of_tree[r["tree"]]
        return Vectors.dense(out / max(out.sum(), 1e-300))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with its probability of class 1 as ``_p1``."""
        sent, cuts = self._sent, self.cuts

        @F.arrow_udf("double")
        def share(x: pa.Array) -> pa.Array:
            first, below, test, value = sent.value
            code = _binned(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), cuts)
            rows, total = np.arange(len(x)) * len(cuts), np.zeros(len(x))
            for root in first:
                at = np.full(len(x), root, np.int64)
                while True:
                    q = test.take(at)
                    to = below.take(2 * at + (code.take(rows + (q >> 8)) > (q & 255)))
                    if (to == at).all():
                        break
                    at = to.astype(np.int64)
                total += value.take(at)
            return pa.array(total / len(first))

        return df.withColumn("_p1", share(vector_to_array(features)))


def _binned(x: np.ndarray, cuts: list) -> np.ndarray:
    code = np.empty(x.shape, np.uint8)
    for j, cut in enumerate(cuts):
        code[:, j] = np.searchsorted(cut, x[:, j], side="left")
    return code
