"""k-modes clustering of categorical rows.

Objective (Huang 1998): matching distance = number of columns in which a row
differs from its cluster mode; minimise the summed distance.

Spark plan:
* rows are collapsed once to distinct tuples with a weight (one aggregate;
  NULL becomes the text 'nan', as a string label encoder would see it);
* modes are k literal tuples on the driver (k x columns values), so the
  distance to every mode is a plain expression and assignment needs no join;
* an update is one aggregate over the tuples: weighted mode per
  (cluster, column), ties to the smallest value;
* the loop stops when the modes stop changing; best of ``n_init`` starts by
  cost.  Batch updates replace the per-point online updates of the original
  algorithm: same objective, not necessarily the same labels.
* the final assignment of all rows is a projection of the case table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_TEXT = "nan"


def _norm(cols: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)).alias(c) for c in cols]


def collapse(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct tuples with weight ``w``."""
    return df.select(*_norm(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))


def _distance(cols: Sequence[str], mode: Sequence[str]) -> Column:
    return sum((F.col(c) != F.lit(v)).cast("int") for c, v in zip(cols, mode))


def assign_expr(cols: Sequence[str], modes: Sequence[Sequence[str]]) -> Column:
    """struct(distance, cluster) of the nearest mode; ties -> lowest id."""
    cands = [F.struct(_distance(cols, m).alias("distance"), F.lit(i).alias("cluster"))
             for i, m in enumerate(modes)]
    return F.array_min(F.array(*cands))


def assign(df: DataFrame, cols: Sequence[str], modes, keep: Sequence[str] = ()) -> DataFrame:
    """Cluster id and distance for every row (a projection; no shuffle)."""
    a = assign_expr(cols, modes)
    d = df.select(*keep, *_norm(cols))
    return d.withColumn("_a", a).select(*keep, *cols, F.col("_a.cluster").alias("cluster"),
                                        F.col("_a.distance").alias("distance"))


def init_frequent(tuples: DataFrame, cols: Sequence[str], k: int) -> list[list[str]]:
    """The k most frequent distinct tuples (ties by tuple text)."""
    rows = tuples.orderBy(F.col("w").desc(), *cols).limit(k).collect()  # k rows
    return [[r[c] for c in cols] for r in rows]


def _modes_literal(starts: list) -> Column:
    """All starts' modes as one constant ``array<array<array<string>>>``
    (start, cluster, column).  Constant folding turns it into a single
    literal, so the expression below has the same shape whatever the modes,
    k or number of starts, and its compiled code is reused across steps."""
    return F.array(*[F.array(*[F.array(*[F.lit(v) for v in m]) for m in modes])
                     for modes in starts])


def multi_assign_expr(cols: Sequence[str], starts: list) -> Column:
    """Per row: array over starts of struct(cluster, distance) of the
    nearest mode (ties -> lowest cluster id)."""
    row = F.array(*[F.col(c) for c in cols])

    def nearest(ms):
        cands = F.transform(ms, lambda m, c: F.struct(
            F.aggregate(F.zip_with(m, row, lambda a, b: (a != b).cast("int")), F.lit(0),
                        lambda acc, x: acc + x).alias("distance"),
            c.alias("cluster")))
        return F.array_min(cands)

    return F.transform(_modes_literal(starts), nearest)


def _update_many(tuples: DataFrame, cols: Sequence[str], starts: dict) -> dict:
    """One batch step for many independent starts in one job.

    ``starts`` maps a start id to its modes.  Every tuple is assigned under
    every start (the tuple table is small: distinct attribute combinations),
    then one aggregate gives the weighted mode per (start, cluster, column)
    and the cluster sizes.  Returns {start: (new_modes, sizes)}; at most
    sum(k) x columns rows reach the driver.
    """
    sids = list(starts)
    a = (tuples.select(*cols, "w", F.posexplode(
            multi_assign_expr(cols, [starts[s] for s in sids])).alias("start", "_s"))
               .select(*cols, "w", "start", F.col("_s.cluster").alias("cluster")))
    long = a.unpivot(["start", "cluster", "w"], list(cols), "column", "value")
    cnt = long.groupBy("start", "cluster", "column", "value").agg(F.sum("w").alias("n"))
    # most weight first, then the smallest value: min over (-n, value)
    best = (cnt.groupBy("start", "cluster", "column")
               .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("b"),
                    F.sum("n").alias("size"))
               .select("start", "cluster", "column", F.col("b.value").alias("value"), "size"))
    out = {sid: ([list(x) for x in m], [0] * len(m)) for sid, m in starts.items()}
    idx = {c: i for i, c in enumerate(cols)}
    for r in best.collect():  # starts x k x columns rows
        modes, sizes = out[sids[r["start"]]]
        modes[r["cluster"]][idx[r["column"]]] = r["value"]
        sizes[r["cluster"]] = r["size"]
    return out


def _reseed_empty(tuples: DataFrame, cols, modes, sizes) -> list:
    """An empty cluster takes the tuple farthest from its own mode."""
    empty = [i for i, s in enumerate(sizes) if s == 0]
    if not empty:
        return modes
    a = tuples.withColumn("_a", assign_expr(cols, modes))
    far = a.orderBy(F.col("_a.distance").desc(), F.col("w").desc(), *cols).limit(len(empty)).collect()
    modes = [list(m) for m in modes]
    for i, r in zip(empty, far):
        modes[i] = [r[c] for c in cols]
    return modes


def costs_of(tuples: DataFrame, cols, starts: dict) -> dict:
    """Summed weighted distance for every start, one job."""
    sids = list(starts)
    a = tuples.select("w", F.posexplode(
        multi_assign_expr(cols, [starts[s] for s in sids])).alias("start", "_s"))
    rows = a.groupBy("start").agg(
        F.sum(F.col("w") * F.col("_s.distance")).alias("cost")).collect()
    return {sids[r["start"]]: float(r["cost"] or 0) for r in rows}


def cost_of(tuples: DataFrame, cols, modes) -> float:
    return costs_of(tuples, cols, {0: modes})[0]


@dataclass
class KModesModel:
    cols: list
    modes: list
    cost: float
    n_iter: int
    converged: bool = True

    def assign(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return assign(df, self.cols, self.modes, keep)


def init_huang(tuples: DataFrame, cols: Sequence[str], k: int, runs: int, seed: int) -> list[list[list[str]]]:
    """Huang's starts for ``runs`` runs of ``k`` clusters.

    Each value of each mode is drawn by its frequency in its column: of all values the
    one with the smallest -ln(u) / n wins, u being read from md5(column | value | draw |
    seed), which is an aggregate over the columns' value counts.  Then the modes become
    tuples of the data, one cluster after the other and all runs together: the nearest
    tuple that isn't a mode of the run yet (ties: the smallest tuple; if all are modes,
    the nearest).  At most runs x k x columns rows reach the driver."""
    cols = list(cols)
    counts = tuples.unpivot(["w"], cols, "column", "value").groupBy("column", "value").agg(F.sum("w").alias("n"))
    draw = F.explode(F.sequence(F.lit(0), F.lit(runs * k - 1))).alias("draw")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "column", "value", "draw", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    key = -F.log((h + 0.5) / float(1 << 32)) / F.col("n")
    drawn = (counts.select("column", "value", "n", draw).groupBy("column", "draw")
             .agg(F.min(F.struct(key.alias("key"), F.col("value"))).alias("b")).select("column", "draw", "b.value"))
    starts = [[[None] * len(cols) for _ in range(k)] for _ in range(runs)]
    for r in drawn.collect():
        starts[r["draw"] // k][r["draw"] % k][cols.index(r["column"])] = r["value"]
    if any(v is None for modes in starts for m in modes for v in m):  # no rows
        return [[] for _ in range(runs)]
    row = F.array(*[F.col(c) for c in cols])
    for i in range(k):
        per_run = F.transform(_modes_literal(starts), lambda ms: F.struct(
            F.aggregate(F.zip_with(F.get(ms, F.lit(i)), row, lambda a, b: (a != b).cast("int")), F.lit(0), lambda acc, x: acc + x).alias("distance"),
            F.exists(ms, lambda m: m == row).alias("taken")))
        near = (tuples.select(*cols, F.posexplode(per_run).alias("run", "_d"))
                .groupBy("run").agg(F.min(F.struct("_d.taken", "_d.distance", *cols)).alias("b")))
        for r in near.collect():  # one row per run
            starts[r["run"]][i] = [r["b"][c] for c in cols]
    return starts


def _initial_many(tuples: DataFrame, cols: Sequence[str], k: int, n_init: int,
                  seed: int, init: str = "frequent") -> list[list]:
    """Start modes for runs 0..n_init-1 in two jobs: run 0 takes the k most
    frequent tuples, run r >= 1 the first k tuples in md5(tuple | seed + r)
    order; with ``init="Huang"`` all come from ``init_huang``.  At most n_init x k
    rows reach the driver."""
    if init == "Huang":
        return [_filled(modes, k, cols) for modes in init_huang(tuples, cols, k, n_init, seed)]
    if init != "frequent":
        raise ValueError(f"unknown init {init!r}: 'frequent' or 'Huang'")
    runs = [init_frequent(tuples, cols, k)]
    if n_init > 1:
        arms = [F.struct(F.lit(r).alias("run"), F.md5(F.concat_ws(
            "|", *[F.col(c) for c in cols], F.lit(str(seed + r)))).alias("h"))
            for r in range(1, n_init)]
        e = tuples.select(*cols, F.explode(F.array(*arms)).alias("_r")).select(
            *cols, "_r.run", "_r.h")
        w = Window.partitionBy("run").orderBy("h")
        picked = e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        by_run: dict = {r: [] for r in range(1, n_init)}
        for r in picked.orderBy("run", "rn").collect():
            by_run[r["run"]].append([r[c] for c in cols])
        runs += [by_run[r] for r in range(1, n_init)]
    return [_filled(modes, k, cols) for modes in runs]


def _filled(modes: list, k: int, cols: Sequence[str]) -> list:
    """``k`` modes, the last repeated where there are fewer distinct tuples than clusters."""
    last = modes[-1] if modes else [NULL_TEXT] * len(cols)
    return modes + [last] * (k - len(modes))


class NotConverged(RuntimeError):
    """A start still moved after ``max_iter`` steps."""


def fit_many(tuples: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int,
             max_iter: int = 100, seed: int = 42, allow_unconverged: bool = False, init: str = "frequent") -> dict:
    """Fit every (k, start) pair together: one job per iteration for all
    starts still moving.  Returns {k: best KModesModel}.  Steps go on until no
    mode moves; a fit that hasn't ended after ``max_iter`` steps raises, or is
    flagged with ``allow_unconverged``."""
    cols = list(cols)
    starts = {}
    kmax = max(ks)
    pool = _initial_many(tuples, cols, kmax, n_init, seed, init)
    for k in ks:
        for run in range(n_init):
            modes = [list(m) for m in pool[run][:k]]
            starts[len(starts)] = (k, modes)
    modes = {sid: m for sid, (_, m) in starts.items()}
    iters = {sid: 0 for sid in starts}
    moving = set(starts)
    for _ in range(max_iter):
        if not moving:
            break
        # every start is kept in every step (converged ones map to themselves):
        # the expression keeps one shape, so its generated code is reused
        step = _update_many(tuples, cols, modes)
        for sid, (new, sizes) in step.items():
            if sid not in moving:
                continue
            new = _reseed_empty(tuples, cols, new, sizes)
            iters[sid] += 1
            if new == modes[sid]:
                moving.discard(sid)
            modes[sid] = new
    if moving and not allow_unconverged:
        raise NotConverged(f"{len(moving)} of {len(starts)} starts still move after {max_iter} steps")
    costs = costs_of(tuples, cols, modes)
    best: dict = {}
    for sid, (k, _) in starts.items():
        m = KModesModel(cols, modes[sid], costs[sid], iters[sid], sid not in moving)
        if k not in best or m.cost < best[k].cost:
            best[k] = m
    return best


def fit(df: DataFrame, cols: Sequence[str], k: int, n_init: int = 5, max_iter: int = 100,
        seed: int = 42, tuples: DataFrame | None = None, init: str = "frequent") -> KModesModel:
    """The best of ``n_init`` starts by cost; ``init``: "frequent" or "Huang"."""
    cols = list(cols)
    own = tuples is None
    if own:
        tuples = collapse(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_many(tuples, cols, [k], n_init, max_iter, seed, init=init)[k]
    finally:
        if own:
            tuples.unpersist()


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 5,
          seed: int = 42) -> DataFrame:
    """(k, cost) for each k, one fit per k on shared cached tuples."""
    tuples = collapse(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = fit_many(tuples, list(cols), list(ks), n_init, seed=seed)
        rows = [(int(k), float(best[k].cost)) for k in ks]
    finally:
        tuples.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def default_ks(n_rows: int) -> list[int]:
    """The reference's k range: 2 .. min(9, n // 100 + 2) - 1."""
    return list(range(2, min(9, n_rows // 100 + 2)))


def default_k(n_rows: int, cap: int = 5) -> int:
    """Explicit, documented choice: min(cap, len(range)), floored at 2 (the
    reference's expression is a length, not an elbow, and is 0 or 1 on small
    inputs)."""
    return max(2, min(cap, len(default_ks(n_rows))))


@dataclass(frozen=True)
class NoteRule:
    """``note`` when ``always`` (formatted with the mode) or when the cluster's mode of ``column`` is in ``values`` (and,
    if given, the mode of ``and_column`` is in ``and_values``);
    ``negate_note`` otherwise."""

    column: str
    values: tuple
    note: str
    negate_note: str | None = None
    and_column: str | None = None
    and_values: tuple = ()
    always: bool = False


def profiles(assigned: DataFrame, cols: Sequence[str], k: int,
             notes: Sequence[NoteRule] = ()) -> DataFrame:
    """I12 + D10: per cluster size, percent of rows, mode of every column
    (ties -> smallest, 'N/A' when empty) and rule notes; clusters without
    rows are listed with size 0."""
    spark = assigned.sparkSession
    from casebook.operators.rates import modes as _modes
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    agg = sizes.join(_modes(assigned, cols, by=["cluster"]), "cluster", "left")
    all_k = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    total = assigned.select(F.count(F.lit(1))).scalar()
    out = (all_k.join(agg, "cluster", "left")
                .fillna({"size": 0})
                .fillna({f"mode_{c}": "N/A" for c in cols})
                .withColumn("pct", F.col("size") * 100.0 / total))
    if notes:
        arms = []
        for r in notes:
            if r.always:
                arms.append(F.format_string(r.note, F.col(f"mode_{r.column}")))
                continue
            hit = F.col(f"mode_{r.column}").isin(*r.values)
            if r.and_column:
                hit = hit & F.col(f"mode_{r.and_column}").isin(*r.and_values)
            arms.append(F.when(hit, F.lit(r.note)))
            if r.negate_note:
                arms.append(F.when(~hit, F.lit(r.negate_note)))
        out = out.withColumn("notes", F.array_join(F.array_compact(F.array(*arms)), "; "))
    return out


def enough_rows(df: DataFrame, min_rows: int = 10) -> bool:
    """Clustering needs at least ``min_rows`` rows; one bounded
    ``limit(min_rows).count()`` job answers it without a full count."""
    return df.limit(min_rows).count() >= min_rows


def fit_if_enough(df: DataFrame, cols: Sequence[str], k: int, min_rows: int = 10,
                  **kw) -> KModesModel | None:
    """``fit`` guarded by ``enough_rows``; None when the input is too small."""
    return fit(df, cols, k, **kw) if enough_rows(df, min_rows) else None
