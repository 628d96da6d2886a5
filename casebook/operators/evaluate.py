"""Exact evaluation of a score against a 0/1 label.

Inputs are DataFrames with a label column and a score column (optionally a
group column such as the split).  Everything is aggregate-first: counts by
score or by (class, bin) collapse duplicates map-side, and the running sums
that AUC and ROC need come from ``ranking.value_prefix_sums`` (bucketed, no
single-task window over all scores).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.operators.ranking import value_prefix_sums
from casebook.session import cut_lineage


def _pred(score: str, cut: float) -> Column:
    return (F.col(score) >= cut).cast("int")


# ------------------------------------------------------------------ D14
def confusion(df: DataFrame, label: str, score: str, cut: float = P.OUTCOME_CUT,
              groups: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), _pred(score, cut)
    return df.where(y.isNotNull()).groupBy(*groups).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"))


# ------------------------------------------------------------------ D15
def metrics(conf: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1; 0 on an empty denominator."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return (conf.withColumn("accuracy", (tp + tn) / (tp + tn + fp + fn))
                .withColumn("precision", prec).withColumn("recall", rec)
                .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                         2 * F.col("precision") * F.col("recall")
                                         / (F.col("precision") + F.col("recall")))
                            .otherwise(F.lit(0.0))))


# ------------------------------------------------------------------ D16
def class_report(df: DataFrame, label: str, score: str, cut: float = P.OUTCOME_CUT) -> DataFrame:
    """Per-class precision/recall/f1/support, then accuracy, macro avg and
    weighted avg rows (sklearn's layout; zero-division -> 0)."""
    m = metrics(confusion(df, label, score, cut)).first()
    tp, fp, fn, tn = m["tp"], m["fp"], m["fn"], m["tn"]

    def prf(t, f_p, f_n):
        p = t / (t + f_p) if t + f_p else 0.0
        r = t / (t + f_n) if t + f_n else 0.0
        return p, r, (2 * p * r / (p + r) if p + r else 0.0)

    c1, c0 = prf(tp, fp, fn), prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = [("0", *c0, s0), ("1", *c1, s1),
            ("accuracy", None, None, (tp + tn) / n if n else 0.0, n),
            ("macro avg", *[(a + b) / 2 for a, b in zip(c0, c1)], n),
            ("weighted avg", *[((a * s0 + b * s1) / n if n else 0.0) for a, b in zip(c0, c1)], n)]
    return df.sparkSession.createDataFrame(
        rows, "class string, precision double, recall double, f1 double, support bigint")


# ------------------------------------------------------------------ D17
def threshold_table(df: DataFrame, label: str, score: str, thresholds=P.THRESHOLDS) -> DataFrame:
    """For each threshold t: rows with score >= t, their share, true
    positives, precision at t (0 when none) and recall at t in percent."""
    y = F.col(label)
    aggs = [F.count(F.lit(1)).alias("total"), F.sum(y).alias("positives")]
    for i, (t, _) in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & (y == 1)).alias(f"tp{i}")]
    one = df.where(y.isNotNull()).agg(*aggs)
    arms = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(name).alias("level"),
                     F.col(f"n{i}").alias("n_at"), F.col(f"tp{i}").alias("tp"))
            for i, (t, name) in enumerate(thresholds)]
    long = one.select("total", "positives", F.explode(F.array(*arms)).alias("t")).select(
        "total", "positives", "t.*")
    return long.select(
        "threshold", "level", "n_at",
        (F.col("n_at") * 100.0 / F.col("total")).alias("pct"),
        "tp",
        F.when(F.col("n_at") > 0, F.col("tp") / F.col("n_at")).otherwise(F.lit(0.0))
         .alias("precision_at"),
        (F.col("tp") * 100.0 / F.col("positives")).alias("recall_at_pct"))


# ------------------------------------------------------------------ D18
def score_histogram(df: DataFrame, label: str, score: str, bins: int = 50) -> DataFrame:
    """Per class: ``bins`` equal bins over that class's own min..max (last bin
    right-closed), count and density ``n / (N_class * width)``; empty bins
    are listed with 0."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    stats = d.groupBy(label).agg(F.min(score).alias("lo"), F.max(score).alias("hi"),
                                 F.count(F.lit(1)).alias("n_class"))
    # bound: one row per class
    j = d.join(F.broadcast(stats), label)
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col(score) - F.col("lo")) * bins / width),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = j.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = stats.select(label, "lo", "hi", "n_class",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, [label, "bin"], "left").fillna({"n": 0})
                .select(label, "bin",
                        (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                        "n",
                        F.when(w > 0, F.col("n") / (F.col("n_class") * w)).alias("density")))


# ------------------------------------------------------------- D19 / D20
def _by_score(df: DataFrame, label: str, score: str, groups: Sequence[str], count: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score (of the rows that a row stands for,
    by its ``count``), checkpointed to the shared
    checkpoint folder: the prefix-sum plan reads it three times (range,
    bucket totals, main pass), and the upstream scoring is not recomputed."""
    y = F.col(label)
    n = F.col(count) if count else F.lit(1)
    g = (df.where(y.isNotNull() & F.col(score).isNotNull())
           .groupBy(*groups, score)
           .agg(F.sum(y * n).cast("long").alias("pos"),
                F.sum((1 - y) * n).cast("long").alias("neg")))
    return cut_lineage(g)


def auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Exact ROC AUC (ties count one half), by rank sums:
    ``sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N)``.  ``count``: how many rows a
    row stands for."""
    g = _by_score(df, label, score, groups, count)
    c = value_prefix_sums(g, score, ["neg"], groups)
    return c.groupBy(*groups).agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def overfit_gap(df: DataFrame, label: str, score: str, split: str = "split") -> DataFrame:
    a = auc(df, label, score, [split])
    row = {r[split]: r["auc"] for r in a.collect()}  # one row per split
    tr, te = row.get("train"), row.get("test")
    return df.sparkSession.createDataFrame(
        [(tr, te, (tr - te) if tr is not None and te is not None else None)],
        "train_auc double, test_auc double, gap double")


# ------------------------------------------------------------- E2 / J3
def roc_curve(df: DataFrame, label: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """ROC points (fpr, tpr, threshold), thresholds descending, with the
    origin prepended at threshold +inf.  ``drop_intermediate`` removes points
    where both running counts are collinear with their neighbours."""
    g = _by_score(df, label, score, [])
    c = value_prefix_sums(g, score, ["pos", "neg"], before=drop_intermediate)
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("m")).first()
    P_, N_, m = tot["P"], tot["N"], tot["m"]
    if drop_intermediate and m > 2:
        # a point is on the line through its neighbours if the next lower score adds what this one adds
        c = c.where((F.col("position") == 1) | (F.col("position") == m)
                    | (F.col("pos") != F.col("prev_pos")) | (F.col("neg") != F.col("prev_neg")))
    pts = c.select(
        (F.lit(m) - F.col("position") + 1).alias("j"), F.col(score).alias("threshold"),
        (F.lit(P_) - F.col("cum_pos") + F.col("pos")).alias("tps"),
        (F.lit(N_) - F.col("cum_neg") + F.col("neg")).alias("fps"))
    origin = df.sparkSession.createDataFrame(
        [(0, float("inf"), 0, 0)], "j long, threshold double, tps long, fps long")
    allp = origin.unionByName(pts.select(F.col("j").cast("long"), "threshold",
                                         F.col("tps").cast("long"), F.col("fps").cast("long")))
    return allp.select(
        (F.col("fps") / F.lit(float(N_))).alias("fpr"),
        (F.col("tps") / F.lit(float(P_))).alias("tpr"),
        "threshold")


def distribution(df: DataFrame, score: str) -> DataFrame:
    """D7 on a score column."""
    from casebook.operators.rates import distribution_stats
    return distribution_stats(df, score)
