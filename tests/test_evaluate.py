"""Evaluation against brute force: AUC with ties, ROC with collinear drop."""

import numpy as np

from casebook.operators import evaluate as EV


def _data(spark, seed=3, n=300):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) * 0.6 + y * 0.3, 2)          # many ties
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double"), y, s


def _auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _roc_brute(y, s):
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    idx = np.where(np.diff(ss))[0]
    idx = np.r_[idx, len(ys) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    thr = ss[idx]
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fps, tps, thr = np.r_[0, fps], np.r_[0, tps], np.r_[np.inf, thr]
    return sorted(zip(fps / fps[-1], tps / tps[-1], thr))


def test_auc_exact_with_ties(spark):
    df, y, s = _data(spark)
    got = EV.auc(df, "y", "s").first()["auc"]
    assert abs(got - _auc_brute(y, s)) < 1e-12


def test_roc_curve_matches_reference_algorithm(spark):
    df, y, s = _data(spark)
    got = sorted((r["fpr"], r["tpr"], r["threshold"]) for r in EV.roc_curve(df, "y", "s").collect())
    want = _roc_brute(y, s)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert abs(g[0] - w[0]) < 1e-12 and abs(g[1] - w[1]) < 1e-12 and g[2] == w[2]


def test_confusion_metrics_zero_guards(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    m = EV.metrics(EV.confusion(df, "y", "s")).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 0, 0, 0)
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 1.0


def test_histogram_counts_and_density(spark):
    df, y, s = _data(spark)
    h = EV.score_histogram(df, "y", "s", bins=10).collect()
    for cls in (0, 1):
        rows = [r for r in h if r["y"] == cls]
        assert len(rows) == 10
        vals = s[y == cls]
        counts, edges = np.histogram(vals, bins=10)
        assert sum(r["n"] for r in rows) == len(vals)
        width = edges[1] - edges[0]
        assert abs(sum(r["density"] * width for r in rows) - 1) < 1e-9


def test_threshold_table(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.85), (1, 0.65), (0, 0.1)], "y int, s double")
    t = {r["threshold"]: r for r in EV.threshold_table(df, "y", "s").collect()}
    assert t[0.8]["n_at"] == 2 and t[0.8]["tp"] == 1 and t[0.8]["precision_at"] == 0.5
    assert t[0.6]["recall_at_pct"] == 100.0


def test_class_report_layout(spark):
    df, _, _ = _data(spark)
    r = {x["class"]: x for x in EV.class_report(df, "y", "s").collect()}
    assert set(r) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert r["accuracy"]["precision"] is None
