"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the whole test tables.

Doubles that are compared against the DuckDB twin are rounded to 6 places
(rates that the analysis itself rounds keep its half-even ``round(3)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.functions import rules as R_
from casebook.operators import crossfold as CV
from casebook.operators import dictionary as DI
from casebook.operators import evaluate as EV
from casebook.operators import features as FE
from casebook.operators import forests as FO
from casebook.operators import growth as GR
from casebook.operators import itemsets as IS
from casebook.operators import kmodes as KM
from casebook.operators import models as MD
from casebook.operators import rates
from casebook.operators import split as SP
from casebook.plans import scoring as SC
from casebook.plans import training as TR
from casebook.plans.catalog import cases as all_cases
from casebook.plans.catalog import derived_cases, documents, input_key, open_cases, stored
from casebook.session import cut_lineage, drop_path, scratch_path
from casebook.sources import sinks as SK
from casebook.sources.cases import load_cases

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ============================================================ step 1
@register("d1_rate_by_item_group")
def d1_rate_by_item_group(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: keyword-rule groups of the item text, outcome rate per group."""
    return rates.rate_table(derived_cases(spark, sf), "item_group", "label")


# ============================================================ step 2: rules
@register("b1_label_map")
def b1_label_map(spark, sf):
    df = derived_cases(spark, sf)
    return df.groupBy("outcome", "label").agg(F.count(F.lit(1)).alias("n"))


@register("b5_out_of_range_flag")
def b5_out_of_range_flag(spark, sf):
    return derived_cases(spark, sf).select("record_id", "age", "vulnerable")


@register("b6_age_bins")
def b6_age_bins(spark, sf):
    return derived_cases(spark, sf).select("record_id", "age", "age_cat", "age_category")


@register("b7_keyword_rules")
def b7_keyword_rules(spark, sf):
    return derived_cases(spark, sf).select("record_id", "item", "weapon", "weapon_group", "weapon_model",
                                           "weapon_service", "item_group")


@register("b8_keyword_narrow")
def b8_keyword_narrow(spark, sf):
    return derived_cases(spark, sf).select(
        "record_id", R_.WEAPON5_NARROW.column("weapon").alias("weapon_narrow"))


@register("b9_keyword3")
def b9_keyword3(spark, sf):
    return derived_cases(spark, sf).select("record_id", "weapon_category")


@register("b10_recode")
def b10_recode(spark, sf):
    return derived_cases(spark, sf).select("record_id", "grp_b", "relation", "grp_b_simple",
                                           "relation_simple")


@register("b11_b12_month")
def b11_b12_month(spark, sf):
    return derived_cases(spark, sf).select("record_id", "month", "month_num", "month_flag")


@register("d1_rate_by_region")
def d1_rate_by_region(spark, sf):
    return rates.rate_table(derived_cases(spark, sf), "region", "label")


@register("d1_rate_by_vulnerable")
def d1_rate_by_vulnerable(spark, sf):
    t = rates.rate_table(derived_cases(spark, sf), "vulnerable", "label")
    # Relabel the 0/1 key
    return t.select(F.when(F.col("vulnerable") == 1, "Vulnerable")
                     .otherwise("Not Vulnerable").alias("group"), "cases", "rate")


@register("d1_rate_by_segment")
def d1_rate_by_segment(spark, sf):
    return rates.rate_table(derived_cases(spark, sf), "grp_b_simple", "label")


@register("d1_quality_by_source")
def d1_quality_by_source(spark, sf):
    return rates.rate_table(documents(spark, sf), "source", "quality")


@register("d2_rate_top5_long")
def d2_rate_top5_long(spark, sf):
    t = rates.rate_tables_long(derived_cases(spark, sf), ["grp_a", "age", "region", "grp_b"],
                               "label", top=5)
    return t.select("feature", "category", r6("rate").alias("rate"), "cases", "rank",
                    "other_categories")


@register("d3_mean_by_year")
def d3_mean_by_year(spark, sf):
    t = rates.grouped_mean(derived_cases(spark, sf), "year", "label")
    return t.select("year", r6("rate").alias("rate"))


@register("d4_summary")
def d4_summary(spark, sf):
    t = rates.outcome_summary(derived_cases(spark, sf), "label")
    return t.select("n_rows", "n_solved", r6("rate").alias("rate"), "n_open", "n_open_all",
                    "n_labelled")


@register("d5_value_counts")
def d5_value_counts(spark, sf):
    return rates.value_counts(derived_cases(spark, sf), "region")


@register("d6_mode_by_region")
def d6_mode_by_region(spark, sf):
    return rates.modes(derived_cases(spark, sf), ["item", "grp_a", "age_cat"], by=["region"])


@register("d7_price_stats")
def d7_price_stats(spark, sf):
    t = rates.distribution_stats(derived_cases(spark, sf), "price")
    return t.select(*[r6(c).alias(c) for c in ["mean", "median", "min", "max"]])


@register("d8_yearly_rate_range")
def d8_yearly_rate_range(spark, sf):
    t = rates.rate_range(rates.grouped_mean(derived_cases(spark, sf), "year", "label"))
    return t.select(r6("min_rate").alias("min_rate"), r6("max_rate").alias("max_rate"))


@register("d9_missing_profile")
def d9_missing_profile(spark, sf):
    t = rates.missing_profile(derived_cases(spark, sf),
                              ["age", "item", "grp_a", "year", "region", "outcome"])
    return t.select("column", r6("missing_pct").alias("missing_pct"))


@register("d10_share_by_priority")
def d10_share_by_priority(spark, sf):
    t = rates.share_of_total(open_cases(spark, sf), "grp_a")
    return t.select("grp_a", "size", r6("pct").alias("pct"))


@register("d11_shape")
def d11_shape(spark, sf):
    return rates.shape(all_cases(spark, sf))


@register("f2_top5_regions")
def f2_top5_regions(spark, sf):
    t = rates.rate_table(derived_cases(spark, sf), "region", "label", digits=None)
    return rates.head(t, 5, "rate", "region").select(
        "region", r6("rate").alias("rate"), "cases", "rank")


@register("f3_bottom5_regions")
def f3_bottom5_regions(spark, sf):
    t = rates.rate_table(derived_cases(spark, sf), "region", "label", digits=None)
    return rates.tail(t, 5, "rate", "region").select(
        "region", r6("rate").alias("rate"), "cases", "rank")


@register("f4_best_worst_years")
def f4_best_worst_years(spark, sf):
    t = rates.grouped_mean(derived_cases(spark, sf), "year", "label")
    return rates.both_ends(t, 3, "rate", "year").select(
        "side", "year", r6("rate").alias("rate"), "rank")


@register("f5_top_open_by_price")
def f5_top_open_by_price(spark, sf):
    return rates.head(open_cases(spark, sf), 5, "price", "record_id").select(
        "record_id", "price", "rank")


@register("f6_both_ends_items")
def f6_both_ends_items(spark, sf):
    t = rates.rate_table(derived_cases(spark, sf), "item", "label", digits=None)
    return rates.both_ends(t, 5, "rate", "item").select(
        "side", "item", r6("rate").alias("rate"), "rank")


# ============================================================ step 3: features, splits

MODEL_NUMERIC = ["age", "units", "year"]
MODEL_CATEGORICAL = ["grp_a", "age_category", "item_group", "region"]


@register("b13_impute_mode")
def b13_impute_mode(spark, sf):
    df = FE.impute_mode(derived_cases(spark, sf), "item_group", "Unknown")
    return df.select("record_id", "item_group")


@register("b14_minmax_year")
def b14_minmax_year(spark, sf):
    df = FE.minmax(derived_cases(spark, sf), "year", "year_norm")
    return df.select("record_id", r6("year_norm").alias("year_norm"))


@register("b15_topk_bucket")
def b15_topk_bucket(spark, sf):
    df = derived_cases(spark, sf)
    m = FE.fit_topk(df, ["region", "item"], k=15)
    return m.apply(df, ["region", "item"]).select("record_id", "region", "item")


@register("c3_semi_join_topk")
def c3_semi_join_topk(spark, sf):
    df = derived_cases(spark, sf)
    m = FE.fit_topk(df, ["region"], k=15)
    return FE.semi_join_topk(df, m, "region").groupBy("region").agg(
        F.count(F.lit(1)).alias("n"))


@register("c1_target_encode")
def c1_target_encode(spark, sf):
    df = derived_cases(spark, sf)
    m = FE.fit_target_encoder(df, "region", "label")
    return m.apply(df).select("record_id", "region", r6("region_rate").alias("region_rate"))


@register("b18_rate_fallback")
def b18_rate_fallback(spark, sf):
    df = derived_cases(spark, sf)
    train = SP.stratified_split(df, ["record_id"], "label").where(F.col("split") == "train")
    m = FE.fit_target_encoder(train, "item", "label")
    return m.apply(df).select("record_id", "item", r6("item_rate").alias("item_rate"))


@register("b25_exact_sample")
def b25_exact_sample(spark, sf):
    return SP.exact_sample(derived_cases(spark, sf), ["record_id"]).select("record_id", "label")


@register("i4_stratified_split")
def i4_stratified_split(spark, sf):
    return SP.stratified_split(derived_cases(spark, sf), ["record_id"], "label").select(
        "record_id", "label", "split")


@register("i5_stratified_folds")
def i5_stratified_folds(spark, sf):
    return SP.stratified_folds(derived_cases(spark, sf), ["record_id"], "label").select(
        "record_id", "label", "fold")


@register("i6_class_weights")
def i6_class_weights(spark, sf):
    return SP.class_weights(derived_cases(spark, sf), "label").select(
        "label", "n", r6("weight").alias("weight"))


def _bucketed_labelled(spark, sf):
    df = derived_cases(spark, sf).where(F.col("label").isNotNull())
    m = FE.fit_topk(df, MODEL_CATEGORICAL, k=15)
    return m.apply(df, MODEL_CATEGORICAL)


@register("a8_vocab")
def a8_vocab(spark, sf):
    v = FE.fit_vocab(_bucketed_labelled(spark, sf), MODEL_NUMERIC, MODEL_CATEGORICAL)
    return v.table(spark)


@register("i2_onehot_drop_first")
def i2_onehot_drop_first(spark, sf):
    df = _bucketed_labelled(spark, sf)
    v = FE.fit_vocab(df, MODEL_NUMERIC, MODEL_CATEGORICAL)
    enc = v.apply(df, keep=["record_id"])
    dummies = v.features[len(MODEL_NUMERIC):]
    long = enc.select("record_id", *[F.col(f"`{d}`") for d in dummies]).unpivot(
        ["record_id"], [f"`{d}`" for d in dummies], "feature", "value")
    return long.groupBy("feature").agg(F.sum("value").cast("long").alias("n_ones"))


@register("i1_onehot_keep_all")
def i1_onehot_keep_all(spark, sf):
    cols = ["item_group", "grp_b_simple", "grp_a", "age_cat", "region"]
    v, enc = FE.onehot_all(open_cases(spark, sf), cols)
    feats = [f"`{f}`" for f in v.features]
    long = enc.unpivot([], feats, "feature", "value")
    return long.groupBy("feature").agg(F.sum("value").cast("long").alias("n_ones"))


@register("i3_label_codes")
def i3_label_codes(spark, sf):
    cols = ["grp_a", "age_cat", "item_group", "grp_b_simple", "region"]
    df = open_cases(spark, sf)
    codes = FE.fit_label_codes(df, cols)
    return codes.apply(df).select("record_id", *[f"{c}_code" for c in cols])


@register("i2_sparse_sums")
def i2_sparse_sums(spark, sf):
    """The logistic regression's matrix as sparse vectors over a dictionary table, summed
    by feature and split."""
    p = _prepared(spark, sf, "lr")
    df = SP.split_and_folds(derived_cases(spark, sf).select("record_id", "label", *LR_NUMERIC, *LR_CATEGORICAL), ["record_id"], "label")
    df = df.fillna(p.features.fill)
    enc = DI.fit_sparse(df.where(F.col("split") == "train"), LR_NUMERIC, LR_CATEGORICAL)
    sums = DI.feature_sums(enc.apply(df, keep=["split"]), ["split"])
    grid = enc.features().select("pos", "feature").crossJoin(F.broadcast(df.select("split").distinct()))  # two splits
    return grid.join(sums, ["split", "pos"], "left").select("split", "feature", F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"))


@register("i3_dictionary_codes")
def i3_dictionary_codes(spark, sf):
    """Label codes from a dictionary table, by join."""
    cols = ["grp_a", "age_cat", "item_group", "grp_b_simple", "region"]
    df = open_cases(spark, sf).select("record_id", *cols)
    d = DI.fit_dictionary(df, cols, null_text="nan")
    return DI.with_codes(df, d, cols, null_text="nan").select("record_id", *[f"{c}_code" for c in cols])


@register("i3_customer_codes")
def i3_customer_codes(spark, sf):
    """Codes of a column without bound: the customers' keys as text, in text order."""
    from casebook.sources.cases import read_table
    df = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return DI.with_codes(df, DI.fit_dictionary(df, ["customer"]), ["customer"]).select("o_orderkey", "customer_code")


# ============================================================ step 4: itemsets, rules

ASSOC_COLS = ["item_group", "grp_b_simple", "grp_a", "age_cat", "region"]


def _itemsets(spark, sf):
    return IS.frequent_itemsets(open_cases(spark, sf), ASSOC_COLS)


@register("d12_itemsets")
def d12_itemsets(spark, sf):
    return _itemsets(spark, sf).select("items_text", "size", "n", r6("support").alias("support"))


@register("d13_rules")
def d13_rules(spark, sf):
    r = IS.rules_for_csv(IS.association_rules(_itemsets(spark, sf)))
    return r.select("antecedents", "consequents",
                    *[r6(c).alias(c) for c in ["antecedent_support", "consequent_support",
                                               "support", "confidence", "lift", "leverage",
                                               "conviction"]])


@register("d13_top10_rules")
def d13_top10_rules(spark, sf):
    t = IS.top_rules(IS.association_rules(_itemsets(spark, sf)), 10)
    return t.select("rank", "antecedents_head", "consequents_head", r6("lift").alias("lift"),
                    r6("support").alias("support"))


# ============================================================ step 5: evaluation


def _scored(spark, sf):
    """Deterministic stand-in score for the evaluation operators:
    price / max(price) (a scalar subquery), on the stratified split.  Stored
    once per session, as a scored evaluation set would be."""
    def build():
        df = SP.stratified_split(derived_cases(spark, sf).select("record_id", "label", "price"), ["record_id"], "label")
        mx = derived_cases(spark, sf).select(F.max("price")).scalar()
        return (df.withColumn("score", F.col("price") / mx)
                  .select("record_id", "label", "split", "price", "score"))
    return stored(spark, sf, "scored", build)


def _test(spark, sf):
    return _scored(spark, sf).where(F.col("split") == "test")


@register("d14_confusion")
def d14_confusion(spark, sf):
    return EV.confusion(_test(spark, sf), "label", "score")


@register("d15_metrics")
def d15_metrics(spark, sf):
    m = EV.metrics(EV.confusion(_test(spark, sf), "label", "score"))
    return m.select(*[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


@register("d16_class_report")
def d16_class_report(spark, sf):
    r = EV.class_report(_test(spark, sf), "label", "score")
    return r.select("class", *[r6(c).alias(c) for c in ["precision", "recall", "f1"]], "support")


@register("d17_threshold_table")
def d17_threshold_table(spark, sf):
    t = EV.threshold_table(_test(spark, sf), "label", "score")
    return t.select("threshold", "level", "n_at", r6("pct").alias("pct"), "tp",
                    r6("precision_at").alias("precision_at"),
                    r6("recall_at_pct").alias("recall_at_pct"))


@register("d18_score_histogram")
def d18_score_histogram(spark, sf):
    h = EV.score_histogram(_test(spark, sf), "label", "score")
    return h.select("label", "bin", r6("bin_start").alias("bin_start"), "n",
                    r6("density").alias("density"))


@register("d19_auc")
def d19_auc(spark, sf):
    return EV.auc(_test(spark, sf), "label", "score").select(r6("auc").alias("auc"))


@register("d20_overfit_gap")
def d20_overfit_gap(spark, sf):
    g = EV.overfit_gap(_scored(spark, sf), "label", "score")
    return g.select(*[r6(c).alias(c) for c in ["train_auc", "test_auc", "gap"]])


@register("e2_roc")
def e2_roc(spark, sf):
    r = EV.roc_curve(_test(spark, sf), "label", "score")
    return r.select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), "threshold")


@register("d7_score_stats_open")
def d7_score_stats_open(spark, sf):
    s = _scored(spark, sf).where(F.col("label") == 0)
    t = EV.distribution(s, "score")
    return t.select(*[r6(c).alias(c) for c in ["mean", "median", "min", "max"]])


# ============================================================ step 6: k-modes

CLUSTER_COLS = ["sex", "age_cat", "weapon_group", "relation_simple", "region"]
K = 5


def _seed_assignment(spark, sf):
    o = open_cases(spark, sf)
    modes = KM.init_frequent(KM.collapse(o, CLUSTER_COLS), CLUSTER_COLS, K)
    return KM.assign(o, CLUSTER_COLS, modes, keep=["record_id"])


@register("i10_kmodes_assign")
def i10_kmodes_assign(spark, sf):
    """Assignment to fixed modes (the k most frequent tuples)."""
    return _seed_assignment(spark, sf).select("record_id", "cluster", "distance")


@register("i12_cluster_profiles")
def i12_cluster_profiles(spark, sf):
    a = _seed_assignment(spark, sf)
    notes = P.cluster_notes("relation_simple", "weapon_group", "sex", "age_cat", "region")
    p = KM.profiles(a, CLUSTER_COLS, K, notes)
    return p.select("cluster", "size", r6("pct").alias("pct"),
                    *[f"mode_{c}" for c in CLUSTER_COLS], "notes")


@register("d10_cluster_share")
def d10_cluster_share(spark, sf):
    a = _seed_assignment(spark, sf)
    keys = spark.range(K).select(F.col("id").cast("int").alias("cluster"))
    t = rates.share_of_total(a, "cluster", all_keys=keys)
    return t.select("cluster", "size", r6("pct").alias("pct"))


@register("i10_kmodes_fit")
def i10_kmodes_fit(spark, sf):
    """Full fit (best of 10 starts) and the A6 assignment table."""
    o = open_cases(spark, sf)
    m = KM.fit(o, CLUSTER_COLS, K, n_init=10)
    return m.assign(o, keep=["record_id"]).select("record_id", "cluster")


@register("i10_kmodes_step")
def i10_kmodes_step(spark, sf):
    """One batch step from the most frequent tuples: the weighted mode of each
    column in each cluster that has rows."""
    tuples = KM.collapse(open_cases(spark, sf), CLUSTER_COLS)
    modes = KM.init_frequent(tuples, CLUSTER_COLS, K)
    new, sizes = KM._update_many(tuples, CLUSTER_COLS, {0: modes})[0]
    rows = [(i, int(n), *m) for i, (m, n) in enumerate(zip(new, sizes)) if n]
    return spark.createDataFrame(rows, "cluster int, size bigint, " + ", ".join(f"mode_{c} string" for c in CLUSTER_COLS))


_HUANG_K, _HUANG_RUNS = 4, 2


@register("i10_huang_starts")
def i10_huang_starts(spark, sf):
    """Huang's starts on the open cases: modes drawn by value frequency, moved to tuples."""
    t = KM.collapse(open_cases(spark, sf), CLUSTER_COLS)
    starts = KM.init_huang(t, CLUSTER_COLS, _HUANG_K, _HUANG_RUNS, seed=P.SPLIT_SEED)
    rows = [(r, c, *mode) for r, modes in enumerate(starts) for c, mode in enumerate(modes)]
    return spark.createDataFrame(rows, "run int, cluster int, " + ", ".join(f"{c} string" for c in CLUSTER_COLS))


@register("i10_huang_fit_converged")
def i10_huang_fit_converged(spark, sf):
    """The fit from Huang's starts: modes that another batch step moves (none), rows, and
    whether its cost is that of its rows."""
    df = open_cases(spark, sf)
    m = KM.fit(df, CLUSTER_COLS, 5, n_init=5, init="Huang")
    t = KM.collapse(df, CLUSTER_COLS)
    again, sizes = KM._update_many(t, CLUSTER_COLS, {0: m.modes})[0]
    moved = sum(a != b for a, b, n in zip(m.modes, again, sizes) if n)
    a = m.assign(df)
    return a.agg(F.lit(len(m.modes)).alias("n_modes"), F.lit(moved).alias("n_moved"), F.count(F.lit(1)).alias("n_rows"),
                 (F.sum("distance") - F.lit(int(m.cost))).cast("long").alias("cost_difference"))


@register("i10_kmodes_fit_converged")
def i10_kmodes_fit_converged(spark, sf):
    """A fit's modes are those of its own assignment: modes, modes that another
    step would move, and rows assigned."""
    o = open_cases(spark, sf)
    tuples = KM.collapse(o, CLUSTER_COLS)
    m = KM.fit(o, CLUSTER_COLS, K, n_init=4)
    new, sizes = KM._update_many(tuples, CLUSTER_COLS, {0: m.modes})[0]
    moved = sum(a != b for x, y, n in zip(m.modes, new, sizes) if n for a, b in zip(x, y))
    return m.assign(o).agg(F.lit(len(m.modes)).alias("n_modes"), F.lit(moved).alias("n_moved"), F.count(F.lit(1)).alias("n_rows"))


@register("i11_elbow_costs")
def i11_elbow_costs(spark, sf):
    o = open_cases(spark, sf)
    return KM.elbow(o, CLUSTER_COLS, KM.default_ks(o.count()), n_init=5)


# ============================================================ step 7: models (rows-only)

LR_NUMERIC = ["age", "vulnerable"]
LR_CATEGORICAL = ["sex", "grp_a", "weapon_group", "relation_simple", "region"]
RF_NUMERIC = ["age", "units", "year"]
RF_CATEGORICAL = ["sex", "age_category", "weapon_service", "region"]

#: A coefficient table whose scores SQL can recompute; names not listed count as 0.
FIXED_INTERCEPT = -1.5
FIXED_COEFFICIENTS = {
    "age": 0.01, "units": 0.05, "region_rate": 2.0, "sex_Male": 0.4, "sex_Unknown": -0.3,
    "age_category_Child": 0.6, "age_category_Senior": -0.4, "weapon_service_Firearm": 0.8,
    "weapon_service_Knife": -0.5, "weapon_service_Other": 0.2, "weapon_service_Strangulation": -0.9}

_PREP: dict = {}


def _prepared(spark, sf, kind: str) -> TR.Prepared:
    key = input_key(spark, sf, kind)
    if key not in _PREP:
        df = derived_cases(spark, sf)
        if kind == "lr":
            # the analysis encodes all categories of these columns; NULL is the baseline
            _PREP[key] = TR.prepare(df, LR_NUMERIC, LR_CATEGORICAL, k=None)
        else:
            _PREP[key] = TR.prepare(df, RF_NUMERIC, RF_CATEGORICAL, rate_key="region")
    return _PREP[key]


def _counted_rows(spark, sf):
    """The forest's encoded rows, those alike counted: stored once, read by every fit of a
    cross-validation and by what is evaluated on it."""
    return stored(spark, sf, "rf_counted", lambda: GR.distinct_rows(
        _prepared(spark, sf, "rf").frame, ["label", "split", "fold", "weight"]))


def _forest(spark, sf):
    key = input_key(spark, sf, "rf_model")
    if key not in _PREP:
        p = _prepared(spark, sf, "rf")
        _PREP[key] = MD.random_forest(p.frame.where(F.col("split") == "train"), MD.FOREST_B)
    return _PREP[key]


def release() -> None:
    """Delete what the model queries keep stored."""
    for key, v in _PREP.items():
        spark = SparkSession.getActiveSession()
        if isinstance(v, TR.Prepared) and spark is not None and key[0] == spark.sparkContext.applicationId:
            drop_path(spark, v.path)
    _PREP.clear()


def _logreg(spark, sf):
    p = _prepared(spark, sf, "lr")
    return p, MD.logistic_regression(p.frame.where(F.col("split") == "train"))


@register("i7_encoded_sums")
def i7_encoded_sums(spark, sf):
    """The logistic regression's matrix over all labelled rows, summed by feature
    and split."""
    p = _prepared(spark, sf, "lr")
    names = spark.createDataFrame(list(enumerate(p.features.vocab.features)), "pos int, feature string")
    from pyspark.ml.functions import vector_to_array
    long = p.frame.select("split", F.posexplode(vector_to_array("features")).alias("pos", "x"))
    return (long.groupBy("split", "pos").agg(F.sum("x").alias("total")).join(names, "pos")
            .select("split", "feature", F.round("total", 3).alias("total")))


@register("i7_optimality")
def i7_optimality(spark, sf):
    """The gradient of the weighted, regularised loss at the fitted coefficients."""
    p, m = _logreg(spark, sf)
    g = MD.logistic_gradient(m, p.frame.where(F.col("split") == "train"), p.features.vocab)
    return g.select("feature", F.abs(F.round("gradient", 4)).alias("gradient"))


@register("i8_coefficient_ends")
def i8_coefficient_ends(spark, sf):
    """The five largest and the five smallest coefficients."""
    p, m = _logreg(spark, sf)
    return MD.coefficient_ends(m, p.features.vocab)


@register("i7_test_report")
def i7_test_report(spark, sf):
    """Class report of the logistic regression on its own test rows, with their AUC."""
    p, m = _logreg(spark, sf)
    s = MD.score(m, p.frame.where(F.col("split") == "test"))
    auc = EV.auc(s, "label", "probability_1").first()["auc"]
    return EV.class_report(s, "label", "probability_1").withColumn("auc", F.lit(auc))


@register("i7_logreg_coefficients")
def i7_logreg_coefficients(spark, sf):
    p = _prepared(spark, sf, "lr")
    m = MD.logistic_regression(p.frame.where(F.col("split") == "train"))
    return MD.coefficient_table(m, p.features.vocab)


@register("i9_tree_importance")
def i9_tree_importance(spark, sf):
    p = _prepared(spark, sf, "lr")
    m = MD.decision_tree(p.frame.where(F.col("split") == "train"))
    return MD.importance_table(m, p.features.vocab)


@register("i16_forest_importance_top10")
def i16_forest_importance_top10(spark, sf):
    p = _prepared(spark, sf, "rf")
    t = MD.importance_table(_forest(spark, sf), p.features.vocab)
    return rates.head(t, 10, "importance", "feature")


@register("i17_scored_test")
def i17_scored_test(spark, sf):
    """Held-out rows scored, with their case attributes fetched by id."""
    p = _prepared(spark, sf, "rf")
    s = MD.score(_forest(spark, sf), p.frame.where(F.col("split") == "test"))
    attrs = derived_cases(spark, sf).select("record_id", "grp_a", "age", "item", "region",
                                            "year", "units")
    return (s.select("record_id", F.col("label").cast("int").alias("actual"),
                     "probability_1", "predicted")
             .join(attrs, "record_id", "left"))


@register("d19_forest_auc")
def d19_forest_auc(spark, sf):
    p = _prepared(spark, sf, "rf")
    s = MD.score(_forest(spark, sf), p.frame)
    return EV.auc(s, "label", "probability_1", ["split"])


@register("d14_forest_confusion")
def d14_forest_confusion(spark, sf):
    p = _prepared(spark, sf, "rf")
    s = MD.score(_forest(spark, sf), p.frame.where(F.col("split") == "test"))
    return EV.metrics(EV.confusion(s, "label", "probability_1"))


def _score_keeping(fm, model, df):
    """All columns of ``df`` with its score, in one pass (C5: no join back)."""
    kept = {c: f"_k{i}" for i, c in enumerate(df.columns)}
    wide = df.select("*", *[F.col(c).alias(k) for c, k in kept.items()])
    s = MD.score(model, fm.encode(wide, keep=list(kept.values())))
    return s.select(*[F.col(k).alias(c) for c, k in kept.items()], "probability_1", "predicted")


@register("i18_rank_open")
def i18_rank_open(spark, sf):
    """Open cases scored by the forest, all case columns kept, sorted by
    score (range-partitioned sort).  Scores rows seen in training, as the
    analysis did."""
    p = _prepared(spark, sf, "rf")
    df = derived_cases(spark, sf).where(F.col("label") == 0)
    # stored once: the sort's range bounds are drawn from the scores, not from a second scoring
    s = cut_lineage(_score_keeping(p.features, _forest(spark, sf), df).drop("predicted"))
    return s.orderBy(F.col("probability_1").desc(), F.col("record_id"))


@register("i19_high_potential")
def i19_high_potential(spark, sf):
    """Held-out open cases with score > 0.7, top 5 (C2 + B2 + B3 + F5)."""
    t = i17_scored_test(spark, sf)
    hp = t.where((F.col("actual") == 0) & (F.col("probability_1") > P.HIGH_POTENTIAL_CUT))
    return rates.head(hp, 5, "probability_1", "record_id")


def _fold_models(spark, sf):
    """The logistic regressions of the cross-validation, fitted together."""
    key = input_key(spark, sf, "lr_folds")
    if key not in _PREP:
        _PREP[key] = CV.fit_folds(_prepared(spark, sf, "lr").frame)
    return _PREP[key]


@register("i5_cv_auc")
def i5_cv_auc(spark, sf):
    """5-fold stratified CV of the logistic regression, exact fold AUCs."""
    # balanced weights recomputed on each fit's own training folds
    oof = _fold_models(spark, sf).score(_prepared(spark, sf, "lr").frame)
    return MD.cv_auc(oof.select("label", "fold", "probability_1"))


@register("i5_cv_auc_forest")
def i5_cv_auc_forest(spark, sf):
    """5-fold stratified CV of forest A, exact fold AUCs."""
    # rows alike have one score: scored and counted once
    oof = MD.out_of_fold(_counted_rows(spark, sf), lambda d: MD.random_forest(
        SP.with_class_weights(d.drop("weight"), "label", count="n"), MD.FOREST_A, count="n"))
    return MD.cv_auc(oof.select("label", "fold", "n", "probability_1"), count="n")


@register("i5_optimality")
def i5_optimality(spark, sf):
    """The gradient of each fold's weighted, regularised loss at its coefficients, from
    the rows the fold leaves: its greatest entry, and the features it has."""
    p, m = _prepared(spark, sf, "lr"), _fold_models(spark, sf)
    out = None
    for f, beta in enumerate(m.coefficients):
        given = MD.GivenLogistic(beta[:-1], float(beta[-1]))
        train = SP.with_class_weights(p.frame.where(F.col("fold") != f).drop("weight"), "label")
        g = MD.logistic_gradient(given, train, p.features.vocab).agg(
            F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n_features"), F.abs(F.round(F.max(F.abs("gradient")), 4)).alias("gradient"))
        out = g if out is None else out.unionByName(g)
    return out


def _oof_forest(spark, sf):
    """Out-of-fold forest predictions of every labelled row (5 fits), stored
    once per session and shared by I15 and the out-of-fold ranking."""
    def build():
        oof = MD.out_of_fold(_prepared(spark, sf, "rf").frame, lambda d: MD.random_forest(d, MD.FOREST_B, count="n"),
                             train=_counted_rows(spark, sf))
        return oof.select("record_id", "label", "fold", "probability_1", "predicted")
    return stored(spark, sf, "rf_oof", build)


@register("i15_oof_accuracy")
def i15_oof_accuracy(spark, sf):
    return MD.oof_accuracy(_oof_forest(spark, sf))


@register("i18_rank_open_oof")
def i18_rank_open_oof(spark, sf):
    """I18 with ``out_of_fold=True``: each open case is scored by the forest
    trained on the folds that do not contain it."""
    oof = _oof_forest(spark, sf).where(F.col("label") == 0).select("record_id", "probability_1")
    df = derived_cases(spark, sf).where(F.col("label") == 0)
    # stored once: the sort's range bounds are drawn from the joined rows, not from a second join
    return cut_lineage(df.join(oof, "record_id", "inner")).orderBy(F.col("probability_1").desc(), F.col("record_id"))


# ============================================================ step 8: scoring


def _requests(spark, sf):
    return SC.parse_requests(SC.requests_from_cases(all_cases(spark, sf)))


@register("b16_b17_request_coercion")
def b16_b17_request_coercion(spark, sf):
    c = SC.coerce_requests(_requests(spark, sf))
    return c.select("request_id", "v_age", "v_victims", "v_year", r6("v_rate").alias("v_rate"),
                    "v_sex", "v_race", "v_weapon", "v_state", "state_text", "error")


@register("b27_documented_ranges")
def b27_documented_ranges(spark, sf):
    """Requests whose numbers lie outside of the documented ranges are errors too."""
    c = SC.coerce_requests(_requests(spark, sf), check_ranges=True)
    return c.select("request_id", "error")


def _standin(spark, sf):
    """Request rows with the stand-in probability (price / max price)."""
    df = derived_cases(spark, sf)
    mx = df.select(F.max("price")).scalar()
    return df.withColumn("p", F.col("price") / mx)


@register("b20_score_tiers")
def b20_score_tiers(spark, sf):
    p = F.col("p")
    return _standin(spark, sf).select(
        "record_id", R_.PRIORITY.column(p).alias("priority_level"),
        R_.RECOMMENDATION.column(p).alias("investigation_recommendation"),
        R_.OUTCOME_TEXT.column(p).alias("predicted_outcome"),
        R_.at_cut(p).alias("predicted_class"))


@register("b21_decision_labels")
def b21_decision_labels(spark, sf):
    d = _standin(spark, sf)
    r = SC.with_decision_labels(d, "p", "age", "weapon_service", "age_category", "region", "p",
                                out="r").select("record_id", "r")
    return r.select("record_id", F.col("r.verdict").alias("verdict"),
                    F.col("r.vulnerability").alias("vulnerability"),
                    F.col("r.vulnerability_label").alias("vulnerability_label"),
                    F.col("r.forensic_insights.risk_profile").alias("risk_profile"),
                    F.col("r.forensic_insights.investigation_advice").alias("advice"),
                    F.col("r.key_factors")[3]["impact"].alias("locality_impact"),
                    F.col("r.key_factors")[1]["impact"].alias("weapon_impact"),
                    F.col("r.key_factors")[1]["value"].alias("weapon_value"),
                    F.col("r.key_factors")[2]["value"].alias("demography_value"),
                    F.col("r.analysis").alias("analysis"))


@register("b22_display_bands")
def b22_display_bands(spark, sf):
    return _standin(spark, sf).select("record_id", R_.BANDS5.column("p").alias("band"))


@register("a13_feature_catalogue")
def a13_feature_catalogue(spark, sf):
    v = a8_vocab(spark, sf)
    return v.agg(F.count(F.lit(1)).alias("features_count"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "feature"))),
                                          lambda s: s["feature"]), ", ").alias("features"),
                 F.lit("ready").alias("model_status"))


def _bundle(spark, sf):
    p = _prepared(spark, sf, "rf")
    return p.features, _forest(spark, sf)


@register("i21_score_requests")
def i21_score_requests(spark, sf):
    fm, m = _bundle(spark, sf)
    return SC.score_requests(_requests(spark, sf), fm, m)


@register("a12_response_json")
def a12_response_json(spark, sf):
    fm, m = _bundle(spark, sf)
    return SC.response_json(SC.score_requests(_requests(spark, sf), fm, m))


def _raw_cases(spark, sf):
    """Raw case rows: text ages (some not a number), some without an id, no derived
    columns."""
    rid = F.col("record_id")
    return all_cases(spark, sf).select(
        F.when(rid % 5 != 0, rid.cast("string")).alias("case_id"), "sex", "weapon", "region", "year", "units",
        F.when(rid % 7 == 0, "abc").otherwise(F.col("age").cast("int").cast("string")).alias("age"))


@register("i20_score_cases")
def i20_score_cases(spark, sf):
    fm, m = _bundle(spark, sf)
    return SC.score_cases(_raw_cases(spark, sf), fm, m, timestamp="2024-01-01T00:00:00")


@register("a9_model_roundtrip")
def a9_model_roundtrip(spark, sf):
    """Save the feature model and forest to the shared checkpoint folder,
    load both back, and score all labelled rows with both pairs: rows, and rows
    whose score or class differs."""
    from pyspark.ml.classification import RandomForestClassificationModel
    fm, m = _bundle(spark, sf)
    path = scratch_path(spark, "model")
    fm.save(path + "/features")
    m.write().overwrite().save(path + "/forest")
    fm2 = TR.FeatureModel.load(path + "/features")
    m2 = RandomForestClassificationModel.load(path + "/forest")
    rows = derived_cases(spark, sf).where(F.col("label").isNotNull())
    a = MD.score(m, fm.encode(rows, keep=["record_id"])).select("record_id", "probability_1", "predicted")
    b = MD.score(m2, fm2.encode(rows, keep=["record_id"])).select(
        "record_id", F.col("probability_1").alias("p2"), F.col("predicted").alias("c2"))
    same = F.col("probability_1").eqNullSafe(F.col("p2")) & F.col("predicted").eqNullSafe(F.col("c2"))
    return a.join(b, "record_id", "full").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_different"))


def _streamed(spark, sf, fm, m):
    from casebook.streaming.requests import score_folder
    src = scratch_path(spark, "requests")
    SC.requests_from_cases(all_cases(spark, sf)).write.text(src)
    return score_folder(spark, src, fm, m)


@register("k1_stream_requests")
def k1_stream_requests(spark, sf):
    """Requests written as JSON lines, scored by a Structured Streaming job
    (availableNow trigger), sink read back."""
    return _streamed(spark, sf, *_bundle(spark, sf))


# ------------------------------------------------------------ the same with a given coefficient table


def _fixed(spark, sf):
    fm = _prepared(spark, sf, "rf").features
    return fm, MD.LinearScorer(fm.vocab.features, FIXED_COEFFICIENTS, FIXED_INTERCEPT)


def _flat(r):
    """Every field of the response, doubles rounded."""
    f = F.col("response.key_factors")
    return r.select(
        "request_id", "error", r6("response.probability").alias("probability"),
        F.col("response.probability_percent").alias("percent"), F.col("response.verdict").alias("verdict"),
        F.col("response.vulnerability").alias("vulnerability"), F.col("response.vulnerability_label").alias("vulnerability_label"),
        *[F.get(f, F.lit(i))[k].alias(f"factor{i}_{k}") for i in range(4) for k in ("label", "value", "impact")],
        *[F.col(f"response.forensic_insights.{k}").alias(k) for k in ("vulnerability_score", "risk_profile", "investigation_advice")],
        F.col("response.analysis").alias("analysis"))


@register("i21_requests_fixed")
def i21_requests_fixed(spark, sf):
    """Every response field of every request form, by a given coefficient table."""
    return _flat(SC.score_requests(_requests(spark, sf), *_fixed(spark, sf)))


@register("a12_response_json_fixed")
def a12_response_json_fixed(spark, sf):
    """The JSON documents, parsed back."""
    js = SC.response_json(SC.score_requests(_requests(spark, sf), *_fixed(spark, sf)))
    body = F.from_json("json", SC.RESPONSE_TYPE.add("error", "string"))
    r = js.select("request_id", body.alias("b")).select(
        "request_id", F.col("b.error").alias("error"), F.when(F.col("b.error").isNull(), F.col("b")).alias("response"))
    return _flat(r)


@register("k1_stream_requests_fixed")
def k1_stream_requests_fixed(spark, sf):
    """What the streaming job appended, every field."""
    return _flat(_streamed(spark, sf, *_fixed(spark, sf)))


@register("k1_stream_answers_fixed")
def k1_stream_answers_fixed(spark, sf):
    """Where the exactly-once stream put each request, and what it said."""
    from casebook.streaming.requests import start_answers
    src, out = scratch_path(spark, "requests"), scratch_path(spark, "answers")
    SC.requests_from_cases(all_cases(spark, sf)).write.text(src)
    start_answers(spark, src, f"{out}/answers", f"{out}/rejects", *_fixed(spark, sf), f"{out}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{out}/answers").select("request_id", F.lit("answers").alias("place"), r6("response.probability").alias("probability"),
                                                       F.lit(None).cast("string").alias("error"))
    bad = spark.read.parquet(f"{out}/rejects").select("request_id", F.lit("rejects").alias("place"), F.lit(None).cast("double").alias("probability"), "error")
    return good.unionByName(bad)


@register("i20_cases_fixed")
def i20_cases_fixed(spark, sf):
    r = SC.score_cases(_raw_cases(spark, sf), *_fixed(spark, sf), timestamp="2024-01-01T00:00:00")
    return r.withColumn("solvability_probability", r6("solvability_probability"))


def _fixed_scores(spark, sf):
    """All labelled rows scored, to 6 places: equal scores are equal in any engine."""
    fm, m = _fixed(spark, sf)
    return MD.score(m, _prepared(spark, sf, "rf").frame).withColumn("probability_1", r6("probability_1"))


def _fixed_test(spark, sf):
    return _fixed_scores(spark, sf).where(F.col("split") == "test")


@register("i17_scored_test_fixed")
def i17_scored_test_fixed(spark, sf):
    """Held-out rows scored, with their case attributes fetched by id."""
    attrs = derived_cases(spark, sf).select("record_id", "sex", "age", "weapon", "region", "year", "units")
    return (_fixed_test(spark, sf).select("record_id", F.col("label").cast("int").alias("actual"),
                                          r6("probability_1").alias("probability"), "predicted")
            .join(attrs, "record_id", "left"))


@register("i19_high_potential_fixed")
def i19_high_potential_fixed(spark, sf):
    """Held-out open cases above the cut, the best five."""
    t = i17_scored_test_fixed(spark, sf)
    hp = t.where((F.col("actual") == 0) & (F.col("probability") > P.HIGH_POTENTIAL_CUT))
    return rates.head(hp, 5, "probability", "record_id").select("record_id", "probability", "sex", "region", "rank")


@register("d14_d19_fixed")
def d14_d19_fixed(spark, sf):
    """Confusion, metrics and AUC of model scores on the held-out rows."""
    s = _fixed_test(spark, sf)
    auc = EV.auc(s, "label", "probability_1").select(r6("auc").alias("auc"))
    m = EV.metrics(EV.confusion(s, "label", "probability_1"))
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")]).crossJoin(auc)


@register("d17_d20_fixed")
def d17_d20_fixed(spark, sf):
    """Threshold table of model scores, with the AUC gap between train and test rows."""
    s = _fixed_scores(spark, sf)
    gap = EV.overfit_gap(s, "label", "probability_1")
    t = EV.threshold_table(s.where("split = 'test'"), "label", "probability_1")
    return t.select("threshold", "n_at", "tp", r6("precision_at").alias("precision_at")).crossJoin(
        gap.select(*[r6(c).alias(c) for c in ("train_auc", "test_auc", "gap")]))


@register("d7_model_score_stats")
def d7_model_score_stats(spark, sf):
    """Mean, median and range of the open cases' model scores."""
    fm, m = _fixed(spark, sf)
    s = MD.score(m, fm.encode(open_cases(spark, sf), keep=["record_id"]))
    return EV.distribution(s, "probability_1").select(*[r6(c).alias(c) for c in ["mean", "median", "min", "max"]])


@register("i5_i15_fold_scores")
def i5_i15_fold_scores(spark, sf):
    """Mean and deviation of the exact AUC over five stratified folds, and the
    accuracy over all, of given scores."""
    s = _fixed_scores(spark, sf)
    return MD.cv_auc(s).select(r6("mean_auc").alias("mean_auc"), r6("std_auc").alias("std_auc"), "folds").crossJoin(
        MD.oof_accuracy(s).select(r6("oof_accuracy").alias("accuracy")))


@register("i9_i16_importance_sums")
def i9_i16_importance_sums(spark, sf):
    """Invariants of the importance tables: a row per feature of the vocabulary, none
    below 0, sum 1."""
    lr, rf = _prepared(spark, sf, "lr"), _prepared(spark, sf, "rf")
    tree = MD.decision_tree(lr.frame.where(F.col("split") == "train"))
    out = None
    for name, model, p in (("tree", tree, lr), ("forest", _forest(spark, sf), rf)):
        t = MD.importance_table(model, p.features.vocab).agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("importance") < 0).alias("n_negative"),
            r6(F.sum("importance")).alias("total"))
        out = t if out is None else out.unionByName(t)
    return out


@register("i8_coefficient_ends_fixed")
def i8_coefficient_ends_fixed(spark, sf):
    """The ends of a given model's coefficient table, with odds ratios."""
    vocab = _prepared(spark, sf, "rf").features.vocab
    given = MD.GivenLogistic([FIXED_COEFFICIENTS.get(f, 0.0) for f in vocab.features], FIXED_INTERCEPT)
    return MD.coefficient_ends(given, vocab, 4).select("feature", "coef", r6("odds_ratio").alias("odds_ratio"))


@register("i9_stump_split")
def i9_stump_split(spark, sf):
    """The split that a one-level tree finds among 0/1 columns (the categories of the
    model's columns), and the training rows and positives on either side."""
    from pyspark.ml.feature import VectorAssembler
    df = SP.stratified_split(derived_cases(spark, sf).where("label is not null").select("record_id", "label", *LR_CATEGORICAL), ["record_id"], "label")
    train = df.where(F.col("split") == "train")
    vocab = FE.fit_vocab(train, [], LR_CATEGORICAL)
    names = [f"_f{i}" for i in range(len(vocab.features))]
    flags = vocab.apply(train, keep=["label"]).toDF("label", *names).withColumn("label", F.col("label").cast("double"))
    # stored once: the fit reads its rows three times
    tree = MD.split_tree(cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(flags).select("label", "features")))
    nodes = FO.node_table(tree)
    feature = F.get(F.array(*[F.lit(f) for f in vocab.features]), F.col("feature"))  # -1: rows alike in all columns
    root = nodes.where("node = 0").select("tree", feature.alias("split_on"))
    leaf = nodes.where("node > 0").select("tree", (F.col("node") == 2).cast("int").alias("value"), "n",
                                          F.element_at("stats", 2).cast("long").alias("positives"))
    return leaf.join(root, "tree").select("split_on", "value", "n", "positives")


@register("i11_elbow_recomputed")
def i11_elbow_recomputed(spark, sf):
    """The elbow's costs less those of the rows assigned anew to the modes (none), and
    whether another batch step moves a mode."""
    df = open_cases(spark, sf)
    t = KM.collapse(df, CLUSTER_COLS)
    ks = list(range(2, 6))
    best = KM.fit_many(t, CLUSTER_COLS, ks, 2)
    out = None
    for k in ks:
        again, sizes = KM._update_many(t, CLUSTER_COLS, {0: best[k].modes})[0]
        moved = sum(a != b for a, b, n in zip(best[k].modes, again, sizes) if n)
        one = best[k].assign(df).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_rows"), F.lit(moved).alias("n_moved"),
                                     (F.sum("distance") - F.lit(int(best[k].cost))).cast("long").alias("cost_difference"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ trees as tables

#: A given tree over (age, units, year): node, left, right, feature, threshold.
FIXED_TREE = [(0, 1, 6, 0, 49.0), (1, 2, 5, 1, 3.0), (2, 3, 4, 2, 1994.0), (3, -1, -1, -1, 0.0), (4, -1, -1, -1, 0.0),
              (5, -1, -1, -1, 0.0), (6, 7, 10, 2, 1997.0), (7, 8, 9, 0, 93.0), (8, -1, -1, -1, 0.0), (9, -1, -1, -1, 0.0),
              (10, -1, -1, -1, 0.0)]
FIXED_MIN_SPLIT = 2500

#: Given stumps: feature, threshold, share of positives up to it and above it.
FIXED_STUMPS = [(0, 39.0, 0.625, 0.375), (1, 4.0, 0.25, 0.5), (2, 1995.0, 0.875, 0.125)]
OOB_SEED = 42


def _number_rows(spark, sf):
    """Labelled rows with their numbers as an array."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RF_NUMERIC])
    return derived_cases(spark, sf).where("label is not null").select("record_id", "label", x.alias("x"))


@register("i13_min_split_nodes")
def i13_min_split_nodes(spark, sf):
    """Rows that reach each node of a given tree, and whether it is a leaf, after nodes
    of fewer rows than the minimum split size were made leaves."""
    rows = _number_rows(spark, sf)
    nodes = spark.createDataFrame([(0, *n) for n in FIXED_TREE], "tree int, node int, left int, right int, feature int, threshold double")
    counted = nodes.join(FO.reach_counts(rows, nodes), ["tree", "node"], "left").fillna(0, ["n"])
    kept = FO.reachable(counted, FIXED_MIN_SPLIT)
    return kept.select("node", "n", F.coalesce(F.col("positives").cast("long"), F.lit(0)).alias("positives"),
                       ((F.col("left") < 0) | (F.col("n") < FIXED_MIN_SPLIT)).alias("leaf"))


@register("i14_min_split_tree")
def i14_min_split_tree(spark, sf):
    """A trained tree cut back to a minimum split size: training rows at the root, split
    nodes with fewer rows than that, and nodes whose row count isn't that of the training
    rows routed through the tree."""
    p = _prepared(spark, sf, "rf")
    train = p.frame.where(F.col("split") == "train")
    tree = MD.decision_tree(train, weight=None, max_depth=8, min_split=FIXED_MIN_SPLIT // 10)
    nodes = FO.node_table(tree)
    from pyspark.ml.functions import vector_to_array
    seen = FO.reach_counts(train.select("label", vector_to_array("features").alias("x")), nodes).select(
        "tree", "node", F.col("n").alias("seen"))
    return nodes.join(seen, ["tree", "node"], "full").agg(
        F.max(F.when(F.col("node") == 0, F.col("n"))).alias("n_root"),
        F.count_if((F.col("left") >= 0) & (F.col("n") < FIXED_MIN_SPLIT // 10)).alias("n_small_splits"),
        F.count_if(~F.col("n").eqNullSafe(F.col("seen"))).alias("n_different"))


@register("i15_bags")
def i15_bags(spark, sf):
    """How often each of the forest's bags holds the labelled rows."""
    return FO.bags(_number_rows(spark, sf), ["record_id"], MD.FOREST_B.num_trees, OOB_SEED)


@register("i15_oob_votes_fixed")
def i15_oob_votes_fixed(spark, sf):
    """Out-of-bag accuracy of given stumps, by number of free trees."""
    rows = _number_rows(spark, sf)
    says = F.array(*[F.when(F.get("x", F.lit(f)) <= t, lo).otherwise(hi) for f, t, lo, hi in FIXED_STUMPS])
    votes = rows.select("record_id", "label", F.posexplode(says).alias("tree", "p1"))
    oob = FO.out_of_bag(votes, ["record_id"], "label", OOB_SEED)
    return oob.groupBy("trees").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("predicted").cast("long").alias("n_predicted"),
                                    r6(F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"))


@register("i15_oob_accuracy")
def i15_oob_accuracy(spark, sf):
    """The forest fitted to explicit bags of the training rows, and its accuracy on the
    rows that each tree's bag leaves out."""
    p = _prepared(spark, sf, "rf")
    train = p.frame.where(F.col("split") == "train")
    model = FO.bagged_forest(train, MD.FOREST_B, ["record_id"])
    votes = FO.leaf_votes(model, train.select("record_id", "label", "features"), ["record_id", "label"])
    return FO.oob_accuracy(FO.out_of_bag(votes, ["record_id"], "label", MD.FOREST_B.seed))


# ============================================================ sources, sinks, set ops

_CSV_NAMES = {"record_id": "Record ID", "outcome": "Crime Solved", "item": "Item", "age": "Victim Age", "grp_a": "Group A",
              "grp_b": "Group B", "region": "State", "units": "Victim Count", "year": "Year", "month": "Month",
              "price": "Price", "weapon": "Weapon", "relation": "Relationship", "sex": "Victim Sex"}


@register("a1_csv_load")
def a1_csv_load(spark, sf):
    """A1-A3 + B1: the case table as the analysis's CSV shape (names with
    spaces; cells with missing-value texts and with quotes in them), written with
    Spark, read back with an explicit schema, names normalised and the 0/1 label
    added."""
    src = all_cases(spark, sf).select(*[F.col(c).alias(n) for c, n in _CSV_NAMES.items()])
    texts = src.withColumns({
        "Victim Age": F.when(F.col("Record ID") % 9 == 0, "NaN").otherwise(F.col("Victim Age").cast("string")),
        "Weapon": F.when(F.col("Record ID") % 8 == 0, "NA").when(F.col("Record ID") % 8 == 1, "None")
                   .when(F.col("Record ID") % 8 == 2, 'a "gun", loaded').otherwise(F.col("Weapon"))})
    path = scratch_path(spark, "cases-csv")
    SK.write_csv(texts, path)
    return load_cases(spark, path, schema=src.schema)


@register("a1_csv_inferred")
def a1_csv_inferred(spark, sf):
    """Types found for the columns of a CSV without a schema: the case table's, one that
    turns to text in its last row, one of truth values, one without values."""
    src = all_cases(spark, sf).select(*[F.col(c).alias(n) for c, n in _CSV_NAMES.items()])
    top = src.agg(F.max("Record ID")).first()[0]
    rid = F.col("Record ID")
    texts = src.withColumns({
        "Victim Age": F.when(rid % 9 == 0, "NaN").otherwise(F.col("Victim Age").cast("string")),
        "Weapon": F.when(rid % 8 == 0, "NA").when(rid % 8 == 1, "None").otherwise(F.col("Weapon")),
        "Late Text": F.when(rid == top, "12x").otherwise(rid.cast("string")),
        "Late Number": F.when(rid == top, "0.5").when(rid % 3 == 0, "N/A").otherwise(rid.cast("string")),
        "Flag": F.when(rid % 2 == 0, "True").otherwise("False"), "Nothing": F.lit("NaN")})
    path = scratch_path(spark, "cases-csv")
    SK.write_csv(texts, path)
    back = load_cases(spark, path)
    return spark.createDataFrame([(c, t) for c, t in back.dtypes], "column string, type string")


@register("a5_rules_csv")
def a5_rules_csv(spark, sf):
    """The rules table as written, with each row's place in the files."""
    rules = IS.association_rules(_itemsets(spark, sf))
    path = SK.write_rules_csv(rules, scratch_path(spark, "rules-csv"))
    schema = ("antecedents string, consequents string, antecedent_support double, "
              "consequent_support double, support double, confidence double, lift double, "
              "leverage double, conviction double")
    back = SK.read_ranked(spark, path, schema)
    return back.select("antecedents", "consequents",
                       *[r6(c).alias(c) for c in ["antecedent_support", "consequent_support",
                                                  "support", "confidence", "lift", "leverage",
                                                  "conviction"]], "place")


@register("f1_sorted_rates")
def f1_sorted_rates(spark, sf):
    """A rate table in rate order, as written: each row's place."""
    t = rates.sort_rates(rates.rate_table(derived_cases(spark, sf), "region", "label"), key="region")
    path = SK.write_csv(t, scratch_path(spark, "rates-csv"))
    return SK.read_ranked(spark, path, t.schema)


@register("a6_cluster_csv")
def a6_cluster_csv(spark, sf):
    path = SK.write_assignments_csv(_seed_assignment(spark, sf), scratch_path(spark, "clusters"))
    return SK.read_csv(spark, path, "record_id bigint, cluster int")


@register("a7_ranked_open_csv")
def a7_ranked_open_csv(spark, sf):
    """Open cases with all case columns and the model score, written in score order
    and read back with each row's place in the files."""
    fm, m = _fixed(spark, sf)
    df = derived_cases(spark, sf).where(F.col("label") == 0)
    s = _score_keeping(fm, m, df).select(*all_cases(spark, sf).columns, F.round("probability_1", 9).alias("score"))
    path = SK.write_ranked_csv(s, scratch_path(spark, "ranked"), "score")
    return SK.read_ranked(spark, path, s.schema).withColumn("score", r6("score"))


@register("g1_vocab_drift")
def g1_vocab_drift(spark, sf):
    """G1: features the model expects that a scoring batch never produces
    (expected EXCEPT ALL present).  Batch: the '1-URGENT' cases."""
    lab = _bucketed_labelled(spark, sf)
    v = FE.fit_vocab(lab, MODEL_NUMERIC, MODEL_CATEGORICAL)
    expected = v.table(spark).select("feature")
    df = derived_cases(spark, sf).where(F.col("label").isNotNull())
    topk = FE.fit_topk(df, MODEL_CATEGORICAL, k=15)
    batch = topk.apply(derived_cases(spark, sf).where(F.col("grp_a") == "1-URGENT"),
                       MODEL_CATEGORICAL)
    present = (batch.select(*MODEL_CATEGORICAL)
                    .unpivot([], MODEL_CATEGORICAL, "column", "value")
                    .where(F.col("value").isNotNull())
                    .select(F.concat_ws("_", "column", "value").alias("feature")).distinct()
                    .unionByName(spark.createDataFrame([(c,) for c in MODEL_NUMERIC], "feature string")))
    return expected.exceptAll(present)


@register("i13_forest_a_importance")
def i13_forest_a_importance(spark, sf):
    """The first forest of the analysis (100 trees, depth 15, min leaf
    10, sqrt features, balanced weights), importance table and test AUC."""
    p, rows = _prepared(spark, sf, "rf"), _counted_rows(spark, sf)
    m = MD.random_forest(rows.where(F.col("split") == "train"), MD.FOREST_A, count="n")
    imp = MD.importance_table(m, p.features.vocab)
    # rows alike have one score: scored and counted once
    a = EV.auc(MD.score(m, rows.where(F.col("split") == "test")), "label", "probability_1", count="n")
    return rates.head(imp, 10, "importance", "feature").withColumn(
        "test_auc", F.lit(a.first()["auc"]))


# ============================================================ second binding: documents
DOC_COLS = ["lang", "source", "toxic"]


@register("d2_documents_rates")
def d2_documents_rates(spark, sf):
    t = rates.rate_tables_long(documents(spark, sf), ["lang", "source"], "quality", top=5)
    return t.select("feature", "category", r6("rate").alias("rate"), "cases", "rank",
                    "other_categories")


def _doc_itemsets(spark, sf):
    return IS.frequent_itemsets(documents(spark, sf).where(F.col("quality") == 0), DOC_COLS)


@register("d12_documents_itemsets")
def d12_documents_itemsets(spark, sf):
    return _doc_itemsets(spark, sf).select("items_text", "size", "n",
                                           r6("support").alias("support"))


@register("d13_documents_rules")
def d13_documents_rules(spark, sf):
    r = IS.rules_for_csv(IS.association_rules(_doc_itemsets(spark, sf)))
    return r.select("antecedents", "consequents",
                    *[r6(c).alias(c) for c in ["antecedent_support", "consequent_support",
                                               "support", "confidence", "lift", "leverage",
                                               "conviction"]])


@register("i10_kmodes_cost")
def i10_kmodes_cost(spark, sf):
    """Cost (summed matching distance) of the open cases under the fixed
    modes, and the rows assigned."""
    a = _seed_assignment(spark, sf)
    return a.agg(F.sum("distance").cast("long").alias("cost"),
                 F.count(F.lit(1)).alias("n_rows"))


@register("d12_basket_itemsets")
def d12_basket_itemsets(spark, sf):
    """D12 on generic baskets: the part names of each order's lines."""
    from casebook.sources.cases import read_table
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    baskets = (li.join(part, li.l_partkey == part.p_partkey, "inner")
                 .groupBy("l_orderkey").agg(F.collect_set("p_name").alias("items")))
    t = IS.basket_itemsets(baskets, "items", min_support=0.01, max_len=3)
    return t.select("items_text", "size", "n", r6("support").alias("support"))
