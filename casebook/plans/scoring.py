"""Scoring of new cases and of service-style requests (I20, I21, A11-A14,
B16, B17, B20-B22, B27).

Both are batch jobs over any number of rows: parse/coerce -> derive ->
encode with the stored ``FeatureModel`` -> model transform -> label columns.
Bad input never raises per row: it lands in an ``error`` column, and the row's
result is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook import presets as P
from casebook.functions import rules as R
from casebook.operators import models as MD
from casebook.plans.training import FeatureModel
from casebook.sources.cases import available

# The fields of a request; every one optional, numbers as JSON numbers or text.
REQUEST_FIELDS = ("sex", "age", "race", "weapon", "state", "year", "victims", "historicalRate")

RESPONSE_TYPE = T.StructType([
    T.StructField("probability", T.DoubleType()),
    T.StructField("probability_percent", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("vulnerability", T.BooleanType()),
    T.StructField("vulnerability_label", T.StringType()),
    T.StructField("key_factors", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("impact", T.StringType())]))),
    T.StructField("forensic_insights", T.StructType([
        T.StructField("vulnerability_score", T.StringType()),
        T.StructField("risk_profile", T.StringType()),
        T.StructField("investigation_advice", T.StringType())])),
    T.StructField("analysis", T.StringType()),
])


# Texts that parse as a number, blanks around them allowed.
_REAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"


def parse_requests(lines: DataFrame, json_col: str = "value", id_field: str = "request_id", keep_text: str | None = None) -> DataFrame:
    """JSON documents (one a row) as (request_id, body VARIANT), with the text
    itself as the column ``keep_text``, if given.  Text that isn't a JSON document has a
    NULL body."""
    body = F.try_parse_json(F.col(json_col))
    text = [] if keep_text is None else [F.col(json_col).alias(keep_text)]
    return lines.select(body.alias("body"), *text).select(
        F.expr(f"try_variant_get(body, '$.{id_field}', 'string')").alias("request_id"), "body", *([] if keep_text is None else [keep_text]))


class _Field:
    """A field of the VARIANT column ``body``: absent (SQL NULL), null (type VOID) or a
    value.  ``read`` gives its columns, which later steps use instead of the VARIANT;
    those of them that no step uses are never computed."""

    def __init__(self, name: str):
        self.name = name
        self.absent, self.kind, self.text, self.number = (F.col(f"_{x}_{name}") for x in ("absent", "kind", "text", "number"))
        self.null = self.kind == "VOID"
        self.is_text = self.kind == "STRING"
        self.is_truth = self.kind == "BOOLEAN"
        # truthiness of the JSON value: absent, null, "", 0, false, [] and {} are false; any other text, also "0", is true
        self.falsy = F.coalesce(self.absent | self.null | (self.is_text & (self.text == "")) | (self.is_truth & (self.text == "false"))
                                | (~self.is_text & (self.number == 0)) | self.text.isin("[]", "{}") & ~self.is_text, F.lit(False))

    def value(self) -> Column:
        return F.expr(f"variant_get(body, '$.{self.name}', 'variant')").alias(f"_v_{self.name}")

    def read(self) -> list[Column]:
        v = f"_v_{self.name}"
        return [F.col(v).isNull().alias(f"_absent_{self.name}"), F.expr(f"schema_of_variant({v})").alias(f"_kind_{self.name}"),
                F.expr(f"try_variant_get({v}, '$', 'string')").alias(f"_text_{self.name}"),
                F.expr(f"try_variant_get({v}, '$', 'double')").alias(f"_number_{self.name}")]

    def real(self) -> Column:
        return (F.when(self.is_text, F.when(self.text.rlike(_REAL), F.btrim(self.text, F.lit(" \t\n\r\f\v")).try_cast("double")))
                .when(self.is_truth, (self.text == "true").cast("double")).otherwise(self.number))

    def whole(self) -> Column:
        """Text must be a whole number; a JSON number loses its fraction."""
        cut = F.when(self.number >= 0, F.floor(self.number)).otherwise(F.ceil(self.number))
        return (F.when(self.is_text, F.when(self.text.rlike(_WHOLE), F.btrim(self.text, F.lit(" \t\n\r\f\v")).try_cast("int")))
                .when(self.is_truth, (self.text == "true").cast("int")).otherwise(cut.try_cast("int")))


# ------------------------------------------------------------- B16 / B17
def coerce_requests(requests: DataFrame, defaults: dict = P.REQUEST_DEFAULTS,
                    falsy_as_missing: bool = True, check_ranges: bool = False) -> DataFrame:
    """(request_id, body) -> typed request columns with defaults, plus ``error``
    (NULL when good).

    * age/victims/year: a false JSON value (absent, null, "", 0) -> default; with
      ``falsy_as_missing=False`` the number 0 is a value; text must parse (counts
      and years as whole numbers), JSON numbers are taken as they are, counts and
      years without their fraction; all else -> error (B17).
    * historicalRate: absent -> default (null too: the service failed on it, Q6);
      "" and other text that doesn't parse -> error.
    * text fields: absent -> default; null stays NULL.  ``state_text`` is the state
      as the service prints it: NULL when absent or null.
    * a body that isn't a JSON object -> error.
    * ``check_ranges`` adds the documented (unenforced) ranges as errors (B27):
      age 0-100, year 1980-2025, victims >= 1.

    Number columns of error rows hold the defaults, so later steps can run."""
    fields = {name: _Field(name) for name in REQUEST_FIELDS}
    kept = [c for c in requests.columns if c != "body"]
    # only an object is a map; its schema would be put together field by field
    whole = F.expr("try_variant_get(body, '$', 'map<string, variant>')").isNotNull()
    requests = requests.select("*", *[f.value() for f in fields.values()])
    requests = requests.select(*requests.columns[:len(kept) + 1], whole.alias("_object"), *[c for f in fields.values() for c in f.read()])
    parsed, missing, kinds = {}, {}, {"age": "double", "victims": "int", "year": "int", "historicalRate": "double"}
    for name, kind in kinds.items():
        f = fields[name]
        parsed[name] = (f.real() if kind == "double" else f.whole()).alias(f"_parsed_{name}")
        if name == "historicalRate":
            lack = F.coalesce(f.absent | f.null, F.lit(True))
        elif falsy_as_missing:
            lack = f.falsy
        else:
            lack = f.falsy & ~F.coalesce(~f.is_text & (f.number == 0), F.lit(False))
        missing[name] = lack.alias(f"_missing_{name}")
    texts = {f"v_{name}": F.when(fields[name].absent, F.lit(defaults[name])).otherwise(fields[name].text) for name in ("sex", "race", "weapon", "state")}
    texts["state_text"] = fields["state"].text
    # each number is parsed once, as a column that its value and the error read
    requests = requests.select(*kept, "body", "_object", *parsed.values(), *missing.values(), *[c.alias(n) for n, c in texts.items()])
    bad, values = ~F.col("_object"), {}
    for name, kind in kinds.items():
        number, given = F.col(f"_parsed_{name}"), ~F.col(f"_missing_{name}")
        wrong = given & number.isNull()
        if check_ranges and name != "historicalRate":
            lo, hi = {"age": (0, 100), "year": (1980, 2025), "victims": (1, None)}[name]
            wrong = wrong | (given & (number < lo)) | ((given & (number > hi)) if hi is not None else F.lit(False))
        bad = bad | F.coalesce(wrong, F.lit(False))
        values[{"historicalRate": "v_rate"}.get(name, f"v_{name}")] = F.coalesce(F.when(given, number), F.lit(defaults[name])).cast(kind)
    return requests.select(*kept, "body", *[c.alias(n) for n, c in values.items()], *texts,
                           F.when(bad, F.lit(P.ERROR_BAD_NUMBER)).alias("error"))


# ------------------------------------------------------------------ B21
def with_decision_labels(df: DataFrame, prob: str, age: str, weapon_group: str,
                         age_group: str, state: str, rate: str, out: str = "response",
                         model_note: str = P.MODEL_NOTE) -> DataFrame:
    """Add the A12 response struct.  ``weapon_group`` holds the service's groups
    (``R.WEAPON5_SERVICE``: a missing weapon is 'Other'); a NULL ``state`` prints
    as None.  ``model_note`` is what the response says of the model.  The parts
    used several times (flag, labels, percent text) are computed once as columns
    first; the struct is then assembled from column references, which keeps the
    generated code small enough for the JIT."""
    p = F.col(prob)
    d = df.withColumns({
        "_vuln": R.OutOfRangeFlag().column(age) == 1,
        "_firearm": F.col(weapon_group) == F.lit("Firearm"),
        "_pct": F.format_string("%.1f%%", p * 100),
        "_state": F.coalesce(F.col(state), F.lit("None")),
    })
    d = d.withColumns({
        "_vlabel": F.when(F.col("_vuln"), F.lit(P.VULNERABLE_TEXT[0]))
                    .otherwise(F.lit(P.VULNERABLE_TEXT[1])),
        "_urgent": F.col("_vuln") | (p > P.URGENCY_CUT),
    })
    vuln, firearm, vlabel = F.col("_vuln"), F.col("_firearm"), F.col("_vlabel")
    factors = F.array(
        F.struct(F.lit(P.FACTOR_LABELS[0]).alias("label"), F.lit(model_note).alias("value"),
                 F.lit("positive").alias("impact")),
        F.struct(F.lit(P.FACTOR_LABELS[1]).alias("label"),
                 F.concat(F.lit(P.FACTOR_WEAPON_TEXT), F.col(weapon_group)).alias("value"),
                 F.when(F.col(weapon_group) == "Other", "neutral").otherwise("positive")
                  .alias("impact")),
        F.struct(F.lit(P.FACTOR_LABELS[2]).alias("label"),
                 F.concat(F.lit(P.FACTOR_DEMOGRAPHY_TEXT), F.col(age_group), F.lit(" ("), vlabel,
                          F.lit(")")).alias("value"),
                 F.when(vuln, "positive").otherwise("neutral").alias("impact")),
        F.struct(F.lit(P.FACTOR_LABELS[3]).alias("label"),
                 F.concat(F.lit(P.FACTOR_LOCALITY_TEXT), F.col("_state")).alias("value"),
                 F.when(F.col(rate) > P.LOCALITY_CUT, "positive").otherwise("negative")
                  .alias("impact")))
    insights = F.struct(
        F.when(vuln, F.lit(P.VULNERABILITY_SCORE_TEXT[0]))
         .otherwise(F.lit(P.VULNERABILITY_SCORE_TEXT[1])).alias("vulnerability_score"),
        R.PROFILE3.column(p).alias("risk_profile"),
        F.when(firearm, F.lit(P.ADVICE_TEXT[0])).otherwise(F.lit(P.ADVICE_TEXT[1]))
         .alias("investigation_advice"))
    analysis = F.format_string(
        P.ANALYSIS_TEXT, F.col("_pct"), vlabel, F.col("_state"),
        F.when(F.col("_urgent"), F.lit(P.URGENCY_TEXT[0])).otherwise(F.lit(P.URGENCY_TEXT[1])),
        F.when(firearm, F.lit(P.BALLISTIC_TEXT)).otherwise(F.lit("")))
    resp = F.struct(
        p.alias("probability"), F.col("_pct").alias("probability_percent"),
        R.VERDICT.column(p).alias("verdict"), vuln.alias("vulnerability"),
        vlabel.alias("vulnerability_label"), factors.alias("key_factors"),
        insights.alias("forensic_insights"), analysis.alias("analysis"))
    return d.withColumn(out, resp).drop("_vuln", "_firearm", "_pct", "_state", "_vlabel",
                                        "_urgent")


@dataclass
class RequestBinding:
    """How request fields map onto the model's case columns."""

    sex: str = "sex"
    age: str = "age"
    weapon: str = "weapon"
    state: str = "region"
    year: str = "year"
    victims: str = "units"
    weapon_rule: R.KeywordRules = R.WEAPON5_SERVICE
    weapon_group: str = "weapon_service"
    age_rule: R.Bins = R.AGE_MODEL
    age_group: str = "age_category"


def score_requests(requests: DataFrame, fm: FeatureModel, model,
                   binding: RequestBinding = RequestBinding(),
                   falsy_as_missing: bool = True, model_note: str = P.MODEL_NOTE) -> DataFrame:
    """Requests (request_id, body) -> (request_id, error, response struct),
    in one pass: every row is scored, and the response of a row with an error is
    NULL.  The request's own rate replaces the stored rate lookup."""
    return score_coerced(coerce_requests(requests, falsy_as_missing=falsy_as_missing), fm, model, binding, model_note)


def score_coerced(coerced: DataFrame, fm: FeatureModel, model, binding: RequestBinding = RequestBinding(),
                  model_note: str = P.MODEL_NOTE) -> DataFrame:
    """``score_requests`` of rows that ``coerce_requests`` gave."""
    b = binding
    case = coerced.select(
        "request_id", "error", "state_text", "v_age", "v_rate",
        F.col("v_sex").alias(b.sex), F.col("v_age").alias(b.age),
        F.col("v_weapon").alias(b.weapon), F.col("v_state").alias(b.state),
        F.col("v_year").alias(b.year), F.col("v_victims").alias(b.victims),
        F.col("v_rate").alias(fm.rate_out or "_rate"))
    case = case.withColumns({
        b.weapon_group: b.weapon_rule.column(b.weapon),
        b.age_group: b.age_rule.column(b.age)})
    keep = ["request_id", "error", "state_text", "v_age", "v_rate", b.weapon_group, b.age_group]
    s = MD.score(model, fm.encode(case, keep=keep, use_given_rate=True))
    r = with_decision_labels(s, "probability_1", "v_age", b.weapon_group, b.age_group,
                             "state_text", "v_rate", model_note=model_note)
    return r.select("request_id", "error", F.when(F.col("error").isNull(), F.col("response")).alias("response"))


def response_json(scored: DataFrame) -> DataFrame:
    """One JSON document per request."""
    return scored.select("request_id", F.when(
        F.col("error").isNull(), F.to_json("response"))
        .otherwise(F.to_json(F.struct(F.col("error")))).alias("json"))


# ------------------------------------------------------------------ I20
@dataclass
class CaseBinding:
    """Columns of raw cases, and the derived ones the model was trained on."""

    age: str = "age"
    age_group: str = "age_category"
    age_rule: R.Bins = R.AGE_MODEL
    weapon: str = "weapon"
    weapon_group: str = "weapon_service"
    weapon_rule: R.KeywordRules = R.WEAPON5_SERVICE


def score_cases(cases: DataFrame, fm: FeatureModel, model, key: str = "case_id",
                timestamp: str | None = None, binding: CaseBinding = CaseBinding()) -> DataFrame:
    """Raw case rows -> probability, percentage text, priority tier, outcome
    text, recommendation, a caller-given timestamp text (deterministic) and
    ``error``.

    The age group is derived, and the weapon group unless the cases bring it
    (A4); categories that the cases have no column for are NULL.  Numeric columns
    may be text; a value that doesn't parse is the row's error and its results
    are NULL.  A missing or NULL key is 'Unknown'."""
    b = binding
    d = cases
    have = lambda *names: available(d, names)
    if not have(key):
        d = d.withColumn(key, F.lit(None).cast("string"))
    d = d.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("Unknown")))
    bad: list[Column] = []
    for c in fm.numeric:
        if not have(c):
            d = d.withColumn(c, F.lit(None).cast("double"))
            continue
        given = F.col(c).cast("string")
        bad.append(given.isNotNull() & given.try_cast("double").isNull())
        d = d.withColumn(f"_n_{c}", given.try_cast("double"))
    error = F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(c)) for x, c in zip(bad, have(*fm.numeric))])), ", ")
    d = d.withColumn("error", F.when(error != "", F.concat(F.lit("not a number: "), error)))
    for c in fm.numeric:
        if have(f"_n_{c}"):
            d = d.withColumn(c, F.col(f"_n_{c}")).drop(f"_n_{c}")
    if have(b.age):
        d = d.withColumn(b.age_group, b.age_rule.column(b.age))
    if not have(b.weapon_group) and have(b.weapon):
        d = d.withColumn(b.weapon_group, b.weapon_rule.column(b.weapon))
    for c in [*fm.categorical, *([fm.rate_key] if fm.rate_key else [])]:
        if not have(c):
            d = d.withColumn(c, F.lit(None).cast("string"))
    s = MD.score(model, fm.encode(d, keep=[key, "error"]))
    p, good = F.col("probability_1"), F.col("error").isNull()
    columns = {
        "solvability_probability": p, "solvability_percentage": F.format_string("%.1f%%", p * 100),
        "priority_level": R.PRIORITY.column(p), "predicted_outcome": R.OUTCOME_TEXT.column(p),
        "investigation_recommendation": R.RECOMMENDATION.column(p)}
    return s.select(key, *[F.when(good, c).alias(n) for n, c in columns.items()],
                    F.lit(timestamp).cast("string").alias("prediction_timestamp"), "error")


def _json_value(column: str, quoted: bool) -> Column:
    text = F.col(column).cast("string")
    return F.concat(F.lit('"'), text, F.lit('"')) if quoted else text


def requests_from_cases(cases: DataFrame) -> DataFrame:
    """Request documents derived from a case table, as JSON lines (column
    ``value``): each number field takes, by the case's key, one of the forms that
    clients send - absent, null, "", " ", "0", 0, 2.5, "2.5", "abc", the number,
    the number as text - and each text field is absent, null or given."""
    rid = F.col("record_id")
    d = cases.select("record_id", "sex", "weapon", "region", F.col("age").cast("int").alias("age"), "year", "units",
                     F.format_string("%.2f", F.lit(0.54) + (rid % 30) / 100).alias("rate"))

    step = lambda by, n: F.floor(rid / by).cast("long") % n
    # the form that a field takes, as a column first
    forms = {"age": step(1, 11), "victims": step(11, 11), "year": step(3, 11), "historicalRate": step(5, 11),
             "sex": step(1, 4), "state": step(2, 4), "weapon": step(4, 4)}
    d = d.select("*", *[code.cast("int").alias(f"_form_{name}") for name, code in forms.items()])

    def number(field: str, column: str) -> Column:
        name, code = f'"{field}":', F.col(f"_form_{field}")
        fixed = F.array(*[F.lit(None if x is None else name + x).cast("string")
                          for x in (None, "null", '""', '" "', '"0"', "0", "2.5", '"2.5"', '"abc"')])
        return (F.when(code == 9, F.concat(F.lit(name), _json_value(column, False)))
                .when(code == 10, F.concat(F.lit(name), _json_value(column, True))).otherwise(F.get(fixed, code)))

    def text(field: str, column: str) -> Column:
        name, code = f'"{field}":', F.col(f"_form_{field}")
        return (F.when(code == 0, F.lit(None)).when(code == 1, F.lit(name + "null"))
                .otherwise(F.concat(F.lit(name), _json_value(column, True))))

    parts = [F.concat(F.lit('"request_id":"'), rid.cast("string"), F.lit('"')),
             number("age", "age"), number("victims", "units"), number("year", "year"), number("historicalRate", "rate"),
             text("sex", "sex"), text("state", "region"), text("weapon", "weapon")]
    return d.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))
