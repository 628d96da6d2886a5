"""Operator 13: license scan by ordered signature rules, in SQL functions only.

A text becomes lower-case words with single blanks between them.  The words name the
rules to try: a rule runs only where its keyword occurs.  Each match is an interval of
words; a detection whose interval lies in that of another of the same or a better
priority is suppressed (of equal ones the earlier rule's stays).  What is left, and the
base phrases, which nothing suppresses, are the detections of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm import signatures
from casebook.llm.common import pick, store

#: How much a detection of each priority says by itself.
WEIGHT = {1: 0.98, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.3}
BASE_WEIGHT = 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIT = "array<struct<start:int,stop:int,label:string,priority:int,rule:int>>"


def _normal(text: Column) -> Column:
    """Blank, the words with single blanks between them, blank.  ``lower`` is A-Z only but
    for the Kelvin sign, the one other letter whose lower case is an ASCII letter."""
    lower = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _rule_array(rules: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(x).alias("expression"), F.lit(label).alias("label"),
                              F.lit(p).alias("priority"), F.lit(i).alias("rule")) for k, x, label, p, i in rules])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] | None = None,
         base: tuple = signatures.BASE) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_words, and all
    matches, before suppression: hits (start, stop: first word and the one after the
    last; label, priority, rule) of ``rules`` and of the ``base`` phrases (priority 0)."""
    rules = signatures.rules() if rules is None else rules
    phrases = [(p.split(" ")[-1], rf"(?<= )(?:{p})(?= )", label, 0, -1 - i) for i, (p, label) in enumerate(base)]
    df = pick(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        _normal(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    words = F.when(F.length("norm") < 3, F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1)
    keys = F.array(*[F.lit(k) for k in sorted({r[0] for r in [*rules, *phrases]})])
    df = df.select("row", "doc_id", "norm", words.cast("long").alias("n_words"),
                   F.array_intersect(F.split("norm", " "), keys).alias("present"))
    df = df.withColumn("tried", F.when(F.size("present") > 0, F.filter(
        _rule_array([*rules, *phrases]), lambda r: F.array_contains("present", r["keyword"]))))
    # a matched stretch gets a mark before its first word; words that bear it are the starts
    hits = F.expr(r"""
        flatten(transform(tried, r -> zip_with(
          filter(transform(split(regexp_replace(norm, r.expression, '\u0001$0'), ' '),
                           (w, i) -> if(startswith(w, '\u0001'), i - 1, null)), i -> i is not null),
          regexp_extract_all(norm, r.expression, 0),
          (a, m) -> named_struct('start', a, 'stop', a + 1 + length(m) - length(replace(m, ' ', '')),
                                 'label', r.label, 'priority', r.priority, 'rule', r.rule))))""")
    none = F.array().cast(_HIT)
    return df.select("row", "doc_id", "n_words", F.coalesce(F.when(F.size("present") > 0, hits.cast(_HIT)), none).alias("hits"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] | None = None,
           base: tuple = signatures.BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (their smallest and largest start), base_labels, labels
    (sorted), score (the greatest weight of a detection, 0 without any) and detections
    (start, stop, label, priority, in words from 0; suppressed ones are left out).

    NULL and empty texts have no words and no detections; NULL ids and repeated rows
    are rows like all others; an empty table gives no rows.  Texts are read whole."""
    found = store(scan(docs, id_col, text_col, rules, base), "license-hits")
    long = found.where(F.size("hits") > 0).select("row", "doc_id", "n_words", F.inline("hits"))
    # what contains an interval stands before it in this order
    before = (Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.lit(None).cast("int")
    for p in sorted(WEIGHT):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority").between(1, p), F.col("stop"))).over(before)).otherwise(reach)
    is_base = F.col("priority") == 0
    long = long.withColumn("reach", reach).where(is_base | F.col("reach").isNull() | (F.col("reach") < F.col("stop")))
    weight = F.lit(BASE_WEIGHT)
    for p, w in WEIGHT.items():
        weight = F.when(F.col("priority") == p, F.lit(w)).otherwise(weight)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    some = long.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"),
        F.max(weight).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "priority"))).alias("detections"))
    empty = found.where(F.size("hits") == 0)
    kinds = dict(some.dtypes)
    values = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "detections": F.array()}
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    rest = empty.select(*[c if c in ("doc_id", "n_words") else values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    return some.select(*columns).unionByName(rest)
