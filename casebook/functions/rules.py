"""Rule-based categorisation as native column expressions (no Python UDFs).

Each rule object renders twice: ``column(c)`` gives a Spark ``Column`` that
stays inside whole-stage codegen, ``sql(expr)`` gives the same rule as ANSI
SQL text (used for the DuckDB oracles and for ``spark.sql`` users).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import presets as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def as_double(c) -> Column:
    """Lenient numeric parse: bad text -> NULL (ANSI mode would raise)."""
    return _col(c).try_cast("double")


def as_double_sql(expr: str) -> str:
    return f"TRY_CAST({expr} AS DOUBLE)"


# --------------------------------------------------------------------- B1
@dataclass(frozen=True)
class ValueMap:
    """Dictionary recode; unknown keys (and NULL) -> NULL (no ELSE)."""

    mapping: dict
    dtype: str = "int"

    def column(self, c) -> Column:
        c = _col(c)
        out = None
        for k, v in self.mapping.items():
            out = (F.when(c == F.lit(k), F.lit(v)) if out is None
                   else out.when(c == F.lit(k), F.lit(v)))
        return out.cast(self.dtype)

    def sql(self, expr: str) -> str:
        arms = " ".join(f"WHEN {_q(k)} THEN {v!r}" for k, v in self.mapping.items())
        t = "INTEGER" if self.dtype == "int" else self.dtype.upper()
        return f"CAST(CASE {expr} {arms} END AS {t})"


OUTCOME = ValueMap(P.OUTCOME_MAP)
MONTH_NUMBER = ValueMap({m: i + 1 for i, m in enumerate(P.MONTHS)})


# --------------------------------------------------------------------- B5
@dataclass(frozen=True)
class OutOfRangeFlag:
    """1 when value < low or value > high; NULL, NaN and bad text -> 0."""

    low: float = P.FLAG_LOW
    high: float = P.FLAG_HIGH

    def column(self, c) -> Column:
        a = as_double(c)
        hit = F.when(F.isnan(a), F.lit(False)).otherwise((a < self.low) | (a > self.high))
        return F.coalesce(hit, F.lit(False)).cast("int")

    def sql(self, expr: str) -> str:
        a = as_double_sql(expr)
        return (f"CAST(COALESCE(CASE WHEN isnan({a}) THEN FALSE "
                f"ELSE ({a} < {self.low} OR {a} > {self.high}) END, FALSE) AS INTEGER)")


# --------------------------------------------------------------------- B6
@dataclass(frozen=True)
class Bins:
    """Ordered ``value < edge -> label`` bins; NULL/NaN/bad text -> unknown."""

    edges: Sequence = tuple(P.AGE_EDGES_PROFILING)
    top: str = P.AGE_TOP
    unknown: str = P.AGE_UNKNOWN

    def column(self, c) -> Column:
        a = as_double(c)
        out = F.when(a.isNull() | F.isnan(a), F.lit(self.unknown))
        for edge, label in self.edges:
            out = out.when(a < edge, F.lit(label))
        return out.otherwise(F.lit(self.top))

    def sql(self, expr: str) -> str:
        a = as_double_sql(expr)
        arms = " ".join(f"WHEN {a} < {e} THEN {_q(l)}" for e, l in self.edges)
        return (f"CASE WHEN {a} IS NULL OR isnan({a}) THEN {_q(self.unknown)} {arms} "
                f"ELSE {_q(self.top)} END")


AGE_PROFILING = Bins(tuple(P.AGE_EDGES_PROFILING))
AGE_MODEL = Bins(tuple(P.AGE_EDGES_MODEL))


# ------------------------------------------------------------- B7, B8, B9
@dataclass(frozen=True)
class KeywordRules:
    """Lower-cased substring rules, first group wins; NULL -> ``null_label``,
    no match -> ``other``."""

    groups: Sequence = tuple((g, tuple(k)) for g, k in P.KEYWORD5)
    other: str = P.KEYWORD_OTHER
    null_label: str = P.KEYWORD_NULL

    def column(self, c) -> Column:
        c = _col(c)
        lc = F.lower(c.cast("string"))
        out = F.when(c.isNull(), F.lit(self.null_label))
        for label, words in self.groups:
            cond = None
            for w in words:
                t = lc.contains(w)
                cond = t if cond is None else (cond | t)
            out = out.when(cond, F.lit(label))
        return out.otherwise(F.lit(self.other))

    def sql(self, expr: str) -> str:
        lc = f"lower(CAST({expr} AS VARCHAR))"
        arms = []
        for label, words in self.groups:
            cond = " OR ".join(f"strpos({lc}, {_q(w)}) > 0" for w in words)
            arms.append(f"WHEN {cond} THEN {_q(label)}")
        return (f"CASE WHEN {expr} IS NULL THEN {_q(self.null_label)} {' '.join(arms)} "
                f"ELSE {_q(self.other)} END")


def keyword_rules(groups, other=P.KEYWORD_OTHER, null_label=P.KEYWORD_NULL) -> KeywordRules:
    return KeywordRules(tuple((g, tuple(k)) for g, k in groups), other, null_label)


WEAPON5 = keyword_rules(P.KEYWORD5)
WEAPON5_MODEL = keyword_rules(P.KEYWORD5_MODEL)
WEAPON5_NARROW = keyword_rules(P.KEYWORD5_NARROW)
WEAPON3 = keyword_rules(P.KEYWORD3)
# The scoring service's copy: NULL becomes the text 'none', which matches nothing.
WEAPON5_SERVICE = keyword_rules(P.KEYWORD5_MODEL, null_label=P.KEYWORD_OTHER)
ITEM_GROUPS = keyword_rules(P.ITEM_GROUPS)


# -------------------------------------------------------------------- B10
@dataclass(frozen=True)
class Recode:
    """Exact (case-sensitive) set membership, first set wins."""

    groups: Sequence = tuple((g, tuple(v)) for g, v in P.RELATION_GROUPS)
    other: str = P.RELATION_OTHER
    null_label: str = P.RELATION_NULL

    def column(self, c) -> Column:
        c = _col(c)
        s = c.cast("string")
        out = F.when(c.isNull(), F.lit(self.null_label))
        for label, values in self.groups:
            out = out.when(s.isin(*values), F.lit(label))
        return out.otherwise(F.lit(self.other))

    def sql(self, expr: str) -> str:
        arms = " ".join(
            f"WHEN CAST({expr} AS VARCHAR) IN ({', '.join(_q(v) for v in values)}) THEN {_q(label)}"
            for label, values in self.groups)
        return (f"CASE WHEN {expr} IS NULL THEN {_q(self.null_label)} {arms} "
                f"ELSE {_q(self.other)} END")


def recode(groups, other=P.RELATION_OTHER, null_label=P.RELATION_NULL) -> Recode:
    return Recode(tuple((g, tuple(v)) for g, v in groups), other, null_label)


RELATION = recode(P.RELATION_GROUPS)
SEGMENTS = recode(P.SEGMENT_GROUPS)


# -------------------------------------------------------------------- B12
@dataclass(frozen=True)
class MemberFlag:
    """1 when the value is in the set, else 0 (NULL -> 0)."""

    values: Sequence = tuple(P.MONTH_FLAG_SET)

    def column(self, c) -> Column:
        return F.coalesce(_col(c).isin(*self.values), F.lit(False)).cast("int")

    def sql(self, expr: str) -> str:
        vals = ", ".join(repr(v) for v in self.values)
        return f"CAST(COALESCE({expr} IN ({vals}), FALSE) AS INTEGER)"


MONTH_FLAG = MemberFlag()


# ------------------------------------------------------------ B20 B21 B22
@dataclass(frozen=True)
class Tiers:
    """Descending cut-offs on a score: the first ``score >= cut`` (or ``>``
    when ``strict``) wins; else ``default``."""

    cuts: Sequence
    default: str
    strict: bool = False

    def column(self, c) -> Column:
        c = _col(c)
        out = None
        for cut, label in self.cuts:
            cond = (c > cut) if self.strict else (c >= cut)
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        return out.otherwise(F.lit(self.default))

    def sql(self, expr: str) -> str:
        op = ">" if self.strict else ">="
        arms = " ".join(f"WHEN {expr} {op} {cut} THEN {_q(l)}" for cut, l in self.cuts)
        return f"CASE {arms} ELSE {_q(self.default)} END"


PRIORITY = Tiers(tuple((c, l) for c, l, _ in P.TIERS5), P.TIERS5_DEFAULT[0])
RECOMMENDATION = Tiers(tuple((c, r) for c, _, r in P.TIERS5), P.TIERS5_DEFAULT[1])
OUTCOME_TEXT = Tiers(((P.OUTCOME_CUT, P.OUTCOME_TEXT[0]),), P.OUTCOME_TEXT[1])
VERDICT = Tiers(((P.VERDICT_CUT, P.VERDICT_TEXT[0]),), P.VERDICT_TEXT[1])
PROFILE3 = Tiers(tuple(P.PROFILE3), P.PROFILE3_DEFAULT, strict=True)
BANDS5 = Tiers(tuple(P.BANDS5), P.BANDS5_DEFAULT)


def at_cut(c, cut: float = P.OUTCOME_CUT) -> Column:
    """Probability -> class with ``>=`` (Spark ML's own ``prediction``
    uses ``>``, so it is never used)."""
    return (_col(c) >= cut).cast("int")
