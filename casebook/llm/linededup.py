"""Operator 8: line dedup by a segment-partition edit join, in SQL functions only.

Two lines within ``k`` edits share, if one is cut into k + 1 segments, at least
one segment, and that stands in the other line near its own place.  A line of n
characters indexes its k + 1 segments by (n, segment, content); each distinct line
probes, for every partner length from n - k to n, the substrings that could be such a
segment.  What meets is verified by a banded bit-parallel edit distance: first each
line with the smallest line of its signature, then, of what that left in different
components, the lines that lengths and letter counts allow to link.

Without a given ``k`` the threshold grows with the shorter of two lines
(``allowed``): one edit from 8 characters on, k from k * ``PER`` on.  Lines of k >= 2
edits are cut at places that their class fixes, so that a probe serves partners of all
lengths.  The probes grow with the square of k, so lines of ``LONG_EDITS`` edits or more
meet otherwise: k edits leave a run of at least (n - k) / (k + 1) equal characters, in
which both lines select the same grams, of a third of its length (``_grams``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import components, likely, pick, store

#: With a given k, lines of fewer characters are compared for equality only: within
#: a few characters almost any two short lines are alike.
LEAST_CHARS = 20

#: Without a given k: one edit from SHORT_CHARS characters on (shorter lines only if
#: equal), and for each PER characters of a longer line one, without an upper limit.
SHORT_CHARS = 8
PER = 100
#: Lines of so many edits or more meet at selected grams instead of segments: the band
#: of fewer fits into the bits of a long.
LONG_EDITS = 31


def _places(spark: SparkSession, most: int) -> DataFrame:
    """(k, s, less, shift) for up to ``most`` edits: segment, how much shorter the partner
    is, shift; of a line's own segments, the second is -1.  A probe of the own length
    without a shift is an own segment."""
    # what stands before and behind the segment differs in length by shift and less - shift:
    # so many edits at least; of the first equal segment, s edits at most stand before it
    probes = """less >= 0 and (less > 0 or shift <> 0) and abs(shift) + abs(less - shift) <= k
                and abs(shift) <= s and abs(less - shift) <= k - s"""
    return (_shifts(spark, 1, most).withColumn("less", F.explode(F.expr("sequence(-1, k)")))
            .where(f"(less = -1 and shift = 0) or ({probes})"))


def _shifts(spark: SparkSession, least: int, most: int) -> DataFrame:
    """(k, s, shift): thresholds, their segments, and how far these may be shifted."""
    return (spark.range(least, most + 1, numPartitions=1).select(F.col("id").cast("int").alias("k"))
            .withColumn("s", F.explode(F.expr("sequence(0, k)"))).withColumn("shift", F.explode(F.expr("sequence(-k, k)"))))


def _hashed(parts: str, start: str, size: str) -> str:
    """SQL: hash of ``parts`` and of so many characters of the line.  The bytes of ASCII
    lines are found without a walk from the line's start; they hash as the characters."""
    start, size = f"cast({start} + 1 as int)", f"cast({size} as int)"
    return (f"if(octet_length(line) = n, xxhash64({parts}, substring(cast(line as binary), {start}, {size})), "
            f"xxhash64({parts}, substring(line, {start}, {size})))")


def _entries(lines: DataFrame, edits, most: int) -> DataFrame:
    """(key, sig, less) of lines(key, line, n): signatures of their segments and probes.
    ``edits(n)`` is SQL for the edits a shorter line of n characters allows, ``most`` at
    the most; a line may be the longer one of a pair with one edit fewer.  Each line
    meets the table of places in a broadcast join."""
    df = lines.withColumn("k", F.expr(f"cast({edits('n')} as int)")).where(f"k between 1 and {most + 1}")
    df = df.select("key", "line", "n", F.explode(F.array("k", F.col("k") - 1)).alias("k")).where(f"k between 1 and {most}")
    m, parts = "(n - greatest(less, 0))", "(k + 1)"
    long = f"(s - {parts} + {m} % {parts})"  # the last segments are longer by one
    start = f"(s * ({m} div {parts}) + greatest(0, {long}) + shift)"
    size = f"({m} div {parts} + if({long} >= 0, 1, 0))"
    df = df.join(F.broadcast(_places(lines.sparkSession, most)), "k").where(f"{edits(m)} = k and {start} >= 0 and {start} + {size} <= n")
    return df.select("key", F.expr(_hashed(f"{m}, s", start, size)).alias("sig"), "less")


#: Greatest threshold whose band fits into the bits of a long.
BAND_EDITS = LONG_EDITS - 1


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _apart(a: str, b: str, k: str) -> str:
    """SQL: whether the first or last 4k + 16 characters show more than ``k`` edits.  Of
    texts k edits apart, beginnings of one length are 2k apart at most: up to k edits,
    and as many characters by which these shift the end."""
    return " or ".join(f"levenshtein({side}({a}, 4 * {k} + 16), {side}({b}, 4 * {k} + 16), 2 * {k}) < 0" for side in ("left", "right"))


def within(a: str, b: str, k: int | str) -> Column:
    """Whether the edit distance of columns ``a`` and ``b`` is at most ``k`` (a number or
    an int column, up to BAND_EDITS).

    What the texts share at both ends is cut off by bisection.  Of the rest, each
    character of b is a column of 2w + 1 cells around the diagonal, kept as bits of
    vertical differences; the distance is followed down the lower edge of the
    band, then along the last row.  A path that leaves the diagonal by more than
    w = (k + m - n) / 2 needs more than k edits to come back to the end."""
    steps = "array(" + ",".join(str(1 << i) for i in range(24, -1, -1)) + ")"
    least = "least(char_length(a), char_length(b))"
    head = (f"aggregate({steps}, 0, (p, s) -> if(p + s <= {least} and "
            "substring(a, p + 1, s) = substring(b, p + 1, s), p + s, p))")
    tail = (f"aggregate({steps}, 0, (p, s) -> if(p + s <= {least} - h and "
            "right(left(a, char_length(a) - p), s) = right(left(b, char_length(b) - p), s), p + s, p))")
    strip = lambda x: f"substring({x}, h + 1, char_length({x}) - h - t)"
    hp, hn = "(z.vn | ~(d | z.vp)) & f", "(d & z.vp)"
    step = f"""named_struct(
        'vp', ({hn} | (~(shiftright(d, 1) | ({hp})))) & f, 'vn', shiftright(d, 1) & ({hp}), 'd',
        z.d + if(y.j <= m - w, if(d & shiftleft(1L, 2 * w) = 0, 1, 0),
              if(({hp}) & shiftleft(1L, m - y.j + w) <> 0, 1, 0) - if({hn} & shiftleft(1L, m - y.j + w) <> 0, 1, 0)))"""
    # the column's character is looked up in its 2w + 1 rows, then the bits are combined
    d0 = """aggregate(slice(p, y.j, 2 * w + 1), 0L, (x, c) -> shiftright(x, 1) | if(c = y.c, shiftleft(1L, 2 * w), 0L),
                      x -> ((((x & z.vp) + z.vp) ^ z.vp) | x | z.vn) & f)"""
    start = "named_struct('vp', f & ~(shiftleft(1L, w) - 1), 'vn', 0L, 'd', w)"
    walk = f"aggregate(q, {start}, (z, y) -> if(z.d > k + w + n - m, z, {_let('d', d0, step)})).d"
    walk = _let("w", "cast((k + abs(m - n)) div 2 as int)", _let("f", "shiftleft(1L, 2 * w + 1) - 1", _let(
        "p", "concat(array_repeat('', w), split(c, ''), array_repeat('', 2 * w))", _let(
            "q", "transform(split(e, ''), (x, i) -> named_struct('j', i + 1, 'c', x))", walk))))
    value = f"""case when abs(m - n) > k then k + 1 when {_apart('c', 'e', 'k')} then k + 1
                     when m <= k or n <= k then least(k + 1, levenshtein(c, e)) else {walk} end"""
    sql = _let("h", head, _let("t", tail, _let("c", strip("a"), _let("e", strip("b"), _let(
        "m", "char_length(c)", _let("n", "char_length(e)", value))))))
    sql = _let("a", a, _let("b", b, f"{sql} <= k"))
    return F.expr(_let("k", f"cast({k} as int)", sql))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, n, key): the lines that aren't blank, trimmed."""
    return (pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
            .select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line")).where("line <> ''")
            .withColumn("n", F.char_length("line")).withColumn("key", F.xxhash64("line")))


def allowed(n: str, per: int = PER) -> str:
    """SQL: edits by which a line of ``n`` characters and one as long or longer may differ."""
    return f"if({n} < {SHORT_CHARS}, 0, greatest(1, cast({n} div {per} as int)))"


def links(docs: DataFrame, k: int, least_chars: int, id_col: str, text_col: str, complete: bool = True) -> DataFrame:
    """(a, b): keys of different lines within ``k`` edits; without ``complete`` only as
    many as their components need."""
    if not 1 <= k <= BAND_EDITS:
        raise ValueError(f"k: 1 to {BAND_EDITS}")
    lines, edits = _distinct(docs, least_chars, id_col, text_col), lambda n: str(k)
    return _linked(lines, [_met(_entries(lines, edits, k))], edits, complete)


def grown_links(docs: DataFrame, per: int, id_col: str, text_col: str, complete: bool = True) -> DataFrame:
    """(a, b): keys of different lines within the edits that the shorter is allowed;
    without ``complete`` only as many as their components need."""
    lines = _distinct(docs, SHORT_CHARS, id_col, text_col)
    edits = lambda n: allowed(n, per)
    low = lines.where(F.col("n") < LONG_EDITS * per + LONG_EDITS)
    # one edit: segments by the partner's length; more: by class
    entries = _entries(low.where(F.col("n") <= 2 * per), lambda n: f"least({edits(n)}, 2)", 1).unionAll(_class_entries(low, per, BAND_EDITS))
    return _linked(lines, [_met(entries), _met(_grams(lines.where(F.col("n") >= LONG_EDITS * per), per))], edits, complete)


def _distinct(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(line, n, key) of the different lines of at least so many characters."""
    lines = lines_of(docs, id_col, text_col).where(F.col("n") >= least).select("line").distinct()
    return store(lines.select("line", F.char_length("line").alias("n"), F.xxhash64("line").alias("key")), "lines-distinct")


def _class_places(spark: SparkSession, most: int) -> DataFrame:
    """(k, s, shift) of lines of one class, whose first k segments have one size and whose
    last reaches to the end: the shorter line's own, without a shift, and the longer
    line's probes.  Of the first equal segment that has no more edits before it than its
    number, and none too many behind it, a partner longer by d stands shifted by t with
    |t| + |d - t| edits at least."""
    return _shifts(spark, 2, most).where("""shift = 0 or exists(sequence(0, k), d ->
        abs(shift) <= s and abs(d - shift) <= k - s and abs(shift) + abs(d - shift) <= k)""")


def _class_entries(lines: DataFrame, per: int, most: int) -> DataFrame:
    """(key, sig, less) of lines(key, line, n) of 2 to ``most`` allowed edits.

    The lines of a class, k, have k * per characters at least, of which each of the first
    k segments takes (k * per) div (k + 1), whatever the line's length: a probe serves
    partners of all lengths, but for the last segment's, which hold the partner's length
    (as they end with the line, their shift is what the lengths differ by)."""
    df = lines.withColumn("k", F.expr(f"cast(n div {per} as int)")).where(f"k between 2 and {most + 1}")
    # a line may also be the longer one of a pair of the class below
    border = F.when(F.expr(f"n - (k - 1) < k * {per}"), F.array("k", F.col("k") - 1)).otherwise(F.array("k"))
    df = (df.select("key", "line", "n", F.explode(border).alias("k")).where(f"k between 2 and {most}")
          .select("key", "line", "n", "k", F.expr(f"cast((k * {per}) div (k + 1) as int)").alias("size"),
                  F.expr(f"cast(n div {per} as int) = k").alias("own")))
    # of the last segment, the partner's length is n - shift: it must be of the class
    fits = f"if(s = k, shift >= 0 and (n - shift) div {per} = k, s * size + shift >= 0 and s * size + shift + size <= n)"
    sig = _hashed("k, s, if(s = k, n - shift, -1)", "(s * size + shift)", "if(s = k, n, size)")
    # without an own entry the unshifted places are probes as well
    return (df.join(F.broadcast(_class_places(lines.sparkSession, most)), "k").where(fits)
            .select("key", F.expr(sig).alias("sig"), F.expr("if(own and shift = 0, -1, 0)").alias("less")))


def _met(entries: DataFrame) -> DataFrame:
    """The different entries (key, sig, less) of signatures at which two lines meet, one of
    them by a segment of its own; and the smallest such line (leader).  Signatures of two
    entries are found first, as only the signatures are dealt out for that."""
    entries = store(entries, "lines-entries")
    twice = entries.groupBy("sig").agg(F.count("*").alias("c"), F.min("less").alias("own")).where("c > 1 and own = -1").select("sig")
    twice = store(twice, "lines-twice")
    some = store(likely(entries, twice, "sig").join(twice, "sig").distinct(), "lines-some")
    own = F.when(F.col("less") == -1, F.col("key"))
    met = (some.groupBy("sig").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min(own).alias("leader"))
           .where("x < y").select("sig", "leader"))
    return store(some.join(met, "sig"), "lines-met")


#: Characters that are counted: an edit changes two of the counts by one at most.
COUNTED = (*"eaiotnrshlducmgbpwf ", "[vkyjqxz]", "[0-9]", "[A-Z]", "[à-æ]", "[ç-ë]", "[ì-ñ]", "[ò-ö]", "[ß÷-ÿ]", "[^\\x00-\\xFF]")


def _counted(x: str) -> Column:
    """Number of characters in a line: of one by the length without it, of a class by a pattern."""
    if len(x) > 1:
        return F.regexp_count("line", F.lit(x))
    return F.octet_length("line") - F.octet_length(F.replace("line", F.lit(x), F.lit("")))


def _linked(lines: DataFrame, ways: list[DataFrame], edits, complete: bool) -> DataFrame:
    """(a, b): links among the lines that meet in any of ``ways`` (entries).

    Lines of one signature are compared if their lengths and counts of some letters differ
    by no more than the edits explain.  Without ``complete``, each line is compared with
    the leader of each of its signatures first, and then only lines whose components
    differ are."""
    keys = None
    for met in ways:
        one = met.select("key")
        keys = one if keys is None else keys.unionAll(one)
    wanted = keys.distinct()
    counts = [_counted(x).alias(f"h{i}") for i, x in enumerate(COUNTED)]
    texts = store(likely(lines, wanted, "key").join(wanted, "key").select("key", "line", "n", *counts), "lines-texts")
    short = texts.drop("line")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = (pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("la"), F.col("n").alias("na")), "a")
                .join(texts.select(F.col("key").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb")), "b")
                .withColumn("k", F.expr(edits("least(na, nb)"))))
        near = (F.when(F.expr(_apart("la", "lb", "k")), F.lit(False)).when(F.col("k") <= BAND_EDITS, within("la", "lb", "k"))
                .otherwise(F.expr("levenshtein(la, lb, k) >= 0")))
        return store(both.where(F.col("k") > 0).where(near).select("a", "b"), name)

    def side(x: str) -> DataFrame:
        return short.select(*[F.col(c).alias(f"{c}_{x}") for c in short.columns])

    explained = F.expr(f"abs(n_a - n_b) <= {edits('least(n_a, n_b)')} and "
                       + " + ".join(f"abs(h{i}_a - h{i}_b)" for i in range(len(COUNTED))) + f" <= 2 * {edits('least(n_a, n_b)')}")
    one = comp = None
    if not complete:
        first = None
        for met in ways:
            pairs = met.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
            first = pairs if first is None else first.unionAll(pairs)
        first = first.distinct().join(side("a"), F.col("a") == F.col("key_a")).join(side("b"), F.col("b") == F.col("key_b")).where(explained)
        one = verified(first.select("a", "b"), "lines-leaders")
        comp = components(one, "lines-first")
    rest = None
    for met in ways:
        placed = met.withColumn("component", F.col("key"))
        if comp is not None:
            placed = met.join(comp, met["key"] == comp["node"], "left").withColumn("component", F.coalesce("component", "key")).drop("node")
            # signatures whose lines are in one component by now are done
            open_ = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
            placed = placed.join(open_, "sig")
        placed = store(placed.join(short, "key"), "lines-open")
        a, b = (placed.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in placed.columns if c not in ("sig", "leader")]) for x in "ab")
        fits = (F.col("component_a") != F.col("component_b")) & (F.col("less_a") == -1) & ((F.col("less_b") >= 0) | (F.col("key_a") < F.col("key_b"))) & explained
        pairs = a.join(b, (a["sig"] == b["sig"]) & fits).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
        rest = pairs if rest is None else rest.unionAll(pairs)
    last = verified(rest.distinct(), "lines-rest")
    return last if one is None else one.unionAll(last)


def _grams(lines: DataFrame, per: int) -> DataFrame:
    """(key, sig, less) of lines of LONG_EDITS edits or more: selected grams of their
    bytes, with about where they stand.

    The shortest equal run, that of the shortest line, holds ``width`` grams.  Those
    of a hash that ends in zeros are selected, and all of a stretch of ``width`` or more
    without any such: equal runs select the same.  Lines of 2**v to 2**(v + 1) - 1
    allowed edits are of level v, and their grams known by blocks of places; a partner's
    gram stands up to 4 bytes an edit away, and is looked up in the blocks there."""
    run = -(-(LONG_EDITS * per - LONG_EDITS) // (LONG_EDITS + 1))
    gram = max(1, run // 3)
    width = run - gram + 1
    zeros = (1 << max(0, (width // 8).bit_length() - 1)) - 1
    hashed = f"xxhash64(substring(b, i, {gram}))"
    stretch = f"if(get(c, j + 1) - i > {width}, sequence(i + 1, get(c, j + 1) - 1), cast(array() as array<int>))"
    sql = _let("b", "cast(line as binary)", _let("m", f"octet_length(b) - {gram} + 1", _let(
        "g", f"filter(sequence(1, m), i -> {hashed} & {zeros} = 0)", _let(
            "c", "concat(array(0), g, array(m + 1))",
            f"transform(concat(g, flatten(transform(c, (i, j) -> {stretch}))), i -> named_struct('at', i, 'h', {hashed}))"))))
    # a line may also be the longer one of a pair of the level below
    level = F.expr(f"length(bin(n div {per})) - 1")
    border = F.when(F.expr(f"n - (shiftleft(1L, v) * {per} - 1) < shiftleft(1L, v)"), F.array("v", F.col("v") - 1)).otherwise(F.array("v"))
    df = lines.select("key", "n", level.alias("v"), F.explode(F.expr(sql)).alias("g"))
    df = df.select("key", "v", F.explode(border).alias("at_v"), "g.at", "g.h")
    block, far = "shiftleft(64, at_v)", "(shiftleft(8, at_v) - 4)"
    around = [f"at div {block}", f"(at - {far} + {block}) div {block} - 1", f"(at + {far}) div {block}"]
    df = df.select("key", "v", "at_v", "h", F.expr(around[0]).alias("here"), F.explode(F.expr(f"array_distinct(array({', '.join(around)}))")).alias("block"))
    return df.select("key", F.xxhash64("at_v", "block", "h").alias("sig"), F.expr("if(at_v = v and block = here, -1, 0)").alias("less"))


def dedup_lines(docs: DataFrame, k: int | None = None, least_chars: int = LEAST_CHARS, per: int = PER, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per line of ``docs`` that isn't blank: doc_id, line_no, class_doc,
    class_line (where the first line of its class stands), kept (it is that line).

    Lines are trimmed of blanks.  Equal lines are of one class, and so are lines
    joined by a chain of links.  Without ``k``, a link is of at most so many edits
    as ``allowed`` says for the shorter line and ``per``.  With ``k``, it is of at
    most ``k`` edits, and lines of fewer than ``least_chars`` characters have no
    links.  NULL and empty texts have no lines;
    a NULL doc_id stands before all; a row that repeats a doc_id repeats its line
    numbers, and of equal places one is kept."""
    near = grown_links(docs, per, id_col, text_col, False) if k is None else links(docs, k, least_chars, id_col, text_col, False)
    near = store(near, "lines-links")
    group = components(near, "lines")
    places = store(lines_of(docs, id_col, text_col).select("doc_id", "line_no", "key"), "lines-places")
    first = F.min(F.struct("doc_id", "line_no"))
    lines = places.groupBy("key").agg(first.alias("first"))
    classed = lines.join(group, lines["key"] == group["node"], "left").select(
        "key", "first", F.coalesce("component", "key").alias("class"))
    heads = classed.groupBy("class").agg(F.min("first").alias("head"))
    head_of = classed.join(heads, "class").select("key", F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line"))
    return (places.join(head_of, "key")
            .select("doc_id", "line_no", "class_doc", "class_line",
                    (F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line"))).alias("kept")))
