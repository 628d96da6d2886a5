"""Operator 10: document fingerprints by Order MinHash, in SQL functions only.

The words of a text (split at each white space) give k-mers; a word of more than
``LONG_WORD`` characters, or of characters of three bytes or more alone (Chinese,
Japanese, Thai), stands as its characters.  The n-th occurrence of a
k-mer in a text counts as an element of its own.  Each of 64 sketches orders all
elements by one hash, read from another starting point of its circle, selects the
``l`` first, puts them back into text order and hashes that tuple.  The share of
equal sketches estimates a similarity that falls when k-mers move, as the edit
distance rises.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import pick, shuffle_width

SKETCHES = 64      # the top 6 bits of a hash name the arc of its circle
LONG_WORD = 32     # longer words are no words: text without blanks
POSITION_BITS = 26  # of the packed (hash, position): texts of up to 2**26 words


def _sketches(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of 64 ints, from the text column ``text`` (not NULL).

    Elements are packed as hash bits above position bits, so that a plain sort
    of longs orders them.  Columns that a lambda reads are made in a select of
    their own, and read twice, so that they are computed once a row."""
    low = (1 << POSITION_BITS) - 1
    keep = [c for c in df.columns]
    steps = "array(64,32,16,8,4,2,1)"
    wide = "array(" + ",".join(str(1 << i) for i in range(POSITION_BITS, -1, -1)) + ")"
    df = df.select(*keep, F.expr(rf"""
        transform(flatten(transform(split({text}, r'[\s\u0085\u2028\u2029\u3000]'), x ->
          if(char_length(x) > {LONG_WORD} or octet_length(x) >= 3 * char_length(x), split(x, ''), array(x)))), x -> xxhash64(x))
        """).alias("__w"))
    df = df.select(*keep, F.expr(f"""
        if(size(__w) > {low}, raise_error('a text of more than {low} k-mers: raise POSITION_BITS'), __w)""").alias("__w"))
    df = df.select(*keep, F.expr(f"""
        sort_array(if(size(__w) < 2, transform(__w, x -> x & {~low}L),
           transform(slice(__w, 1, greatest(size(__w) - 1, 1)), (x, i) -> (xxhash64(x, get(__w, i + 1)) & {~low}L) | i)))
        """).alias("__s"))
    again = f"shiftright(x, {POSITION_BITS}) = shiftright(get(__s, i - 1), {POSITION_BITS})"
    df = df.select(*keep, F.expr(f"filter(__s, (x, i) -> i = 0 or not {again})").alias("__first"),
                   F.expr(f"filter(__s, (x, i) -> i > 0 and {again})").alias("__more"))
    # the start of a k-mer's run in __more is found by bisection; the place in the run numbers the occurrence
    start = (f"aggregate(filter({wide}, p -> p <= size(__more)), 0, (lo, p) -> "
             f"if(lo + p <= size(__more) and get(__more, lo + p - 1) < (x & {~low}L), lo + p, lo))")
    df = df.select(*keep, F.expr(f"""
        sort_array(concat(
          transform(__first, x -> (xxhash64(shiftright(x, {POSITION_BITS}), 0) & {~low}L) | (x & {low}L)),
          transform(__more, (x, i) -> (xxhash64(shiftright(x, {POSITION_BITS}), i - {start} + 1) & {~low}L) | (x & {low}L))))
        """).alias("__o"))
    # no sketch reads beyond the two first elements of an arc
    df = df.select(*keep, F.expr(
        "filter(__o, (x, i) -> i < 2 or shiftright(x, 58) <> shiftright(get(__o, i - 2), 58))").alias("__a"))
    at = (f"aggregate({steps}, 0, (lo, p) -> if(lo + p <= size(__a) and shiftright(get(__a, lo + p - 1), 58) < b, "
          "lo + p, lo))")
    df = df.select(*keep, F.expr(f"""
        transform(transform(sequence(-32, 31), b -> {at}), p -> struct(
          get(__a, p % size(__a)) as e, get(__a, (p + 1) % size(__a)) as f))""").alias("__p"))
    h = lambda x: f"shiftright({x}, {POSITION_BITS})"
    return df.select(*keep, F.expr(f"""
        transform(__p, q -> cast(case when (q.e & {low}L) = (q.f & {low}L) then xxhash64({h('q.e')})
                                 when (q.e & {low}L) < (q.f & {low}L) then xxhash64({h('q.e')}, {h('q.f')})
                                 else xxhash64({h('q.f')}, {h('q.e')}) end & 65535 as int))""").alias(out))


def fingerprints(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, 64 ints, the fingerprint of ``text_col`` (NULL as the
    empty text, whose only k-mer is the empty word; a text of one word has that
    word as its only k-mer).  Equal texts have equal fingerprints."""
    return _sketches(df.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "__text", out).drop("__text")


def as_text(column: str) -> F.Column:
    """Four hex digits a sketch."""
    return F.expr(f"array_join(transform({column}, x -> substring(lower(hex(65536 + x)), 2)), '')")


def likeness(a: str, b: str) -> F.Column:
    """Share of equal sketches."""
    return F.expr(f"size(filter({a}, (x, i) -> x = get({b}, i))) / cast({SKETCHES} as double)")


def with_next(df: DataFrame, id_col: str, carry: dict[str, str], tie: list[str]) -> DataFrame:
    """Add for each row, under the names that ``carry`` maps to, the columns of the
    next row in descending ``id_col`` (NULL last; ties by ``tie``); the row after
    the last is the first.

    Rows are dealt to ranges of the id, cut at its quantiles (as many as four
    times the shuffle partitions, whatever the size of the input), and shuffled
    once; the first row of each range also visits the range before it.  Rows of
    one id are one range: ids are meant to be nearly unique."""
    spark = df.sparkSession
    n = 4 * shuffle_width(spark)
    keyed = df.withColumn("__k", F.col(f"`{id_col}`").cast("double"))
    cuts = keyed.where("__k is not null").approxQuantile("__k", [i / n for i in range(1, n)], 0.1 / n)
    cuts = sorted(set(cuts))
    if cuts:
        dealt = (Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__k", outputCol="__b", handleInvalid="keep")
                 .transform(keyed.withColumn("__k", F.coalesce("__k", F.lit(-float("inf")))))
                 .withColumn("__b", F.when(F.col(f"`{id_col}`").isNull(), F.lit(-1)).otherwise(F.col("__b").cast("int"))))
    else:
        dealt = keyed.withColumn("__b", F.when(F.col("__k").isNull(), F.lit(-1)).otherwise(F.lit(0)))
    order = [F.col(f"`{id_col}`").desc_nulls_last(), *[F.col(f"`{t}`").asc_nulls_first() for t in tie]]
    # the ranges that have rows (as many as the cuts at most), from the lowest up; each one's first row visits the range above it
    filled = [r[0] for r in dealt.select("__b").distinct().orderBy("__b").collect()]
    if not filled:
        return df.select("*", *[F.col(f"`{c}`").alias(o) for c, o in carry.items()])
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    up = F.element_at(F.create_map(*[F.lit(x) for kv in above.items() for x in kv]), F.col("__b"))
    head = dealt.groupBy("__b").agg(F.max(f"`{id_col}`").alias("__hid")).withColumnRenamed("__b", "__hb")
    visits = F.when(F.col("__hb").isNull(), F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g")))).otherwise(
        F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g")), F.struct(up.alias("b"), F.lit(1).alias("g"))))
    both = (dealt.join(F.broadcast(head), (F.col("__b") == F.col("__hb")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__hid")), "left")
            .withColumn("__v", F.explode(visits))
            .select(*df.columns, F.col("__v.b").alias("__b"), F.col("__v.g").alias("__guest")))
    w = Window.partitionBy("__b").orderBy(F.col("__guest"), *order)
    return (both.select("*", *[F.lead(f"`{c}`").over(w).alias(o) for c, o in carry.items()])
            .where("__guest = 0").drop("__b", "__guest"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document's, in descending
    doc_id; after the last comes the first.  NULL text is the empty text; a NULL
    doc_id comes last; rows of one doc_id follow in the order of their texts.  One
    row alone is its own next; an empty table gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = fingerprints(base, "text", "fp")
    pairs = with_next(base, "doc_id", {"text": "next_text", "fp": "next_fp"}, tie=["text"])
    half = F.expr("cast(char_length(text) div 2 as int)")
    pairs = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp",
                         F.expr("concat(left(text, cast(char_length(text) - char_length(text) div 2 as int)), "
                                "left(next_text, cast(char_length(text) div 2 as int)))").alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    pairs = _sketches(pairs, "edited", "efp")
    return pairs.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"),
                        as_text("efp").alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"),
                        likeness("fp", "next_fp").alias("near_next"))
