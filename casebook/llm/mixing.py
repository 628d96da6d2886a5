"""Operator 4: mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (in md5 order) into one stream of words
that is cut into blocks of ``block_words``; the last block of a source may be
shorter.  The mix is a sequence of slots: the n-th golden-ratio point, mapped
through the cumulative weights, names the slot's source, and the r-th slot of a
source takes block ``r mod blocks`` of its stream.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import SPACE_WORD, pick, rank_within, store, text_or_empty

#: 2**32 divided by the golden ratio, made odd: n * STEP mod 2**32 visits every
#: 32-bit point once, as evenly spread as multiples of the golden ratio are.
STEP = 2654435769


@dataclass
class Mix:
    """documents: one row per input row (doc_id, source, size, digest, source_size,
    target, taken).  schedule: (slot, source, epoch, block, words), the mix itself.
    pieces: (source, block, doc_id, at, doc_at, words), what each block holds."""

    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    sources: DataFrame


def targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Add weight and target to (source, source_size): weights repeat over the
    sources in code-point order (NULL last); a target is the source's share of
    all sizes, stopped at ``max_repeats`` times its size, the excess reshared.

    The level L at which the uncapped sources fill (target = weight * L) is the
    largest of (rest of the total) / (rest of the weights) as sources are capped
    in the order of size / weight.  One row per source passes here, after the
    sizes are summed."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(max_repeats)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    share = F.col("level") * F.col("weight")
    return (sources.withColumn("weight", w).withColumn("reach", level)
            .withColumn("level", F.max("reach").over(everything))
            .withColumn("target", F.when(share >= cap, cap.cast("double")).otherwise(share))
            .withColumn("quota", F.floor("target").cast("long"))
            .drop("reach", "level"))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, source, epoch, block, words) for sources(source, source_size, quota).

    A source needs ``slots`` = whole epochs x blocks + the blocks of the rest.  The
    points give each source its share of slots up to a few; slots beyond a
    source's need are dropped and the few a source lacks follow at the end, so
    that every source gets its quota exactly."""
    spark = sources.sparkSession
    b = block_words
    per_epoch = F.ceil(F.col("source_size") / b).cast("long")
    need = sources.where("quota > 0").select(
        "source", "source_size", "quota", per_epoch.alias("blocks"),
        (F.floor(F.col("quota") / F.col("source_size")).cast("long") * per_epoch
         + F.ceil((F.col("quota") % F.col("source_size")) / b).cast("long")).alias("slots"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    need = store(need.withColumn("upto", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("sid", F.row_number().over(order).cast("long")), "mix-need")
    stats = need.agg(F.sum("slots").alias("n"), F.count("*").alias("s")).first()
    n, count = int(stats["n"] or 0), int(stats["s"])
    cells = 1 << max(10, (4 * count).bit_length())
    # the source intervals of [0, n), cut at cell borders for an equi-join on the cell
    lo, hi = F.col("upto") - F.col("slots"), F.col("upto")
    spans = need.select("sid", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(
        F.floor(lo * F.lit(float(cells)) / F.lit(float(max(n, 1)))).cast("long"),
        F.least(F.lit(cells - 1), F.floor(hi * F.lit(float(cells)) / F.lit(float(max(n, 1))))).cast("long"))).alias("cell"))
    low, high = F.col("id") % 65536, F.floor(F.col("id") / 65536).cast("long") % 65536
    point = (low * STEP + high * ((STEP << 16) % (1 << 32))) % (1 << 32) / F.lit(float(1 << 32))
    points = (spark.range(n).select(F.col("id").alias("slot"), (point * F.lit(float(n))).alias("x"))
              .withColumn("cell", F.floor(F.col("x") * F.lit(float(cells)) / F.lit(float(max(n, 1)))).cast("long"))
              .withColumn("part", F.floor(F.col("slot") / 65536).cast("long")))
    mapped = (points.join(spans, "cell").where("x >= lo and x < hi").select("slot", "part", "sid"))
    mapped = store(rank_within(mapped, ["sid"], "part", [F.col("slot")], F.lit(1), "rank"), "mix-slots")
    had = mapped.groupBy("sid").agg(F.count("*").alias("had"))
    late = (need.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
            .where("had < slots")
            .select("sid", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"))
            .select((F.lit(n) + F.col("rank") * count + F.col("sid")).alias("slot"), "sid", "rank"))
    ranked = mapped.select("slot", "sid", "rank").unionAll(late)
    block, epoch = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks")).cast("long")
    return (ranked.join(need, "sid").where("rank < slots")
            .withColumn("block", block).withColumn("epoch", epoch)
            .withColumn("words", F.least(F.lit(b), F.col("source_size") - F.col("block") * b,
                                         F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("block") * b))
            .select("slot", "source", "epoch", "block", F.col("words").cast("long").alias("words")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, block_words: int = 1024) -> Mix:
    """Mix all rows of ``docs`` to the weights of their sources.

    NULL text has size 0; a document without words is in no block and its taken
    is 0; NULL sources are one source, the last.  Rows that repeat a doc_id are
    rows of their own.  An empty table gives empty results.  Reruns agree: the
    order in a source is md5(doc_id), then doc_id, then size, then the text's hash.
    """
    sizes = store(pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.expr(f"cast(regexp_count(coalesce(text, ''), r'{SPACE_WORD}') as long)").alias("size"),
        F.xxhash64(text_or_empty()).alias("digest"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")), "mix-sizes")
    sources = store(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats),
                    "mix-sources")
    # 256 md5 buckets per source, and 16 times as many for each 16-fold of 12 million rows
    digits = 2
    rows = sizes.count()
    while rows > 12_000_000 * 16 ** (digits - 2):
        digits += 1
    spread = sizes.withColumn("bucket", F.substring("key", 1, digits))
    placed = store(rank_within(spread, ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("digest")],
                               F.col("size"), "at")
                   .withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    b = block_words
    plan = schedule(sources, b)
    first, last = F.floor(F.col("at") / b).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / b).cast("long")
    pieces = (placed.where("size > 0").select("row", "source", "doc_id", "at", "size",
                                              F.explode(F.sequence(first, last)).alias("block"))
              .withColumn("from", F.greatest(F.col("at"), F.col("block") * b))
              .withColumn("to", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b))
              .select("row", "source", "block", "doc_id", (F.col("from") - F.col("block") * b).alias("at"),
                      (F.col("from") - F.col("at")).alias("doc_at"), (F.col("to") - F.col("from")).alias("words")))
    # slots of one block that take as many words are one row before they meet its pieces
    used = plan.groupBy("source", "block", "words").agg(F.count("*").alias("times")).select(
        F.col("source").alias("s_source"), F.col("block").alias("s_block"), F.col("words").alias("s_words"), "times")
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("s_words") - F.col("at"))) * F.col("times")
    taken = (pieces.join(used, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
             .groupBy("row").agg(F.sum(part).alias("got")))
    info = sources.select(F.col("source").alias("s"), "source_size", "target")
    documents = (placed.join(taken, "row", "left").join(info, F.col("source").eqNullSafe(F.col("s")))
                 .select("doc_id", "source", "size", "digest", "source_size", "target",
                         F.coalesce("got", F.lit(0)).cast("long").alias("taken")))
    return Mix(documents, plan, pieces.drop("row"), sources)


def copies(documents: DataFrame, per_doc: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them: taken / size,
    rounded to whole documents.  Rows are known by id, source and text; rows alike in
    all three share their sum, the first of them in column order the rest of it."""
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("long")
    often = (per_doc.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"))
             .agg(F.sum(times).alias("__sum"), F.count("*").alias("__rows")).where("__sum > 0"))
    found = (documents.join(often, F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
                            & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source"))
                            & (F.xxhash64(text_or_empty(f"`{text_col}`")) == F.col("__digest")))
             .withColumn("__times", F.expr("cast(__sum div __rows as int)")))
    order = Window.partitionBy("__id", "__source", "__digest").orderBy(*[F.col(f"`{c}`") for c in documents.columns])
    uneven = (found.where("__sum % __rows > 0").withColumn("__nth", F.row_number().over(order))
              .withColumn("__times", F.expr("__times + if(__nth <= __sum % __rows, 1, 0)")).drop("__nth"))
    return (found.where("__sum % __rows = 0").unionByName(uneven).where("__times > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
            .drop("__id", "__source", "__digest", "__sum", "__rows", "__times", "__copy"))
