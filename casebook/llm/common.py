"""Helpers shared by the operators: column picking, shared scratch tables,
ASCII word rules and connected components."""

from __future__ import annotations

import bisect
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.session import ensure_checkpoint_dir

#: Words of the space rule: maximal runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z only.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As LOWER_AZ, and every ASCII character but a-z and 0-9 becomes a blank.
LOWER_ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
                    else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: extra columns of the input,
    whatever their names, never meet those an operator adds."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


#: Folders that operators made in this session, for ``clear_scratch``.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the checkpoint folder that all executors share (a URI:
    the scheme of ``spark.checkpoint.dir`` is kept)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders that operators made so far, when their results have been
    written or are no longer wanted; how many there were."""
    n = len(_MADE)
    while _MADE:
        drop_folder(spark, _MADE.pop())
    return n


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts the
    lineage and survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark sends to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python passes by bytes as well as by
    rows, so that a worker's memory doesn't follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(pdf, chars: int, column: str = "text"):
    """``pdf`` in runs of consecutive rows whose texts have up to ``chars`` characters
    together; a longer text stands alone."""
    upto = pdf[column].str.len().cumsum().tolist()
    start = 0
    while start < len(upto):
        stop = bisect.bisect_right(upto, (upto[start - 1] if start else 0) + chars, start)
        stop = max(stop, start + 1)
        yield pdf.iloc[start:stop]
        start = stop


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rank_within(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                value: Column, out: str) -> DataFrame:
    """Exclusive running sum ``out`` of ``value`` per ``group`` in the order of
    ``bucket`` and then ``order``, without bringing a group to one task: sums
    inside a (group, bucket), plus the totals of the buckets before it.  NULL
    group values form a group of their own."""
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*group, bucket).agg(F.sum(value).alias("__total"))
              .withColumn("__before", F.coalesce(F.sum("__total").over(over), F.lit(0)))
              .select(*[F.col(g).alias(f"__t_{g}") for g in group], F.col(bucket).alias("__t_b"), "__before"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__t_{g}"))
    return (df.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(totals, same & (F.col(bucket) == F.col("__t_b")))
            .withColumn(out, (F.col("__inner") + F.col("__before")).cast("long"))
            .drop("__inner", "__before", "__t_b", *[f"__t_{g}" for g in group]))


def _digest(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)`` (longs): ``(node, component)`` with
    the smallest node of each component, for every node that has a link.

    Alternating large-star and small-star steps; every step is a join or an
    aggregate with map-side combining, stored in the shared scratch folder, and
    a hub is pre-aggregated to its smallest neighbour, so no node's
    neighbourhood is ever collected.  Ends when a step changes nothing.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), name)
    state = _digest(edges)
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: neighbours below a node, and the node, go to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small = store(small, name)
        edges, before, state = small, state, _digest(small)
        if state == before:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


#: Bits of the filter that ``likely`` sends to every task: 2 MiB, whatever the data.
FILTER_BITS = 24


def likely(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids`` (one column), and a few
    others: a one-hash filter of fixed size, sent to every task, that spares a later
    exact join most of the rows it would shuffle for nothing.  The more ids, the
    more rows pass; it never drops one of ``ids``."""
    h = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(1 << FILTER_BITS))
    words = (ids.select(h.alias("__h")).groupBy(F.floor(F.col("__h") / 64).cast("long").alias("__word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(__h % 64 as int))")).alias("__bits")))
    # at most 2**(FILTER_BITS - 6) rows
    mine = F.pmod(F.xxhash64(F.col(f"`{column}`").cast("long")), F.lit(1 << FILTER_BITS))
    return (df.withColumn("__h", mine).join(F.broadcast(words), F.floor(F.col("__h") / 64).cast("long") == F.col("__word"))
            .where("(__bits & shiftleft(1L, cast(__h % 64 as int))) <> 0").drop("__h", "__word", "__bits"))


def bits_for(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))
