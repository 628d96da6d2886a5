"""Operator 3: n-gram Jaccard join by a token-group matrix.

Documents become sets of shingle hashes; equal sets are one class.  Similar
classes are put in groups of bounded size, and the matrix holds each group's
token union.  A document's overlap with a union bounds its overlap with every
member, so a group is opened - its members compared exactly - only if the bound
allows a link.  Three exact rules keep the work in proportion to the input:

* A set links only with sets that share at least ``need`` of its ``prefix`` (its
  smallest hashes, a little over (100 - threshold) % of it).  Sets whose prefix
  holds fewer tokens that any other set has are out at once.
* Groups are formed by min-hash; a group's members are compared with one another
  and with the leader of their min-hash, which links most copies.
* A document meets only the groups of other components so far: what is already
  connected needs no further comparison.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import LOWER_AZ, bits_for, bounded_batches, components, drop_folder, likely, pick, scratch, store, text_or_empty

GROUP_ROWS, GROUP_TOKENS = 128, 400_000
MIN_HASHES = 2

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(1 << 16, 1 << n.bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words (A-Z lower-cased,
    words end at ASCII white space); of fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _POWERS.get(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[:len(flat)], out=sums[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    first, last = starts[:len(words) - k + 1], ends[k - 1:]
    return np.unique(_mix((sums[last] - sums[first]) * down[first]).view(np.int64))


#: One more shared token is asked for per so many of a set: first of all sets, then
#: of those that are left, whose prefixes are longer.
SLACK, WHOLE_SLACK = 25, 5


def prefix_sizes(n: int, threshold: int, slack: int = SLACK) -> tuple[int, int]:
    """(tokens of the prefix, how many of them a linked set has at least).

    A linked set shares at least a = ceil(threshold % of n) tokens, so at least c
    of any n - a + c of them.  Both c and the number that meets a linked set's own
    prefix grow with the size of the set."""
    a = -(-threshold * n // 100)
    return n - a + n // slack + 1, a // slack + 1


SETS = "doc_id long, n long, d1 long, d2 long, need long, prefix array<long>"
WHOLE = SETS + ", tokens array<long>, mins array<long>"


def sets(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """docs(doc_id, text) with set size, digest of the set and prefix.  If ``docs``
    also has a digest (d1, d2), only the rows that have that digest, with all
    tokens and the min-hashes."""
    whole = "d1" in docs.columns
    names = [x.split()[0] for x in (WHOLE if whole else SETS).split(", ")]

    def run(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        for pdf in batches:
            out = []
            wanted = zip(pdf["d1"], pdf["d2"]) if whole else [None] * len(pdf)
            for d, text, want in zip(pdf["doc_id"], pdf["text"], wanted):
                t = shingles(text, size)
                n = len(t)
                d1, d2 = np.frombuffer(hashlib.blake2b(t.tobytes(), digest_size=16).digest(), "<i8").tolist()
                if whole and (d1, d2) != want:
                    continue
                p, need = prefix_sizes(n, threshold, WHOLE_SLACK if whole else SLACK) if n else (0, 0)
                row = (None if pd.isna(d) else int(d), n, d1, d2, need, t[:p])
                if whole:
                    mins = [int(_mix(t.view(np.uint64) ^ np.uint64(_BASE * j & _MASK)).view(np.int64).min())
                            for j in range(1, MIN_HASHES + 1)] if n else []
                    row += (t, mins)
                out.append(row)
                if len(out) == 512:
                    yield frame(out)
                    out = []
            yield frame(out)

    base = docs.withColumn("text", text_or_empty())
    return base.mapInPandas(run, WHOLE if whole else SETS)


def _alive(found: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, family, even, odd) of the sets that may link with a set of
    another document: their prefixes hold enough tokens that others' prefixes hold.  The
    family is the one of those tokens that most documents have, with their number; even
    and odd are the same among the tokens of either parity.

    Tokens are compared by as many bits as keep chance meetings rare among so many
    (12 bits more than the count has); a chance meeting only keeps a set."""
    prefixes = found.where("n > 0 and doc_id is not null")
    total = prefixes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    entries = prefixes.select("doc_id", F.explode("prefix").alias("token")).select(
        "doc_id", F.shiftrightunsigned("token", 64 - min(64, bits_for(int(total)) + 12)).alias("token"))
    shared = (entries.groupBy("token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("docs"))
              .where("a < b").select("token", "docs"))
    each = F.struct("docs", "token")
    met = entries.join(shared, "token").groupBy("doc_id").agg(
        F.count("*").alias("met"), F.max(each).alias("family"), F.max(F.when(F.col("token") % 2 == 0, each)).alias("even"),
        F.max(F.when(F.col("token") % 2 != 0, each)).alias("odd"))
    return (prefixes.select("doc_id", "d1", "d2", "need").join(met, "doc_id").where("met >= need")
            .select("doc_id", "d1", "d2", "family", "even", "odd"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set, 16,384 tokens at a time."""
    universe, inverse = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    out = np.zeros((len(left), len(right)))
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    for at in range(0, len(universe), 1 << 14):
        a, b = np.searchsorted(inverse, [at, at + (1 << 14)])
        part = np.zeros((len(left) + len(right), min(1 << 14, len(universe) - at)), np.float32)
        part[owner[a:b], inverse[a:b] - at] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: int) -> np.ndarray:
    both = _overlaps(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both
    return 100 * both >= threshold * union


LINKS = "a long, b long"


def _chunk(count: str, tokens: str) -> Column:
    """Into how many groups a key's rows are dealt."""
    return F.greatest(F.ceil(F.col(count) / GROUP_ROWS), F.ceil(F.col(tokens) / GROUP_TOKENS)).cast("long")


def _group_links(threshold: int):
    """A function that gives the links among a group's rows (doc_id, tokens, guest)."""

    def run(pdf):
        pdf = pdf.sort_values(["guest", "doc_id"], ascending=[False, True])
        ids, token_sets = pdf["doc_id"].to_numpy(), list(pdf["tokens"])
        out = []
        if len(ids) > 1:
            a, b = np.nonzero(np.triu(_linked(token_sets, token_sets, threshold), 1))
            # a spanning forest carries the same components as all pairs
            root = list(range(len(ids)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[x]), int(ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _in_groups(found: DataFrame, threshold: int) -> DataFrame:
    """Links among the rows of a group, and with the leader of their min-hash."""
    keyed = found.select("doc_id", "n", F.posexplode("mins").alias("j", "key"))
    stats = keyed.groupBy("j", "key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("rows"), F.sum("n").alias("all")) \
        .where("rows > 1").withColumn("groups", _chunk("rows", "all")).drop("rows", "all")
    own = keyed.join(stats, ["j", "key"]).select(
        "j", "key", F.pmod(F.xxhash64("doc_id"), F.col("groups")).alias("g"), "doc_id", F.lit(False).alias("guest"))
    guests = stats.where("groups > 1").select(
        "j", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"),
        F.col("leader").alias("doc_id"), F.lit(True).alias("guest"))
    members = own.unionAll(guests).join(found.select("doc_id", "tokens"), "doc_id")

    return members.groupBy("j", "key", "g").applyInPandas(_group_links(threshold), LINKS)


def _band(n: Column) -> Column:
    """Sizes by powers of 1.25: linked sets are in one band or in two that touch."""
    return F.floor(F.log(n) / F.log(F.lit(1.25))).cast("long")


def _across(found: DataFrame, linked: DataFrame, threshold: int) -> DataFrame:
    """Links between units: a unit is a large component so far, or a group of
    documents and small components of one family and size.

    The matrix holds, for each group of a unit, the union of the members' prefixes;
    a query whose prefix meets a group's in fewer tokens than a linked set's would
    is through with it.  Queries and groups that have one of the two tokens that most
    documents have (of even and of odd ones) in common share most tokens: they meet by
    blocks of the matrix, the others by their tokens.  What is left is bounded by the union of all the members' tokens, and the members of a group are
    compared only with queries that pass.  The rows of a family's group are compared
    with one another as well."""
    comp = components(linked, "jaccard-a")
    placed = (found.select("doc_id", "n", "need", "prefix", "family", "even", "odd").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .withColumn("component", F.coalesce("component", "doc_id")))
    sizes = placed.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("all"),
                                              F.struct(F.max("family").alias("family"), _band(F.max("n")).alias("band")).alias("kin"))
    families = sizes.where(F.col("rows") <= GROUP_ROWS).groupBy("kin").agg(F.sum("rows").alias("kin_rows"), F.sum("all").alias("kin_all"))
    units = (sizes.join(families, "kin", "left").withColumn("loose", F.col("rows") <= GROUP_ROWS)
             .withColumn("share", F.pmod(F.xxhash64("component"), _chunk("kin_rows", "kin_all")))
             .select("component", "rows", "all", "loose", F.when(F.col("loose"), F.concat(
                 F.lit("f"), F.col("kin.family.token"), F.lit("-"), F.col("kin.band"), F.lit("-"), "share")).otherwise(F.concat(F.lit("c"), "component")).alias("unit")))
    g = F.when(F.col("loose"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id"), _chunk("rows", "all")))
    rows = F.when(F.col("loose"), F.lit(1).cast("long")).otherwise(F.col("rows"))
    placed = store(placed.join(units, "component").select(
        "doc_id", "n", "need", "prefix", "unit", "even", "odd", rows.alias("rows"), g.alias("g"), "loose"), "jaccard-placed")
    # a group's two tokens: of its members' the ones that most documents have
    heads = placed.groupBy("unit", "g").agg(F.max("even").alias("even"), F.max("odd").alias("odd")).select(
        F.col("unit").alias("to"), "g", F.col("even.token").alias("to_even"), F.col("odd.token").alias("to_odd"))
    heads = store(heads, "jaccard-heads")
    # tokens of one unit only can't join two
    crossing = (placed.select("unit", F.explode("prefix").alias("token")).groupBy("token")
                .agg(F.min("unit").alias("x"), F.max("unit").alias("y")).where("x < y").select("token"))
    cells = (placed.select("unit", "rows", "g", "n", F.explode("prefix").alias("token")).groupBy("unit", "rows", "g", "token")
             .agg(F.min("n").alias("least"), F.max("n").alias("most")))
    matrix = cells.join(crossing, "token").select("token", F.col("unit").alias("to"), F.col("rows").alias("to_rows"), "g", "least", "most")
    matrix = matrix.join(heads, ["to", "g"])
    asks = placed.select("doc_id", "n", "need", F.col("even.token").alias("even"), F.col("odd.token").alias("odd"), "unit", "rows",
                         F.explode("prefix").alias("token"))
    # the smaller unit asks; sizes of linked sets differ by the threshold at most
    apart = ~F.coalesce(F.col("even") == F.col("to_even"), F.lit(False)) & ~F.coalesce(F.col("odd") == F.col("to_odd"), F.lit(False))
    fits = apart & (F.struct("rows", "unit") < F.struct("to_rows", "to")) & (100 * F.col("n") >= threshold * F.col("least")) \
        & (100 * F.col("most") >= threshold * F.col("n"))
    opened = (asks.join(matrix, "token").where(fits).groupBy("doc_id", "need", "to", "g").agg(F.count("*").alias("bound"))
              .where("bound >= need").select("doc_id", "to", "g"))
    opened = store(opened.unionAll(_within_families(placed, heads, threshold)), "jaccard-asked")
    per_group = opened.groupBy("to", "g").agg(F.count("*").alias("asked"))
    opened = store(opened.join(per_group, ["to", "g"]).withColumn("parts", F.ceil(F.col("asked") / GROUP_ROWS).cast("long"))
                   .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("asked"), "jaccard-opened")
    queries = opened.select("doc_id", "to", "g", "part").join(found.select("doc_id", "tokens"), "doc_id")
    tokens = found.select(F.col("doc_id").alias("m_id"), F.col("tokens").alias("m_tokens"))
    members = (opened.select("to", "g", "part").distinct()
               .join(placed.select(F.col("unit").alias("to"), "g", F.col("doc_id").alias("m_id")), ["to", "g"])
               .join(tokens, "m_id")
               .select(F.col("to").alias("m_to"), F.col("g").alias("m_g"), F.col("part").alias("m_part"), "m_id", "m_tokens"))
    inside = (placed.where("loose").select("unit", "doc_id").join(found.select("doc_id", "tokens"), "doc_id")
              .withColumn("guest", F.lit(False)).groupBy("unit").applyInPandas(_group_links(threshold), LINKS))

    def run(left, right):
        out = []
        if len(left) and len(right):
            union = np.unique(np.concatenate(list(right["m_tokens"])))
            held = [_count_in(t, union) for t in left["tokens"]]
            left = left[[100 * h >= threshold * len(t) for h, t in zip(held, left["tokens"])]]
            if len(left):
                x, y = left["doc_id"].to_numpy(), right["m_id"].to_numpy()
                a, b = np.nonzero(_linked(list(left["tokens"]), list(right["m_tokens"]), threshold))
                out = list(zip(x[a].tolist(), y[b].tolist()))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    across = queries.groupBy("to", "g", "part").cogroup(members.groupBy("m_to", "m_g", "m_part")).applyInPandas(run, LINKS)
    return inside.unionAll(across)


#: Queries and groups of one family in a block of the matrix.
BLOCK_QUERIES, BLOCK_GROUPS = 512, 64


def _within_families(placed: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, to, g): for each query the groups of other units that share one of its two
    family tokens and hold enough of its prefix, in blocks of queries and groups."""
    unions = (placed.groupBy(F.col("unit").alias("to"), F.col("rows").alias("to_rows"), "g").agg(
        F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"))
        .join(heads, ["to", "g"]))
    both = lambda even, odd: F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col(even).alias("token")),
                                               F.struct(F.lit(1).alias("p"), F.col(odd).alias("token")))).alias("f")
    docs = placed.select("doc_id", "n", "need", "unit", "rows", "prefix", F.coalesce("even.token", F.lit(-1).cast("long")).alias("even"),
                         both("even.token", "odd.token")).where(
        "f.token is not null")
    groups = unions.select("to", "to_rows", "g", "least", "most", "tokens", F.coalesce("to_even", F.lit(-1).cast("long")).alias("m_even"),
                           both("to_even", "to_odd")).where("f.token is not null")
    fams = (docs.groupBy("f").agg(F.count("*").alias("docs"), F.min("unit").alias("x"))
            .join(groups.groupBy("f").agg(F.count("*").alias("groups"), F.max("to").alias("y")), "f").where("groups > 1 or x <> y")
            .select("f", F.ceil(F.col("docs") / BLOCK_QUERIES).cast("long").alias("db"), F.ceil(F.col("groups") / BLOCK_GROUPS).cast("long").alias("gb")))
    fams = store(fams, "jaccard-families")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = docs.join(fams, "f").select(F.col("f.p").alias("p"), F.col("f.token").alias("fam"), F.pmod(F.xxhash64("doc_id"), F.col("db")).alias("i"),
                                          every("gb").alias("j"), "doc_id", "n", "need", "unit", "rows", "prefix", "even")
    groups = groups.join(fams, "f").select(
        F.col("f.p").alias("m_p"), F.col("f.token").alias("m_fam"), every("db").alias("m_i"), F.pmod(F.xxhash64("to", "g"), F.col("gb")).alias("m_j"),
        "to", "to_rows", "g", "least", "most", "tokens", "m_even")

    def run(left, right):
        out = []
        if len(left) and len(right):
            prefixes = list(left["prefix"])
            tokens, owner = np.concatenate(prefixes), np.repeat(np.arange(len(left)), [len(x) for x in prefixes])
            n, need = left["n"].to_numpy(), left["need"].to_numpy()
            asker = list(zip(left["rows"], left["unit"]))
            ids = left["doc_id"].to_numpy()
            even = left["even"].to_numpy()  # -1: none
            for r in right.itertuples(index=False):
                union = np.sort(np.asarray(r.tokens))
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                bound = np.bincount(owner[union[at] == tokens], minlength=len(left))
                passed = (bound >= need) & (100 * n >= threshold * r.least) & (100 * r.most >= threshold * n)
                if r.m_p and r.m_even >= 0:
                    passed &= even != r.m_even  # met by the even token already
                out += [(int(ids[k]), r.to, int(r.g)) for k in np.flatnonzero(passed).tolist() if asker[k] < (r.to_rows, r.to)]
        return pd.DataFrame(out, columns=["doc_id", "to", "g"]).astype({"doc_id": "int64", "g": "int64"})

    return queries.groupBy("p", "fam", "i", "j").cogroup(groups.groupBy("m_p", "m_fam", "m_i", "m_j")).applyInPandas(run, "doc_id long, to string, g long")


def _count_in(tokens: np.ndarray, union: np.ndarray) -> int:
    """How many of ``tokens`` are in the sorted ``union``."""
    at = np.searchsorted(union, tokens)
    return int((union[np.minimum(at, len(union) - 1)] == tokens).sum())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, itself included).

    Two documents link when 100 * intersection >= threshold * union of their sets.
    NULL and empty texts have no shingles and link with nothing; a NULL doc_id
    links with nothing and has a NULL component; rows that repeat a doc_id are
    one document.  An empty table gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    bounded_batches(spark)
    path = scratch(spark, "jaccard-sets")
    sets(base, size, threshold).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(SETS).parquet(path)
    plain = store(found.drop("prefix"), "jaccard-plain")
    classes = plain.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    # one document of each class goes on; without the copies, fewer sets may still link
    one = lambda alive: alive.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    alive = store(one(_alive(found)), "jaccard-alive")
    again = store(likely(found, alive.select("doc_id"), "doc_id").join(alive, ["doc_id", "d1", "d2"]), "jaccard-again")
    alive = store(one(_alive(again)), "jaccard-twice")
    drop_folder(spark, path)
    texts = (likely(base, alive.select("doc_id"), "doc_id").join(alive, "doc_id").dropDuplicates())
    whole = store(sets(texts.select("doc_id", "text", "d1", "d2"), size, threshold), "jaccard-whole")
    # once more, by longer prefixes
    whole = store(whole.join(_alive(whole).select("doc_id", "family", "even", "odd").distinct(), "doc_id"), "jaccard-kept")
    near = store(_in_groups(whole, threshold), "jaccard-near")
    far = store(_across(whole, near, threshold), "jaccard-far")
    comp = components(near.unionAll(far), "jaccard-all")
    nodes = classes.join(comp, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    key = lambda c: F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(c))
    return (plain.select("doc_id", "n", key("d1").alias("d1"), key("d2").alias("d2")).join(nodes, ["d1", "d2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (NULL after
    all others).  A document is an id with a text: rows that repeat both are one, texts
    that share an id, or have none, are documents of their own."""
    from pyspark.sql import Window
    keyed = docs.withColumn("__row", F.xxhash64(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")))
    comps = jaccard_components(keyed, id_col="__row", text_col=text_col, **options).select(F.col("doc_id").alias("__row"), "component_id")
    ids = keyed.select(F.col(f"`{id_col}`").isNull().alias("__none"), F.col(f"`{id_col}`").alias("__id"), "__row").distinct()
    keep = (comps.distinct().join(ids, "__row").groupBy("component_id").agg(F.min(F.struct("__none", "__id", "__row")).alias("__first"))
            .select("__first.__row").distinct())
    order = Window.partitionBy("__row").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    return keyed.join(keep, "__row").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "__row")
