"""Operator 1: token ids in a byte-aligned variable-length file format.

Every id is replaced by its rank among the corpus's ids, the most frequent
first.  Four ranks share one control byte (two bits each: their lengths in bytes
less one); control bytes and data bytes are columns of their own, so a reader
turns a control stream into lengths, and those into places, by numpy table
lookup, without a branch per id.  A file is a Parquet file of blocks; its rows
stand in ascending document order, and the files in that of their shards.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import bounded_batches, drop_folder, pick, scratch, shuffle_width, text_or_empty

#: Ids in a block at least, but for a shard's last; a block holds whole documents.
BLOCK_IDS = 1 << 16
#: New entries after which a worker's table of pre-tokens loses its older half.
CACHE_PIECES = 250_000
#: Code points below are cut by a pattern of their own; all are in NFC, and but for
#: these letters their lower case is among them.
LATIN, LEAVES_LATIN = 0x250, "\u0130\u023a\u023e"

#: FIXED VALUES: the pre-token rule of the tokenizer file's Split step.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: FIXED VALUES (end)

BLOCK_SCHEMA = ("shard long, block long, n_ids long, doc_id array<long>, doc_ids array<int>, "
                "control binary, data binary")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Recent(dict):
    """A table of bounded size: when ``limit`` new entries have come, the oldest half goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def lacks(self, keys) -> list:
        """The keys without an entry; entries of the older half are renewed."""
        out = []
        for k in keys:
            if k not in self:
                if k in self.old:
                    self[k] = self.old[k]
                else:
                    out.append(k)
        return out

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts, the same as the tokenizer's own, with each distinct
    pre-token encoded once.

    A text is normalised and cut into pre-tokens; those not met before go to the
    tokenizer's model in one call, where a word-end piece closes each.  For
    tokenizers that don't have this form (a word end, white space dropped) and for
    texts with their special tokens, whole texts go to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        spec = json.loads(self.tk.to_str())
        model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False)
        suffix = model.get("end_of_word_suffix")
        self.wordwise = (bool(suffix) and json.dumps(PIECE, ensure_ascii=False) in pre and '"ByteLevel"' in pre
                         and not model.get("unk_token"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = "<u2" if self.tk.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends = np.zeros(self.tk.get_vocab_size(), bool)
        for token, i in self.tk.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        # the model alone: pre-tokens come normalised, cut and in byte letters
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"},
                                                           "added_tokens": []}))
        self.letters = _byte_letters()
        self.pieces = _Recent(CACHE_PIECES)
        kinds = {k: "".join(chr(c) for c in range(128, LATIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.latin = re.compile(PIECE.replace(r"\p{L}", "a-z" + kinds["L"]).replace(r"\p{N}", "0-9" + kinds["N"]).replace(r"\s", WHITE))
        self.any = regex.compile(PIECE.replace(r"\s", WHITE))

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(LATIN) and not any(c in text for c in LEAVES_LATIN):
            return self.latin.findall(text.lower())
        return self.any.findall(self.tk.normalizer.normalize_str(text))

    def _spell(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 2048):
            part = new[i:i + 2048]
            spelt = " ".join([self._spell(p) for p in part])
            ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(stops) != len(part):
                raise ValueError("a pre-token without exactly one word end")
            raw, at = ids.tobytes(), 0
            for p, to in zip(part, stops.tolist()):
                self.pieces[p] = raw[at:to]
                at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.wordwise and not any(s in t for s in self.special) for t in texts]
        cut = [self._cut(t) if ok else [] for t, ok in zip(texts, plain)]
        known = self.pieces
        self._learn(known.lacks(set().union(*cut).difference(known)))
        out = [b"".join(map(known.__getitem__, ps)) for ps in cut]
        for i, ok in enumerate(plain):
            if not ok:
                out[i] = np.array(self.tk.encode(texts[i], add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        known.age()
        return out


_ENCODER: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODER:
        _ENCODER[path] = WordEncoder(path)
    return _ENCODER[path]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs(doc_id, text) as (doc_id, ids): little-endian ids, 2 bytes each for
    vocabularies of up to 65,536 ids, else 4; ``end_id`` closes each document."""

    def run(batches):
        enc = _encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"),
                                    "ids": [x + end for x in enc.encode(part["text"].tolist())]})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, ids binary")


def _width(tokenizer: str) -> str:
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over the whole corpus: counts per partition, then summed."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for pdf in batches:
            for x in pdf["ids"]:
                c = np.bincount(np.frombuffer(x, dtype))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[:len(c)] += c
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen.astype(np.int64), "n": total[seen]})

    return tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    ranks = ranks.astype(np.uint32)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two[:len(ranks)] = length - 1
    four = two.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    planes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), planes[np.arange(4) < length[:, None]].tobytes()


#: For each control byte, the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks that ``pack`` wrote: lengths by table lookup, places by a running
    sum, and the bytes gathered a plane at a time."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    place = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data, np.uint8)
    out = raw[place].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            out[more] |= raw[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
              id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every row of ``docs`` and write the files under ``path``:
    ``path/ranks`` (rank, id, n) and ``path/blocks``.

    Ids stand in ascending ``id_col`` order (NULL first; rows of one id in the
    order of their ids' bytes).  NULL text is the empty text, whose only id is
    ``end_id``; an empty table gives an empty set of blocks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dtype = _width(tokenizer)
    raw = scratch(spark, "tokens")
    token_ids(pick(docs, doc_id=id_col, text=text_col), tokenizer, end_id).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(raw)
    # one row for each id of the vocabulary at most
    counts = id_counts(tokens, dtype).orderBy(F.desc("n"), "id").toPandas()
    spark.createDataFrame(
        pd.DataFrame({"rank": np.arange(len(counts), dtype=np.int64), "id": counts["id"].astype("int64"),
                      "n": counts["n"].astype("int64")}), "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.uint32)
    rank_of[counts["id"].to_numpy(dtype=np.int64)] = np.arange(len(counts), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)

    def blocks(batches):
        shard, block, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            control, data = pack(table.value[np.frombuffer(b"".join(ids), dtype)])
            return pd.DataFrame({"shard": [shard], "block": [block], "n_ids": [n], "doc_id": [held],
                                 "doc_ids": [[len(x) // np.dtype(dtype).itemsize for x in ids]],
                                 "control": [control], "data": [data]})

        for pdf in batches:
            for d, x in zip(pdf["doc_id"], pdf["ids"]):
                held.append(None if pd.isna(d) else int(d))
                ids.append(x)
                n += len(x) // np.dtype(dtype).itemsize
                if n >= block_ids:
                    yield row()
                    block, held, ids, n = block + 1, [], [], 0
        if held:
            yield row()

    (tokens.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
     .mapInPandas(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks"))
    drop_folder(spark, raw)


def _decoded(spark: SparkSession, path: str):
    """The rows of a frame of blocks, decoded: r -> (doc ids, ids of each document as
    little-endian unsigned 32-bit integers)."""
    # one row for each id of the vocabulary at most
    ranks = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").toPandas()
    id_of = np.zeros(max(1, len(ranks)), "<u4")
    id_of[ranks["rank"].to_numpy(dtype=np.int64)] = ranks["id"].to_numpy()
    table = spark.sparkContext.broadcast(id_of)

    def decode(r):
        ids = table.value[unpack(r.control, r.data, r.n_ids)]
        parts = np.split(ids, np.cumsum(np.asarray(r.doc_ids, dtype=np.int64))[:-1])
        return pd.array([None if d is None or d != d else int(d) for d in r.doc_id], dtype="Int64"), parts

    return decode


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` as (shard, block, nth, doc_id, ids): ``ids`` are a
    document's ids as little-endian unsigned 32-bit integers."""
    decode = _decoded(spark, path)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                docs, parts = decode(r)
                yield pd.DataFrame({"shard": r.shard, "block": r.block, "nth": np.arange(len(parts)),
                                    "doc_id": docs, "ids": [p.tobytes() for p in parts]})

    return (spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
            .mapInPandas(run, "shard long, block long, nth long, doc_id long, ids binary"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start, n_tokens, ids_crc32."""
    starts = (spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", "n_ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = starts.withColumn("in_shard", F.coalesce(
        F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0)))
    # one row for each file
    shards = (starts.groupBy("shard").agg(F.sum("n_ids").alias("all")).withColumn(
        "ahead", F.coalesce(F.sum("all").over(before(Window.orderBy("shard"))), F.lit(0))).drop("all"))
    at = inside.join(shards, "shard").select("shard", "block", (F.col("in_shard") + F.col("ahead")).alias("block_start"))

    decode = _decoded(spark, path)

    def crc(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, parts = decode(r)
                yield pd.DataFrame({"shard": r.shard, "block": r.block, "nth": np.arange(len(parts)), "doc_id": ids,
                                    "n_tokens": np.array([len(p) for p in parts], np.int64), "ids_crc32": [zlib.crc32(p) for p in parts]})

    docs = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInPandas(
        crc, "shard long, block long, nth long, doc_id long, n_tokens long, ids_crc32 long")
    here = Window.partitionBy("shard", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return (docs.join(at, ["shard", "block"])
            .select("doc_id", (F.col("block_start") + F.coalesce(F.sum("n_tokens").over(here), F.lit(0))).cast("long").alias("start"),
                    "n_tokens", "ids_crc32"))
