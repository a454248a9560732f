"""Content-addressed store of token ids.

A rolling hash over a window of ids cuts each document's stream at places that
its content alone decides, so equal passages give equal chunks wherever they
stand. The store holds three tables in one folder:

* ``objects/kind=chunk``: each distinct chunk once, ``key`` (its digest), ``home`` (the
  first document that has it), ``shared`` (others may have it too), ``data``, zstandard
  of little-endian ids, 2 bytes wide if all fit;
* ``recipes``: per document in ascending doc_id order ``part, row, doc_id, within,
  n_tokens, chunks (digests), root`` where root is the Merkle root of its chunks;
* ``manifest``: per part ``part, n_docs, n_tokens, start, root`` where root is the
  Merkle root of its documents' roots.

Defined results: a null text is empty and has its end id only; rows with equal
doc_id are ordered by their root, and null doc_ids come first; an empty table
gives empty tables; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import bounded, fresh_path, own_columns, shuffle_width
from lumenframe.llm.encoding import encoder
from lumenframe.llm.rolling import mixed, rolled


@dataclass(frozen=True)
class Chunking:
    """A cut falls after an id where the hash of the last ``window`` ids has
    ``mask_bits`` zero bits; chunks have ``least`` to ``most`` ids."""

    window: int = 16
    mask_bits: int = 9
    least: int = 128
    most: int = 4096


def spread(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each id."""
    return mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def spread_small() -> np.ndarray:
    """``spread`` of every 16-bit id."""
    return spread(np.arange(1 << 16, dtype=np.uint64))


#: Documents of about so many ids are cut and hashed in one go.
SLICE_IDS = 1 << 18

#: Odd base of the rolling hash, modulo 2^64.
BASE = 0xD6E8FEB86659FD93


def cuts(ids: np.ndarray, how: Chunking = Chunking()) -> list[int]:
    """End positions of the chunks of one document, the last being its length."""
    return cuts_of(ids, [len(ids)], how)[0]


def cuts_of(ids: np.ndarray, lengths: list[int], how: Chunking = Chunking()) -> list[list[int]]:
    """The same, of documents whose ids stand one after another: all are hashed in
    one go, and windows over a document's edge are left out."""
    values = spread_small()[ids] if len(ids) and int(ids.max()) < 1 << 16 else spread(ids)
    hits = np.flatnonzero(mixed(rolled(values, how.window, BASE)) < np.uint64(1 << (64 - how.mask_bits))) + how.window
    ends = np.cumsum(lengths)
    edges = np.searchsorted(hits, [0, *ends.tolist()], side="right").tolist()
    out, begin = [], 0
    for k, n in enumerate(lengths):
        own, last = [], 0
        if n > how.least:
            for hit in (hits[edges[k] : edges[k + 1]] - begin).tolist():
                if hit < how.window:
                    continue
                while hit - last > how.most:
                    last += how.most
                    own.append(last)
                if hit - last >= how.least:
                    own.append(hit)
                    last = hit
            while n - last > how.most:
                last += how.most
                own.append(last)
        if last < n:
            own.append(n)
        out.append(own)
        begin += n
    return out


@lru_cache(maxsize=1)
def engines() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A process's compressor and decompressor."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


class Planes:
    """The bytes of some ids by significance, from which chunks are compressed."""

    def __init__(self, ids: np.ndarray):
        self.width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
        flat = np.ascontiguousarray(ids, f"<u{self.width}").view(np.uint8).reshape(-1, self.width)
        self.planes = [flat[:, k].tobytes() for k in range(self.width)]

    def packed(self, begin: int, end: int) -> bytes:
        """A chunk's bytes in the store: a width byte and the compressed byte planes."""
        return bytes([self.width]) + engines()[0].compress(b"".join([p[begin:end] for p in self.planes]))


def packed(ids: np.ndarray) -> bytes:
    return Planes(ids).packed(0, len(ids))


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(engines()[1].decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype("<u4")


def digest(ids: np.ndarray) -> bytes:
    return hashlib.sha256(ids.astype("<u4", copy=False)).digest()[:20]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        pairs = zip(level[::2], [*level[1::2], b""][: (len(level) + 1) // 2], strict=True)
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in pairs]
    return level[0]


def emitted(docs: DataFrame, tokenizer: str, end_id: int, how: Chunking, remembered: int = 1 << 19) -> DataFrame:
    """A row per document and one per chunk, told apart by ``kind``, in one narrow pass.

    ``row`` numbers documents. A task sends a chunk's data once, a row without data
    when it meets the chunk again, and nothing after that, so a chunk that most
    documents share costs two rows a task. It remembers ``remembered`` digests and
    then starts anew, which only sends some chunks again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, key binary, row long, data binary, doc_id {kind}, n_tokens long, chunks array<binary>, root binary"
    names = ["kind", "key", "row", "data", "doc_id", "n_tokens", "chunks", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 33
        met: dict[bytes, bool] = {}
        for whole in batches:
            doc_kind, at, encoded = whole.column(0).type, 0, enc.encode(whole.column(1))
            while at < whole.num_rows:
                raws, size, first = [], 0, at
                while at < whole.num_rows and size < SLICE_IDS:
                    raws.append(encoded[at] + end)
                    size += len(raws[-1]) // 4
                    at += 1
                batch, n_docs = whole.slice(first, at - first), len(raws)
                raw = memoryview(b"".join(raws))
                lengths = [len(r) // 4 for r in raws]
                del raws
                ids = np.frombuffer(raw, "<u4")
                planes = Planes(ids)
                begin, keys, counts, roots, sent = 0, [], [], [], []
                for k, ends in enumerate(cuts_of(ids, lengths, how)):
                    own, last, mine = [], begin, set()
                    for e in ends:
                        key = hashlib.sha256(raw[4 * last : 4 * (begin + e)]).digest()[:20]
                        own.append(key)
                        again = met.get(key)
                        if not again and key not in mine:
                            mine.add(key)
                            met[key] = again is not None
                            sent.append((key, row + k, planes.packed(last, begin + e) if again is None else None))
                        last = begin + e
                    keys += own
                    counts.append(len(own))
                    roots.append(merkle(own))
                    begin += lengths[k]
                    if len(met) >= remembered:
                        met.clear()
                numbers = range(row, row + n_docs)
                row += n_docs
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.repeat("document", n_docs), pa.array([x.to_bytes(8, "big") for x in numbers], pa.binary()), pa.array(numbers, pa.int64()),
                    pa.nulls(n_docs, pa.binary()), batch.column(0), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys, pa.binary())), pa.array(roots, pa.binary()),
                ], names=names)
                n = len(sent)
                if n:
                    own_keys, rows, data = zip(*sent, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat("chunk", n), pa.array(own_keys, pa.binary()), pa.array(rows, pa.int64()), pa.array(data, pa.binary()),
                        pa.nulls(n, doc_kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.binary()),
                    ], names=names)

    return docs.mapInArrow(run, schema)


def part_roots(recipes: DataFrame, width: int) -> DataFrame:
    """``part, n_docs, n_tokens, root`` of each part, from the roots of its recipes."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = totals.setdefault(part, [0, 0, []])
                t[0], t[1] = t[0] + 1, t[1] + n
                t[2].append(root)
        rows = [(k, n, tokens, merkle(roots)) for k, (n, tokens, roots) in totals.items()]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["part", "n_docs", "n_tokens", "root"])

    return (
        recipes.select("part", "n_tokens", "root", "within", "doc_id")
        .repartition(width, "part")
        .sortWithinPartitions("part", "within", "doc_id", "root")
        .select("part", "n_tokens", "root")
        .mapInArrow(summed, "part int, n_docs long, n_tokens long, root binary")
    )


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, how: Chunking = Chunking()
) -> str:
    """Encode ``docs`` and write the store's three tables under ``path``.

    Chunks meet by digest in one shuffle, after each task has sent its own once;
    documents travel beside them, so texts are encoded once and nothing else is
    stored. Recipes are dealt by ranges of doc_id; a document's start is its part's
    start, from the manifest (one row a part), plus the running sum within the part.
    """
    spark = docs.sparkSession
    sent = emitted(own_columns(bounded(docs), "doc_id", "text"), tokenizer, end_id, how)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("data", "doc_id", "n_tokens", "chunks", "root")]
    met = sent.repartition(shuffle_width(spark), "kind", "key").groupBy("kind", "key")
    met = met.agg(F.min("row").alias("home"), (F.count("*") > 1).alias("shared"), *first)
    met.write.partitionBy("kind").parquet(f"{path}/objects")
    encoded = spark.read.schema(met.schema).parquet(f"{path}/objects").where("kind = 'document'").withColumnRenamed("home", "row")

    width = shuffle_width(spark)
    recipes = encoded.select("row", "doc_id", "n_tokens", "chunks", "root")
    ranged = recipes.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "root")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.array(batch.column(2), np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            columns = [pa.array(np.full(len(n), part, np.int32)), *batch.columns[:2], pa.array(before), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "row", "doc_id", "within", "n_tokens", "chunks", "root"])

    numbered = ranged.mapInArrow(
        number, f"part int, row long, doc_id {kind}, within long, n_tokens long, chunks array<binary>, root binary"
    )
    numbered.write.parquet(f"{path}/recipes")

    roots = part_roots(spark.read.parquet(f"{path}/recipes"), width)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = roots.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return path


class Altered(ValueError):
    """The recipes aren't those of the manifest."""


def check_parts(recipes: DataFrame, manifest: DataFrame) -> None:
    """Raise ``Altered`` unless each part has the manifest's root and counts.

    The driver sees the number of parts that differ and one of them.
    """
    names = ("n_docs", "n_tokens", "root")
    found = part_roots(recipes, shuffle_width(recipes.sparkSession))
    both = manifest.select("part", *[F.col(n).alias(f"own_{n}") for n in names]).join(found, "part", "full")
    same = [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]
    differs = both.where(~(same[0] & same[1] & same[2]))
    n, part = differs.agg(F.count("*"), F.min("part")).first()
    if n:
        raise Altered(f"{n} parts differ from the manifest, the first is {part}")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, verified, ids`` per document, from the files alone.

    ``ids`` are little-endian unsigned 32-bit; a caller that wants their checksum only
    leaves them out by ``with_ids``. Each chunk is held against its
    digest, each document against its Merkle root and length, and the recipes of
    each part against the manifest before anything is read; a difference there raises.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    check_parts(recipes, manifest)
    starts = manifest.select("part", F.col("start").alias("part_start"))
    recipes = recipes.join(F.broadcast(starts), "part")  # one row a part
    start = (F.col("part_start") + F.col("within")).alias("start")
    recipes = recipes.select("row", "doc_id", start, "n_tokens", "chunks", "root")
    objects = spark.read.schema("key binary, home long, shared boolean, data binary, kind string").parquet(f"{path}/objects")
    chunks = objects.where("kind = 'chunk'").drop("kind")
    own = chunks.select(F.col("home").alias("row"), "key", "data")
    wanted = recipes.select("row", F.explode(F.array_distinct("chunks")).alias("key"))
    borrowed = wanted.join(chunks.where("shared"), "key").where("row <> home").select("row", "key", "data")
    parts = own.unionByName(borrowed).withColumn("seq", F.lit(1))
    together = recipes.withColumn("seq", F.lit(0)).unionByName(parts, allowMissingColumns=True)
    dealt = together.repartition(shuffle_width(spark), "row").sortWithinPartitions("row", "seq")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    order = ["seq", "doc_id", "start", "n_tokens", "chunks", "root", "key", "data"]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "verified"] + ["ids"] * with_ids
        held: list = []
        found: dict[bytes, bytes] = {}
        rows: list[tuple] = []
        doc_kind = pa.int64()

        def close() -> None:
            if not held:
                return
            doc_id, start, n, keys, root = held
            ids = b"".join([found[k] for k in keys if k in found])
            sound = all(k in found for k in keys) and len(ids) == 4 * n and merkle(keys) == root
            rows.append((doc_id, start, n, zlib.crc32(ids), sound, *((ids,) if with_ids else ())))

        def flush() -> pa.RecordBatch:
            kinds = [doc_kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * with_ids
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for whole in batches:
            doc_kind = whole.column(1).type
            for at in range(0, whole.num_rows, 1000):
                columns = [c.to_pylist() for c in whole.slice(at, 1000).columns]
                for seq, doc_id, start, n, keys, root, key, data in zip(*columns, strict=True):
                    if seq == 0:
                        close()
                        held, found = [doc_id, start, n, keys, root], {}
                    elif hashlib.sha256(ids := unpacked(data).tobytes()).digest()[:20] == key:
                        found[key] = ids
                    if len(rows) >= 500:
                        yield flush()
        close()
        if rows:
            yield flush()

    return dealt.select(*order).mapInArrow(rebuild, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, verified boolean" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` to a store and read it back; a document that doesn't
    verify raises an error instead of giving wrong ids."""
    where = path or fresh_path(docs.sparkSession, "token-store")
    back = read_documents(docs.sparkSession, write_store(docs, where, tokenizer), with_ids)
    error = F.raise_error(F.lit("a document differs from its Merkle root"))
    checked = F.when(F.col("verified"), F.col("ids_crc32")).otherwise(error).alias("ids_crc32")
    return back.select("doc_id", "start", "n_tokens", checked, *["ids"] * with_ids)
