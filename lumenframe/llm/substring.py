"""Exact repeated passages by fixed-block anchors.

Of every document the non-overlapping blocks of ``block`` words are the
reference index, and every rolling window of ``block`` words probes it. A
passage of ``window >= 2 * block - 1`` words that stands in two places always
holds a whole block of each place, so each repeat is hit. Hits are then extended
to maximal exact repeats: of the ``window``-word windows over hit blocks the bytes
are held against those of all others, by 128-bit BLAKE2b digests of the words
joined by one space, and neighbouring ones that occur earlier join up. The quick
hashes of blocks only choose which windows to look at; no word goes by them.

Nothing is compared pair by pair. Documents are gathered where they lie into chunks
of ``chunk_bytes`` of text; a chunk sends each hash it holds once (however often it
stands there) to the hash's bucket, and the bucket answers with one bit per hash:
first whether an anchor elsewhere meets it, then whether it also starts in a smaller
document. There are as many buckets as chunks, so a bucket holds about as many
hashes as a chunk, at any size of the input. Rows between chunks and buckets are at
most one a hash and at most chunks times buckets; a passage that a third of all
documents share costs each chunk one hash, so no key is hot.

The order is doc_id, then place. Defined results: a null or blank text has no words;
a text longer than a chunk is a chunk of its own; rows with the same doc_id (or none;
null is the smallest) don't precede one another, only places within a row do; an
empty table gives no rows; columns of ``docs`` of any name are carried unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe.llm.common import bounded, stored
from lumenframe.llm.rolling import mixed, rolled

U = np.uint64
#: Odd bases of the polynomial hashes over bytes and blocks.
BYTE_BASE, BLOCK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NULL_ID = np.iinfo(np.int64).min
#: Texts are hashed in parts of about so many bytes.
PART = 1 << 18
#: Bits of a block's fingerprint beside its bucket: some 1,000 times the hashes of a
#: bucket. Too few would only make more windows to look at.
BITS = 30


@dataclass(frozen=True)
class Anchors:
    """``window`` words make a repeat. A chunk of ``chunk_bytes`` of text takes some
    forty times as much memory in a worker."""

    window: int = 20
    chunk_bytes: int = 3 << 20

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def powers(n: int, known: list[tuple[np.ndarray, np.ndarray]] = []) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE**k and its inverse modulo 2^64 for k < n."""
    size = max(n, 2 * PART)
    if not known or len(known[0][0]) < n:
        up, down = np.full(size, BYTE_BASE, U), np.full(size, pow(BYTE_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 2 * PART:  # a word longer than a part
            return made[0][:n], made[1][:n]
        known[:] = [made]
    return known[0][0][:n], known[0][1][:n]


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """``raw`` in pieces of about PART bytes that end at a blank, with their places."""
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PART else min((k for k in (raw.find(b" ", at + PART), raw.find(b"\n", at + PART)) if k >= 0), default=len(raw))
        yield at, raw[at:end]
        at = end


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word of ``raw``."""
    out: list[tuple[np.ndarray, ...]] = []
    for at, piece in parts(raw):
        buf = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~BLANK[buf]
        step = np.diff(inside)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * up[:-1], out=sums[1:])
        out.append((first + at, end + at, mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(U))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Words:
    """The words of a chunk's documents, in order of doc_id, with single blanks between them."""

    def __init__(self, texts: list[bytes]):
        self.texts = [b" ".join(t.split()) for t in texts]
        self.raw = b"\n".join(self.texts)
        edges = np.cumsum([0, *(len(t) + 1 for t in self.texts)])
        self.first, self.end, self.hashes = words_of(self.raw)
        self.offsets = np.searchsorted(self.first, edges)  # of documents, in words
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.offsets))

    def __len__(self) -> int:
        return len(self.first)

    def starts(self, size: int) -> np.ndarray:
        """Places where a run of ``size`` words of one document starts."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self) - size + 1] == self.row[size - 1 :])

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        """128 bits, as two numbers, of the bytes of the runs of ``size`` words."""
        out, view, digest = np.empty((len(at), 2), "<u8"), memoryview(self.raw), hashlib.blake2b
        for k in range(0, len(at), 1 << 14):
            own = at[k : k + (1 << 14)]
            spans = zip(self.first[own].tolist(), self.end[own + size - 1].tolist(), strict=True)
            made = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in spans])
            out[k : k + len(own)] = np.frombuffer(made, "<u8").reshape(-1, 2)
        return out


def bucket(h: np.ndarray, width: int) -> np.ndarray:
    return ((h >> U(32)) * U(width)) >> U(32)


def fresh_ones(*ranked: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the one before."""
    out = np.ones(len(ranked[0]), bool)
    if len(out):
        out[1:] = False
        for x in ranked:
            out[1:] |= x[1:] != x[:-1]
    return out


def squeezed(sorted_values: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences, in the narrowest width that holds them."""
    steps = np.diff(sorted_values, prepend=U(0))
    most = int(steps.max()) if len(steps) else 0
    width = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def spread(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(U), dtype=U)


class Chunk:
    """What one chunk sends to the buckets and makes of their answers."""

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes], how: Anchors, width: int):
        self.how, self.width, self.doc_ids = how, width, doc_ids
        self.words = Words(texts)
        self.places = self.words.starts(how.block)
        h = mixed(rolled(self.words.hashes, how.block, BLOCK_BASE))[self.places]
        self.words.hashes = None
        keys = bucket(h, width) << U(BITS) | h & U((1 << BITS) - 1)
        del h
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        fresh = fresh_ones(ranked)
        self.distinct = ranked[fresh]
        del keys, ranked
        self.number = np.empty(len(order), np.int32)  # of each place's key among the distinct ones
        self.number[order] = np.cumsum(fresh) - 1
        del order, fresh
        self.anchor = (self.places - self.words.offsets[self.words.row[self.places]]) % how.block == 0
        self.anchored = np.zeros(len(self.distinct), bool)
        self.anchored[self.number[self.anchor]] = True

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """bucket, fingerprints, bits that say which of them are anchors."""
        low = self.distinct & U((1 << BITS) - 1)
        for k, a, b in edges_of(self.distinct >> U(BITS)):
            yield k, squeezed(low[a:b]), np.packbits(self.anchored[a:b]).tobytes()

    def candidates(self, answers: dict[int, bytes]) -> None:
        """Finds the windows over met blocks. answers: a bit per fingerprint by bucket."""
        met = (np.bincount(self.number, minlength=len(self.distinct)) > 1) & self.anchored
        where = self.distinct >> U(BITS)
        for k, bits in answers.items():
            a, b = np.searchsorted(where, [U(k), U(k + 1)])
            met[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        size, block = self.how.window, self.how.block
        alone = np.zeros(len(self.words) + 1, np.int32)  # own blocks that stand nowhere else
        alone[1 + self.places[self.anchor & ~met[self.number]]] = 1
        before = np.cumsum(alone, dtype=np.int32)
        del self.number, self.anchor, self.anchored, self.distinct, self.places, alone, met, where
        at = self.words.starts(size)
        at = at[before[at + size - block + 1] == before[at]]
        del before
        found = self.words.digests(at, size)
        order = np.lexsort((found[:, 1], found[:, 0]))
        self.at, self.one, self.two = at[order], found[order, 0], found[order, 1]
        self.fresh = fresh_ones(self.one, self.two)
        self.group = np.cumsum(self.fresh, dtype=np.int32) - 1

    def windows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """bucket, both halves of its distinct windows' digests, the smallest doc_id of each."""
        one, two, ids = self.one[self.fresh], self.two[self.fresh], self.doc_ids[self.words.row[self.at[self.fresh]]]
        for k, a, b in edges_of(bucket(one, self.width)):
            yield k, one[a:b].tobytes(), two[a:b].tobytes(), np.ascontiguousarray(ids[a:b]).tobytes()

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which words an earlier window covers. answers: a bit per distinct window by bucket."""
        n = len(self.words)
        if not len(self.at):
            return np.zeros(n, bool)
        rows = self.words.row[self.at]
        ids = self.doc_ids[rows]
        later = ids > ids[self.fresh][self.group]
        later[1:] |= ~self.fresh[1:] & (rows[1:] == rows[:-1])
        where = bucket(self.one[self.fresh], self.width)
        elsewhere = np.zeros(len(where), bool)
        for k, bits in answers.items():
            a, b = np.searchsorted(where, [U(k), U(k + 1)])
            elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        later |= elsewhere[self.group]
        begin = self.at[later]
        step = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + self.how.window, minlength=n + 1)[: n + 1]
        return np.cumsum(step)[:n] > 0


def edges_of(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """value, begin, end of each run of the sorted ``where``."""
    begins = np.flatnonzero(fresh_ones(where))
    ends = [*begins[1:].tolist(), len(where)][: len(begins)]
    yield from zip(where[begins].tolist(), begins.tolist(), ends, strict=True)


def meet_blocks(table: pa.Table) -> pa.Table:
    """One bucket: says to each chunk which of its fingerprints another chunk has
    too, where one of them is an anchor."""
    held = [spread(x.as_py()) for x in table["keys"]]
    anchors = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table["extra"], held, strict=True)]
    flat = np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    fresh = fresh_ones(flat[order])
    group = np.cumsum(fresh) - 1
    anchored = np.zeros(int(fresh.sum()), bool)
    anchored[group[np.concatenate(anchors)[order]]] = True
    met = np.empty(len(flat), bool)
    met[order] = ((np.bincount(group) > 1) & anchored)[group]
    return answered(table, met, [len(p) for p in held])


def first_windows(table: pa.Table) -> pa.Table:
    """One bucket: says to each chunk which of its windows start in a smaller doc_id."""
    one, two, ids = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("keys", U), ("extra", U), ("ids", np.int64)))
    order = np.lexsort((ids, two, one))
    fresh = fresh_ones(one[order], two[order])
    least = ids[order][fresh][np.cumsum(fresh) - 1]
    later = np.empty(len(order), bool)
    later[order] = ids[order] > least
    return answered(table, later, [len(x) // 8 for x in table["keys"].to_pylist()])


def answered(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    edges = np.cumsum([0, *sizes])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


ANSWER = "chunk long, bucket int, bits binary"


def gathered(docs: DataFrame, how: Anchors) -> DataFrame:
    """``chunk, rows``: documents as compressed Arrow streams of ``chunk_bytes`` of
    text, gathered where they lie. ``docs`` starts with id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal chunk, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            size, chunk = 0, chunk + 1
            return pa.RecordBatch.from_arrays([pa.array([chunk - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                end = min(int(np.searchsorted(upto, done + how.chunk_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(upto[end - 1]) - done
                at = end
                if size >= how.chunk_bytes:
                    yield sent()
        if held:
            yield sent()

    return docs.mapInArrow(run, "chunk long, rows binary")


def opened(blob: bytes) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A chunk's rows in order of id, their ids and texts."""
    table = pa.ipc.open_stream(blob).read_all()
    ids = np.array([NULL_ID if x is None else x for x in table["id"].to_pylist()], np.int64)
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    return table, ids[order], [(t.as_py() or "").encode() for t in table["text"]]


def by_bucket(answers: pa.Table, step: int) -> dict[int, bytes]:
    own = answers.filter(pc.equal(answers["step"], step))
    return dict(zip(own["bucket"].to_pylist(), own["bits"].to_pylist(), strict=True))


def judged(docs: DataFrame, how: Anchors = Anchors()) -> DataFrame:
    """The columns of ``docs`` as ``c0, c1, ...`` with ``n_words, n_removed, kept`` (the
    words left, joined by one space).

    The texts are read once and stored in chunks (compressed, about a third of their
    size); three passes read those, two of them beside the buckets' answers.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    carried = [n for n, c in zip(names, docs.columns, strict=True) if c != "text"]
    own = bounded(docs).select(
        F.col("`doc_id`").alias("id"), F.col("`text`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns, strict=True) if n in carried]
    )
    chunks = stored(gathered(own, how), "chunks")
    width = max(1, chunks.count())

    def rows_of(chunk: int, rows: list[tuple], kinds: dict) -> pa.Table:
        columns = [[chunk] * len(rows), *([r[k] for r in rows] for k in range(len(kinds)))]
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds.values()], strict=True)], names=["chunk", *kinds])

    block_kinds = {"bucket": pa.int32(), "keys": pa.binary(), "extra": pa.binary()}
    window_kinds = block_kinds | {"ids": pa.binary()}

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0), batch.column(1), strict=True):
                _, ids, texts = opened(blob.as_py())
                yield from rows_of(chunk.as_py(), list(Chunk(ids, texts, how, width).blocks()), block_kinds).to_batches()

    sent = chunks.mapInArrow(send_blocks, "chunk long, bucket int, keys binary, extra binary")
    met = stored(sent.groupBy("bucket").applyInArrow(meet_blocks, ANSWER), "met-blocks").withColumn("step", F.lit(1))

    def candidates(rows: pa.Table, answers: pa.Table) -> tuple[pa.Table, Chunk]:
        table, ids, texts = opened(rows["rows"][0].as_py())
        chunk = Chunk(ids, texts, how, width)
        chunk.candidates(by_bucket(answers, 1))
        return table, chunk

    def send_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows_of(0, [], window_kinds)
        return rows_of(rows["chunk"][0].as_py(), list(candidates(rows, answers)[1].windows()), window_kinds)

    windows = chunks.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(
        send_windows, "chunk long, bucket int, keys binary, extra binary, ids binary"
    )
    later = stored(windows.groupBy("bucket").applyInArrow(first_windows, ANSWER), "later-windows").withColumn("step", F.lit(2))

    kinds = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, docs.columns, strict=True)]
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def keep(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        table, chunk = candidates(rows, answers)
        gone, words = chunk.removed(by_bucket(answers, 2)), chunk.words
        n_words, n_removed, kept = [], [], []
        for k, whole in enumerate(words.texts):
            a, b = words.offsets[k], words.offsets[k + 1]
            out = gone[a:b]
            n_words.append(len(out))
            n_removed.append(int(out.sum()))
            if n_removed[-1]:
                left = ~out
                spans = zip(words.first[a:b][left].tolist(), words.end[a:b][left].tolist(), strict=True)
                whole = b" ".join([words.raw[x:y] for x, y in spans])
            kept.append(whole)
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        columns = [table[n if n in carried else "text"].cast(arrow.field(n).type) for n in names]
        return pa.table([*columns, *made], schema=arrow)

    answers = met.unionByName(later)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, schema)


MADE = ("n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, how: Anchors = Anchors()) -> DataFrame:
    """The rows of ``docs`` with ``n_words, n_removed`` and ``kept``; columns of ``docs``
    with one of these names give way."""
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in MADE]
    return judged(docs, how).select(*own, *MADE)


def without_repeats(docs: DataFrame, how: Anchors = Anchors()) -> DataFrame:
    """The rows and columns of ``docs`` with repeats taken out of ``text`` (and of
    ``n_chars``, where there is one); texts without repeats stay as they are."""
    changed = F.col("n_removed") > 0
    own = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    columns = [(F.when(changed, own[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"c{k}")) if c in own else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)]
    return judged(docs, how).select(*columns)
