"""Harmonic packing.

A document's ids (with its end id) are in the class k of its length:
``capacity/(k+1) < length <= capacity/k``. A bin of class k takes exactly k
documents, so a worker fills bins without looking at other classes or workers: the
operator is one narrow pass with no shuffle. As cutting is free, two cuts are made.
A document longer than the capacity first gives full bins and is classed by what
is left. And the slack of a bin that has its k documents (less than
``capacity/(k+1)``) takes the head of the worker's next document, which is classed
by its rest. So each bin is full to the last id, and a document is cut only where a
bin ends. When a worker ends, its unfinished bins are merged, cut to fit; only the
last sequence of a worker is short.

Defined results: a null text is empty and gives one piece, its end id; a text of
any length is cut, one document in memory at a time; documents of equal length and
repeated rows are packed each in the order of the scan; an empty table gives no
pieces; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm.common import bounded, own_columns
from lumenframe.llm.encoding import encoder

#: Little-endian width of one id in ``ids``.
WIDTH = 4


@dataclass(frozen=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // WIDTH


class HarmonicPacker:
    """The bins of one worker. Holds less than k pieces of each class k, and one bin
    whose slack the next document fills."""

    def __init__(self, capacity: int = 2048):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {}
        self.slack: list[Piece] = []
        self.room = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """Takes a document's ids; gives the bins that became full."""
        total, start = len(ids) // WIDTH, 0

        def cut(n: int) -> Piece:
            nonlocal start
            start += n
            return Piece(doc_id, start - n, ids[(start - n) * WIDTH : start * WIDTH], total)

        if self.room and total:
            self.slack.append(piece := cut(min(self.room, total)))
            self.room -= piece.length
            if not self.room:
                yield self.slack
        while total - start >= self.capacity:
            yield [cut(self.capacity)]
        if start < total:
            k = self.capacity // (total - start)
            bin_ = self.open.setdefault(k, [])
            bin_.append(cut(total - start))
            if len(bin_) == k:
                del self.open[k]
                room = self.capacity - sum(p.length for p in bin_)
                if room:
                    self.slack, self.room = bin_, room
                else:
                    yield bin_

    def finish(self) -> Iterator[list[Piece]]:
        """The unfinished bins' pieces in full bins and one last one."""
        bin_, room = (self.slack, self.room) if self.room else ([], self.capacity)
        for k in sorted(self.open):
            for piece in self.open[k]:
                while piece is not None:
                    take = min(room, piece.length)
                    bin_.append(Piece(piece.doc_id, piece.start, piece.ids[: take * WIDTH], piece.doc_tokens))
                    room -= take
                    rest = piece.ids[take * WIDTH :]
                    piece = Piece(piece.doc_id, piece.start + take, rest, piece.doc_tokens) if rest else None
                    if not room:
                        yield bin_
                        bin_, room = [], self.capacity
        self.open.clear()
        self.room = 0
        if bin_:
            yield bin_


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, rows_out: int = 4096, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    ``ids`` are little-endian unsigned 32-bit; a caller that wants their checksum only
    leaves them out by ``with_ids``. ``sequence_id`` is the worker's partition number
    times 2^32 plus its count of bins; a retried task reads the same partition and so
    gives the same ids.
    """
    own = own_columns(bounded(docs), "doc_id", "text")
    kind = own.schema["doc_id"].dataType
    arrow_kind = pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    ids_field, ids_kind = (", ids binary", [("ids", pa.binary())]) if with_ids else ("", [])
    schema = f"doc_id {kind.simpleString()}, start long, length long{ids_field}, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    fields = pa.schema(
        [("doc_id", arrow_kind), ("start", pa.int64()), ("length", pa.int64()), *ids_kind]
        + [(n, pa.int64()) for n in ("ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), HarmonicPacker(capacity)
        end = end_id.to_bytes(WIDTH, "little")
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def bins() -> Iterator[list[Piece]]:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    yield from packer.add(doc_id, ids + end)
            yield from packer.finish()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        for bin_ in bins():
            offset = 0
            for p in bin_:
                ids = (p.ids,) if with_ids else ()
                rows.append((p.doc_id, p.start, p.length, *ids, zlib.crc32(p.ids), p.doc_tokens, sequence, offset))
                offset += p.length
            sequence += 1
            if len(rows) >= rows_out:
                yield flush()
        if rows:
            yield flush()

    return own.mapInArrow(run, schema)
