"""Quality rules by compression bands.

A text that zstandard shrinks much more than prose of its length is repetitive;
one that it hardly shrinks is noise. Both the whole text and its fixed chunks
are compressed, and each length class has its own allowed band of ratios, of
which there is one set for Latin and one for other scripts.

Defined results: a null or blank text has no words and fails the base rules; a text
of any length is compressed whole, one at a time, and what stands behind its last full
chunk counts in the whole ratio only; equal texts have equal verdicts and repeated
rows are judged one by one; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import BLANKS, own_columns

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """For texts of up to ``max_bytes`` (None: any): allowed raw/compressed ratios."""

    max_bytes: int | None
    low: float
    high: float


#: Up to each length the lower limit lies at or below the least 0.5 % of real Latin-script
#: text of the length (messages in 41 languages, an English book, licences); base64 lies
#: under it at every length.
NARROW = (
    Band(400, 1.20, 2.6), Band(500, 1.23, 2.6), Band(650, 1.27, 3.0), Band(800, 1.30, 3.0), Band(1_000, 1.35, 3.0),
    Band(1_300, 1.42, 3.1), Band(1_700, 1.48, 3.1), Band(2_200, 1.55, 3.1), Band(3_000, 1.64, 3.3), Band(4_000, 1.70, 3.3),
    Band(6_000, 1.76, 3.6), Band(9_000, 1.86, 3.6), Band(16_000, 1.98, 3.6), Band(32_000, 2.08, 3.8), Band(64_000, 2.25, 3.8),
    Band(None, 2.30, 4.5),
)

#: The same of Cyrillic, Greek, Indic, Thai, Korean, Chinese and Japanese text, which
#: lies further apart.
WIDE = (
    Band(500, 1.20, 2.6), Band(650, 1.26, 3.0), Band(1_300, 1.31, 3.2), Band(1_700, 1.37, 4.0), Band(2_200, 1.42, 4.0),
    Band(3_000, 1.50, 4.0), Band(4_000, 1.54, 4.0), Band(6_000, 1.63, 4.6), Band(9_000, 1.74, 4.6), Band(16_000, 1.80, 4.6),
    Band(32_000, 1.95, 5.0), Band(64_000, 2.10, 5.0), Band(None, 2.20, 6.0),
)


@dataclass(frozen=True)
class CompressionBands:
    """Parameters of the rule.

    A text is rejected when its own ratio leaves the band of its length, or when
    more than ``chunk_share`` of its full chunks leave the chunk band. A text
    of less than one full chunk has no chunks. Texts of ``wide_from`` bytes a
    character or more have the wide limits.
    """

    bands: tuple[Band, ...] = NARROW
    wide_bands: tuple[Band, ...] = WIDE
    wide_from: float = 1.5
    chunk_bytes: int = 2_048
    chunk_low: float = 1.58
    wide_chunk_low: float = 1.44
    chunk_high: float = 4.0
    chunk_share: float = 0.30
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def wide(self, size: int, chars: int) -> bool:
        return size >= self.wide_from * chars

    def band(self, size: int, wide: bool = False) -> Band:
        bands = self.wide_bands if wide else self.bands
        return next(b for b in bands if b.max_bytes is None or size <= b.max_bytes)


def word_counts(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(windows)] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def ratios(raw: bytes, press: zstandard.ZstdCompressor, rule: CompressionBands, wide: bool = False) -> tuple[float, int, int]:
    """Whole-text ratio, number of full chunks, chunks outside the chunk band."""
    if not raw:
        return 0.0, 0, 0
    whole = len(raw) / len(press.compress(raw))
    size, view, bad, n = rule.chunk_bytes, memoryview(raw), 0, len(raw) // rule.chunk_bytes
    low = rule.wide_chunk_low if wide else rule.chunk_low
    for k in range(n):
        r = size / len(press.compress(view[k * size : (k + 1) * size]))
        bad += not low <= r <= rule.chunk_high
    return whole, n, bad


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def judge(df: DataFrame, rule: CompressionBands = CompressionBands(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``df``: the ``keep`` columns, counts, ratios and verdict.

    Narrow: one pass over the scan, no shuffle; memory is one Arrow batch.
    """
    own = own_columns(df, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=rule.level)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(batch.num_columns - 1):
                s = text.as_py() or ""
                raw = s.encode()
                counts = word_counts(raw, s)
                n, repeated = counts[0], counts[4]
                base_failed = n < rule.min_words or 100 * repeated > rule.max_repeat_percent * n
                wide = rule.wide(len(raw), len(s))
                whole, chunks, bad = ratios(raw, press, rule, wide)
                band = rule.band(len(raw), wide)
                good = band.low <= whole <= band.high and bad <= rule.chunk_share * chunks
                out.append((*counts, base_failed, good and not base_failed, whole, chunks, bad))
            made = zip(*out, strict=True) if out else [[] for _ in kinds]
            arrays = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *columns]
            )

    source = df.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("__text"))
    return source.mapInArrow(run, f"{fields}, {SCHEMA}")


def passing(df: DataFrame, rule: CompressionBands = CompressionBands()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df``.

    The verdict is computed beside each row, so no join is needed. Columns travel
    under numbers, which no verdict's name can clash with.
    """
    own = df.select(F.col("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    kept = judge(own, rule, tuple(f"c{k}" for k in range(len(df.columns)))).where("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])
