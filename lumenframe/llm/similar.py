"""Near copies by the Jaccard similarity of their shingle sets.

Texts of equal words are folded first. Candidates come from two searches: SimHash
fingerprints within the radius (BK-trees, see ``simhash``), and MinHash bands, of
which one agrees for all but some 7 of 100,000 pairs at similarity 0.8. Each bucket
gives one edge a text, to the least of the bucket. What these edges connect is one
group, and within a group the similar pairs are found exactly: texts that share
none of their rarest fifth of shingles can't reach 0.8, the others are compared
unless they are connected already. A group of more than ``group_bytes`` of text is
dealt to several parts, and every two parts meet.

Defined results: a text without words is similar to its like only; a text of no
more words than a shingle is one shingle; a text of any length is hashed whole, one at
a time; repeated rows and rows without doc_id are rows of their own; an empty table
gives no rows; columns of any name are carried unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_group, bounded, stored
from lumenframe.llm.components import components
from lumenframe.llm.simhash import SimHash, fingerprint, near_links, shingle_hashes


@dataclass(frozen=True)
class Similar:
    """Similar: intersection by union is ``least`` percent or more."""

    shingle: int = 5
    least: int = 80
    bands: int = 24
    rows: int = 5
    seed: int = 42
    group_bytes: int = 32 << 20
    simhash: SimHash = field(default_factory=SimHash)


def shingle_set(raw: bytes, how: Similar = Similar()) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(raw, how.shingle, how.seed), np.uint64))


def factors(how: Similar) -> np.ndarray:
    return np.random.default_rng(how.seed).integers(1, 1 << 63, how.bands * how.rows, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, by: np.ndarray, how: Similar) -> list[int]:
    """One signed key a band: the least of the set under each of its ``rows`` orders."""
    least = np.full(len(by), ~np.uint64(0), np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12), None] * by).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(how.bands, how.rows))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, how: Similar) -> DataFrame:
    """``__row, doc_id, size, digest, fp, keys`` of each row of ``__row, doc_id, text``, narrow."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors(how)
        for batch in batches:
            made: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(2):
                raw = (text.as_py() or "").encode()
                made[0].append(len(raw))
                made[1].append(hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest())
                made[2].append(fingerprint(raw, how.simhash))
                made[3].append(band_keys(shingle_set(raw, how), by, how))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["__row", "doc_id", "size", "digest", "fp", "keys"])

    return docs.select("__row", "doc_id", "text").mapInArrow(run, f"__row long, doc_id {kind}, size long, digest binary, fp long, keys array<long>")


def candidates(texts: DataFrame, how: Similar) -> DataFrame:
    """Edges ``a, b`` over the nodes of ``node, fp, keys``."""
    members = texts.select("node", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    banded = beside_group(members, hubs, "key").select(F.col("node").alias("a"), "b")
    fps = stored(texts.groupBy("fp").agg(F.min("node").alias("hub")), "distinct-fingerprints")
    same = texts.join(fps, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    end = lambda x: fps.select(F.col("fp").alias(x), F.col("hub").alias(f"{x}_hub"))
    near = near_links(fps.select("fp"), how.simhash).join(end("a"), "a").join(end("b"), "b")
    return banded.unionByName(same).unionByName(near.select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b")))


def similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Of two sets of distinct numbers."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def similar_links(sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` that connect what all similar pairs connect."""
    sizes = np.array([len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum(sizes)
    held = [np.sort(rank[token[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    # Two similar sets share one of their rarest len - ceil(least %) + 1.
    first = [h[: n - -(-least * n // 100) + 1] for h, n in zip(held, sizes.tolist(), strict=True)]
    rare, owner = np.concatenate(first), np.repeat(np.arange(len(sets)), [len(f) for f in first])
    order = np.lexsort((owner, rare))
    rare, owner = rare[order], owner[order]
    begins = np.flatnonzero(np.diff(rare, prepend=-1))
    label, tested, out = np.arange(len(sets)), set(), []
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(rare)], strict=True):
        if hi - lo < 2:
            continue
        own = owner[lo:hi]
        if (label[own] == label[own[0]]).all():
            continue
        for k in range(1, len(own)):
            i, before = int(own[k]), own[:k]
            before = before[label[before] != label[i]]
            while len(before):
                j, before = int(before[0]), before[1:]
                if (i, j) in tested:
                    continue
                tested.add((i, j))
                if similar(held[i], held[j], least):
                    out.append((i, j))
                    label[label == label[i]] = label[j]
                    before = before[label[before] != label[i]]
    return out


def verified(groups: DataFrame, texts: DataFrame, own: DataFrame, how: Similar) -> DataFrame:
    """Edges ``a, b`` that connect the similar texts of each group of ``node, root``."""
    held = groups.join(texts.select("node", "size"), "node")
    parts = held.groupBy("root").agg(F.ceil(F.sum("size") / how.group_bytes).cast("int").alias("parts"))
    held = beside_group(held, parts.select("root", F.greatest("parts", F.lit(1)).alias("parts")), "root")
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = held.select("node", "root", "parts", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.where("parts = 1 or part <> other")
    dealt = met.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "node")
    sent = dealt.join(own.select(F.col("__row").alias("node"), "text"), "node").select("g", "node", "text")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        sets = [shingle_set((t.as_py() or "").encode(), how) for t in table.column("text")]
        links = similar_links(sets, how.least) if len(sets) > 1 else []
        ends = [pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    return sent.groupBy("g").applyInArrow(run, "a long, b long").distinct()


def representatives(docs: DataFrame, how: Similar = Similar()) -> DataFrame:
    """The rows of ``docs`` that stay: of what similar texts connect those with the least doc_id.

    Rows with equal or no doc_id neither multiply nor vanish: classes without any
    doc_id keep all their rows, and of other classes rows without doc_id go.
    """
    numbers = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    doc_id, text = (F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text"))
    whole = stored(bounded(docs).select(F.monotonically_increasing_id().alias("__row"), *numbers), "numbered")
    own = whole.select("__row", doc_id, text)
    each = stored(sketches(own, how), "sketches")
    firsts = stored(each.groupBy("digest").agg(F.min("__row").alias("node")), "distinct-texts")
    texts = each.join(firsts.select("node"), F.col("__row") == F.col("node")).select("node", "size", "fp", "keys")
    texts = stored(texts, "texts")
    roots = components(candidates(texts, how))
    groups = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "groups")
    classes = components(verified(groups, texts, own, how))
    named = firsts.join(classes, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    rows = stored(each.select("__row", "doc_id", "digest").join(named, "digest").select("__row", "doc_id", "root"), "classes")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("least"))
    gone = beside_group(rows, least, "root").where(~F.col("doc_id").eqNullSafe(F.col("least"))).select("__row")
    stays = whole.join(gone, "__row", "left_anti")
    return stays.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
