"""SimHash near-duplicates found with BK-trees.

Distinct fingerprints are dealt to shards: 64 bits are cut into ``blocks`` parts,
and two fingerprints within ``radius`` bits agree on at least ``blocks - radius``
whole parts, so each choice of that many parts is a table and the bits of those
parts are a shard's key. ``blocks`` is a fixed parameter, whatever the number of
fingerprints: with 5 blocks a fingerprint has five rows and a shard one 12- or
13-bit part in common, and the search is left to the shard's BK-tree. Its children
are keyed by their integer Hamming distance to the parent; a query at distance d
from a node follows only edges within [d - radius, d + radius], and no subtree that
is connected with the query already.

A shard of more than ``tree_size`` fingerprints is cut into p trees of about that
size and its queries into p slices. Each tree is packed into one row and sent once to
each slice of its own number or above, where trees are searched one after another.
A worker turns its links into stars (one edge a fingerprint), so no group emits its
pairs, and components are found from the stars.

Defined results: a null or blank text has fingerprint zero and is linked like any
other; a text of any length is hashed whole, one at a time; repeated rows and rows
without doc_id are kept, and a component's id is the least doc_id in it (null if none
has one); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_group, shuffle_width, stored
from lumenframe.llm.components import components


@dataclass(frozen=True)
class SimHash:
    """``blocks`` 5 suits up to some 100 million fingerprints, 6 (15 rows each, shards of
    21 bits) more than that; every choice above ``radius`` finds the same links."""

    shingle: int = 4
    seed: int = 42
    radius: int = 4
    blocks: int = 5
    tree_size: int = 1 << 16


def shingle_hashes(raw: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of every ``size`` words of the lower-cased text, or of a shorter text as it is."""
    words = raw.lower().split()
    if not words:
        return []
    flat, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hash_(flat, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths).tolist()
    return [hash_(flat[a:b], seed) for a, b in zip(begins, ends[size - 1 :].tolist(), strict=False)]


def fingerprint(raw: bytes, how: SimHash = SimHash()) -> int:
    """Signed 64-bit fingerprint: bits set in over half of the shingles' XXH64."""
    hashes = shingle_hashes(raw, how.shingle, how.seed)
    if not hashes:
        return 0
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(packed), 1 << 15):
        counts += np.unpackbits(packed[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, how: SimHash = SimHash(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` per row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint((t.as_py() or "").encode(), how) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], names=[*keep, "fp"])

    own = docs.select(*keep, "text")
    kept = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(run, f"{kept}, fp long")


def tables(blocks: int, radius: int) -> list[int]:
    """Masks, as signed longs, of every choice of blocks that ``radius`` errors leave whole."""
    if blocks <= radius:
        raise ValueError("more blocks than errors are needed")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKForest:
    """BK-trees of many groups at once, level by level.

    ``values`` are distinct within a group; equal ``groups`` stand together. The
    first value of a group is its root. At each level every value still on its way
    measures its distance to its node and moves to the child under that distance,
    or becomes that child if it is the first to come.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        n = len(values)
        first = np.ones(n, bool)
        first[1:] = groups[1:] != groups[:-1]
        self.roots = np.flatnonzero(first)
        self.root_of = self.roots[np.cumsum(first) - 1] if n else self.roots
        moving = np.flatnonzero(~first)
        node = self.root_of[moving]
        edges, children, self.levels = [], [], []
        while len(moving):
            distance = np.bitwise_count(values[moving] ^ values[node]).astype(np.int64)
            key = node * 65 + distance
            named, at, which = np.unique(key, return_index=True, return_inverse=True)
            edges.append(named)
            children.append(moving[at])
            self.levels.append((node[at], moving[at]))
            stays = np.zeros(len(moving), bool)
            stays[at] = True
            node, moving = moving[at][which][~stays], moving[~stays]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edges = key[order]
        self.children = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def uniform(self, labels: np.ndarray) -> np.ndarray:
        """Whether all values of the subtree under each value have one label."""
        out = np.ones(len(self.values), bool)
        for node, child in reversed(self.levels):
            np.logical_and.at(out, node, out[child] & (labels[child] == labels[node]))
        return out

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int, labels: np.ndarray | None = None, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, value number) pairs within ``radius``, from each query's tree.

        With ``labels`` of the values and the queries (``mine``) subtrees of nothing but
        the query's own label are left out."""
        query, node = np.arange(len(queries)), roots
        uniform = None if labels is None else self.uniform(labels)
        while len(query):
            if uniform is not None:
                open_ = ~(uniform[node] & (labels[node] == mine[query]))
                query, node = query[open_], node[open_]
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), side="right")
            many = high - low
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            query, node = np.repeat(query, many), self.children[np.repeat(low, many) + inner]


class Stars:
    """Union of links with vectorised hooking; gives one edge per linked number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up


#: Distances measured in one go; the first slice of a large tree is smaller, so that
#: what it connects needn't be visited again.
PAIRS = 1 << 21


def slices(size: np.ndarray, pairs: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries, whose trees have ``size`` values, of about ``pairs`` distances; the first ones are smaller."""
    upto, at, now = np.cumsum(size), 0, max(1, pairs // 32)
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + now, side="right")))
        yield at, end
        at, now = end, min(2 * now, pairs)


def linked(forest: BKForest, tree: np.ndarray, asks: np.ndarray, roots: np.ndarray, size: np.ndarray, values: np.ndarray, radius: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among ``values``, of which ``tree`` are in the forest and ``asks`` ask it."""
    stars, large = Stars(len(values)), len(size) and int(size.max()) > 1 << 10
    for a, b in slices(size, pairs):
        own = asks[a:b]
        known = (stars.parent[tree], stars.parent[own]) if large and a else (None, None)
        for query, node in forest.within(values[own], roots[a:b], radius, *known):
            stars.link(own[query], tree[node])
    ends = np.flatnonzero(stars.parent != np.arange(len(values)))
    return values[ends].view(np.int64), values[stars.parent[ends]].view(np.int64)


def shard_links(group: np.ndarray, values: np.ndarray, radius: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among the values of each group, whose tree they all ask."""
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    forest, every = BKForest(values, group), np.arange(len(values))
    size = np.diff([*forest.roots, len(values)])[np.searchsorted(forest.roots, forest.root_of)]
    return linked(forest, every, every, forest.root_of, size, values, radius, pairs)


def slice_links(queries: np.ndarray, tree: np.ndarray, radius: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among the values of one tree and the queries that ask it."""
    forest = BKForest(tree, np.zeros(len(tree), np.int64))
    asks = len(tree) + np.arange(len(queries))
    asked = np.zeros(len(queries), np.int64)
    return linked(forest, np.arange(len(tree)), asks, asked, asked + len(tree), np.concatenate([tree, queries]), radius, pairs)


EDGES = "a long, b long"


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(fps: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """Edges ``a, b`` that connect what links within the radius connect; ``fps`` is
    a stored table of distinct ``fp``."""
    width, radius = shuffle_width(fps.sparkSession), how.radius
    masks = tables(how.blocks, radius)
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    members = fps.select("fp", F.explode(keys).alias("s")).select("fp", "s.t", "s.key")
    sizes = members.groupBy("t", "key").count().where("count > 1")
    sizes = sizes.select("t", "key", F.ceil(F.col("count") / F.lit(how.tree_size)).cast("int").alias("parts"))
    # There are at most 2^bits shards to a table, whatever the input.
    if sum(2 ** (m % (1 << 64)).bit_count() for m in masks) <= 1 << 20:
        sizes = F.broadcast(sizes)
    held = members.join(sizes, ["t", "key"])

    small = held.where("parts = 1").select(F.xxhash64("t", "key").alias("g"), "fp")
    small = small.repartition(width * 2, "g").sortWithinPartitions("g")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def links() -> pa.RecordBatch:
            g, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            return edge_batch(*shard_links(g, fp.view(np.uint64), radius))

        for batch in batches:
            g, fp = np.array(batch.column(0)), np.array(batch.column(1))
            if not len(g):
                continue
            if rows >= 1 << 17:  # cut where a group ends
                cut = int(np.searchsorted(g, held[-1][0][-1], side="right"))
                if cut:
                    held.append((g[:cut], fp[:cut]))
                if cut == len(g):
                    continue
                yield links()
                held, rows, g, fp = [], 0, g[cut:], fp[cut:]
            held.append((g, fp))
            rows += len(g)
        if held:
            yield links()

    part = F.pmod(F.xxhash64("fp", "t"), F.col("parts")).cast("int").alias("part")
    crowded = held.where("parts > 1").select("t", "key", "parts", part, "fp")
    trees = crowded.groupBy("t", "key", "parts", "part").agg(F.collect_list("fp").alias("tree"))
    trees = trees.select("t", "key", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("part"), "tree")
    asked = crowded.select("t", "key", "part", "fp").unionByName(trees, allowMissingColumns=True)
    asked = asked.select(F.xxhash64("t", "key", "part").alias("g"), "t", "key", "part", "fp", "tree")
    asked = asked.repartition(width * 2, "g").sortWithinPartitions("g", "t", "key", "part", F.col("tree").isNotNull())

    def search_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, queries = None, np.zeros(0, np.uint64)
        for batch in batches:
            own = np.stack([np.array(batch.column(k), np.int64) for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(own)]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                if tuple(own[x]) != slice_:
                    slice_, queries = tuple(own[x]), np.zeros(0, np.uint64)
                fps = batch.column(3).slice(x, y - x).drop_null()
                queries = np.concatenate([queries, np.array(fps, np.int64).view(np.uint64)])
                for tree in batch.column(4).slice(x, y - x).drop_null():
                    yield edge_batch(*slice_links(queries, np.array(tree.values, np.int64).view(np.uint64), radius))

    found = small.mapInArrow(search, EDGES).unionByName(asked.select("t", "key", "part", "fp", "tree").mapInArrow(search_slices, EDGES))
    return found.where("a <> b").distinct()


def classified(each: DataFrame, how: SimHash) -> DataFrame:
    """``fp, component_id`` per distinct fingerprint of ``fp, id``."""
    fps = stored(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(fps.select("fp"), how))
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(beside_group(labelled, least, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``."""
    each = stored(fingerprints(docs, how), "fingerprints")
    classes = classified(each.select("fp", F.col("doc_id").alias("id")), how)
    return each.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
