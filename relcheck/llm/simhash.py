"""SimHash near-duplicates, searched with BK-trees.

A 64-bit fingerprint of three-word shingles is made for each text. Equal fingerprints are one node.
Two fingerprints that differ in r bits or fewer are equal in at least one of r + 1 blocks of the
word (pigeonhole), so nodes are sharded by (block, its value) and each shard has a BK-tree, whose
children are keyed by their Hamming distance to the parent; a search follows only edges within the
radius. The trees grow with the corpus, so they are built where their shard's rows are instead of being
broadcast. A shard with more than `shard_limit` nodes is split again by blocks of its other bits,
which keeps every link: after three rounds its nodes agree in 37 bits, and what is left is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .textscan import LOWER, NOT_SPACE, map_batches, scratch, slices, staged, text_bytes, words

RADIUS = 3
SHINGLE = 3


def shingle_hashes(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles in text order, and where each text's begin (rows + 1).

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    import xxhash

    lowered = LOWER[data]
    starts, ends, at = words(lowered, off, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    size = ends - starts
    new_start = np.cumsum(size + 1) - size - 1
    spaced = np.full(int(new_start[-1] + size[-1] + 1), 32, np.uint8)
    inside = np.flatnonzero(NOT_SPACE[lowered])
    spaced[inside + np.repeat(new_start - starts, size)] = lowered[inside]
    new_end = new_start + size
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    n_words = np.diff(at)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    text_at = np.concatenate([[0], np.cumsum(n_shingles)])
    first = np.repeat(at[:-1] - text_at[:-1], n_shingles) + np.arange(text_at[-1])
    last = np.minimum(first + shingle - 1, np.repeat(at[1:], n_shingles) - 1)
    h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(new_start[first].tolist(), new_end[last].tolist())), np.uint64, len(first))
    return h, text_at


def majority(h: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Of each text's hashes the bits that are set in over half, as uint64; 0 for texts without any."""
    n_shingles = np.diff(text_at)
    out = np.zeros(len(n_shingles), np.uint64)
    has = np.flatnonzero(n_shingles)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    begin = 0
    while begin < len(has):  # so many texts at once that their unpacked bits stay small
        end = max(begin + 1, int(np.searchsorted(text_at[has], text_at[has[begin]] + 200_000)))
        part = has[begin:end]
        a, b = text_at[part[0]], text_at[part[-1] + 1]
        bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, text_at[part] - a, axis=0, dtype=np.int32)
        out[part] = ((2 * ones > n_shingles[part, None]) * weight).sum(axis=1, dtype=np.uint64)
        begin = end
    return out


def fingerprints_of(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as uint64; 0 for texts without words."""
    return majority(*shingle_hashes(data, off, shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = fingerprints_of(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """All values in the tree within the radius."""
        found, stack = [], self.nodes[:1]
        while stack:
            here, children = stack.pop()
            d = (here ^ value).bit_count()
            if d <= radius:
                found.append(here)
            stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found

    def add(self, value: int) -> None:
        new = (value, {})
        if not self.nodes:
            self.nodes.append(new)
            return
        here = self.nodes[0]
        while (d := (here[0] ^ value).bit_count()) and d in here[1]:
            here = here[1][d]
        if d:
            here[1][d] = new


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect the values of one shard as all pairs within the radius would, one a value at most."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for u in tree.near(v, radius):
            if (a := root(u)) != (b := root(v)):
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in values if (r := root(v)) != v]


def _deal(df: DataFrame, width: int, radius: int) -> DataFrame:
    """Each row once for each of radius + 1 equal blocks of the `width` bits in `left`.

    The block's number and value go into shard, the other bits stay in left.
    """
    w = width // (radius + 1)
    left, shard = F.col("left"), F.col("shard")
    dealt = []
    for i in range(radius + 1):
        value = F.shiftrightunsigned(left, i * w).bitwiseAND(F.lit((1 << w) - 1))
        below = left.bitwiseAND(F.lit((1 << i * w) - 1))
        above = F.shiftleft(F.shiftrightunsigned(left, (i + 1) * w), i * w) if (i + 1) * w < 64 else F.lit(0).cast("long")
        dealt.append(F.struct(F.xxhash64(shard, F.lit(width), F.lit(i), value).alias("shard"), below.bitwiseOR(above).alias("left")))
    return df.select("fp", F.explode(F.array(*dealt)).alias("k")).select("fp", "k.shard", "k.left")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = 400) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) that connect all pairs within the radius."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(rows[0], prepend=~rows[0, :1], append=~rows[0, -1:]))
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    found += shard_links(np.sort(rows[1, a:b].view(np.uint64)).tolist(), radius)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:  # sorted by shard; the last shard of a batch may go on in the next
            held = np.concatenate([held, np.stack([batch.column("shard").to_numpy(), batch.column("fp").to_numpy()])], axis=1)
            whole = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if whole:
                yield links(held[:, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield links(held)

    ready: list[DataFrame] = []
    todo, width = nodes.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("left")), 64
    while True:
        dealt = _deal(todo, width, radius)
        width -= width // (radius + 1)
        hot = staged(dealt.groupBy("shard").count().where(F.col("count") > shard_limit).select("shard"))
        if hot.isEmpty() or width % (radius + 1):
            ready.append(dealt.select("shard", "fp"))
            break
        ready.append(dealt.join(hot, "shard", "left_anti").select("shard", "fp"))
        todo = staged(dealt.join(hot, "shard", "left_semi"))
    rows = ready[0]
    for part in ready[1:]:
        rows = rows.union(part)
    return map_batches(rows.repartition("shard").sortWithinPartitions("shard"), search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id reachable over links of `radius` differing bits or fewer. Null
    and empty texts share fingerprint 0. Rows with a null doc_id keep a row but name no component;
    repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        marked = keep(fingerprints(docs))
        nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
        links = fingerprint_links(nodes, radius)
        by_fp = connected_components(links.select("a", "b"))
        # components are named by fingerprint first, then by the least document in them
        named = nodes.join(by_fp.withColumnRenamed("node", "fp"), "fp")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        joined = named.join(least, "component").select("fp", "component_id")
        # written first: then both sides of the last join are plain exchanges, and the rows of a hot fingerprint can be split
        node_component = keep(nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(node_component, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
