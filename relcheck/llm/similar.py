"""Near-duplicates by the exact Jaccard similarity of shingle sets: SimHash first, then a prefix-filtered join.

Two sets of similarity t or more share, under any one order of all shingles, one among the first
n - ceil(t n) + 1 of each (their prefixes), so texts meet by those alone and no pair is lost. First the order
puts a quarter of all shingles (by their hash) first, rarest first, and the others behind by hash: only texts that
meet under it go on, as whole sets. Then all shingles are ordered, rarest among these texts first, so that a text of
which a fifth is its own meets nobody, however common the rest is. SimHash fingerprints, searched with BK-trees,
link the closest copies of those; at a similarity of 0.8 fingerprints differ in 4 to 11 bits of 64, beyond any
radius that shards can be searched for, so the rest is left to the prefixes. Texts meet by a shingle and a band of sizes,
and only one whose shingle lies in its first ninth can be the smaller of two, so texts that share a page of common text
but are not similar have nobody to meet: first a few leaders of a large group with all others, then those not yet in one
component with each other. Pairs that meet are held against bounds of their sizes, places and 256 parity bits each, and
are confirmed on whole sets, SimHash's pairs too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components
from .simhash import RADIUS, fingerprint_links, majority
from .textscan import LOWER, NOT_SPACE, fits, map_batches, mix, per_text, ragged, scratch, slices, span_hashes, staged, text_bytes, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
#: One in so many shingles comes first in the order, by its count. With four, their number is over a prefix's.
FIRST = 4
BITS = ("b0", "b1", "b2", "b3")


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after another, and where each text's begin (rows + 1).

    Words are runs without ASCII white space, A-Z lower-cased; fewer of them than a shingle are one shingle. Null
    texts and texts without words have none.
    """
    data, off = text_bytes(texts)
    data = LOWER[data]
    starts, ends, at = words(data, off, NOT_SPACE)
    n_words = np.diff(at)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(text)) + np.repeat(at[:-1] - (np.cumsum(n) - n), n)
    h = span_hashes(word_hashes(data, starts, ends), first, np.minimum(first + shingle, at[1:][text]))
    shift = np.uint64(max(1, len(n).bit_length()))
    order = np.argsort(text.astype(np.uint64) << (np.uint64(64) - shift) | h >> shift)
    text, h = text[order], h[order]
    same = text[1:] == text[:-1]
    if (same & (h[1:] < h[:-1])).any():  # hashes that differ in their last bits only
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | ~same
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mix(total[at[1:]] - total[at[:-1]] + n), np.uint64(0))


def parity_bits(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits for each set, as 4 longs: the parity of its shingles in each 256th of the hashes.

    Two sets differ in as many shingles as bits at least.
    """
    rows = len(at) - 1
    text = np.repeat(np.arange(rows), np.diff(at))
    odd = np.bincount(text * 256 + (h >> np.uint64(56)).astype(np.int64), minlength=rows * 256).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, 256), axis=1).view("<u8").astype(np.uint64).view(np.int64)


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def is_first(h: np.ndarray) -> np.ndarray:
    return h % np.uint64(FIRST) == 0


def emitted(h: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Which shingles may lie in a prefix: all of the first class, of the others the least so far as those are too few."""
    n, early = np.diff(at), is_first(h)
    missing = np.maximum(prefix_length(n, similarity) - per_text(early, at), 0)
    late = np.cumsum(~early)
    before = np.concatenate([[0], late])[at[:-1]]
    return early | (late - np.repeat(before, n) <= np.repeat(missing, n))


def _enough(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that first meet at the places pos can be similar enough, by sizes, places and parity bits."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    n = x("n") + y("n")
    both, differ = F.lit(similarity / (1 + similarity)) * n - 1e-6, F.lit((1 - similarity) / (1 + similarity)) * n + 1e-6
    bits = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in BITS), F.lit(0))
    return (F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * similarity - 1e-6) & (F.least(x("n") - x("pos"), y("n") - y("pos")) >= both) & (bits <= differ)


def _prefixes(sets: DataFrame, nodes: DataFrame, first: int, *bits: str) -> DataFrame:
    """(h, set, n, pos, *bits) of the shingles in the sets' prefixes that other sets have too; pos is a lower bound of the place.

    One in `first` shingles comes first in the order, the rarest of them first; nodes has their number as early.
    """
    each = sets.select("set", F.explode("hashes").alias("h"))
    # a count of rows, combined before the shuffle; written first, so that a large partition of the join can be split
    shared = staged(each.groupBy("h").agg(F.count("*").alias("df"), (F.min("set") != F.max("set")).alias("met")).where("met").select("h", "df"))
    held = each.join(shared, "h").select("set", "h", "df").distinct().withColumn("late", F.pmod(F.col("h"), F.lit(first)) != 0)
    own = Window.partitionBy("set")  # a set's own shingles
    ranked = held.withColumn("met", F.count(F.when(~F.col("late"), 1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy("late", "df", "h")))
    placed = ranked.join(nodes.select("set", "n", "early", "prefix", *bits), "set")
    pos = F.when(F.col("late"), F.col("early") + F.col("nth") - 1 - F.col("met")).otherwise(F.col("early") - F.col("met") + F.col("nth") - 1)
    return placed.withColumn("pos", pos).where("late OR pos < prefix").select("h", "set", "n", F.col("pos").cast("int").alias("pos"), *bits)


def _bands(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (h, n, pos, ...) with each band of sizes that hold a smaller or equal partner, and whether the row may be the smaller.

    Two similar sets that first meet at places pos share n - pos shingles at most, each. So the smaller has no more
    shingles than (n - pos) (1 + 1/similarity) - n of the larger, and the larger no more than that of the smaller: a
    row whose own size is beyond that (its place lies behind a ninth of the set at 0.8) is never the smaller one.
    """
    n, room = F.col("n"), F.floor((F.col("n") - F.col("pos")) * (1 + 1 / similarity) - F.col("n") + 1e-6)
    band = lambda size: F.floor(F.log(size.cast("double")) / float(-np.log(similarity)))
    least, most = F.ceil(n * similarity - 1e-6), F.least(n, room)
    wide = rows.where(least <= most).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    return wide.withColumn("smaller", (n <= room) & (F.col("band") == band(n)))


def _meeting(rows: DataFrame) -> DataFrame:
    """The sets of which a row has company."""
    company = staged(rows.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h"))
    return rows.join(company, "h", "left_semi").select("set").distinct()


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that connect all whose fingerprints lie within the radius, as candidates."""
    by_fp = staged(nodes.groupBy("fp").agg(F.min("set").alias("first"), F.count("*").alias("size")))
    equal = nodes.join(by_fp.where("size > 1"), "fp").select(F.col("first").alias("a"), F.col("set").alias("b"))
    near = fingerprint_links(by_fp.select("fp"), RADIUS).distinct()
    ends = near.join(by_fp.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.union(ends.select("x", "y")).where("a <> b")


def near_duplicate_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, pair_limit: int = 16, rounds: int = 2, leaders: int = 12, most_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, row, rep) for every row of docs; row is a hash of its text, rep the least (doc_id, row) reachable.

    See near_duplicates. rep is null if all rows of a component have null ids.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), shingle)
            n, use, bits = np.diff(at), emitted(h, at, similarity), parity_bits(h, at)
            columns = [pa.array(set_ids(h, at).view(np.int64)), pa.array(n), pa.array(per_text(is_first(h), at)), pa.array(prefix_length(n, similarity)), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row"), *columns, pa.array(majority(h, at).view(np.int64)), ragged(h[use].view(np.int64), per_text(use, at), pa.int64())], ["doc_id", "row", "set", "n", "early", "prefix", *BITS, "fp", "hashes"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, at).view(np.int64)), ragged(h.view(np.int64), np.diff(at), pa.int64())], ["set", "hashes"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(similar, pa.bool_()))

    with scratch(docs.sparkSession) as keep:
        marked = staged(map_batches(keyed, mark, "doc_id long, row long, set long, n long, early long, prefix long, " + "".join(f"{b} long, " for b in BITS) + "fp long, hashes array<long>"))
        rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("rep")
        # a text of the set to confirm by, whatever its id
        nodes = staged(marked.groupBy("set").agg(rep, F.min("row").alias("row"), *(F.min(c).alias(c) for c in ("n", "early", "prefix", *BITS, "fp"))))
        rows = staged(_prefixes(marked.select("set", "hashes"), nodes, FIRST))
        chosen = staged(_meeting(rows).join(nodes.select("set", "row", "n", "prefix", *BITS, "fp"), "set"))
        texts = keyed.select("row", "text").join(fits(chosen.select("row").distinct(), most_broadcast), "row", "left_semi")
        sets = staged(map_batches(texts, whole, "set long, hashes array<long>").join(chosen.select("set"), "set", "left_semi").dropDuplicates(["set"]))
        component = None

        def settle(met: DataFrame) -> bool:
            """Confirms pairs (a, b) and renews the components if one of them is new."""
            nonlocal component
            pairs = staged(met)
            if not (count := pairs.count()):
                return False
            need = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
            used = sets.join(fits(need, most_broadcast), "set", "left_semi")
            held = pairs.join(used.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(used.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
            fresh = staged(map_batches(held.select("a", "b", "x", "y"), confirm, "a long, b long"))
            if not (count := fresh.count()):
                return False
            if component is not None:  # what is known counts as links to the least of each component
                count += component.count()
                fresh = fresh.union(component.where("set <> component").select("set", "component"))
            component = staged(connected_components(fresh).withColumnRenamed("node", "set"), 2 * count)
            return True

        def named_by(rows: DataFrame) -> DataFrame:
            return rows.drop("comp").join(component, "set", "left").withColumn("comp", F.coalesce("component", "set")).drop("component")

        settle(_simhash_pairs(chosen))
        rows = staged(_prefixes(sets, chosen.withColumn("early", F.col("n")), 1, *BITS))
        rows = _bands(named_by(rows) if component is not None else rows.withColumn("comp", F.col("set")), similarity)
        one = F.struct("set", "n", "pos", "comp", *BITS)
        key = ["h", "band"]
        for turn, limit in enumerate([4, *(pair_limit << 4 * turn for turn in range(rounds)), 1 << 31]):
            groups = rows.groupBy(key).agg(F.count_if("smaller").alias("smaller ones"), F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            sizes = staged(groups.where("`smaller ones` > 0 AND low <> high").select(*key, (F.col("smaller ones") * F.col("size")).alias("work")))
            if sizes.isEmpty():
                break
            rows = staged(rows.join(sizes, key))
            small = F.col("work") <= limit * limit
            pair = [F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")]
            apart = (F.col("x.comp") != F.col("y.comp")) & _enough("x", "y", similarity)
            x, y = rows.where(small & F.col("smaller")).select(*key, one.alias("x")), rows.where(small).select(*key, one.alias("y"))
            ordered = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.set") < F.col("y.set"))
            few = x.join(y, key).where(ordered & apart).select(*pair)
            # by another hash each turn, so that leaders are spread over the group
            some = F.array(*(F.min(F.struct(F.xxhash64("set", F.lit(leaders * turn + i)).alias("by"), one.alias("y"))) for i in range(leaders)))
            heads = rows.where(~small & F.col("smaller")).groupBy(key).agg(some.alias("leaders"))
            many = rows.where(~small).select(*key, one.alias("x")).join(heads, key).select("x", F.explode("leaders.y").alias("y")).where(apart).select(*pair).union(few)
            renewed = settle(many.distinct())
            rows = rows.where(~small).drop("work")
            rows = named_by(rows) if renewed else rows
        named = nodes.select("set", "rep")
        if component is not None:
            named = _least(named.join(component, "set", "left").select("set", "rep", F.coalesce("component", "set").alias("comp")))
        # written first: then both sides of the join are plain exchanges, and a hot set can be split
        return keep(marked.select("doc_id", "row", "set")).join(keep(named), "set").select("doc_id", "row", "rep")


def _least(whose: DataFrame) -> DataFrame:
    """(set, rep): of each component's sets the least rep."""
    whose = staged(whose)
    least = staged(whose.groupBy("comp").agg(F.min("rep").alias("rep")))
    return whose.select("set", "comp").join(least, "comp").select("set", "rep")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, pair_limit: int = 16, rounds: int = 2) -> DataFrame:
    """(doc_id, component_id) for every row of docs.

    component_id is the least doc_id reachable over pairs of texts whose shingle sets have the Jaccard
    similarity or more. Null texts and texts without words have one, empty, set. Rows with a null doc_id
    keep a row but name no component; repeated rows stay repeated; other columns are not read.

    Of groups with more than 16 possible pairs a few leaders are paired with all others first. Then groups of up to
    `pair_limit` squared possible pairs are paired in full; of larger ones other leaders with all, round by round with
    sixteen times the limit each; after `rounds`, what is still in different components is paired with those texts of
    its band of sizes that can be the smaller.
    """
    return near_duplicate_rows(docs, shingle, similarity, pair_limit, rounds).select("doc_id", F.col("rep.doc_id").alias("component_id"))
