"""What each filter of a chain removes, under every order of the filters.

A document fails some filters: its mask. It goes at the first step of an order whose filter it fails, so
the removal steps of all documents under all orders are a min-plus product: mask rows (0 where a filter
fails, unreachable elsewhere) times the orders' inverse permutations (the step at which each order has
each filter). Documents of one part and mask go alike; they are counted first, and the counts are
scattered to (order, step) by their removal step.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textscan import staged

NEVER = 1 << 40

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text, null counting as empty: too short, too repetitive, shouting, odd signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The 0-based step at which each mask goes under each order, at least NEVER if at none: a min-plus product.

    masks: bit f set where filter f fails. orders: a row of filter numbers for each order.
    """
    n = orders.shape[1]
    weight = np.where(masks[:, None] >> np.arange(n) & 1, 0, NEVER)
    position = np.argsort(orders, axis=1)  # the inverse permutations
    return (weight[:, :, None] + position.T[None]).min(axis=1)


def audit_masks(counts: DataFrame, names: str) -> DataFrame:
    """The audit of counted masks (part, mask, n, good, toxic), bit f of a mask for names[f], in all orders of the names.

    A task takes the masks of one part, which are 2^filters at most; masks that repeat add up. Every order
    and step has a row, zeros included; no counts give no rows.
    """
    orders = np.array(list(permutations(range(len(names)))))
    labels = ["".join(names[f] for f in o) for o in orders]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        masks, n, good, toxic = (table.column(c).to_numpy() for c in ("mask", "n", "good", "toxic"))
        steps = removal_steps(masks, orders)
        bits = masks[:, None] >> np.arange(len(names)) & 1

        def scattered(weights: np.ndarray) -> np.ndarray:
            out = np.zeros(orders.shape, np.int64)
            mask, order = np.nonzero(steps < NEVER)
            np.add.at(out, (order, steps[mask, order]), weights[mask])
            return out

        removed = scattered(n)
        fails = (bits * n[:, None]).sum(axis=0)
        alone = np.array([n[masks == 1 << f].sum() for f in range(len(names))])
        shares = np.zeros(len(names), np.int64)
        np.add.at(shares, orders, removed)
        values = {"kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails[orders] - removed, "unique_fails": alone[orders], "good_lost": scattered(good), "toxic_lost": scattered(toxic), "shapley": shares[orders]}
        rows = {"part": pa.repeat(key[0], orders.size), "filter_order": np.repeat(labels, orders.shape[1]), "step": np.tile(np.arange(1, orders.shape[1] + 1, dtype=np.int32), len(orders))}
        return pa.table(rows | {k: v.ravel() for k, v in values.items()})

    return counts.groupBy("part").applyInArrow(run, AUDIT)


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """AUDIT rows of documents (doc_id, text, lang) for the filters `failures` (name to failure of a row) and `copies`.

    A document fails `copies` if a smaller doc_id has the same text, removed or not (SHA-256 of the text; null
    and empty are the same). Parts are values of lang, null being the empty string. good: labels (doc_id,
    quality, toxic) have quality 1 for it, toxic: toxic 1; of several labels of an id any counts, a null or
    absent one does not. Rows count as often as they occur; repeated ids are not each other's copies; rows
    without an id have no label and are no copies, nor have they any. Without documents there are no rows.

    Texts are read once, into a narrow staged table. The first of each text meets its row by digest and id
    together, so copies of one text, however many, are dealt over all tasks.
    """
    failures = text_failures(F.coalesce("text", F.lit(""))) if failures is None else failures
    names = "".join(failures) + copies
    mask = sum((F.coalesce(c, F.lit(False)).cast("long") * (1 << i) for i, c in enumerate(failures.values())), F.lit(0).cast("long"))
    narrow = staged(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), mask.alias("mask")))
    named = narrow.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    last = F.when(F.col("first").isNull(), F.lit(1 << len(failures))).otherwise(F.lit(0))
    met = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + last).alias("mask")).join(flags, "doc_id", "left")
    rows = met.select("part", "mask", "good", "toxic").union(narrow.where("doc_id IS NULL").select("part", "mask", F.lit(0).cast("long"), F.lit(0).cast("long")))
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0).cast("long")).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0).cast("long")).alias("toxic"))
    return audit_masks(counts, names)
