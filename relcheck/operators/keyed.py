"""Differences of two relations by key, where a key may have many rows on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .relations import _signed, written
from .scans import MOST_ROWS, dealt, running


def _placed(surplus: DataFrame, keys: list[str]) -> DataFrame:
    """Each surplus row with `start`: how many surplus copies of its key and side precede it in the order of all columns.

    Each side also has a row without values where its copies end.
    """
    by = [*keys, "wanted"]
    spread = running(surplus, by, ["values"], upto=("sum", F.col("n")))
    held = F.struct(F.lit(True).alias("here"), F.col("values"))
    starts = spread.select(*by, (F.col("upto") - F.col("n")).alias("start"), held.alias("row"))
    ends = surplus.groupBy(*by).agg(F.sum("n").alias("start"), F.struct(F.lit(False).alias("here"), F.first("values").alias("values")).alias("row"))
    return starts.unionByName(ends)


def keyed_diff(have: DataFrame, want: DataFrame, keys: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """(keys, status, changed_columns, copies): keys whose rows are missing, extra or changed, and the columns that changed.

    Rows of a key are bags: equal rows of both sides cancel, copy by copy. Of what is left, the first copies of
    one side are paired with the first of the other in the order of all their columns (of have's order, nulls first), and each pair is
    `changed`; copies beyond the shorter side are `extra` or `missing` and name no column. A key has one row
    for each status and set of changed columns, which counts the copies, so a relation never differs from itself
    and n copies of a key make no n times n rows. Null keys are keys; columns of want go by have's names.

    The sides are counted in one shuffle by whole rows. Copies are runs of places, which are laid over each
    other by running values, so neither the copies of a row nor the rows of a key are ever joined pairwise.
    """
    others = [c for c in have.columns if c not in keys]
    signed, names = _signed(have, want.select(*(F.col(f"`{c}`") for c in have.columns)))
    plain = dict(zip(have.columns, names))
    values = F.struct(*(F.col(plain[c]).alias(f"v{i}") for i, c in enumerate(others)), F.lit(0).alias("no column"))
    # keys are named apart from what is computed here
    mine = [f"key {i}" for i in range(len(keys))]
    surplus = written(signed.where("h <> w").select(*(F.col(plain[c]).alias(k) for c, k in zip(keys, mine)), values.alias("values"), F.abs(F.col("w") - F.col("h")).alias("n"), (F.col("w") > F.col("h")).alias("wanted")))
    placed = _placed(dealt(surplus, [*mine, "wanted"], ["values"], most_rows), mine)
    covering = running(dealt(placed, mine, ["start", "wanted"], most_rows), mine, ["start", "wanted"], h=("last", F.when(~F.col("wanted"), F.col("row"))), w=("last", F.when(F.col("wanted"), F.col("row"))), end=("next", F.col("start")))
    runs = covering.where("end > start").withColumn("copies", F.col("end") - F.col("start"))
    here, there = (F.coalesce(F.col(side)["here"], F.lit(False)) for side in ("h", "w"))

    def differs(i: int) -> Column:
        return ~F.col(f"h.values.v{i}").eqNullSafe(F.col(f"w.values.v{i}"))

    changed = F.array_compact(F.array(*(F.when(differs(i), F.lit(c)) for i, c in enumerate(others)))) if others else F.array().cast("array<string>")
    status = F.when(here & there, "changed").when(here, "extra").otherwise("missing")
    found = runs.select(*mine, status.alias("status"), F.when(here & there, changed).otherwise(F.array().cast("array<string>")).alias("changed_columns"), "copies")
    summed = found.groupBy(*mine, "status", "changed_columns").agg(F.sum("copies").alias("copies"))
    return summed.select(*(F.col(k).alias(c) for k, c in zip(mine, keys)), "status", "changed_columns", "copies")
