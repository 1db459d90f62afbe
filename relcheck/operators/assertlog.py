"""Assertion logs (A1-A12): file_id, seq, op, passed, n, text.

Ops: assert, todo_start, todo, todo_end, skip, note, plan, no_plan, finish, error. A file is the unit
of order; files run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import glob_to_regex, is_glob
from .scans import MOST_ROWS, dealt, running

#: Globs without a whole word that a broadcast may hold.
MOST_GLOBS = 10_000

_WORD = r"\w+"


def _in_order(log: DataFrame, most_rows: int, **wanted: tuple[str, Column]) -> DataFrame:
    """The log with running values of each file's events; a file of more than `most_rows` events is dealt over tasks."""
    return running(dealt(log, ["file_id"], ["seq"], most_rows), ["file_id"], ["seq"], **wanted)


def _results(n: Column, op: Column) -> Column:
    """How many results an event records: an assertion one, a skip n (none below 1)."""
    return F.when(op == "assert", 1).when(op == "skip", F.greatest(F.coalesce(n, F.lit(1)), F.lit(0))).otherwise(0)


def number_assertions(log: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A1: (file_id, seq, op, first_number, results): the number, from 1 in each file, of the first result of an event."""
    results = _results(F.col("n"), F.col("op"))
    placed = _in_order(log.select("file_id", "seq", "op", results.alias("results")), most_rows, upto=("sum", F.col("results")))
    return placed.withColumn("first_number", F.col("upto") - F.col("results") + 1).where("results > 0").select("file_id", "seq", "op", F.col("first_number").cast("long"), F.col("results").cast("long"))


def apply_todo(log: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A2: assertions with directive and reason.

    todo_start covers until todo_end or the next directive; todo covers the next max(n, 1) assertions (a null
    n has no end); a null reason is empty; skips neither receive nor use up a todo.
    """
    is_directive = F.col("op").isin("todo_start", "todo", "todo_end")
    left = F.when(F.col("op") == "todo", F.greatest(F.col("n"), F.lit(1)))
    left = F.when((F.col("op") == "todo") & F.col("n").isNull(), F.lit(None)).otherwise(left)
    # a directive carries how many assertions its file had before it
    is_assert = F.when(F.col("op") == "assert", 1)
    made = F.when(is_directive, F.struct("op", left.alias("limit"), F.coalesce("text", F.lit("")).alias("reason"), F.col("asserts").alias("before")))
    counted = _in_order(log.select("file_id", "seq", "op", "passed", "n", "text"), most_rows, asserts=("sum", is_assert))
    marked = running(counted, ["file_id"], ["seq"], d=("last", made))
    nth = F.col("asserts") - F.col("d.before")
    covered = F.col("d").isNotNull() & (F.col("d.op") != "todo_end") & ((F.col("d.op") == "todo_start") | F.col("d.limit").isNull() | (nth <= F.col("d.limit")))
    todo = F.coalesce(covered, F.lit(False)) & (F.col("op") == "assert")
    out = marked.withColumn("todo", todo).where("op = 'assert'")
    return out.select("file_id", "seq", "passed", F.when(F.col("todo"), F.lit("todo")).alias("directive"), F.when(F.col("todo"), F.col("d.reason")).alias("directive_reason"))


def expand_skips(log: DataFrame) -> DataFrame:
    """A3: each skip as n passed results with the directive skip; none for n below 1."""
    count = F.coalesce("n", F.lit(1))
    each = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return log.where("op = 'skip'").select("file_id", "seq", F.explode(each).alias("nth"), F.lit(True).alias("passed"), F.lit("skip").alias("directive"), F.coalesce("text", F.lit("")).alias("directive_reason"))


def assertions(log: DataFrame) -> DataFrame:
    """All numbered results with their directives (A1-A3 together)."""
    numbers = number_assertions(log).select("file_id", "seq", "first_number")
    own = apply_todo(log).select("file_id", "seq", F.lit(1).alias("nth"), "passed", "directive", "directive_reason")
    both = own.unionByName(expand_skips(log))
    return both.join(numbers, ["file_id", "seq"]).select("file_id", (F.col("first_number") + F.col("nth") - 1).alias("number"), "passed", "directive", "directive_reason")


def attach_notes(log: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A4: each note with the number of the last result before it; null if there is none."""
    placed = _in_order(log.select("file_id", "seq", "op", "n", "text"), most_rows, t=("sum", _results(F.col("n"), F.col("op"))))
    return placed.where("op IN ('note', 'diag')").select("file_id", "seq", F.when(F.col("t") > 0, F.col("t")).cast("long").alias("after_assertion"), F.col("text").alias("message"))


def validate_document(results: DataFrame, plans: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A5: (file_id, problem, expected, found) of numbered results and declared plans.

    lost: the first gap in the numbers; plan_count: another number than declared (a null plan declares none);
    plan_twice: more than one plan. Files without a plan are fine.
    """
    numbers = dealt(results.select("file_id", "number"), ["file_id"], ["number"], most_rows)
    gap = running(numbers, ["file_id"], ["number"], last=("before", F.col("number"))).withColumn("want", F.coalesce("last", F.lit(0)) + 1).where("number <> want")
    lost = gap.groupBy("file_id").agg(F.min(F.struct("number", "want")).alias("m")).select("file_id", F.lit("lost").alias("problem"), F.col("m.want").cast("long").alias("expected"), F.col("m.number").cast("long").alias("found"))
    ran = results.groupBy("file_id").agg(F.count("*").alias("ran"))
    declared = plans.groupBy("file_id").agg(F.count("*").alias("plans"), F.max("declared").alias("declared"))
    both = declared.join(ran, "file_id", "left").withColumn("ran", F.coalesce("ran", F.lit(0).cast("bigint")))
    twice = both.where("plans > 1").select("file_id", F.lit("plan_twice").alias("problem"), F.lit(1).cast("long").alias("expected"), F.col("plans").alias("found"))
    count = both.where("plans = 1 AND declared <> ran").select("file_id", F.lit("plan_count").alias("problem"), F.col("declared").alias("expected"), F.col("ran").alias("found"))
    return lost.unionByName(twice).unionByName(count)


def status_of(directive: Column, passed: Column) -> Column:
    """Passed, failed, todo_passed, todo_failed or skipped."""
    return F.when(directive == "skip", F.lit("skipped")).when(directive == "todo", F.when(passed, F.lit("todo_passed")).otherwise(F.lit("todo_failed"))).when(passed, F.lit("passed")).otherwise(F.lit("failed"))


def assertion_status(results: DataFrame) -> DataFrame:
    """A6 over a table of results."""
    return results.withColumn("status", status_of(F.col("directive"), F.coalesce("passed", F.lit(False))))


def file_outcome(files: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """(file_id, results, passed): fails on any failure without a directive or on an error; no result passes.

    A file with an error has no document: its results count as none.
    """
    failed = (F.col("directive").isNull()) & ~F.coalesce("passed", F.lit(False))
    by_file = results.groupBy("file_id").agg(F.count("*").alias("n"), F.bool_or(failed).alias("failed"))
    broken = errors.select("file_id").distinct().withColumn("error", F.lit(True))
    both = files.select("file_id").distinct().join(by_file, "file_id", "left").join(broken, "file_id", "left")
    error = F.coalesce("error", F.lit(False))
    return both.select("file_id", F.when(error, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("results"), (~error & ~F.coalesce("failed", F.lit(False))).alias("passed"))


def suite_outcome(outcomes: DataFrame, suite: Column) -> DataFrame:
    """Failures of total and passed for each suite."""
    return outcomes.groupBy(suite.alias("suite")).agg(F.count_if(~F.col("passed")).alias("failures"), F.count("*").alias("total")).withColumn("passed", F.col("failures") == 0)


def flatten_detail(detail: Column) -> Column:
    """A JSON object as a map of strings: objects by their display (null as NULL), texts as they are, others as JSON."""
    whole = F.from_json(detail, "map<string,string>")
    display = lambda v: F.from_json(v, "map<string,string>")

    def flat(v: Column) -> Column:
        inner = F.when(v.startswith("{"), display(v))
        return F.when(F.coalesce(F.map_contains_key(inner, "display"), F.lit(False)), F.coalesce(F.element_at(inner, F.lit("display")), F.lit("NULL"))).otherwise(F.coalesce(v, F.lit("null")))

    return F.transform_values(whole, lambda _, v: flat(v))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """A10: keys in both snapshots of which any value moved: key, was and now."""
    values = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*values).alias("was"))
    b = after.select(key, F.struct(*values).alias("now"))
    return a.join(b, key).where(~F.col("was").eqNullSafe(F.col("now")))


def _met(paths: DataFrame, selectors: DataFrame, root: str) -> DataFrame:
    normal = F.regexp_replace(F.regexp_replace("selector", r"^(\./)+", ""), "/+$", "")
    asked = selectors.select("selector").distinct().select("selector", normal.alias("s"), glob_to_regex(normal).alias("re"), is_glob(normal).alias("glob"))
    p, s = F.col("path"), F.col("s")
    within = F.when(p.startswith(root + "/"), F.substring(p, F.lit(len(root) + 2), F.length(p))).otherwise(p)
    # a path meets a name by itself and its folders, so that names are an equi-join
    folders = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/", -1))), lambda i: F.array_join(F.slice(F.split(c, "/", -1), 1, i), "/"))
    named = paths.select("path", F.explode(F.array_union(folders(p), folders(within))).alias("s")).join(asked.select("selector", "s"), "s").select("path", "selector")
    globs = asked.where("glob").select("selector", "re", _whole_word(s).alias("word"))
    fits = F.regexp_like(p, F.col("re")) | F.regexp_like(within, F.col("re"))
    # a path that fits has the glob's whole word among its own, so they meet in an equi-join
    said = paths.select("path", F.explode(F.array_distinct(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0)))).alias("word"))
    met = named.union(said.join(globs, "word").where(fits).select("path", "selector"))
    # only what has no whole word, like `*` and `a*b`, is held against every path
    loose = globs.where("word IS NULL").select("selector", "re")
    n = loose.limit(MOST_GLOBS + 1).count()
    if n:
        met = met.union(paths.select("path").join(F.broadcast(loose) if n <= MOST_GLOBS else loose, fits).select("path", "selector"))
    return met


def _whole_word(glob: Column) -> Column:
    """The longest word of a glob that no wildcard touches, which any path that fits has as a word of its own; null for none."""
    plain = F.regexp_replace(glob, r"\[[^\]]*\]?", "*")
    words = F.regexp_extract_all(plain, F.lit(rf"(?<![\w*?]){_WORD}(?![\w*?])"), F.lit(0))
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]


def select_paths(paths: DataFrame, selectors: DataFrame, root: str = "tests") -> DataFrame:
    """The distinct paths that any selector names: exactly, as a folder, or as a glob; relative to root too."""
    return _met(paths, selectors, root).select("path").distinct()


def unmatched_selectors(paths: DataFrame, selectors: DataFrame, root: str = "tests") -> DataFrame:
    """Selectors that match no path."""
    return selectors.select("selector").distinct().join(_met(paths, selectors, root).select("selector").distinct(), "selector", "left_anti")
