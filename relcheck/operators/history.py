"""Change history and registry integrity.

packages: project, id, mode, deploy_sha256, ...; edges and applied_edges: project, child, parent;
applied: project, id, mode, deploy_sha256; history: run_id, sequence, recorded_at, package_id, action, outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import KEY, closure, deployment_order
from .scans import MOST_ROWS, dealt, running

HEADER = "definition-v1"


def definition_hash(packages: DataFrame, header: str = HEADER) -> DataFrame:
    """Packages (id, mode, depends array, deploy_sha256) with definition_sha256.

    Binds id, mode, the set of dependencies and the script's own hash; the order of dependencies does not matter.
    """
    depends = F.array_join(F.array_sort(F.transform("depends", lambda x: x.cast("string"))), ",")
    text = F.concat(F.lit(header + "\nid="), F.col("id").cast("string"), F.lit("\ntransaction="), F.col("mode"), F.lit("\ndepends="), F.coalesce(depends, F.lit("")), F.lit("\ndeploy_sha256="), F.col("deploy_sha256"), F.lit("\n"))
    return packages.withColumn("definition_sha256", F.sha2(text, 256))


def plan(packages: DataFrame, edges: DataFrame, applied: DataFrame) -> DataFrame:
    """(project, id, position, status): applied and pending packages, both in deployment order."""
    have = applied.select(*KEY).distinct().withColumn("have", F.lit(True))
    status = F.when(F.col("have"), F.lit("applied")).otherwise(F.lit("pending")).alias("status")
    return deployment_order(packages, edges).join(have, KEY, "left").select(*KEY, "position", status)


def missing_from_source(packages: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied ids that the source no longer has."""
    return applied.select(*KEY).distinct().join(packages.select(*KEY), KEY, "left_anti")


def _parents(edges: DataFrame, name: str) -> DataFrame:
    return edges.groupBy("project", F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias(name))


def changed_definitions(packages: DataFrame, edges: DataFrame, applied: DataFrame, applied_edges: DataFrame) -> DataFrame:
    """I4: applied packages whose definition changed, with the first cause that fits and both values.

    Causes in order: dependencies (as sets), mode, script, manifest (packages and applied rows may carry a
    definition_sha256; where they don't, nothing else can have changed).
    """
    none = F.array().cast("array<bigint>")
    now = packages.join(_parents(edges, "depends"), KEY, "left").select(*KEY, F.struct(F.coalesce("depends", none).alias("depends"), "mode", F.col("deploy_sha256").alias("deploy"), (F.col("definition_sha256") if "definition_sha256" in packages.columns else F.lit(None).cast("string")).alias("definition")).alias("now"))
    was = applied.join(_parents(applied_edges, "depends"), KEY, "left").select(*KEY, F.struct(F.coalesce("depends", none).alias("depends"), "mode", F.col("deploy_sha256").alias("deploy"), (F.col("definition_sha256") if "definition_sha256" in applied.columns else F.lit(None).cast("string")).alias("definition")).alias("was"))
    both = was.join(now, KEY)
    text = lambda side: F.array_join(F.col(f"{side}.depends").cast("array<string>"), ",")
    differs = lambda f: ~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}"))
    cause = F.when(differs("depends"), F.struct(F.lit("dependencies").alias("cause"), text("was").alias("old"), text("now").alias("new")))
    for field, name in (("mode", "mode"), ("deploy", "script"), ("definition", "manifest")):
        known = differs(field) if field != "definition" else F.col("was.definition").isNotNull() & F.col("now.definition").isNotNull() & differs(field)
        cause = cause.when(known, F.struct(F.lit(name).alias("cause"), F.col(f"was.{field}").alias("old"), F.col(f"now.{field}").alias("new")))
    return both.withColumn("c", cause).where("c IS NOT NULL").select(*KEY, "c.cause", "c.old", "c.new")


def unclosed_applied(edges: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied packages of which a prerequisite is not applied, and those prerequisites."""
    done = applied.select(*KEY).distinct()
    needs = edges.select("project", F.col("child").alias("id"), "parent").join(done, KEY, "left_semi")
    open_ = needs.join(done.withColumnRenamed("id", "parent"), ["project", "parent"], "left_anti")
    return open_.groupBy(*KEY).agg(F.array_sort(F.collect_set("parent")).alias("absent"))


def first_error(packages: DataFrame, edges: DataFrame, applied: DataFrame, applied_edges: DataFrame) -> DataFrame:
    """The one error that a project reports: absent from source, else changed, else unclosed; the lowest id of its kind."""
    kinds = (missing_from_source(packages, applied), "missing"), (changed_definitions(packages, edges, applied, applied_edges), "changed"), (unclosed_applied(edges, applied), "unclosed")
    union = None
    for rank, (df, name) in enumerate(kinds):
        part = df.select(*KEY, F.lit(rank).alias("rank"), F.lit(name).alias("error"))
        union = part if union is None else union.union(part)
    # min_by combines before the shuffle: one row a project leaves each task
    return union.groupBy("project").agg(F.min(F.struct("rank", "id", "error")).alias("m")).select("project", "m.id", "m.error")


def _effect(action: Column, outcome: Column) -> Column:
    """What an event does to its package: applied, absent, blocked or nothing (null)."""
    return (
        F.when(action.isin("deploy", "baseline") & (outcome == "succeeded"), F.lit("applied"))
        .when((action == "resolve") & (outcome == "asserted_applied"), F.lit("applied"))
        .when((action == "revert") & (outcome == "succeeded"), F.lit("absent"))
        .when((action == "resolve") & (outcome == "asserted_not_applied"), F.lit("absent"))
        .when((action == "deploy") & (outcome == "attempted"), F.lit("blocked"))
    )


def current_state(history: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, state, recorded_at): the last state-changing event by (recorded_at, run_id, sequence) decides; pending without one."""
    effect = _effect(F.col("action"), F.col("outcome"))
    last = F.max_by(F.struct("e", "recorded_at"), F.when(F.col("e").isNotNull(), F.struct("recorded_at", "run_id", "sequence")))
    folded = history.withColumn("e", effect).groupBy(key).agg(last.alias("s"))
    state = F.when(F.col("s.e") == "absent", F.lit("pending")).otherwise(F.coalesce("s.e", F.lit("pending")))
    return folded.select(key, state.alias("state"), F.when(F.col("s.e").isNotNull(), F.col("s.recorded_at")).alias("recorded_at"))


def unresolved_attempts(history: DataFrame, key: str = "package_id") -> DataFrame:
    """I8: packages whose attempt nothing has closed: when the open attempts began, and how many there are."""
    effect = _effect(F.col("action"), F.col("outcome"))
    at = F.struct("recorded_at", "run_id", "sequence")
    marked = history.withColumn("e", effect).where("e IS NOT NULL").withColumn("at", at)
    closed = marked.groupBy(key).agg(F.max(F.when(F.col("e") != "blocked", F.col("at"))).alias("closed"))
    open_ = marked.where("e = 'blocked'").join(closed, key).where(F.col("closed").isNull() | (F.col("at") > F.col("closed")))
    return open_.groupBy(key).agg(F.min("recorded_at").alias("started_at"), F.count("*").alias("attempts"))


def status(packages: DataFrame, applied: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row a package, blocked before applied before pending; attempts and applied ids without a source too."""
    source, done, open_ = (df.select(*KEY).distinct().withColumn(n, F.lit(True)) for df, n in ((packages, "source"), (applied, "done"), (attempts, "open")))
    all_ = source.join(done, KEY, "full").join(open_, KEY, "full")
    state = F.when(F.col("open"), F.lit("blocked")).when(F.col("done"), F.lit("applied")).otherwise(F.lit("pending"))
    return all_.select(*KEY, state.alias("status"), F.coalesce("source", F.lit(False)).alias("in_source"))


def baseline_set(edges: DataFrame, applied: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets and all that they need, without what is applied already."""
    return closure(edges, targets).select(*KEY).distinct().join(applied.select(*KEY), KEY, "left_anti")


def revertible(packages: DataFrame, edges: DataFrame, applied: DataFrame) -> DataFrame:
    """For each applied package of the source whether it can be reverted, and the first reason against it.

    Reasons in order: dependents (applied ones, listed), irreversible, no_script (empty payload or none).
    """
    done = applied.select(*KEY).distinct()
    standing = edges.select("project", F.col("parent").alias("id"), "child").join(done.withColumnRenamed("id", "child"), ["project", "child"], "left_semi")
    dependents = standing.groupBy(*KEY).agg(F.array_sort(F.collect_set("child")).alias("dependents"))
    rows = packages.join(done, KEY, "left_semi").join(dependents, KEY, "left")
    reason = F.when(F.col("dependents").isNotNull(), F.lit("dependents")).when(~F.col("reversible"), F.lit("irreversible")).when(F.coalesce(F.trim("payload"), F.lit("")) == "", F.lit("no_script"))
    return rows.select(*KEY, reason.isNull().alias("revertible"), reason.alias("reason"), F.coalesce("dependents", F.array().cast("array<bigint>")).alias("dependents"))


def audit_append_only(history: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(run_id, problem, sequence): duplicates, gaps, runs that do not start at 1, time running backwards.

    A run of more than `most_rows` sequence numbers is dealt over tasks.
    """
    distinct = history.groupBy("run_id", "sequence").agg(F.count("*").alias("n"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))
    placed = running(dealt(distinct, ["run_id"], ["sequence"], most_rows), ["run_id"], ["sequence"], before=("before", F.col("sequence")), earlier=("before", F.col("last")))
    seen = placed.select("run_id", "sequence", "n", "first", "before", "earlier")
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("duplicate")),
        F.when(F.col("before").isNull() & (F.col("sequence") != 1), F.lit("start")),
        F.when(F.col("sequence") - F.col("before") > 1, F.lit("gap")),
        F.when(F.col("first") < F.col("earlier"), F.lit("backwards")),
    ))
    return seen.select("run_id", F.explode(problems).alias("problem"), "sequence")


def state_union(applied: DataFrame, attempts: DataFrame) -> DataFrame:
    """Both state tables as one, tagged by kind."""
    return applied.select(F.lit("applied").alias("kind"), *KEY).unionByName(attempts.select(F.lit("attempt").alias("kind"), *KEY))


def single_owner(registries: DataFrame, configured: DataFrame) -> DataFrame:
    """Per database none, owned, several, other_project or other_schema.

    registries: db, schema_name, project; configured: db, schema_name, project, one row a database.
    """
    found = registries.groupBy("db").agg(F.count_distinct("schema_name", "project").alias("owners"), F.min("schema_name").alias("have_schema"), F.min("project").alias("have_project"))
    both = configured.join(found, "db", "left")
    verdict = (
        F.when(F.col("owners").isNull(), F.lit("none"))
        .when(F.col("owners") > 1, F.lit("several"))
        .when(F.col("have_project") != F.col("project"), F.lit("other_project"))
        .when(F.col("have_schema") != F.col("schema_name"), F.lit("other_schema"))
        .otherwise(F.lit("owned"))
    )
    return both.select("db", F.coalesce("owners", F.lit(0).cast("bigint")).alias("owners"), verdict.alias("verdict"))


def format_gate(registries: DataFrame, supported: int) -> DataFrame:
    """(db, format_version) to uninitialised, current, upgrade (with the steps' versions) or too_new."""
    v = F.col("format_version")
    gate = F.when(v.isNull(), F.lit("uninitialised")).when(v > supported, F.lit("too_new")).when(v == supported, F.lit("current")).otherwise(F.lit("upgrade"))
    steps = F.when(v < supported, F.sequence(v + 1, F.lit(supported))).otherwise(F.array().cast("array<int>"))
    return registries.select("db", gate.alias("gate"), steps.alias("steps"))


def reconcile_checksums(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """I16: (path, status): modified, missing or unrecorded paths."""
    a, b = recorded.select("path", F.col("sha256").alias("was")), actual.select("path", F.col("sha256").alias("now"))
    both = a.join(b, "path", "full")
    state = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("was").isNull(), F.lit("unrecorded")).when(F.col("was") != F.col("now"), F.lit("modified"))
    return both.select("path", state.alias("status")).where("status IS NOT NULL")


def checksum_rollup(recorded: DataFrame, tree: Column) -> DataFrame:
    """I16: per tree the recorded paths' count and a digest of its checksum lines.

    The digest is built in three levels, so that no task gathers a tree's whole list: of the lines, sorted by
    path, whose path hash has the same first two bytes (65,536 lists a tree, of equal size whatever the paths
    are), of those digests by first byte, and of these 256.
    """
    line = F.struct("path", F.concat("sha256", F.lit("  "), "path", F.lit("\n")).alias("line"))
    bucket = F.substring(F.sha2("path", 256), 1, 4)
    parts = recorded.groupBy(tree.alias("tree"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), ""), 256).alias("d"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256)
    bytes_ = parts.groupBy("tree", F.substring("bucket", 1, 2).alias("bucket")).agg(F.sum("n").alias("n"), digest.alias("d"))
    return bytes_.groupBy("tree").agg(F.sum("n").alias("recorded"), digest.alias("digest"))


def resolve_selectors(packages: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, outcome, candidates): id prefixes or exact slugs to unique, none or ambiguous.

    packages: id (text), slug. Ids meet selectors by their prefixes of the lengths that selectors have.
    """
    asked = selectors.select("selector").dropna().distinct()
    lengths = [r[0] for r in asked.select(F.length("selector")).distinct().collect()]  # as many as the longest has characters at most
    prefixes = F.explode(F.filter(F.array(*(F.when(F.length("id") >= n, F.substring("id", 1, n)) for n in lengths)), lambda x: x.isNotNull())) if lengths else F.explode(F.array().cast("array<string>"))
    keys = packages.select("id", prefixes.alias("selector")).union(packages.select("id", F.col("slug").alias("selector")))
    met = keys.join(asked, "selector")
    found = met.groupBy("selector").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    all_ = selectors.select("selector").distinct().join(found, "selector", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    outcome = F.when(n < 1, F.lit("none")).when(n == 1, F.lit("unique")).otherwise(F.lit("ambiguous"))
    return all_.select("selector", outcome.alias("outcome"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def run_history(reports: DataFrame, history: DataFrame) -> DataFrame:
    """Each report with the events that its run wrote; reports of runs that wrote none stay."""
    return reports.join(history, "run_id", "left")


def sequence_of_steps(history: DataFrame) -> DataFrame:
    """Each event's status in its run: after the first failure later steps are skipped, never left out."""
    w = Window.partitionBy("run_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.col("outcome") == "failed").over(w)
    return history.select("run_id", "sequence", "package_id", F.when(F.coalesce(failed, F.lit(False)), F.lit("skipped")).otherwise(F.col("outcome")).alias("status"))
