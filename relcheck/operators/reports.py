"""Findings, policy, reports and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import human_duration
from .scans import MOST_ROWS, dealt, running

# Error codes and their exit codes; any other code is 70.
EXIT_CODES = {
    3: ("config.not_found", "config.invalid", "config.unsupported_format_version", "target.unknown", "target.invalid", "project.already_exists", "selector.matched_nothing", "io.error"),
    4: ("manifest.invalid", "manifest.unsupported_format_version", "migration.missing_script", "migration.directory_mismatch", "migration.duplicate_id", "migration.unknown_dependency", "migration.reversibility_invalid", "migration.id_invalid", "graph.cycle", "graph.self_dependency", "script.parse_error", "script.transaction_control", "script.statement_count", "script.empty", "execution.mode_unsupported", "lint.failed"),
    5: ("history.migration_missing", "history.definition_changed", "history.dependencies_changed"),
    6: ("lock.unavailable",),
    7: ("target.connection_failed", "target.server_unsupported"),
    8: ("registry.format_too_new", "registry.project_mismatch", "registry.not_initialized", "registry.upgrade_failed", "registry.blocked", "resolve.nothing_to_resolve"),
    9: ("deploy.failed", "verify.failed", "revert.failed", "deploy.outcome_unknown"),
}


def apply_policy(findings: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """Severity of each finding: note if its package allows the code (first entry), else error if denied, else warning.

    findings: package_id, ordinal, code and, where known, message and hint; allow: package_id, place, code,
    reason; deny: code. An accepted finding's message tells the reason and its hint goes.
    """
    first = allow.groupBy("package_id", "code").agg(F.min_by("reason", "place").alias("reason"))
    denied = deny.select("code").distinct().withColumn("denied", F.lit(True))
    both = findings.join(first, ["package_id", "code"], "left").join(denied, "code", "left")
    accepted = F.col("reason").isNotNull()
    severity = F.when(accepted, F.lit("note")).when(F.col("denied"), F.lit("error")).otherwise(F.lit("warning"))
    message = F.col("message") if "message" in findings.columns else F.col("code")
    hint = F.col("hint") if "hint" in findings.columns else F.lit(None).cast("string")
    return both.select("package_id", "ordinal", "code", severity.alias("severity"), F.when(accepted, F.concat(message, F.lit(" (accepted: "), "reason", F.lit(")"))).otherwise(message).alias("message"), F.when(~accepted, hint).alias("hint"))


def promoted_errors(judged: DataFrame, by: str = "package_id") -> DataFrame:
    """Denied findings as errors lint.failed that name the rule; is_first marks each group's first one."""
    errors = judged.where("severity = 'error'")
    first = errors.groupBy(by).agg(F.min("ordinal").alias("__first"))
    return errors.join(first, by).select(by, "ordinal", F.lit("lint.failed").alias("error"), F.col("code").alias("lint"), "message", (F.col("ordinal") == F.col("__first")).alias("is_first"))


def unknown_denials(deny: DataFrame, rules: DataFrame) -> DataFrame:
    """Denied codes that no rule has."""
    return deny.select("code").distinct().join(rules.select("code"), "code", "left_anti")


def risk_counts(judged: DataFrame) -> DataFrame:
    """Findings by severity and rule with subtotals (null: all)."""
    return judged.rollup("severity", "code").agg(F.count("*").alias("n"), F.count_distinct("package_id").alias("packages"))


def report_counts(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts of (action, status) for each report, as columns."""
    n = lambda a, s: F.count_if((F.col("action") == a) & (F.col("status") == s))
    return steps.groupBy(by).agg(n("deploy", "succeeded").alias("applied"), n("verify", "succeeded").alias("verified"), n("plan", "applied").alias("listed_applied"), n("plan", "pending").alias("listed_pending"), F.count_if(F.col("status") == "failed").alias("failed"))


def report_summary(reports: DataFrame) -> DataFrame:
    """One row a parsed report: its counts and the closing line."""
    r = F.col("report")
    def count(array, test):
        return F.coalesce(F.size(F.filter(array, test)), F.lit(0))

    step = lambda a, s: count(r["migrations"], lambda m: (m["action"] == a) & (m["status"] == s))
    facts = reports.select(
        r["run"]["id"].alias("run_id"), r["run"]["command"].alias("command"), r["outcome"].alias("outcome"), r["run"]["duration_ms"].alias("duration_ms"),
        step("deploy", "succeeded").alias("applied"), step("verify", "succeeded").alias("verified"), step("plan", "applied").alias("listed_applied"), step("plan", "pending").alias("listed_pending"),
        count(r["tests"], lambda t: F.lit(True)).alias("tests"), count(r["tests"], lambda t: t["status"] == "succeeded").alias("tests_passed"), count(r["diagnostics"], lambda x: x["severity"] == "warning").alias("warnings"),
    )
    text = lambda c: F.col(c).cast("string")
    plural = lambda c, word: F.when(F.col(c) == 1, F.lit(word)).otherwise(F.lit(word + "s"))
    parts = F.array_compact(F.array(
        F.when(F.col("applied") > 0, F.concat(text("applied"), F.lit(" "), plural("applied", "migration"), F.lit(" applied"))),
        F.when(F.col("verified") > 0, F.concat(text("verified"), F.lit(" verified"))),
        F.when(F.col("listed_applied") > 0, F.concat(text("listed_applied"), F.lit(" applied"))),
        F.when(F.col("listed_pending") > 0, F.when(F.col("command") == "deploy", F.concat(text("listed_pending"), F.lit(" "), plural("listed_pending", "migration"), F.lit(" planned"))).otherwise(F.concat(text("listed_pending"), F.lit(" pending")))),
        F.when(F.col("tests") > 0, F.concat(text("tests_passed"), F.lit("/"), text("tests"), F.lit(" test files passed"))),
        F.when(F.col("warnings") > 0, F.concat(text("warnings"), F.lit(" "), plural("warnings", "warning"))),
    ))
    idle = F.when(F.col("command") == "init", F.lit("Initialized project")).when(F.col("command") == "new", F.lit("Created migration")).when(F.col("command") == "lint", F.lit("No problems found")).otherwise(F.lit("Nothing to do"))
    said = F.array_join("parts", ", ")
    none = F.size("parts") == 0
    ok = F.col("outcome") == "success"
    line = F.when(ok & none, idle).when(ok, F.concat(F.lit("Done: "), said)).when(none, F.lit("Failed")).otherwise(F.concat(F.lit("Failed after "), said))
    return facts.withColumn("parts", parts).withColumn("summary", F.concat(line, F.lit(" in "), human_duration(F.col("duration_ms")))).drop("parts")


def unshown_errors(reports: DataFrame) -> DataFrame:
    """Report errors that no package, script or test shows already (same code and message)."""
    r, error = F.col("report"), F.col("report.error")
    same = lambda e: F.coalesce((e["code"] == error["code"]) & (e["message"] == error["message"]), F.lit(False))
    at_package = F.exists(r["migrations"], lambda m: same(m["error"]) | F.coalesce(F.exists(m["scripts"], lambda s: same(s["error"])), F.lit(False)))
    shown = F.coalesce(at_package, F.lit(False)) | F.coalesce(F.exists(r["tests"], lambda t: same(t["error"])), F.lit(False))
    return reports.where(error.isNotNull() & ~shown).select(r["run"]["id"].alias("run_id"), error["code"].alias("code"), error["message"].alias("message"))


def flatten_reports(reports: DataFrame) -> dict[str, DataFrame]:
    """Packages, scripts, assertions and diagnostics as flat tables, keyed by run_id."""
    r = F.col("report")
    run = r["run"]["id"].alias("run_id")
    packages = reports.select(run, F.explode("report.migrations").alias("m")).select("run_id", "m.id", "m.slug", "m.action", "m.status", "m.definition_sha256", "m.duration_ms", F.col("m.error.code").alias("error_code"))
    scripts = reports.select(run, F.explode("report.migrations").alias("m")).select("run_id", F.col("m.id").alias("id"), F.explode("m.scripts").alias("s")).select("run_id", "id", "s.role", "s.path", "s.sha256", "s.status", F.col("s.error.code").alias("error_code"))
    assertions = reports.select(run, F.explode("report.tests").alias("t")).select("run_id", F.col("t.path").alias("path"), F.explode("t.assertions").alias("a")).select("run_id", "path", "a.number", "a.description", "a.status", "a.directive_reason", "a.diagnostics")
    diagnostics = reports.select(run, F.posexplode("report.diagnostics").alias("place", "d")).select("run_id", "place", "d.severity", "d.code", "d.message", "d.migration_id")
    return {"packages": packages, "scripts": scripts, "assertions": assertions, "diagnostics": diagnostics}


def redact_reports(reports: DataFrame) -> DataFrame:
    """Run-varying fields by placeholders and package ids by their slugs; hashes stay."""
    r = F.col("report")
    hide = lambda s, *names: _with(s, {n: F.lit(f"[{n}]") for n in names})
    run = _with(hide(r["run"], "id", "started_at", "finished_at"), {"duration_ms": F.lit(0).cast("bigint")})
    target = F.when(r["target"].isNotNull(), hide(r["target"], "database", "server_version"))
    zero = F.lit(0).cast("bigint")
    scripts = lambda m: F.transform(m["scripts"], lambda s: _with(s, {"duration_ms": zero}))
    packages = F.transform(r["migrations"], lambda m: _with(m, {"id": F.concat(F.lit("[id of "), m["slug"], F.lit("]")), "duration_ms": zero, "scripts": scripts(m)}))
    tests = F.transform(r["tests"], lambda t: _with(t, {"duration_ms": zero}))
    return reports.withColumn("report", _with(r, {"run": run, "target": target, "migrations": packages, "tests": tests}))


def _with(column: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        column = column.withField(name, value)
    return column


def diff_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Redacted reports that one side has more often than the other, as JSON with both counts."""
    def side(df, have, want):
        return redact_reports(df).select(F.to_json("report").alias("report"), F.lit(have).alias("a"), F.lit(want).alias("b"))

    counted = side(a, 1, 0).union(side(b, 0, 1)).groupBy("report").agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"))
    return counted.where("in_a <> in_b")


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """(path, value as text) of every value within a column that isn't null: `a.b`, `a[0]`, and `a.key` of a map."""
    none = F.array().cast("array<struct<path:string, value:string>>")
    within = lambda name: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), name)
    if isinstance(kind, T.StructType):
        found = F.concat(*(_leaves(value.getField(f.name), f.dataType, within(F.lit(f.name))) for f in kind.fields))
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    elif isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, within(e["key"]))))
    else:
        found = F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))
    return F.when(value.isNotNull(), found).otherwise(none)


def diff_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """(run_id, path, was, now): the fields of redacted reports of one run that differ between a and b, wherever they stand.

    was and now are the sorted values that one side has more often: one where a run has one report, none where
    a side lacks the field or the run. Reports become (path, value) rows in one pass, which are counted within tasks before one shuffle.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        run = df.withColumn("run_id", F.col("report.run.id"))
        redacted = redact_reports(run)
        each = F.explode(_leaves(F.col("report"), redacted.schema["report"].dataType, F.lit(""))).alias("leaf")
        return redacted.select("run_id", each).select("run_id", "leaf.path", "leaf.value", F.lit(sign).alias("n"))

    counted = side(a, 1).union(side(b, -1)).groupBy("run_id", "path", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    more = lambda sign: F.array_sort(F.flatten(F.collect_list(F.when(F.col("n") * sign > 0, F.array_repeat("value", F.abs("n").cast("int"))))))
    return counted.groupBy("run_id", "path").agg(more(1).alias("was"), more(-1).alias("now"))


def exit_code_of(code: Column) -> Column:
    """The exit code of an error code: 0 for none, 70 for one that is not known."""
    out = F.when(code.isNull(), F.lit(0))
    for number, codes in EXIT_CODES.items():
        out = out.when(code.isin(*codes), F.lit(number))
    return out.otherwise(F.lit(70))


def over_budget(metrics: DataFrame, budgets: dict[str, float], keys: list[str]) -> DataFrame:
    """One row for each measure of a row above its limit."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("budget")) for m, b in budgets.items())))
    return metrics.select(*keys, each.alias("e")).select(*keys, "e.*").where("value > budget")


def rank_percentile(metrics: DataFrame, value: str, percents: list[int], by: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """sorted[(n - 1) * p / 100], rounded down; never between two values.

    Values are counted first, so a group's task sees its distinct values, not its rows; more than `most_rows` of them are dealt over tasks.
    """
    counts = metrics.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running(dealt(counts, by, [value], most_rows), by, [value], upto=("sum", F.col("n")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("rows"))
    wanted = total.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("place", F.floor((F.col("rows") - 1) * F.col("p") / 100))
    hit = ranked.join(wanted, by).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return hit.select(*by, "p", F.col(value).alias("value"))


def top_n(metrics: DataFrame, value: str, keys: list[str], n: int = 10) -> DataFrame:
    """The n rows with the largest value; ties by the keys."""
    return metrics.select(*keys, value).orderBy(F.desc(value), *keys).limit(n)


def totals(metrics: DataFrame, value: str, key: str, by: list[str]) -> DataFrame:
    """Rows, sum, maximum and the key of the largest row (the greatest key of equals) for each group."""
    return metrics.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.max_by(key, F.struct(value, key)).alias("largest_key"))
