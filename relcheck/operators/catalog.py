"""Catalog snapshots, ownership and access.

A snapshot holds one row a column: db, schema_name, relation, kind, column_name, column_type, owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .relations import materialise, written

# Relation kinds of each object type, and the privileges of each object type.
KINDS = {"table": ("r", "p"), "view": ("v", "m"), "sequence": ("S",)}
PRIVILEGES = {
    "table": ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN"),
    "schema": ("CREATE", "USAGE"),
    "function": ("EXECUTE",),
}
_NAME = ["db", "schema_name", "relation"]


def _objects(snapshot: DataFrame, kind: str) -> DataFrame:
    return snapshot.where(F.col("kind").isin(*KINDS[kind])).select(*_NAME).distinct()


def objects_present(snapshot: DataFrame, expected: DataFrame, kind: str = "table") -> DataFrame:
    """G1: expected objects (db, schema_name, relation) that the snapshot lacks."""
    return expected.select(*_NAME).distinct().join(_objects(snapshot, kind), _NAME, "left_anti")


def objects_absent(snapshot: DataFrame, unexpected: DataFrame, kind: str = "table") -> DataFrame:
    """Objects that should not exist and do."""
    return unexpected.select(*_NAME).distinct().join(_objects(snapshot, kind), _NAME, "left_semi")


def resolve_visible(snapshot: DataFrame, names: DataFrame, search_path: DataFrame) -> DataFrame:
    """Each (db, relation) to the first schema of the db's search path (db, schema_name, place) that has it; null if none has."""
    on_path = snapshot.select(*_NAME).distinct().join(search_path, ["db", "schema_name"])
    first = on_path.groupBy("db", "relation").agg(F.min_by("schema_name", "place").alias("schema_name"))
    return names.select("db", "relation").distinct().join(first, ["db", "relation"], "left")


def layouts(snapshot: DataFrame, order_by: str = "column_name") -> DataFrame:
    """Each relation's ordered `name:type` list."""
    entry = F.struct(F.col(order_by).alias("at"), F.concat_ws(":", "column_name", "column_type").alias("entry"))
    return snapshot.groupBy(*_NAME).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]).alias("layout"))


def layout_matches(snapshot: DataFrame, expected: DataFrame, order_by: str = "column_name") -> DataFrame:
    """Whether each expected (db, schema_name, relation, layout) is there with just that layout."""
    want = expected.select(*_NAME, F.col("layout").alias("want"))
    both = want.join(layouts(snapshot, order_by), _NAME, "left")
    return both.select(*_NAME, F.coalesce(F.col("layout") == F.col("want"), F.lit(False)).alias("passed"))


def relations_having_all(snapshot: DataFrame, columns: list[str]) -> DataFrame:
    """Relations that have every one of the columns."""
    met = snapshot.where(F.col("column_name").isin(*columns)).groupBy(*_NAME).agg(F.count_distinct("column_name").alias("n"))
    return met.where(F.col("n") == len(set(columns))).select(*_NAME)


def membership_closure(memberships: DataFrame) -> DataFrame:
    """(role, member_of): all roles that a role is a member of, directly or not, and itself."""
    direct = memberships.select("role", "member_of").distinct()
    roles = direct.select("role").union(direct.select("member_of")).distinct()
    frontier = materialise(roles.select("role", F.col("role").alias("member_of"))).toDF("role", "member_of")
    seen = frontier
    step = direct.select(F.col("role").alias("via"), F.col("member_of").alias("next"))
    while True:
        further = frontier.join(step, frontier.member_of == step.via).select("role", F.col("next").alias("member_of")).distinct()
        frontier = materialise(further.join(seen, ["role", "member_of"], "left_anti")).toDF("role", "member_of")
        if frontier.isEmpty():
            return seen
        seen = materialise(seen.union(frontier)).toDF("role", "member_of")


def effective_privileges(grants: DataFrame, memberships: DataFrame, kind: str = "table", asked: DataFrame | None = None, broadcast_roles: int = 1_000_000) -> DataFrame:
    """(object, role, privileges): what each role holds on an object directly, by membership and as PUBLIC, sorted.

    grants: object, grantee, privilege; only privileges that the kind of object knows count. Every role that a grant
    or a membership names has a row for every object where it holds anything, and so has PUBLIC itself. A caller who
    asks for pairs (object, role), of any roles, gets what PUBLIC holds for these and for the pairs that hold something
    by themselves or a membership, instead of for every role. Privileges are bits until the end.
    """
    names = sorted(PRIVILEGES[kind])
    bit = F.element_at(F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i)))), F.col("privilege"))
    known = written(grants.where(F.col("privilege").isin(*names)).groupBy("object", "grantee").agg(F.bit_or(bit).alias("bits")))
    public = known.where("grantee = 'PUBLIC'").select("object", "bits")
    own = known.where("grantee <> 'PUBLIC'").select("object", F.col("grantee").alias("role"), "bits")
    inherited = own.withColumnRenamed("role", "member_of").join(membership_closure(memberships), "member_of").select("object", "role", "bits")
    held = own.union(inherited)
    if asked is None:
        named = grants.where("grantee <> 'PUBLIC'").select(F.col("grantee").alias("role"))
        roles = written(named.union(memberships.select("role")).union(memberships.select("member_of")).distinct())
        if roles.count() <= broadcast_roles:
            roles = F.broadcast(roles)
        # each object meets each role, so few objects are dealt out too
        tasks = int(grants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shared = written(public).repartition(tasks).crossJoin(roles)
    else:
        shared = held.select("object", "role").union(asked.select("object", "role")).distinct().join(public, "object")
    every = held.union(shared.select("object", "role", "bits")).union(public.select("object", F.lit("PUBLIC"), "bits"))
    listed = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names))))
    return every.groupBy("object", "role").agg(F.bit_or("bits").alias("bits")).select("object", "role", listed.alias("privileges"))


def privs_are(effective: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (object, role) of either side: passed, have, want, missing and unexpected, all sorted."""
    none = F.array().cast("array<string>")
    both = effective.select("object", "role", F.col("privileges").alias("have")).join(expected.select("object", "role", F.array_sort(F.array_distinct("privileges")).alias("want")), ["object", "role"], "full")
    sides = both.select("object", "role", F.coalesce("have", none).alias("have"), F.coalesce("want", none).alias("want"))
    out = sides.withColumns({"missing": F.array_sort(F.array_except("want", "have")), "unexpected": F.array_sort(F.array_except("have", "want"))})
    return out.withColumn("passed", (F.size("missing") == 0) & (F.size("unexpected") == 0))


def owner_is(snapshot: DataFrame, expected: DataFrame) -> DataFrame:
    """The owner of each expected (db, schema_name, relation, owner); an absent object fails with a null owner."""
    found = snapshot.groupBy(*_NAME).agg(F.min("owner").alias("have"))
    want = expected.select(*_NAME, F.col("owner").alias("want")).distinct()
    return want.join(found, _NAME, "left").withColumn("passed", F.coalesce(F.col("have") == F.col("want"), F.lit(False)))


def roles_with_any(memberships: DataFrame, privileged: list[str]) -> DataFrame:
    """Roles that are, or are members of, any of the privileged roles, directly or not.

    Walks down from the privileged ones, so other roles' memberships are never followed; a privileged role that has no membership at all is not listed.
    """
    direct = written(memberships.select("role", "member_of").distinct())
    there = direct.select("role").union(direct.select(F.col("member_of").alias("role"))).distinct()
    frontier = written(there.where(F.col("role").isin(*privileged)))
    found = frontier
    while not frontier.isEmpty():
        below = direct.join(frontier.select(F.col("role").alias("member_of")), "member_of", "left_semi").select("role").distinct()
        frontier = written(below.join(found, "role", "left_anti"))
        found = written(found.union(frontier))
    return found
