"""Dependency graphs, many at once, keyed by project.

Edges are (project, child, parent): child depends on parent. Nodes are (project, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .relations import written
from .scans import dealt, running

KEY = ["project", "id"]

#: Parts that a loop gathers before they are written as one, so that no plan grows with the rounds.
MOST_PARTS = 16


def edges_of(nodes: DataFrame) -> DataFrame:
    """H1: (project, child, parent) of nodes with a `depends` array."""
    return nodes.select("project", F.col("id").alias("child"), F.explode("depends").alias("parent"))


def adjacency(edges: DataFrame) -> DataFrame:
    """H1: each parent's direct dependents, sorted."""
    return edges.groupBy("project", F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("child")).alias("dependents"))


def unknown_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H2: edges to ids that the project doesn't have."""
    known = nodes.select("project", F.col("id").alias("parent"))
    return edges.join(known, ["project", "parent"], "left_anti").select("project", "child", "parent").distinct()


def invalid_edges(edges: DataFrame) -> DataFrame:
    """H3: self dependencies and edges listed more than once, with a reason."""
    counted = edges.groupBy("project", "child", "parent").agg(F.count("*").alias("n"))
    both = F.array_compact(F.array(F.when(F.col("child") == F.col("parent"), F.lit("self")), F.when(F.col("n") > 1, F.lit("duplicate"))))
    return counted.select("project", "child", "parent", F.explode(both).alias("reason"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """H3: ids claimed by more than one node of a project."""
    return nodes.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def heads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H4: nodes that nothing depends on."""
    return nodes.select(*KEY).join(edges.select("project", F.col("parent").alias("id")), KEY, "left_anti")


def dependents_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """H5: the direct dependents of each (project, id)."""
    wanted = ids.select("project", F.col("id").alias("parent")).distinct()
    return edges.join(wanted, ["project", "parent"]).select("project", "parent", "child").distinct()


def _gathered(parts: list[DataFrame], part: DataFrame) -> list[DataFrame]:
    """The parts and one more; written as one where there are too many."""
    parts = [*parts, part]
    return [written(reduce(DataFrame.union, parts))] if len(parts) > MOST_PARTS else parts


def _known_edges(known: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select("project", "child", "parent").distinct().join(known.withColumnRenamed("id", "parent"), ["project", "parent"], "left_semi")


def _rooted(singles: DataFrame) -> DataFrame:
    """singles (project, id, up, w: each waits for `up` alone, w levels below) with `up` at the end of each run of them.

    Pointers double, so rounds grow with the logarithm of the longest run. What goes round in a ring, or hangs
    on one, is left out.
    """
    bound = singles.count().bit_length()
    for _ in range(bound + 1):
        on = singles.select("project", F.col("id").alias("up"), F.col("up").alias("further"), F.col("w").alias("more"))
        moved = F.col("further").isNotNull().alias("moved")
        both = written(singles.join(on, ["project", "up"], "left").select(*KEY, F.coalesce("further", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), moved))
        singles = both.drop("moved")
        if both.where("moved").isEmpty():
            return singles
    return written(singles.join(singles.select("project", F.col("id").alias("up")), ["project", "up"], "left_anti").select(*singles.columns))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H6: (project, id, level): the longest path down to a node without known dependencies; null on or behind a cycle.

    Ordering by (level, id) respects every edge. A node that waits for one other alone is so many levels above it, whatever
    else there is, so runs of such nodes are contracted first: edges go to the runs' ends and
    carry their lengths. That is repeated as long as it pays, since diamonds become runs. Then all
    ready nodes of all projects are peeled in a round, and each round moves only edges whose parents have just been
    placed. Rounds are as many as junctions follow each other, and the logarithm of the longest run.
    """
    known = nodes.select(*KEY).distinct()
    kept, aside = known, []
    left = written(_known_edges(known, edges).withColumn("w", F.lit(1)))
    while True:
        counted = written(left.groupBy("project", F.col("child").alias("id")).agg(F.count("*").alias("waits"), F.min("parent").alias("up"), F.max("w").alias("w")))
        waiting, singles = counted.agg(F.count("*"), F.count_if(F.col("waits") == 1)).first()
        if not singles or aside and singles * 8 < waiting:
            break
        alone = counted.where("waits = 1").select(*KEY, "up", "w")
        aside.append(_rooted(alone))
        kept = kept.join(alone, KEY, "left_anti")
        ends = aside[-1].select("project", F.col("id").alias("parent"), "up", F.col("w").alias("more"))
        on = left.join(counted.where("waits > 1").select("project", F.col("id").alias("child")), ["project", "child"], "left_semi").join(ends, ["project", "parent"], "left")
        onto = on.select("project", "child", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        left = written(onto.groupBy("project", "child", "parent").agg(F.max("w").alias("w")))

    start = kept.join(counted, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("waits"), F.lit(0).alias("level"))
    state = written(start.union(counted.select(*KEY, "waits", F.lit(0))))
    placed: list[DataFrame] = []
    while True:
        ready = state.where("waits = 0")
        if ready.isEmpty():
            break
        placed = _gathered(placed, ready.select(*KEY, "level"))
        sent = left.join(ready.select("project", F.col("id").alias("parent"), "level"), ["project", "parent"]).groupBy("project", F.col("child").alias("id")).agg(F.count("*").alias("freed"), F.max(F.col("level") + F.col("w")).alias("at"))
        state = written(state.where("waits > 0").join(sent, KEY, "left").select(*KEY, (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits"), F.greatest("level", "at").alias("level")))
    if not placed:
        return known.withColumn("level", F.lit(None).cast("int"))
    levels = reduce(DataFrame.union, placed)
    for ends in reversed(aside):
        levels = levels.union(ends.join(levels.select("project", F.col("id").alias("up"), "level"), ["project", "up"]).select(*KEY, (F.col("level") + F.col("w")).alias("level")))
    return known.join(levels, KEY, "left")


def _lifts(up: DataFrame) -> list[DataFrame]:
    """For paths along (project, id, up): tables of the ids 1, 2, 4, ... steps on, as long as there are any.

    `top` is the greatest of the ids that are passed, the first included. A path ends at an id that has no row.
    """
    tables = [written(up.select(*KEY, "up", F.col("id").alias("top")))]
    while not tables[-1].isEmpty():
        on = tables[-1].select("project", F.col("id").alias("up"), F.col("up").alias("further"), F.col("top").alias("more"))
        tables.append(written(tables[-1].join(on, ["project", "up"]).select(*KEY, F.col("further").alias("up"), F.greatest("top", "more").alias("top"))))
    return tables[:-1]


def _greater_on_runs(singles: DataFrame) -> DataFrame:
    """(project, id, ahead, root) of singles (project, id, up): the nearest greater id on the run up from each; where there is none, the run's end.

    Binary search on doubled steps: a step is taken where all ids that it passes are less.
    """
    at = singles.select(*KEY, F.col("up").alias("at"))
    for k, table in enumerate(reversed(_lifts(singles))):
        step = table.select("project", F.col("id").alias("at"), "up", "top")
        at = at.join(step, ["project", "at"], "left").select(*KEY, F.when(F.col("top") < F.col("id"), F.col("up")).otherwise(F.col("at")).alias("at"))
        at = written(at) if k % 4 == 3 else at
    inside = singles.select("project", F.col("id").alias("at"), F.lit(True).alias("inside"))
    return written(at.join(inside, ["project", "at"], "left").select(*KEY, F.when(F.col("inside"), F.col("at")).alias("ahead"), F.when(F.col("inside").isNull(), F.col("at")).alias("root")))


def _tails(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, id, root, tail) of asked ids within runs: the run's end, and the ids from there to the id that are greater than all after them."""
    pairs = asked.select(*KEY, F.col("id").alias("member"))
    for table in _lifts(runs.where("ahead IS NOT NULL").select(*KEY, F.col("ahead").alias("up"))):
        further = pairs.join(table.select("project", F.col("id").alias("member"), "up"), ["project", "member"]).select(*KEY, F.col("up").alias("member"))
        pairs = written(pairs.union(further))
    tails = pairs.groupBy(*KEY).agg(F.sort_array(F.collect_list("member"), asc=False).alias("tail"), F.max("member").alias("first"))
    return tails.join(runs.select("project", F.col("id").alias("first"), "root"), ["project", "first"]).select(*KEY, "root", "tail")


def _leaders(here: DataFrame, inner: DataFrame) -> DataFrame:
    """(project, id, ahead): of a node's path, the nearest id that is greater; null if there is none.

    The path of a node goes through the dependency that is deployed last. Of several dependencies that is the
    one with the greatest list of leaders, the node's own id being the last of its list, and lists fall. So only
    junctions, which have several dependencies, are followed in rounds; runs of nodes with one dependency are searched by doubled steps.
    """
    counted = written(inner.groupBy("project", F.col("child").alias("id")).agg(F.count("*").alias("waits"), F.min("parent").alias("up")))
    singles = written(counted.where("waits = 1").select(*KEY, "up"))
    runs = _greater_on_runs(singles)
    junctions = counted.where("waits > 1").select(*KEY, "waits")
    links = inner.join(junctions.select("project", F.col("id").alias("child")), ["project", "child"], "left_semi")
    asked = links.select("project", F.col("parent").alias("id")).distinct().join(singles.select(*KEY), KEY, "left_semi")
    none = F.array().cast(f"array<{dict(here.dtypes)['id']}>")
    tails = _tails(asked, runs).select("project", F.col("id").alias("parent"), "root", "tail")
    links = written(links.join(tails, ["project", "parent"], "left").select("project", "child", F.coalesce("root", "parent").alias("base"), F.coalesce("tail", none).alias("tail")))
    sources = here.join(counted, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("waits"), none.alias("most"))
    state = written(sources.union(junctions.select(*KEY, "waits", none)))
    led = lambda c: F.filter(c, lambda x: x > F.col("id"))
    lists: list[DataFrame] = []
    while True:
        ready = state.where("waits = 0")
        if ready.isEmpty():
            break
        now = ready.select(*KEY, F.concat(led("most"), F.array("id")).alias("list"))
        lists = _gathered(lists, now)
        whole = F.when(F.size("tail") == 0, F.col("list")).otherwise(F.concat(F.filter("list", lambda x: x > F.element_at("tail", 1)), F.col("tail")))
        sent = links.join(now.select("project", F.col("id").alias("base"), "list"), ["project", "base"]).groupBy("project", F.col("child").alias("id")).agg(F.count("*").alias("freed"), F.max(whole).alias("sent"))
        state = written(state.where("waits > 0").join(sent, KEY, "left").select(*KEY, (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits"), F.greatest("most", "sent").alias("most")))
    every = reduce(DataFrame.union, lists) if lists else here.limit(0).select(*KEY, none.alias("list"))
    last = lambda c: F.element_at(c, -1)
    own = every.select(*KEY, F.try_element_at("list", F.lit(-2)).alias("ahead"))
    ends = runs.where("ahead IS NULL").join(every.select("project", F.col("id").alias("root"), "list"), ["project", "root"])
    above = ends.withColumn("over", led("list")).select(*KEY, F.when(F.size("over") > 0, last("over")).alias("ahead"))
    return own.union(above).union(runs.where("ahead IS NOT NULL").select(*KEY, "ahead"))


def deployment_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H7: (project, id, position): of all ready nodes the least id goes next.

    A node that has become ready goes before all greater ones, so it follows its leader, the nearest greater id on its
    path (see _leaders), and all of what smaller nodes led by that one lead. The order is thus the
    leaders' forest, depth first, the children of a leader by id: a node comes after its leader and all that the
    leader's smaller children lead. How many each leads, and the sums along its leaders, are found by doubled
    steps; the children of one leader (and those that have none) are summed in their order however many they are. Rounds grow with the
    junctions that follow each other and with logarithms; no task sees a whole project. Nodes on or behind a cycle have no position.
    """
    here = written(topological_levels(nodes, edges).where("level IS NOT NULL").select(*KEY))
    inner = written(_known_edges(here, edges).join(here.withColumnRenamed("id", "child"), ["project", "child"], "left_semi"))
    led = written(_leaders(here, inner))
    lifts = _lifts(led.where("ahead IS NOT NULL").select(*KEY, F.col("ahead").alias("up")))
    sizes = led.select(*KEY, "ahead", F.lit(1).cast("long").alias("size"))
    for table in lifts:
        below = table.join(sizes.select(*KEY, "size"), KEY).groupBy("project", F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        sizes = written(sizes.join(below, KEY, "left").select(*KEY, "ahead", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    by = ["project", "ahead"]
    at = running(dealt(sizes, by, ["id"]), by, ["id"], upto=("sum", F.col("size"))).select(*KEY, (F.col("upto") - F.col("size") + 1).alias("position"))
    for table in lifts:
        at = written(at)
        before = table.select(*KEY, "up").join(at.select("project", F.col("id").alias("up"), F.col("position").alias("more")), ["project", "up"]).select(*KEY, "more")
        at = at.join(before, KEY, "left").select(*KEY, (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"))
    return at


def closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """H8: (project, target, id): every target with all it depends on, directly or not, once each.

    A frontier moves one edge a round and never visits a pair twice, so diamonds cost nothing extra.
    """
    steps = edges.select("project", F.col("child").alias("id"), "parent").distinct()
    frontier = written(targets.select("project", F.col("id").alias("target"), "id").distinct())
    seen = frontier
    while True:
        step = frontier.join(steps, KEY).select("project", "target", F.col("parent").alias("id")).distinct()
        frontier = written(step.join(seen, ["project", "target", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = written(seen.union(frontier))


def closure_of(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """H8: the closure with each id's deployment position."""
    return closure(edges, targets).join(deployment_order(nodes, edges), KEY, "left")


def stuck_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H9: nodes on a cycle or behind one."""
    return topological_levels(nodes, edges).where("level IS NULL").select(*KEY)


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H9: (project, stuck, cycle): for each project with stuck nodes their number and one cycle's ids.

    The cycle starts at its least id, and each of its nodes depends on the next one. It is the one that is
    met from the least stuck id by always taking the least stuck dependency. Such walks go by doubled steps:
    a join gives the node 2, 4, 8, ... steps on for all nodes at once, so rounds grow with the logarithm of
    a project's stuck nodes, and no task follows a walk.
    """
    stuck = written(stuck_nodes(nodes, edges))
    inner = _known_edges(stuck, edges).join(stuck.withColumnRenamed("id", "child"), ["project", "child"], "left_semi")
    # any stuck node has a stuck dependency, so following the least one must come round
    jumps = [written(inner.groupBy("project", F.col("child").alias("id")).agg(F.min("parent").alias("next")))]
    start = written(jumps[0].groupBy("project").agg(F.min("id").alias("id"), F.count("*").alias("stuck")))
    most = start.agg(F.max("stuck")).first()[0] or 0
    for _ in range(most.bit_length()):
        on = jumps[-1].select("project", F.col("id").alias("next"), F.col("next").alias("further"))
        jumps.append(written(jumps[-1].join(on, ["project", "next"]).select(*KEY, F.col("further").alias("next"))))
    # as many steps as there are nodes lead onto the cycle, and as many again go round it
    ring = written(start.join(jumps[-1], KEY).select("project", F.col("next").alias("id"), F.lit(0).cast("long").alias("step")))
    for k, jump in enumerate(jumps):
        further = ring.join(jump, KEY).select("project", F.col("next").alias("id"), F.col("step") + (1 << k))
        ring = written(ring.union(further).groupBy(*KEY).agg(F.min("step").alias("step")))
    turn = ring.groupBy("project").agg(F.count("*").alias("n"), F.min_by("step", "id").alias("turn"))
    placed = ring.join(turn, "project").select("project", F.struct(((F.col("step") - F.col("turn") + F.col("n")) % F.col("n")).alias("at"), "id").alias("node"))
    found = placed.groupBy("project").agg(F.transform(F.sort_array(F.collect_list("node")), lambda x: x["id"]).alias("cycle"))
    kind = nodes.schema["project"].dataType
    return start.join(found, "project").select(F.col("project").cast(kind).alias("project"), "stuck", "cycle")


def below_head(nodes: DataFrame, edges: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested dependencies (project, id) that exist but are not heads; each once."""
    asked = requested.select(*KEY).distinct().join(nodes.select(*KEY), KEY, "left_semi")
    return asked.join(heads(nodes, edges), KEY, "left_anti")
