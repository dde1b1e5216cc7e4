"""Configurations of a duplication and loss history: which ortholog group each position of a joint state holds at each node."""

from __future__ import annotations

from itertools import combinations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, release
from ..sources.newick import Tree, node_kind

#: A configuration: for each position its ortholog group and whether that is alive (1) or lost (0).
Configuration = tuple[tuple[int, int], ...]


def runs(positions: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for p in sorted(positions):
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def divide(conf: Configuration) -> dict[str, object]:
    """extent (positions of each group alive), distinct (positions of lost groups) and loc (groups alive, by first position)."""
    extent: dict[int, list[int]] = {}
    for pos, (orlg, alive) in enumerate(conf):
        if alive:
            extent.setdefault(orlg, []).append(pos)
    return {"extent": extent, "distinct": [p for p, (_, alive) in enumerate(conf) if not alive], "loc": list(extent)}


def accessible_pairs(confs: list[Configuration]) -> list[tuple[int, int]]:
    """Pairs of groups, a < b, that are alive together in some configuration."""
    return sorted({(a, b) for c in confs for a in divide(c)["loc"] for b in divide(c)["loc"] if a < b})


def configurations(tree: Tree, event_group: dict[str, int]) -> dict[str, Configuration]:
    """The configuration below each node, in the smallest joint state that can hold the history.

    ``event_group`` names the place of a duplication or loss: the position, counted among the groups alive just above it,
    (by their first positions) of the group that it duplicates or loses. Nodes are visited depth first; a duplication of
    group o gives the next two numbers. Where o holds one position, a position is put in behind it; where it holds up to
    three, those are shared out in every way. Of several smallest results the first counts.
    """
    need = {n for n in tree.nodes if node_kind(n) in ("duplication", "loss")}
    if need != set(event_group):
        raise ValueError(f"no place for {sorted(need - set(event_group))}; not in the tree: {sorted(set(event_group) - need)}")
    if not any(node_kind(n) == "duplication" for n in need):
        raise ValueError("a history needs a duplication")
    found: list[dict[str, Configuration]] = []

    def extend(todo: list[str], confs: dict[str, Configuration], top: int) -> None:
        if not todo:
            found.append(confs)
            return
        node, rest = todo[0], todo[1:]
        above = confs[tree.parent(node)] if tree.parent(node) is not None else ((0, 1),)
        kind = node_kind(node)
        if kind not in ("duplication", "loss"):
            extend(rest, confs | {node: above}, top)
            return
        groups = divide(above)["loc"]
        at = event_group[node]
        if at >= len(groups):
            raise ValueError(f"{node} is at group {at} of {len(groups)}")
        orlg = groups[at]
        places = divide(above)["extent"][orlg]
        if kind == "loss":
            extend(rest, confs | {node: tuple((o, 0 if o == orlg else a) for o, a in above)}, top)
            return
        a, b = top, top + 1
        if len(places) == 1:
            p = places[0]
            # a position more: every configuration so far gets a copy of this position beside it
            wider = {n: (*c[: p + 1], c[p], *c[p + 1 :]) for n, c in confs.items()}
            extend(rest, wider | {node: (*above[:p], (a, 1), (b, 1), *above[p + 1 :])}, top + 2)
            return
        if len(places) > 3:
            raise ValueError("a group of more than three positions cannot be duplicated")
        for first in (f for size in range(1, len(places)) for f in combinations(places, size)):
            given = {p: a if p in first else b for p in places}
            extend(rest, confs | {node: tuple((given.get(p, o), alive) for p, (o, alive) in enumerate(above))}, top + 2)

    extend(tree.depth_first(), {}, 1)
    best = min(range(len(found)), key=lambda k: (len(found[k][tree.root]), k))
    return found[best]


def without_root(tree: Tree, confs: dict[str, Configuration]) -> tuple[Tree, dict[str, Configuration]]:
    """The tree from its first duplication on, where a node ``Root`` was put above it."""
    if tree.root != "Root":
        return tree, confs
    below = tree.children("Root")
    if len(below) != 1:
        raise ValueError("Root needs one child")
    return Tree([e for e in tree.edges if e[0] != "Root"]), {n: c for n, c in confs.items() if n != "Root"}


def processes(tree: Tree, confs: dict[str, Configuration]) -> tuple[list[Configuration], dict[tuple[str, str], int]]:
    """The distinct configurations, sorted, and for each edge the number of that of its parent."""
    used = sorted({confs[p] for p, _ in tree.edges})
    return used, {(p, c): used.index(confs[p]) for p, c in tree.edges}


def configuration_relation(spark: SparkSession, confs: dict[str, Configuration]) -> DataFrame:
    """node, pos, orlg, alive."""
    return spark.createDataFrame([(n, p, o, a) for n, c in sorted(confs.items()) for p, (o, a) in enumerate(c)], "node string, pos int, orlg int, alive int")


def run_relation(rows: DataFrame, *by: str, place: str = "pos") -> DataFrame:
    """``by``, start, n: the runs of consecutive places of each group. Places that occur twice count once."""
    w = Window.partitionBy(*by).orderBy(place)
    island = rows.select(*by, place).distinct().withColumn("island", F.col(place) - F.row_number().over(w))
    return island.groupBy(*by, "island").agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("n")).drop("island")


def accessible_pair_relation(alive: DataFrame, *, within: str = "node", group: str = "orlg") -> DataFrame:
    """a, b, n: pairs of groups a < b that are alive together, and in how many nodes. A node's groups fit a row."""
    held = alive.groupBy(within).agg(F.array_sort(F.collect_set(group)).alias("held"))
    pairs = held.select(F.explode("held").alias("a"), "held").select("a", F.explode("held").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns with ``process``: 1, 2, ... in their order. As many rows as there are configurations."""
    return rows.select(*columns).distinct().withColumn("process", F.row_number().over(Window.orderBy(*columns)))


def edge_processes(edges: DataFrame, confs: DataFrame, *, parent: str = "parent", node: str = "node", conf: str = "conf") -> DataFrame:
    """edges with ``process``: the number of the configuration of each edge's parent."""
    of = confs.select(F.col(node).alias("__node"), conf).join(numbered(confs, conf), conf).drop(conf)
    return edges.join(of, F.col(parent) == F.col("__node")).drop("__node")


def changed(before: DataFrame, after: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The rows of ``before`` that ``after`` lacks: groups that end on an edge or, the other way round, begin there."""
    return before.join(after, on, "left_anti")


def group_changes(spark: SparkSession, tree: Tree, confs: dict[str, Configuration]) -> DataFrame:
    """parent, child, orlg, change: the groups that are ``gone`` or ``born`` on each edge."""
    rows = [(p, c, side, o) for p, c in tree.sorted_edges() for side, n in ((0, p), (1, c)) for o in divide(confs[n])["loc"]]
    held = spark.createDataFrame(rows, "parent string, child string, side int, orlg int")
    before, after = held.filter("side = 0").drop("side"), held.filter("side = 1").drop("side")
    on = ["parent", "child", "orlg"]
    return changed(before, after, on).withColumn("change", F.lit("gone")).unionByName(changed(after, before, on).withColumn("change", F.lit("born")))


def smallest(rows: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """by, value: of each group the value that comes first in the given order."""
    return rows.groupBy(by).agg(F.min_by(value, F.struct(*order)).alias(value))


#: Of a configuration as a column: for each position its group and whether that is alive.
CONF = "array<struct<orlg:int,alive:int>>"


def searched(steps: DataFrame, *, by: str = "tree", most_steps: int = 1000) -> DataFrame:
    """``by``, node, conf (an array of orlg, alive): what ``configurations`` finds, for any number of histories at once.

    ``steps`` has by, step (0, 1, ...: nodes depth first), node, parent (null at the root), kind and at (place of a duplication or
    loss among the groups alive above). Equal histories are searched once, and their result is joined to each. A history so far
    is a row with the steps ahead and the configurations of its nodes; a step makes a row for every way to share out the positions
    of a duplicated group: subsets by bit masks, smaller ones first. Of a history's rows that with the fewest positions stays, then the first. Histories with a step that cannot be, such as a place
    that no group has, are in no result.
    """
    row = F.struct("step", "node", "parent", "kind", F.col("at").cast("int").alias("at"))
    whole = steps.filter(F.col(by).isNotNull() & (F.col("step") >= 0)).groupBy(by).agg(F.array_sort(F.collect_set(row)).alias("history"))
    whole = cut(whole)
    ends = {r[0] for r in whole.select(F.element_at("history", -1)["step"]).distinct().collect()}  # numbers of steps
    top = max(ends, default=None)
    if top is None or top > most_steps:
        if top is None:
            return whole.select(by, F.lit("").alias("node"), F.array().cast(CONF).alias("conf")).limit(0)
        raise ValueError(f"a history of more than {most_steps} steps")
    one = F.array(F.struct(F.lit(0).alias("orlg"), F.lit(1).alias("alive")))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{CONF}>"))
    held = whole.select("history").distinct().select("history", F.col("history").alias("ahead"), nothing.alias("confs"), F.lit(1).alias("next"), F.array().cast("array<int>").alias("path"))
    made = done = None
    for k in range(top + 1):
        s = held.select("history", F.filter("ahead", lambda x: x["step"] > k).alias("ahead"), "confs", "next", "path", F.explode(F.filter("ahead", lambda x: x["step"] == k)).alias("now"))
        s = s.select("history", "ahead", "confs", "next", "path", "now.node", "now.parent", "now.kind", "now.at")
        above = F.when(F.col("parent").isNull(), one).otherwise(F.try_element_at("confs", F.col("parent")))
        s = s.withColumn("above", above).filter("above is not null")
        groups = F.array_distinct(F.transform(F.filter("above", lambda x: x["alive"] == 1), lambda x: x["orlg"]))
        s = s.withColumn("orlg", F.when(F.col("at") >= 0, F.get(groups, F.col("at"))))
        s = s.filter("kind not in ('duplication', 'loss') or orlg is not null")
        places = F.filter(F.sequence(F.lit(0), F.size("above") - 1), lambda i: (F.get("above", i)["orlg"] == F.col("orlg")) & (F.get("above", i)["alive"] == 1))
        s = s.withColumn("places", F.when(F.col("kind") == "duplication", places).otherwise(F.array().cast("array<int>")))
        m = F.size("places")
        # every proper part of the places, as (size, places): a bit for each
        chosen = lambda mask: F.filter("places", lambda p, i: F.call_function("getbit", mask, i) == 1)
        masks = F.transform(F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.least(m, F.lit(62))) - 2), lambda x: F.struct(F.size(chosen(x)).alias("size"), chosen(x).alias("first")))
        ways = F.when(m > 1, F.array_sort(masks)).otherwise(F.array(F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("first"))))
        s = s.select("*", F.posexplode(ways).alias("way", "part"))
        p = F.get("places", F.lit(0))
        was = F.col("above")
        pair = F.array(*[F.struct((F.col("next") + i).alias("orlg"), F.lit(1).alias("alive")) for i in (0, 1)])
        grown = F.concat(F.slice(was, 1, p), pair, F.slice(was, p + 2, F.size(was)))
        given = F.transform(was, lambda x, i: F.when(F.array_contains("places", i), F.struct(F.when(F.array_contains("part.first", i), F.col("next")).otherwise(F.col("next") + 1).alias("orlg"), x["alive"].alias("alive"))).otherwise(x))
        lost = F.transform(was, lambda x: F.struct(x["orlg"].alias("orlg"), F.when(x["orlg"] == F.col("orlg"), 0).otherwise(x["alive"]).alias("alive")))
        now = F.when(F.col("kind") == "loss", lost).when((F.col("kind") == "duplication") & (m == 1), grown).when(F.col("kind") == "duplication", given).otherwise(was)
        # a group of one position gets another, and so does every configuration so far
        wider = F.transform_values("confs", lambda _, c: F.concat(F.slice(c, 1, p + 1), F.slice(c, p + 1, 1), F.slice(c, p + 2, F.size(c))))
        known = F.when((F.col("kind") == "duplication") & (m == 1), wider).otherwise(F.col("confs"))
        s = s.select("history", "ahead", F.map_concat(known, F.map_from_arrays(F.array("node"), F.array(now))).alias("confs"), (F.col("next") + F.when(F.col("kind") == "duplication", 2).otherwise(0)).alias("next"), F.concat("path", F.array("way")).alias("path"))
        made, before = cut(s), made
        if before is not None:
            release(before)
        held = made.filter(F.size("ahead") > 0)
        if k in ends:
            size = F.size(F.element_at(F.map_values("confs"), 1))
            best = cut(made.filter(F.size("ahead") == 0).groupBy("history").agg(F.min_by("confs", F.struct(size, "path")).alias("confs")))
            done = best if done is None else done.unionByName(best)
    return whole.join(done, "history").select(by, F.explode("confs").alias("node", "conf"))


def search(steps: DataFrame, *, by: str = "tree", most_steps: int = 1000) -> DataFrame:
    """``by``, node, pos, orlg, alive: ``searched``, a row for each position."""
    got = searched(steps, by=by, most_steps=most_steps)
    return got.select(by, "node", F.posexplode("conf").alias("pos", "x")).select(by, "node", "pos", F.col("x.orlg").alias("orlg"), F.col("x.alive").alias("alive"))


def steps_of(tree: Tree, event_group: dict[str, int]) -> list[tuple[int, str, str | None, str, int | None]]:
    """step, node, parent, kind and at of one history, for ``search``."""
    return [(k, n, tree.parent(n), node_kind(n), event_group.get(n)) for k, n in enumerate(tree.depth_first())]
