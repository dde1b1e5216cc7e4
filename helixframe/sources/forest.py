"""Trees as relations: any number of Newick texts to their edges, histories spliced into them, and paths, without a parser on the driver.

A text is cut into brackets, commas and labels, a row each. Its running depth pairs the brackets: of one level, an opening
bracket is the last before what it holds and before the bracket that closes it. A label names what closes just before it, and its
parent is the label of the brackets around it. A tree fits a row, as its text does; trees are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .newick import node_kind_column

MARKS = ("(", ")", ",", ";")


def tokens(texts: DataFrame, *, id: str = "tree", text: str = "text") -> DataFrame:
    """tree, pos, token, level, group (where the brackets around the token, or those that it closes, open), before, after (tokens) and closed.

    ``closed`` is where the brackets open that end just before the token. Labels are trimmed; empty ones are no tokens.
    """
    t = texts.select(F.col(id).alias("tree"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[(),;]|[^(),;]+"), 0)).alias("pos", "token"))
    t = t.select("tree", "pos", F.regexp_replace("token", r"\A\s+|\s+\z", "").alias("token")).filter("token <> ''")
    order = Window.partitionBy("tree").orderBy("pos")
    depth = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)).over(order)
    t = t.withColumn("level", (depth + F.when(F.col("token") == ")", 1).otherwise(0)).cast("int"))
    opened = F.last(F.when(F.col("token") == "(", F.col("pos")), ignorenulls=True).over(Window.partitionBy("tree", "level").orderBy("pos"))
    t = t.withColumn("group", opened)
    before, after = F.lag("token").over(order), F.lead("token").over(order)
    return t.withColumns({"before": before, "after": after, "closed": F.when(before == ")", F.lag("group").over(order))})


def nodes(tokens_: DataFrame) -> DataFrame:
    """tree, pos, node, length (null if not given), group, closed of every label; a length that is no number is null."""
    label = ~F.col("token").isin(*MARKS)
    name = F.regexp_replace(F.substring_index("token", ":", 1), r"\s+\z", "")
    given = F.when(F.instr("token", ":") > 0, F.expr("try_cast(trim(substr(token, instr(token, ':') + 1)) as double)"))
    return tokens_.filter(label).select("tree", "pos", name.alias("node"), given.alias("length"), "group", "closed", "level", "token")


def edges(texts: DataFrame, *, id: str = "tree", text: str = "text") -> DataFrame:
    """tree, parent, child, kind, length of every edge of every text; broken texts give what can be paired, see ``violations``.

    A null text has no edges, and neither has a tree of one node.
    """
    n = nodes(tokens(texts, id=id, text=text))
    # each label stands by the brackets that it is in and by those that it closes, so the texts are made once: texts whose parts
    # come in any order, as a list of a shuffle does, would have other places in each of two sides of a join
    at = F.explode(F.array(F.struct(F.col("group").alias("at"), F.lit(False).alias("closes")), F.struct(F.col("closed").alias("at"), F.lit(True).alias("closes")))).alias("e")
    n = n.select("tree", "node", "length", at).select("tree", "node", "length", "e.*").filter("at is not null")
    parent = F.max(F.when(F.col("closes"), F.col("node"))).over(Window.partitionBy("tree", "at"))
    n = n.withColumn("parent", parent).filter("not closes and parent is not null")
    return n.select("tree", "parent", F.col("node").alias("child"), node_kind_column(F.col("node")).alias("kind"), "length")


def laid_out(edges_: DataFrame, *by: str) -> DataFrame:
    """edges with ``edge_id``: their number in each tree, by parent, then child: the order that branch lengths are laid out in."""
    return edges_.withColumn("edge_id", (F.row_number().over(Window.partitionBy(*by).orderBy("parent", "child")) - 1).cast("int"))


def violations(texts: DataFrame, *, id: str = "tree", text: str = "text") -> DataFrame:
    """tree, problem, n: everything that is wrong with each text, not the first only: ``brackets``, ``unnamed`` (nodes), ``roots`` (not one),
    ``names`` (used twice), ``lengths`` (no numbers), ``empty``."""
    t = cut(tokens(texts, id=id, text=text))
    mark = F.col("token").isin(*MARKS)
    unnamed = (F.col("token") == ")") & (F.col("after").isNull() | F.col("after").isin(*MARKS)) | (F.col("token").isin(",", ")") & (F.col("before").isNull() | F.col("before").isin("(", ","))) | (~mark & F.col("token").startswith(":"))
    last = F.max_by(F.col("level") - F.when(F.col("token") == ")", 1).otherwise(0), "pos")
    count = lambda c: F.count(F.when(c, 1))
    per = t.groupBy("tree").agg(
        (count((F.col("token") == ")") & (F.col("level") < 1)) + F.abs(last)).alias("brackets"),
        count(unnamed).alias("unnamed"),
        F.abs(count(~mark & (F.col("level") == 0)) - 1).alias("roots"),
        count(~mark & F.col("token").contains(":") & F.expr("try_cast(trim(substr(token, instr(token, ':') + 1)) as double)").isNull()).alias("lengths"),
    )
    twice = nodes(t).filter("node <> ''").groupBy("tree", "node").count().filter("count > 1").groupBy("tree").agg(F.count(F.lit(1)).alias("names"))
    none = texts.select(F.col(id).alias("tree"), F.col(text).alias("text")).filter(F.coalesce(F.trim("text"), F.lit("")) == "").select("tree", F.lit("empty").alias("problem"), F.lit(1).cast("long").alias("n"))
    kinds = ["brackets", "unnamed", "roots", "lengths", "names"]
    long = per.join(twice, "tree", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    return long.select("tree", *[F.col(k).cast("long") for k in kinds]).unpivot("tree", kinds, "problem", "n").filter("n > 0").unionByName(none)


def splice(edges_: DataFrame, history: DataFrame, *by: str) -> DataFrame:
    """``by``, parent, child: edges with the events (an array of names) of each branch ``parent_child`` put on it as nodes of one child.

    A branch ``Root_x`` that is no edge adds a root above x. Branches that are not in the tree are in no result: see ``unknown_branches``.
    """
    name = F.concat_ws("_", "parent", "child")
    at = history.select(*by, F.col("branch"), F.col("events"))
    on = [*by, "branch"]
    plain = edges_.select(*by, "parent", "child", name.alias("branch"))
    tops = roots(edges_, *by).withColumnsRenamed({"root": "child"}).select(*by, F.lit("Root").alias("parent"), "child").withColumn("branch", name)
    added = tops.join(at.select(*on), on, "left_semi")
    got = plain.unionByName(added).join(at, on, "left")
    chain = F.concat(F.array("parent"), F.coalesce("events", F.array().cast("array<string>")), F.array("child"))
    return got.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda k: F.struct(F.get(chain, k - 1).alias("parent"), F.get(chain, k).alias("child")))).alias("e")).select(*by, "e.parent", "e.child")


def unknown_branches(edges_: DataFrame, history: DataFrame, *by: str) -> DataFrame:
    """The rows of a history whose branch is no edge, and no ``Root_x`` of the root either."""
    name = F.concat_ws("_", "parent", "child").alias("branch")
    top = roots(edges_, *by).select(*by, F.concat(F.lit("Root_"), "root").alias("branch"))
    return history.join(edges_.select(*by, name).unionByName(top), [*by, "branch"], "left_anti")


def roots(edges_: DataFrame, *by: str) -> DataFrame:
    """``by``, root: the nodes that are no child."""
    return edges_.select(*by, F.col("parent").alias("root")).distinct().join(edges_.select(*by, F.col("child").alias("root")), [*by, "root"], "left_anti")


def paths(edges_: DataFrame, root: str | None = None, *, by: Sequence[str] = (), deepest: int = 1000) -> DataFrame:
    """``by``, node, depth, path (names joined by /) of every node below a root: the given one, or every node without a parent.

    Each round doubles how far all nodes look up, so a tree of depth d takes log2(d) joins; what has come to its root joins no
    more. A relation with a cycle is an error once it is deeper than ``deepest``.
    """
    by = list(by)
    up = cut(edges_.select(*by, F.col("child").alias("node"), F.col("parent").alias("top"), F.lit(1).alias("depth"), F.col("child").alias("path")))
    done, reach = [], 1
    seen = lambda df: df.select(*by, F.col("node").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"), F.col("path").alias("upper"))
    while True:
        above = seen(up)
        for d in done:
            above = above.unionByName(seen(d))
        both = cut(up.join(above, [*by, "top"], "left"))
        done.append(both.filter("further is null").select(*by, "node", "top", "depth", "path"))
        up = both.filter("further is not null").select(*by, "node", F.col("further").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "upper", "path").alias("path"))
        reach *= 2
        if up.isEmpty():
            break
        if reach > 2 * deepest:
            raise ValueError(f"no end after {deepest} levels")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out if root is None else out.filter(F.col("top") == root)
    return out.select(*by, "node", "depth", F.concat_ws("/", "top", "path").alias("path"))


def below(paths_: DataFrame, node: Column) -> DataFrame:
    """The rows of ``paths`` of a node and all below it: the edges after a duplication there."""
    return paths_.filter(F.array_contains(F.split("path", "/"), node))
