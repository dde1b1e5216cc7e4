"""Rooted trees: Newick text, duplication and loss lists, and their edge relations. Trees are small and live on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*([(),;]|[^(),;]+)")
#: Kinds of node by name: duplication, loss and speciation nodes are a letter and a number, all else is a tip.
KINDS = {"D": "duplication", "L": "loss", "N": "speciation"}


def node_kind(name: str) -> str:
    return KINDS.get(name[:1], "tip") if re.fullmatch(r"[DLN][0-9]+", name) else "tip"


def node_kind_column(name: Column) -> Column:
    """node_kind of a column of names."""
    out = F.lit("tip")
    for letter, kind in KINDS.items():
        out = F.when(name.rlike(rf"\A{letter}[0-9]+\z"), kind).otherwise(out)
    return out


@dataclass
class Tree:
    """Edges (parent, child) of a rooted tree; ``root`` has no parent."""

    edges: list[tuple[str, str]]
    lengths: dict[tuple[str, str], float] = field(default_factory=dict)

    @property
    def root(self) -> str:
        return next(p for p, _ in self.edges if p not in {c for _, c in self.edges})

    @property
    def nodes(self) -> list[str]:
        """The root first, then every node after its parent."""
        out = [self.root]
        for n in out:
            out.extend(self.children(n))
        return out

    def depth_first(self) -> list[str]:
        out: list[str] = []
        todo = [self.root]
        while todo:
            out.append(todo.pop())
            todo.extend(reversed(self.children(out[-1])))
        return out

    @property
    def tips(self) -> list[str]:
        parents = {p for p, _ in self.edges}
        return [n for n in self.nodes if n not in parents]

    def children(self, node: str) -> list[str]:
        return [c for p, c in self.edges if p == node]

    def parent(self, node: str) -> str | None:
        found = [p for p, c in self.edges if c == node]
        if len(found) > 1:
            raise ValueError(f"{node} has {len(found)} parents")
        return found[0] if found else None

    def path(self, node: str) -> list[str]:
        """From the root to the node."""
        out = [node]
        while (p := self.parent(out[-1])) is not None:
            out.append(p)
        return out[::-1]

    def sorted_edges(self) -> list[tuple[str, str]]:
        """In the order that lays out branch lengths: by parent, then by child."""
        return sorted(self.edges)

    def below(self, node: str) -> set[str]:
        out = {node}
        for n in self.nodes:
            if self.parent(n) in out:
                out.add(n)
        return out


def parse(text: str) -> Tree:
    """A tree from Newick text with named inner nodes; lengths after colons are kept, a final semicolon is optional."""
    edges: list[tuple[str, str]] = []
    lengths: dict[tuple[str, str], float] = {}
    stack: list[list[tuple[str, float | None]]] = [[]]
    closed: list[tuple[str, float | None]] | None = None

    def close(label: str) -> None:
        nonlocal closed
        name, _, length = label.partition(":")
        name = name.strip()
        if not name:
            raise ValueError("every node of the tree needs a name")
        for child, t in closed or []:
            edges.append((name, child))
            if t is not None:
                lengths[name, child] = t
        stack[-1].append((name, float(length) if length else None))
        closed = None

    tokens = TOKEN.findall(text.strip())
    label: str | None = None
    for tok in tokens:
        if tok == "(":
            stack.append([])
        elif tok in ",);":
            if label is not None or closed is not None:
                close(label or "")
                label = None
            if tok == ")":
                closed = stack.pop()
        else:
            label = tok.strip()
    if label is not None or closed is not None:
        close(label or "")
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("unbalanced tree")
    return Tree(edges, lengths)


def splice(tree: Tree, history: list[tuple[str, list[str]]]) -> Tree:
    """Puts the events of each branch ``parent_child`` on it as nodes of one child; ``Root_x`` adds a root above."""
    edges = list(tree.edges)
    for branch, events in history:
        parent, _, child = branch.partition("_")
        if parent == "Root" and not any("Root" in e for e in edges):
            edges.append(("Root", child))
        if (parent, child) not in edges:
            raise ValueError(f"no branch {branch}")
        edges.remove((parent, child))
        chain = [parent, *events, child]
        edges.extend(zip(chain, chain[1:]))
    return Tree(edges)


def post_duplication_edges(tree: Tree, node: str) -> set[tuple[str, str]]:
    """Edges into the node or below it."""
    inside = tree.below(node)
    return {(p, c) for p, c in tree.edges if c in inside}


def with_duplicated_root(tree: Tree, node: str) -> Tree:
    """The tree with a root ``dup`` above, where the duplication is at the root itself."""
    return Tree([("dup", tree.root), *tree.edges], dict(tree.lengths)) if node == tree.root else tree


def three_epochs(tree: Tree) -> Tree:
    """The tree with its inner nodes numbered from N2, depth first, and two edges N0, N1, N2 above its root, on which the first
    and the second duplication stand."""
    inner = [n for n in tree.depth_first() if tree.children(n)]
    new = {n: f"N{k + 2}" for k, n in enumerate(inner)}
    return Tree([("N0", "N1"), ("N1", "N2"), *[(new[a], new.get(b, b)) for a, b in tree.edges]])


def report(tree: Tree, confs: dict | None = None) -> str:
    """A line for each node: its kind, its parent and its configuration."""
    return "\n".join(f"{'  ' * (len(tree.path(n)) - 1)}{n} ({node_kind(n)})" + (f" {list(confs[n])}" if confs and n in confs else "") for n in tree.depth_first())


def read_tree(spark: SparkSession, path: str) -> Tree:
    return parse(spark.read.text(path, wholetext=True).first()["value"])


def read_history(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Lines of a branch and its events, split at white space."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter("w[0] <> ''")
    return [(r["w"][0], r["w"][1:]) for r in rows.collect()]  # a list of branches, as small as the tree


def read_tips(spark: SparkSession, path: str) -> list[str]:
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def edge_relation(spark: SparkSession, tree: Tree) -> DataFrame:
    """edge_id, parent, child, kind of the child: edges in layout order."""
    rows = [(k, p, c) for k, (p, c) in enumerate(tree.sorted_edges())]
    return spark.createDataFrame(rows, "edge_id int, parent string, child string").withColumn("kind", node_kind_column(F.col("child")))
