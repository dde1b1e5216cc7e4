"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for what no rule fits.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits, as struct(rule, verdict), or null.

    A rule fits its host and every subdomain when the path starts with the rule's path. Rules of one length are tried in
    their given order.
    """
    out: Column | None = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return empty if out is None else out.otherwise(empty)


def features(host: Column, path: Column, dims: int, sizes: Sequence[int]) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked with the part that it comes from."""

    def grams(part: Column, mark: str, n: int) -> Column:
        s = F.concat(F.lit("^"), part, F.lit("$"))
        ids = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(mark), s.substr(i, F.lit(n))), F.lit(dims)).cast("int"))
        return F.when(F.length(s) >= n, ids).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*[grams(c, mark, n) for c, mark in ((host, "h"), (path, "p")) for n in sizes]))


def _weights(values: Sequence[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{v:.9g}" for v in values) + "]"), "array<double>")


def _score(buckets: Column, weights: Column, bias: float) -> Column:
    z = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    z = z / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")) + F.lit(float(bias))
    return 1 / (1 + F.exp(-z))


def fit(labelled: DataFrame, *, url: str = "url", label: str = "label", dims: int = 1024, sizes: Sequence[int] = (3, 4, 5), rounds: int = 25, rate: float = 6.0, l2: float = 1e-3, max_labelled: int = 1000) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression, by full-batch gradient descent in DataFrame jobs.

    ``labelled`` is a small table of url and label (1: block). At most ``max_labelled`` rows, the least by a hash of their
    url, are used; that bound is the only sample taken. Rows with a null url or label are left out. Without rows of both
    labels the weights are zero and the bias follows the rows there are. Only one number for each bucket reaches the driver.
    """
    c = F.col(url)
    rows = labelled.filter(c.isNotNull() & F.col(label).isNotNull()).select(c.alias("u"), F.col(label).cast("int").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("u"), "u", "y").limit(max_labelled).select(features(host_of(F.col("u")), path_of(F.col("u")), dims, sizes).alias("x"), "y")
    rows = cut(rows)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights, bias = [0.0] * dims, 0.0
    if n == 0 or ones in (0, n):
        return weights, 0.0 if n == 0 else math.log((ones + 0.5) / (n - ones + 0.5))
    for _ in range(rounds):
        missed = rows.select("x", (_score(F.col("x"), _weights(weights), bias) - F.col("y")).alias("d"))
        step = missed.select(F.explode(F.concat(F.array(F.lit(-1)), "x")).alias("b"), F.when(F.col("b") == -1, F.col("d")).otherwise(F.col("d") / F.sqrt(F.size("x").cast("double"))).alias("g"))
        for b, g in step.groupBy("b").agg((F.sum("g") / n).alias("g")).collect():
            if b < 0:
                bias -= rate * g
            else:
                weights[b] -= rate * (g + l2 * weights[b])
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules: Sequence[tuple[str, str]] = (), *, id: str = "page_id", url: str = "url", sizes: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """id, host, path, rule, verdict, score of every row; one output row for each input row, repeated rows included.

    The verdict is that of the longest fitting rule, or else ``block`` where the regression gives 0.5 or more. A null url
    has an empty host and path and is scored by the bias alone. Other columns of the input are not read.
    """
    weights, bias = model
    rows = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", _score(features(F.col("host"), F.col("path"), len(weights), sizes), _weights(weights), bias))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learned).alias("verdict"), "score")
