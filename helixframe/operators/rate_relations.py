"""Rates as relations: the models of ``rates`` again, by joins and expressions alone.

``pi`` is a relation of nt (one letter) and freq. State spaces are fixed by the model, so the joins below are of constant size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACID, NUCLEOTIDES, SENSE_CODONS


def _letters(spark: SparkSession, name: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias(name), F.lit(c).alias(f"n{name}")) for k, c in enumerate(NUCLEOTIDES)])
    return spark.range(0, 1, numPartitions=1).select(F.inline(rows))


def _is_transition(a: Column, b: Column) -> Column:
    return (a != b) & (F.abs(a - b) == 2)


def hky(pi: DataFrame, kappa: float) -> DataFrame:
    """x, y, q: the twelve rates between nucleotides, of mean one at stationarity."""
    spark = pi.sparkSession
    f = F.broadcast(pi)  # four rows
    raw = _letters(spark, "x").crossJoin(_letters(spark, "y")).filter("x <> y")
    raw = raw.join(f.select(F.col("nt").alias("nx"), F.col("freq").alias("px")), "nx").join(f.select(F.col("nt").alias("ny"), F.col("freq").alias("py")), "ny")
    raw = raw.withColumn("r", F.col("py") * F.when(_is_transition(F.col("x"), F.col("y")), kappa).otherwise(1.0))
    mean = raw.agg(F.sum(F.col("px") * F.col("r")).alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("x", "y", (F.col("r") / F.col("m")).alias("q"))  # mean: one row


def two_paralogs(pi: DataFrame, kappa: float, tau: float) -> DataFrame:
    """s, t, rate, share: the 96 changes of a pair of copies, and what part of each is due to a copy."""
    q = hky(pi, kappa)
    other = pi.sparkSession.range(0, 4, numPartitions=1).select(F.col("id").cast("int").alias("z"))
    one = q.crossJoin(other)
    copied = F.when(F.col("y") == F.col("z"), F.lit(tau)).otherwise(0.0)
    rate = F.col("q") + copied
    first = one.select((F.col("x") * 4 + F.col("z")).alias("s"), (F.col("y") * 4 + F.col("z")).alias("t"), rate.alias("rate"), (copied / rate).alias("share"))
    second = one.select((F.col("z") * 4 + F.col("x")).alias("s"), (F.col("z") * 4 + F.col("y")).alias("t"), rate.alias("rate"), (copied / rate).alias("share"))
    return first.unionByName(second)


def codon_table(spark: SparkSession) -> DataFrame:
    """codon, state, aa of the 61 sense codons."""
    return spark.createDataFrame([(c, k, AMINO_ACID[c]) for k, c in enumerate(SENSE_CODONS)], "codon string, state int, aa string").coalesce(1)


def mg94(pi: DataFrame, kappa: float, omega: float) -> DataFrame:
    """a, b, q: the 526 rates of single changes among sense codons."""
    spark = pi.sparkSession
    f = F.broadcast(pi)
    c = codon_table(spark)
    at = spark.range(0, 3, numPartitions=1).select((F.col("id") + 1).cast("int").alias("k"))
    weight = c.crossJoin(at).withColumn("nt", F.substring("codon", F.col("k"), F.lit(1))).join(f, "nt").groupBy("codon").agg(F.product("freq").alias("w"))
    total = weight.agg(F.sum("w").alias("total"))
    weight = weight.crossJoin(F.broadcast(total)).select(F.col("codon").alias("a"), (F.col("w") / F.col("total")).alias("pa"))
    pair = c.select(F.col("codon").alias("a"), F.col("aa").alias("aa_a")).crossJoin(c.select(F.col("codon").alias("b"), F.col("aa").alias("aa_b")))
    unlike = [F.substring("a", k, 1) != F.substring("b", k, 1) for k in (1, 2, 3)]
    pair = pair.filter(reduce(lambda x, y: x + y, [u.cast("int") for u in unlike]) == 1)
    spot = F.when(unlike[0], 1).when(unlike[1], 2).otherwise(3)
    pair = pair.withColumn("x", F.substring("a", spot, F.lit(1))).withColumn("y", F.substring("b", spot, F.lit(1))).join(f.select(F.col("nt").alias("y"), "freq"), "y")
    ts = F.concat("x", "y").isin("AG", "GA", "CT", "TC")
    rate = F.col("freq") * F.when(ts, kappa).otherwise(1.0) * F.when(F.col("aa_a") != F.col("aa_b"), omega).otherwise(1.0)
    pair = pair.select("a", "b", rate.alias("r")).join(weight, "a")
    mean = pair.agg(F.sum(F.col("pa") * F.col("r")).alias("m"))
    return pair.crossJoin(F.broadcast(mean)).select("a", "b", (F.col("r") / F.col("m")).alias("q"))


def three_paralogs(pi: DataFrame, kappa: float, tau: dict[tuple[int, int], float]) -> DataFrame:
    """s, t, rate, copies: changes of one of three copies, with a rate for every (donor, recipient)."""
    spark = pi.sparkSession
    digits = spark.range(0, 64, numPartitions=1).select(F.col("id").cast("int").alias("s")).withColumn("d", F.array(F.floor(F.col("s") / 16), F.floor(F.col("s") / 4) % 4, F.col("s") % 4).cast("array<int>"))
    which = spark.range(0, 3, numPartitions=1).select(F.col("id").cast("int").alias("o"))
    rows = digits.crossJoin(which).withColumn("x", F.get("d", F.col("o"))).join(F.broadcast(hky(pi, kappa)), "x")
    weight = F.element_at(F.array(F.lit(16), F.lit(4), F.lit(1)), F.col("o") + 1)
    copies = reduce(lambda a, b: a + b, [F.when((F.col("o") == r) & (F.get("d", F.lit(g)) == F.col("y")), v).otherwise(0.0) for (g, r), v in tau.items()])
    return rows.select("s", (F.col("s") + (F.col("y") - F.col("x")) * weight).alias("t"), (F.col("q") + copies).alias("rate"), copies.alias("copies"))


def pair_site(pi: DataFrame, kappa: float, n: int, init: float, p: float) -> DataFrame:
    """s, t, rate: the 3,360 changes of two copies at two positions n apart."""
    spark = pi.sparkSession
    one, both = init / p * (1 - (1 - p) ** n), init / p * (1 - p) ** n
    digit = lambda k: F.pmod(F.floor(F.col("s") / 4**k), F.lit(4)).cast("int")
    states = spark.range(0, 256, numPartitions=1).select(F.col("id").cast("int").alias("s")).withColumn("d", F.array(*[digit(k) for k in (3, 2, 1, 0)]))
    place = spark.range(0, 4, numPartitions=1).select(F.col("id").cast("int").alias("k"))
    rows = states.crossJoin(place).withColumn("x", F.get("d", F.col("k"))).join(F.broadcast(hky(pi, kappa)), "x")
    other, beside, beside_other = (F.col("k") + 2) % 4, F.col("k").bitwiseXOR(F.lit(1)), (F.col("k").bitwiseXOR(F.lit(1)) + 2) % 4
    copied = F.when(F.get("d", other) == F.col("y"), one + F.when(F.get("d", beside) == F.get("d", beside_other), both).otherwise(0.0)).otherwise(0.0)
    weight = F.element_at(F.array(F.lit(64), F.lit(16), F.lit(4), F.lit(1)), F.col("k") + 1)
    single = rows.select("s", (F.col("s") + (F.col("y") - F.col("x")) * weight).alias("t"), (F.col("q") + copied).alias("rate"))
    d = [F.get("d", F.lit(k)) for k in range(4)]
    far = states.filter((d[0] != d[2]) & (d[1] != d[3]))
    into = far.select("s", (d[2] * 64 + d[3] * 16 + d[2] * 4 + d[3]).alias("t"), F.lit(both).alias("rate"))
    back = far.select("s", (d[0] * 64 + d[1] * 16 + d[0] * 4 + d[1]).alias("t"), F.lit(both).alias("rate"))
    return single.unionByName(into).unionByName(back)


def row_sums(rates: DataFrame, state: str = "s", rate: str = "rate") -> DataFrame:
    """state, out (the rate of leaving it), n (how many states it can go to)."""
    return rates.groupBy(state).agg(F.sum(rate).alias("out"), F.count(F.lit(1)).alias("n"))


def equal_rates(k: int, t: Column) -> tuple[Column, Column]:
    """Chance to end in the same state, and in a given other one, after time t at equal rates among k states."""
    return 1.0 / k + (1 - 1.0 / k) * F.exp(-t), 1.0 / k - 1.0 / k * F.exp(-t)


def prune_level(children: DataFrame, k: int, *, parent: str, length: str, message: str = "m") -> DataFrame:
    """parent, m: the log messages (one for each of k states) of parents from those of their children, one level up."""
    same, other = equal_rates(k, F.col(length))
    states = F.sequence(F.lit(0), F.lit(k - 1))

    def along(s: Column) -> Column:
        terms = F.transform(F.col(message), lambda v, z: v + F.log(F.when(z == s, same).otherwise(other)))
        top = F.array_max(terms)
        return top + F.log(F.aggregate(F.transform(terms, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b))

    up = children.select(parent, F.transform(states, along).alias("u"))
    sums = up.groupBy(parent).agg(*[F.sum(F.get("u", F.lit(s))).alias(f"s{s}") for s in range(k)])
    return sums.select(parent, F.array(*[F.col(f"s{s}") for s in range(k)]).alias("m"))


def codon_pair(pi: DataFrame, kappa: float, omega: float, tau_synonymous: float, tau_other: float, homo_omega: float | None = None, scale: float = 1.0) -> DataFrame:
    """process, s, t, rate, share: the changes of two codon copies (process 1), and before a duplication (process 0), where both move.

    A state is 61 times the first codon's number plus the second's. A copy takes on the other's codon at ``tau_synonymous`` where
    both stand for one amino acid, else at ``tau_other``: besides a change of one letter, or alone. ``share`` is what part of a rate
    is due to copies. With ``homo_omega`` changes to the amino acid of the other copy are selected by it instead of omega, and
    rates stand in the units that ``scale`` makes of the unselected ones. Rows are made from the 526 changes of one letter and the
    pairs of codons; no state is compared with another.
    """
    spark = pi.sparkSession
    c = codon_table(spark)
    other = F.broadcast(c.select(F.col("state").alias("z"), F.col("aa").alias("aa_z")))  # 61 rows
    named = lambda x: F.broadcast(c.select(F.col("codon").alias(x), F.col("state").alias(f"s_{x}"), F.col("aa").alias(f"aa_{x}")))
    q = mg94(pi, kappa, omega).join(named("a"), "a").join(named("b"), "b").select(F.col("s_a").alias("x"), F.col("s_b").alias("y"), "aa_a", "aa_b", "q")
    before = q.select(F.lit(0).alias("process"), (F.col("x") * 62).alias("s"), (F.col("y") * 62).alias("t"), F.col("q").alias("rate"), F.lit(0.0).alias("copied"))
    point = F.col("q")
    if homo_omega is not None:
        point = scale * F.col("q") * F.when((F.col("aa_a") != F.col("aa_b")) & (F.col("aa_b") == F.col("aa_z")), homo_omega / omega).otherwise(1.0)
    one = q.crossJoin(other).select("x", "y", "z", point.alias("rate"), F.lit(0.0).alias("copied"))
    tau = F.when(F.col("aa") == F.col("aa_z"), tau_synonymous).otherwise(tau_other)
    copies = c.crossJoin(other).filter("state <> z").select(F.col("state").alias("x"), F.col("z").alias("y"), "z", tau.alias("rate"), tau.alias("copied"))
    changes = one.unionByName(copies)
    first = changes.select((F.col("x") * 61 + F.col("z")).alias("s"), (F.col("y") * 61 + F.col("z")).alias("t"), "rate", "copied")
    second = changes.select((F.col("z") * 61 + F.col("x")).alias("s"), (F.col("z") * 61 + F.col("y")).alias("t"), "rate", "copied")
    pair = first.unionByName(second).groupBy("s", "t").agg(F.sum("rate").alias("rate"), F.sum("copied").alias("copied"))
    return before.unionByName(pair.select(F.lit(1).alias("process"), "s", "t", "rate", "copied")).select("process", "s", "t", "rate", (F.col("copied") / F.col("rate")).alias("share"))


def joint(pi: DataFrame, kappa: float, groups: Sequence[int], tau: dict[tuple[int, int], float]) -> DataFrame:
    """s, t, rate, share: changes of a joint state whose positions belong to ``groups``; those of one group change together.

    A group takes on what another (donor, recipient) holds at the rate that ``tau`` has for them. States in which
    positions of a group differ are none. ``share`` is what part of a rate is due to copies.
    """
    spark = pi.sparkSession
    m = len(groups)
    weight = [4 ** (m - 1 - k) for k in range(m)]
    digits = spark.range(0, 4**m, numPartitions=1).select(F.col("id").cast("int").alias("s")).withColumn("d", F.array(*[F.pmod(F.floor(F.col("s") / w), F.lit(4)).cast("int") for w in weight]))
    alive = sorted(set(groups))
    first = {g: list(groups).index(g) for g in alive}
    for k, g in enumerate(groups):
        digits = digits.filter(F.get("d", F.lit(k)) == F.get("d", F.lit(first[g])))
    which = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(first[g]).alias("at"), F.lit(sum(w for w, h in zip(weight, groups) if h == g)).alias("w")) for g in alive]))
    rows = digits.select("s", "d", which.alias("e")).withColumn("x", F.get("d", F.col("e.at"))).join(F.broadcast(hky(pi, kappa)), "x")  # twelve rates
    copied = reduce(lambda a, b: a + b, [F.when((F.col("e.g") == r) & (F.get("d", F.lit(first[g])) == F.col("y")), float(v)).otherwise(0.0) for (g, r), v in tau.items() if g in first and r in first], F.lit(0.0))
    rate = F.col("q") + copied
    return rows.select("s", (F.col("s") + (F.col("y") - F.col("x")) * F.col("e.w")).cast("int").alias("t"), rate.alias("rate"), (copied / rate).alias("share"))


def root_prior(pi: DataFrame, positions: int) -> DataFrame:
    """s, prior: the root's distribution, on the joint states whose positions agree."""
    repeat = sum(4**k for k in range(positions))
    return pi.select(((F.instr(F.lit("".join(NUCLEOTIDES)), F.col("nt")) - 1) * repeat).cast("int").alias("s"), F.col("freq").alias("prior"))


def pair_site_single(pi: DataFrame, kappa: float) -> DataFrame:
    """s, t, rate: before the duplication both copies change together, at one of two positions at a time."""
    other = F.broadcast(pi.sparkSession.range(0, 4, numPartitions=1).select(F.col("id").cast("int").alias("z")))
    q = hky(pi, kappa).crossJoin(other)
    first = q.select((F.col("x") * 68 + F.col("z") * 17).alias("s"), (F.col("y") * 68 + F.col("z") * 17).alias("t"), F.col("q").alias("rate"))
    return first.unionByName(q.select((F.col("z") * 68 + F.col("x") * 17).alias("s"), (F.col("z") * 68 + F.col("y") * 17).alias("t"), F.col("q").alias("rate")))


def absorbing(pi: DataFrame, kappa: float, tau: float) -> DataFrame:
    """s, t, rate: two copies that change alone (16 states) until one copies the other (state 16)."""
    spark = pi.sparkSession
    alone = two_paralogs(pi, kappa, 0.0).select("s", "t", "rate")
    return alone.unionByName(spark.range(0, 16, numPartitions=1).select(F.col("id").cast("int").alias("s"), F.lit(16).alias("t"), F.lit(2.0 * tau).alias("rate")))
