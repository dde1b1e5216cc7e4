"""Configurations and joint states as columns: which are valid, and which changes lead from one to another.

A configuration is an array of (orlg, alive), a place each; a state is an array of symbols, one at each place. Every predicate is
false, not null, where something it needs is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _told(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _alive(conf: Column) -> Column:
    return F.filter(conf, lambda x: x["alive"] == 1)


def extent(conf: Column) -> Column:
    """The places of each group alive: a map from its number to an array."""
    places = F.transform(conf, lambda x, i: F.struct(x["orlg"].alias("orlg"), x["alive"].alias("alive"), i.alias("i")))
    of = lambda g: F.transform(F.filter(places, lambda x: (x["orlg"] == g) & (x["alive"] == 1)), lambda x: x["i"])
    groups = F.array_distinct(F.transform(_alive(conf), lambda x: x["orlg"]))
    return F.map_from_entries(F.transform(groups, lambda g: F.struct(g, of(g))))


def lost(conf: Column) -> Column:
    """The places of groups that are lost."""
    return F.filter(F.transform(conf, lambda x, i: F.when(x["alive"] == 0, i)), lambda i: i.isNotNull())


def is_configuration(conf: Column) -> Column:
    """Whether there is a place, each has a group and is alive (1) or lost (0), and no group is both."""
    whole = F.forall(conf, lambda x: x["orlg"].isNotNull() & _told(x["alive"].isin(0, 1)))
    groups = F.size(F.array_distinct(F.transform(conf, lambda x: x["orlg"])))
    return _told((F.size(conf) > 0) & whole & (F.size(F.array_distinct(conf)) == groups))


def is_state(state: Column, conf: Column) -> Column:
    """Whether the places of each group alive agree."""
    held = F.filter(F.zip_with(conf, state, lambda x, s: F.struct(x["orlg"].alias("orlg"), x["alive"].alias("alive"), s.alias("s"))), lambda x: x["alive"] == 1)
    return _told(F.size(F.array_distinct(held)) == F.size(F.array_distinct(F.transform(held, lambda x: x["orlg"]))))


def is_state_of(state: Column, conf: Column, base: int = 4) -> Column:
    """Whether a state can stand in a configuration: a symbol at each place, the same throughout a group alive."""
    symbols = F.forall(state, lambda s: _told((s >= 0) & (s < base)))
    return _told((F.size(state) == F.size(conf)) & symbols & is_state(state, conf))


def is_change_of(a: Column, b: Column, conf: Column, base: int = 4) -> Column:
    """Whether one change leads from state a to b: of one group alive, at all its places. Lost groups are frozen."""
    moved = F.filter(F.zip_with(conf, F.zip_with(a, b, lambda x, y: x != y), lambda x, m: F.when(m, x)), lambda x: x.isNotNull())
    one = (F.size(F.array_distinct(F.transform(moved, lambda x: x["orlg"]))) == 1) & F.forall(moved, lambda x: x["alive"] == 1)
    return _told(is_state_of(a, conf, base) & is_state_of(b, conf, base) & one)


def _changed(a: Column, b: Column) -> Column:
    """The places at which two states differ."""
    return F.filter(F.transform(F.zip_with(a, b, lambda x, y: x != y), lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def is_pair_change(a: Column, b: Column) -> Column:
    """Whether one change leads from a to b, states of two copies at two sites: of one place, or of both places of a copy to
    what the other copy holds there."""
    at = _changed(a, b)
    copies = [F.array(F.lit(k), F.lit(k + 1)) for k in (0, 2)]
    copied = ((at == copies[0]) | (at == copies[1])) & F.forall(at, lambda k: F.get(b, k) == F.get(a, (k + 2) % 4))
    return _told((F.size(a) == 4) & (F.size(b) == 4) & ((F.size(at) == 1) | copied))


def is_single_change(a: Column, b: Column) -> Column:
    """Whether one change leads from a to b before the duplication: both copies alike, and one site of both changes."""
    alike = lambda x: F.slice(x, 1, 2) == F.slice(x, 3, 2)
    return _told((F.size(a) == 4) & (F.size(b) == 4) & alike(a) & alike(b) & (F.size(_changed(F.slice(a, 1, 2), F.slice(b, 1, 2))) == 1))
