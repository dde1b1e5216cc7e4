"""Repair of conversations: turns are kept, given another role, deleted or inserted at least cost so that the roles read ``(s?(ua)+)?``.

A conversation's turns and the states of that pattern make a layered graph. Forward and backward least costs tell the arcs
that lie on a cheapest path; a walk along them holds the set of states that the letters so far can lead to, and takes the least
letter that leaves it. (The letters fix the place among the turns, so the set lies in one layer, and their number fixes the roles.)

A conversation may be long: turns are sorted in ranges over tasks and cut into blocks. A block acts on costs as a small matrix and on
sets of states as a table, so costs and sets are carried from block to block by streams of such rows, and turns are
handled in the tasks that hold their blocks. Conversations that lie within one block are repaired where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, freed, release

#: Edits' costs; what an undeleted truncated turn costs more; turns and bytes of text of a block.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_TURNS, BLOCK_BYTES = 1024, 4_000_000
FAR = 1 << 50
#: States: nothing yet, after s, after u, after a. Where a role's initial leads from each; the first and the last may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START, ENDS, ROLES = 0, (0, 3), {"u": "user", "a": "assistant"}
INSERTS = [(p, q) for (p, x), q in STEPS.items() if x in ROLES]
LEGAL = {"su", "ua", "au"}
BLANK = r"[\x20\x09-\x0D]"

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, column))) for column in zip(*b)) for row in a)


def min_plus(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(x + y for x, y in zip(row, v))) for row in m)


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of a turn. Code 0 must be deleted; else 1 + 2 * (place of its initial in "sua", or 3) + truncated."""
    out = [("D", DELETE, p, p) for p in range(4)]
    if code:
        symbol, more = "sua?"[(code - 1) // 2], TRUNCATED * ((code - 1) % 2)
        out += [("K", KEEP + more, p, q) for (p, x), q in STEPS.items() if x == symbol]
        out += [("R", REROLE + more, p, q) for p, q in INSERTS]
    return out


def _single() -> Matrix:
    """Costs of insertions alone between states."""
    m = tuple(tuple(0 if p == q else INSERT if (p, q) in INSERTS else FAR for q in range(4)) for p in range(4))
    return _times(m, _times(m, m))


ARCS = [_arcs(c) for c in range(9)]
GROWN = _single()
BARE = [tuple(tuple(min([c for _, c, x, y in arcs if (x, y) == (p, q)], default=FAR) for q in range(4)) for p in range(4)) for arcs in ARCS]
TURN = [_times(m, GROWN) for m in BARE]
BEGIN = _times((tuple(0 if p == START else FAR for p in range(4)),), GROWN)[0]
FINISH = min_plus(GROWN, tuple(0 if p in ENDS else FAR for p in range(4)))


@lru_cache(1 << 14)
def matrix(codes: bytes) -> Matrix:
    """Least costs from each state before the turns to each behind them."""
    out = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))
    for c in codes:
        out = _times(out, TURN[c])
    return out


def costs(codes: bytes, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[list, list]:
    """Forward and backward least costs at every layer, from those at the first and the last."""
    forward, backward = [tuple(before)], [tuple(after)]
    for c in codes:
        forward.append(_times((forward[-1],), TURN[c])[0])
    for c in reversed(codes):
        backward.append(min_plus(GROWN, min_plus(BARE[c], backward[-1])))
    return forward, backward[::-1]


def walk(codes: bytes, forward: list, backward: list, states: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """Least letters along cheapest paths from a set of states, and the set they lead to; ``last``: to the end of the conversation."""
    total = min(x + y for x, y in zip(forward[0], backward[0]))
    out, i = [], 0
    while True:
        if i == len(codes) and (not last or any(p in ENDS and forward[i][p] == total for p in states)):
            return "".join(out), states
        ways: dict[str, set[int]] = {}
        for p, q in INSERTS:
            if p in states and forward[i][p] + INSERT + backward[i][q] == total:
                ways.setdefault("I", set()).add(q)
        if i < len(codes):
            for letter, cost, p, q in ARCS[codes[i]]:
                if p in states and forward[i][p] + cost + backward[i + 1][q] == total:
                    ways.setdefault(letter, set()).add(q)
        letter = min(ways)
        out.append(letter)
        states = frozenset(ways[letter])
        i += letter != "I"


@lru_cache(1 << 14)
def repair_codes(codes: bytes) -> tuple[int, str]:
    """Cost and letters of a whole conversation."""
    forward, backward = costs(codes, BEGIN, FINISH)
    return min(x + y for x, y in zip(forward[0], backward[0])), walk(codes, forward, backward, frozenset([START]), True)[0]


def role_at(place: int, total: int) -> str:
    """Initial of the role of the turn at a place among the repaired ones."""
    if total % 2:
        return "s" if place == 0 else "au"[place % 2]
    return "ua"[place % 2]


def apply(letters: str, codes: bytes, rows: list[dict], done: int, total: int) -> list[dict]:
    """The repaired turns (role, text, edit) of a block before which ``done`` of ``total`` stand; rows are those of codes that may stay."""
    out, i = [], 0
    left = iter(rows)
    for letter in letters:
        row = None
        if letter != "I":
            row = next(left) if codes[i] else None
            i += 1
        if letter == "D":
            continue
        role = row["role"] if letter == "K" else ROLES[role_at(done + len(out), total)]
        out.append({"role": role, "text": "" if letter == "I" else row["text"], "edit": letter})
    return out


def joined(turns: list[dict]) -> bytes:
    return "\n".join(f"{t['role']}:{t['text']}" for t in turns).encode("utf-8", "surrogatepass")


LINE = "struct<role:string,text:string,edit:string>"
STATS = ("blank", "duplicate", "truncated", "illegal")
BLOCKS = f"k string, part int, seq int, whole boolean, {', '.join(f'{c} long' for c in STATS)}, first string, last string, low long, high long, turns long, first_turn long, last_turn long, cost long, audit string, sha string, codes binary, rows array<struct<role:string,text:string>>, lines array<{LINE}>"
_row, _line = pa.struct([("role", pa.string()), ("text", pa.string())]), pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
ARROW = pa.schema(
    [("k", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in STATS], ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns", "first_turn", "last_turn", "cost")]
    + [("audit", pa.string()), ("sha", pa.string()), ("codes", pa.binary()), ("rows", pa.list_(_row)), ("lines", pa.list_(_line))]
)


class Block:
    """Turns of one conversation that stand together."""

    def __init__(self, k: str, seq: int, whole: bool) -> None:
        self.out = {"k": k, "seq": seq, "whole": whole} | dict.fromkeys(STATS, 0) | dict.fromkeys(("first", "last", "low", "high", "first_turn", "last_turn"))
        self.codes, self.rows, self.size, self.turns = bytearray(), [], 0, 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None, copies: int) -> None:
        o, first = self.out, role[:1]
        if not self.codes:
            o["first"], o["first_turn"] = first, turn
        elif o["last"] + first not in LEGAL:
            o["illegal"] += 1
        o["illegal"] += copies - 1
        if turn is not None and (not self.codes or turn != o["last_turn"]):
            self.turns += 1
            o["low"], o["high"] = turn if o["low"] is None else o["low"], turn
        o["last"], o["last_turn"] = first, turn
        if fault:
            o[fault] += 1
        o["blank" if fault == "blank" else "duplicate"] += copies - 1
        if fault in ("blank", "duplicate"):
            self.codes.append(0)
        else:
            symbol = "sua".find(first) if first else -1
            self.codes.append(1 + 2 * (symbol if symbol >= 0 else 3) + (fault == "truncated"))
            self.rows.append({"role": role, "text": text})
            self.size += len(text)
        self.codes.extend(bytes(copies - 1))

    def end(self, lines: bool) -> dict:
        o, codes = self.out | {"turns": self.turns}, bytes(self.codes)
        if not o["whole"]:
            return o | {"codes": codes, "rows": self.rows}
        cost, letters = repair_codes(codes)
        turns = apply(letters, codes, self.rows, 0, sum(x != "D" for x in letters))
        return o | {"cost": cost, "audit": letters, "sha": hashlib.sha256(joined(turns)).hexdigest(), "lines": turns if lines else None}


def _blocks(most: int, lines: bool) -> Callable:
    """Turns in order to blocks; the first and the last conversation of a task may go on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, held, first, size = None, [], True, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part} | r for r in held], ARROW)

        for b in batches:
            for k, turn, role, text, fault, n in zip(*(c.to_pylist() for c in b.columns)):
                while n:
                    full = block is not None and (len(block.codes) >= most or block.size >= BLOCK_BYTES)
                    if block is None or block.out["k"] != k or full:
                        if block is not None:
                            same = block.out["k"] == k
                            block.out["whole"] &= not same
                            held.append(block.end(lines))
                            size += block.size
                            first &= same
                        block = Block(k, block.out["seq"] + 1 if block is not None and block.out["k"] == k else 0, not first and not (block is not None and block.out["k"] == k))
                        if len(held) >= 1000 or size > BLOCK_BYTES:
                            yield batch()
                            held, size = [], 0
                    copies = min(n, most)
                    block.add(turn, role, text, fault, copies)
                    n -= copies
                    fault = fault if fault == "blank" else "duplicate"  # of copies that go on in another block
        if block is not None:
            block.out["whole"] = False
            held.append(block.end(lines))
        if held:
            yield batch()

    return freed(run)


def _stream(df: DataFrame, columns: list[str], order: list[Column], step: Callable, schema: str) -> DataFrame:
    """Rows of each conversation in order through ``step(key, row, state)``, which gives the next state and a row or None; at the end row is None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["k"] != key:
                    if key is not None:
                        out.append(step(key, None, state)[1])
                    key, state = row["k"], None
                state, got = step(key, row, state)
                out.append(got)
            yield from made(out)
        if key is not None:
            yield from made([step(key, None, state)[1]])

    def made(out: list) -> Iterator[pa.RecordBatch]:
        if out := [r for r in out if r is not None]:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], types)

    types = _arrow(df, schema)
    sorted_ = df.select(*columns).repartition("k").sortWithinPartitions("k", *order)
    return sorted_.mapInArrow(freed(run), schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _long(blocks: DataFrame) -> DataFrame:
    """letters and lines of blocks whose conversations have several: k, part, seq, cost, audit, lines and the columns of blocks."""
    place = ["k", "part", "seq"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [[x for row in matrix(c.as_py()) for x in row] for c in b.column("codes")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in place] + [pa.array(m, pa.list_(pa.int64()))], names=[*place, "m"])

    ways = cut(blocks.select(*place, "codes").mapInArrow(freed(measured), "k string, part int, seq int, m array<bigint>"))
    square = lambda m: tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4))

    def ahead(key, row, f):
        if row is None:
            return None, None
        f = f or BEGIN
        return _times((f,), square(row["m"]))[0], {**row, "before": list(f)}

    def back(key, row, b):
        if row is None:
            return None, None
        after = b or FINISH
        return min_plus(GROWN, min_plus(square(row["m"]), after)), {**row, "after": list(after), "last": b is None}

    up, down = [F.col("part"), F.col("seq")], [F.desc("part"), F.desc("seq")]
    forward = _stream(ways, [*place, "m"], up, ahead, "k string, part int, seq int, m array<bigint>, before array<bigint>")
    both = cut(_stream(forward, [*place, "m", "before"], down, back, "k string, part int, seq int, before array<bigint>, after array<bigint>, last boolean"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                forward, backward = costs(r["codes"], r["before"], r["after"])
                total = min(x + y for x, y in zip(forward[0], backward[0]))
                good = [p for p in range(4) if forward[0][p] + backward[0][p] == total]
                to, kept = [0] * 16, [0] * 16
                for mask in range(1, 16):
                    states = frozenset(p for p in range(4) if mask >> p & 1)
                    if states <= set(good):
                        letters, then = walk(r["codes"], forward, backward, states, r["last"])
                        to[mask], kept[mask] = sum(1 << p for p in then), sum(x != "D" for x in letters)
                out.append({c: r[c] for c in place} | {"to": to, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("to", pa.list_(pa.int64())), ("kept", pa.list_(pa.int64()))]))

    coded = blocks.select(*place, "codes").join(both, place)
    moves = coded.select(*place, "codes", "before", "after", "last").mapInArrow(freed(tables), "k string, part int, seq int, to array<bigint>, kept array<bigint>")

    def carried(key, row, at):
        if row is None:
            return None, None
        mask, done = at or (1 << START, 0)
        return (row["to"][mask], done + row["kept"][mask]), {**row, "mask": mask, "done": done, "own": row["kept"][mask]}

    sets = cut(_stream(moves, [*place, "to", "kept"], up, carried, "k string, part int, seq int, mask bigint, done bigint, own bigint"))
    totals = sets.groupBy("k").agg(F.sum("own").alias("total"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(_line))])
        for b in batches:
            for r in b.to_pylist():
                forward, backward = costs(r["codes"], r["before"], r["after"])
                states = frozenset(p for p in range(4) if r["mask"] >> p & 1)
                letters, _ = walk(r["codes"], forward, backward, states, r["last"])
                lines = apply(letters, r["codes"], r["rows"], r["done"], r["total"])
                cost = min(x + y for x, y in zip(forward[0], backward[0]))
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in place} | {"cost": cost, "audit": letters, "lines": lines}], schema)

    whole = blocks.select(*place, "codes", "rows").join(both, place).join(sets.select(*place, "mask", "done"), place).join(totals, "k")
    out = whole.select(*place, "codes", "rows", "before", "after", "last", "mask", "done", "total").mapInArrow(freed(decided), f"k string, part int, seq int, cost long, audit string, lines array<{LINE}>")
    got = cut(out.join(blocks.drop("cost", "audit", "lines", "codes", "rows", "sha"), place))
    release(ways, both, sets)
    return got


def _sums(blocks: DataFrame) -> DataFrame:
    """Blocks with letters and lines, in order, to one row of each conversation; a digest is a chain, so its texts are streamed, not held."""
    schema = f"k string, {', '.join(f'{c} long' for c in STATS)}, low long, high long, turns long, cost long, audit string, sha string"

    def step(key, row, s):
        if row is None:
            return None, s["out"] | {"k": key, "audit": "".join(s["audit"]), "sha": s["hash"].hexdigest()}
        if s is None:
            s = {"out": dict.fromkeys((*STATS, "turns"), 0) | {"low": None, "high": None, "cost": row["cost"]}, "audit": [], "hash": hashlib.sha256(), "any": False, "last": None, "turn": None}
        o = s["out"]
        for c in (*STATS, "turns"):
            o[c] += row[c]
        if s["last"] is not None and s["last"] + row["first"] not in LEGAL:
            o["illegal"] += 1
        if row["first_turn"] is not None and row["first_turn"] == s["turn"]:
            o["turns"] -= 1
        o["low"] = row["low"] if o["low"] is None else o["low"]
        o["high"] = o["high"] if row["high"] is None else row["high"]
        s["last"], s["turn"] = row["last"], row["last_turn"]
        s["audit"].append(row["audit"])
        if row["lines"]:
            s["hash"].update((b"\n" if s["any"] else b"") + joined(row["lines"]))
            s["any"] = True
        return s, None

    columns = ["k", "part", "seq", *STATS, "first", "last", "low", "high", "turns", "first_turn", "last_turn", "cost", "audit", "lines"]
    return _stream(blocks, columns, [F.col("part"), F.col("seq")], step, schema)


def key(c: Column) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def blocks_of(convs: DataFrame, *, id: str, turn: str, role: str, text: str, copies: str | None = None, most: int = BLOCK_TURNS, lines: bool = False) -> DataFrame:
    """Turns in order, as blocks; ``copies`` tells how often a row stands."""
    text_, role_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    rows = convs.select(key(F.col(id)).alias("k"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"), (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("n"))
    rows = cut(rows.groupBy("k", "turn", "role", "text").agg(F.sum("n").alias("n")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # the earliest turn of each role and text that stands in several; the join stays one of two shuffles, whose hot keys are split
    seen = rows.filter(~blank).groupBy("k", "role", F.sha2("text", 256).alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at"), F.count(F.lit(1)).alias("c"))
    seen = dealt(seen.filter("c > 1").select("k", "role", "d", "at"))
    told = rows.withColumn("d", F.sha2("text", 256)).join(seen.hint("merge"), ["k", "role", "d"], "left")
    later = F.col("at").isNotNull() & ~F.col("turn").eqNullSafe(F.col("at.turn"))
    cut_off = ~F.col("text").rlike(rf"[.!?]{BLANK}*\z")
    fault = F.when(blank, "blank").when(later, "duplicate").when(cut_off, "truncated")
    told = told.select("k", "turn", "role", "text", fault.alias("fault"), "n")
    ordered = told.repartitionByRange("k", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("k", "turn", "role", "text")
    return cut(ordered.mapInArrow(_blocks(most, lines), BLOCKS))


def repair(convs: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, most: int = BLOCK_TURNS) -> DataFrame:
    """k (text of the id), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of convs.

    Turns are taken by ``turn`` (nulls first; equal ones by role, then text), null roles and texts are one blank. A turn's first fault counts: blank
    (also empty), duplicate (role and text stood before), truncated (its last character that is no blank is none of ``.!?``). illegal
    counts neighbours whose initials are none of su, ua, au. ``audit`` has the letters of the cheapest edits in order, of equal ones
    the ASCII-least. Ids may be null; repeated rows are duplicates; an empty table has no conversation; other columns do not matter.
    """
    blocks = blocks_of(convs, id=id, turn=turn, role=role, text=text, copies=copies, most=most)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    out = lambda df: df.select("k", gaps.alias("gaps"), *STATS, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return out(blocks.filter("whole")).unionByName(out(_sums(_long(cut(blocks.filter("not whole"))))))


def repaired_turns(convs: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = BLOCK_TURNS) -> DataFrame:
    """k, place (part, seq, pos: in order), role, text, edit of every turn of the repaired conversations."""
    blocks = blocks_of(convs, id=id, turn=turn, role=role, text=text, most=most, lines=True)
    lines = blocks.filter("whole").select("k", "part", "seq", "lines").unionByName(_long(cut(blocks.filter("not whole"))).select("k", "part", "seq", "lines"))
    return lines.select("k", "part", "seq", F.posexplode("lines").alias("pos", "x")).select("k", F.struct("part", "seq", "pos").alias("place"), "x.*")


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32 of ``conv_id:turn`` (nulls: one blank) modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 sets the role to user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.withColumn("kind", F.pmod(F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")), F.lit(20)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(plain("role"))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def damaged_and_repaired(convs: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """conv_id and the columns of ``repair`` of every conversation, after its rows are damaged; zeros, an empty audit and the digest of nothing where no row is left."""
    got = repair(damage(convs.select("conv_id", "turn", "role", "text")), copies="copies", most=most)
    ids = convs.select("conv_id").distinct().withColumn("k", key(F.col("conv_id")))
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", *STATS, "cost")]
    return ids.join(got, "k", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL for the query: a state is a text of its cost in eight digits, letters, a mark and lines, so that ``least`` is the rule."""

    def then(state: str, cost: int, letter: str, line: str = "''", extra: str = "0") -> str:
        at = f"strpos({state}, chr(1))"
        return f"lpad((left({state}, 8)::int + {cost} + {extra})::varchar, 8, '0') || substr({state}, 9, {at} - 9) || '{letter}' || substr({state}, {at}) || {line}"

    kept = "chr(10) || role || ':' || text"
    keep = lambda p, x: f"case when ok and first = '{x}' then {then(p, KEEP, 'K', kept, 'more')} end"
    other = lambda p, r: f"case when ok then {then(p, REROLE, 'R', f"chr(10) || '{r}:' || text", 'more')} end"
    drop = lambda p: then(p, DELETE, "D")
    s0, s1 = drop("s0"), f"least({drop('s1')}, {keep('s0', 's')})"
    s2 = f"least({drop('s2')}, {', '.join(f(p, x) for p in ('s0', 's1', 's3') for f, x in ((keep, 'u'), (other, 'user')))})"
    s3 = f"least({drop('s3')}, {keep('s2', 'a')}, {other('s2', 'assistant')})"
    insert_u = ", ".join(then(p, INSERT, "I", "chr(10) || 'user:'") for p in ("s0", "s1", "s3"))
    insert_a = then("s2", INSERT, "I", "chr(10) || 'assistant:'")
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"
    return rf"""
    with recursive c as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
    e as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as kind from c),
    d as (
      select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case kind when 3 then 2 else 1 end)) as copy from e where kind <> 0),
    o as (
      select *, coalesce('=' || conv_id, '') as key, left(role, 1) as first, row_number() over w as i, lag(left(role, 1)) over w as before
      from d window w as (partition by conv_id order by turn nulls first, role, text)),
    f as (
      select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][ 	-
]*\z') then 'truncated' else '' end as fault
      from (select *, row_number() over (partition by conv_id, role, text order by i) as nth from o)),
    g as (select *, fault not in ('blank', 'duplicate') as ok, case when fault = 'truncated' then {TRUNCATED} else 0 end as more from f),
    n as (
      select key, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || first not in ('su', 'ua', 'au')) as illegal, count(*) as turns from g group by key),
    walk(key, i, s0, s1, s2, s3) as (
      select key, 0::bigint, s0, s1, s2, {insert_a} from (select key, s0, s1, s3, least(s2, {insert_u}) as s2 from (select key, '00000000' || chr(1) as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from n))
      union all
      select key, i, s0, s1, s2, least(s3, {insert_a}) from (
        select key, i, s0, s1, s3, least(s2, {insert_u}) as s2 from (
          select g.key, g.i, {s0} as s0, {s1} as s1, {s2} as s2, {s3} as s3 from walk join g on g.key = walk.key and g.i = walk.i + 1))),
    z as (select walk.key, least(s0, s3) as s from walk join n on n.key = walk.key and n.turns = walk.i),
    ids as (select distinct conv_id, coalesce('=' || conv_id, '') as key from conversations)
    select conv_id, {", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("gaps", *STATS))}, coalesce(left(s, 8)::bigint, 0) as cost,
      coalesce(substr(s, 9, strpos(s, chr(1)) - 9), '') as audit, sha256(coalesce(substr(s, strpos(s, chr(1)) + 2), '')) as repaired_sha256
    from ids left join n on n.key = ids.key left join z on z.key = ids.key"""
