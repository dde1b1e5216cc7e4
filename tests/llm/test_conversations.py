import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from helixframe.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, k string, n int, fault string, part string"
EMPTY = hashlib.sha256(b"").hexdigest()
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, letters) and its lines, by a search in rising order over turns and states; rows have role, text and fault."""
    import heapq

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, letters, lines
        if (cost, letters, i, state) in seen:
            continue
        seen.add((cost, letters, i, state))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        push = lambda c, letter, j, s, line: heapq.heappush(heap, (cost + c, letters + letter, j, s, lines + ((line,) if line else ())))
        for x in ("user", "assistant"):
            if x[0] in follows and cost < 60:
                push(5, "I", i, x[0], f"{x}:")
        if i < len(rows):
            role, text, fault = rows[i]
            push(2, "D", i + 1, state, None)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[0] in follows:
                    push(more, "K", i + 1, role[0], f"{role}:{text}")
                for x in ("user", "assistant"):
                    if x[0] in follows:
                        push(more + 1, "R", i + 1, x[0], f"{x}:{text}")


def dynamic(roles):
    """Least cost and letters of complete turns, by the best of each state so far; ``-`` must be deleted."""
    best = {"": (0, "")}
    for x in roles:
        new = {}
        for state, (c, letters) in best.items():
            ways = [(state, 2, "D")]
            if x != "-":
                ways += [(y, 0 if y == x else 1, "K" if y == x else "R") for y in {"": "su", "s": "u", "u": "a", "a": "u"}[state] if y == x or y != "s"]
            for y, more, letter in ways:
                new[y] = min(new.get(y, (9**9, "")), (c + more, letters + letter))
        for a, b in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
            if a in new:
                new[b] = min(new.get(b, (9**9, "")), (new[a][0] + 5, new[a][1] + "I"))
        best = new
    return min(best[x] for x in ("", "a") if x in best)


def slow(rows, damaged=True):
    plain = lambda x: " " if x is None else str(x)
    out, convs = [], {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text, copies = plain(role), plain(text), 1
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        cost, letters, lines = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def corpus(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        role = "user"
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["One.", "Two!", "Cut", " \t\n", "", "é?  \n", "Three.", f"{rng.random()}.", f"{rng.random()}", None])
            r = rng.choice([role, role, role, "system" if t == 0 else role, "user", "assistant", "tool", None, "", "usher"])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), r, text))
            role = "assistant" if role == "user" else "user"
    rows += [(None, t, r, "Null id.") for t, r in enumerate(["user", "assistant", "user"])] + [(-4, 1, "user", "x" * 300_000 + "."), (-4, 2, "assistant", "ok.")]
    rows += [(-9, None, "user", "a."), (-9, None, "assistant", "b.")] * 5
    return rows


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "k", 1, "f", "p") for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [1, 3, cv.BLOCK_TURNS])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(table, most, seed):
    """Blocks of any size give what a search by rising cost finds."""
    rows = corpus(seed)
    df = cv.damaged_and_repaired(table(rows).repartition(4), most=most)
    assert [c for c, t in df.dtypes if t == "bigint"] == COLUMNS[:7]
    want = slow(rows)
    assert found(df) == want
    assert sum(r[2] for r in want) > 5 and sum(r[3] for r in want) > 5 and sum(r[4] for r in want) > 5 and len({r[7] for r in want}) > 20


def test_letters_by_search():
    """Every short sequence of turns: cost and letters, whole and in blocks cut at every place."""
    roles = ["system", "user", "assistant", "other"]
    kinds = [("user", "x", "blank"), *((r, "x", f) for r in roles for f in ("", "truncated"))]
    rng = random.Random(3)
    cases = [list(x) for n in range(4) for x in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randint(4, 9))] for _ in range(300)]
    for rows in cases:
        codes = bytes(0 if f == "blank" else 1 + 2 * roles.index(r) + (f == "truncated") for r, _, f in rows)
        want = cheapest(rows)
        assert cv.repair_codes(codes) == want[:2]
        letters = want[1]
        turns = cv.apply(letters, codes, [{"role": r, "text": t} for r, t, f in rows if f != "blank"], 0, sum(x != "D" for x in letters))
        assert tuple(f"{t['role']}:{t['text']}" for t in turns) == want[2]
        for at in range(1, len(codes)):
            a, b = codes[:at], codes[at:]
            middle = cv._times((cv.BEGIN,), cv.matrix(a))[0]
            after = cv.min_plus(cv.GROWN, cv.min_plus(cv.matrix(b), cv.FINISH))
            x, states = cv.walk(a, *cv.costs(a, cv.BEGIN, after), frozenset([cv.START]), False)
            y, _ = cv.walk(b, *cv.costs(b, middle, cv.FINISH), states, True)
            assert x + y == letters


def test_oracle(table):
    rows = corpus(7)
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pandas(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})))
    r = con.execute(cv.oracle())
    at = [c[0] for c in r.description]
    assert sorted((tuple(x[at.index(c)] for c in COLUMNS) for x in r.fetchall()), key=repr) == found(cv.damaged_and_repaired(table(rows))) == slow(rows)


@pytest.mark.parametrize("most", [2, 1024])
def test_repaired_turns(table, most):
    """The turns themselves: of a long conversation beside short ones, joined they have the digest of ``repair``."""
    rows = corpus(5, 20) + [(77, t, ("user", "assistant", "user")[t % 3], f"{t % 40}.") for t in range(200)] + [(78, 5, "user", "Again.")] * 50
    texts = {}
    for r in cv.repaired_turns(table(rows), most=most).orderBy("k", "place").collect():
        texts.setdefault(r["k"], []).append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI"
    got = cv.repair(table(rows), most=most).collect()
    for r in got:
        lines = texts.get(r["k"], [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r["repaired_sha256"] and len(lines) == sum(x != "D" for x in r["audit"])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    short = [r for r in rows if r[0] not in (77, 78)]
    want = {("" if w[0] is None else f"={w[0]}"): w[1:] for w in slow(short, damaged=False)}
    all_ = {r["k"]: tuple(r[c] for c in COLUMNS[1:]) for r in got}
    assert {k: v for k, v in all_.items() if k not in ("=77", "=78")} == want
    seen = [(r[2], r[3]) for r in rows if r[0] == 77]
    codes = "".join("-" if x in seen[:t] else x[0][0] for t, x in enumerate(seen))
    cost, letters = dynamic(codes)
    assert all_["=77"][:7] == (0, 0, codes.count("-"), 0, sum(("user", "assistant", "user")[t % 3] == ("user", "assistant", "user")[(t + 1) % 3] for t in range(199)), cost, letters)
    assert all_["=78"][:7] == (0, 0, 49, 0, 49, 100, "D" * 50)


def test_nothing_left_and_empty(table):
    assert cv.damaged_and_repaired(table([])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(cv.damaged_and_repaired(table([(gone, 0, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
