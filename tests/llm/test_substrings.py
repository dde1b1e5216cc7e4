import random
import re

import duckdb
import pandas as pd
import pytest

from helixframe.llm import substrings


CUT = {"sentence": lambda t: re.findall(substrings.SENTENCE, t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "paragraph": lambda t: paragraphs(t)}


def paragraphs(t):
    """Lines up to the last of the blank lines behind them; blank lines at the beginning are one by themselves."""
    out, blank = [""], False
    for x in re.findall(r"[^\n]*\n|[^\n]+", t):
        if x.strip(" \t\r\n") and blank:
            out.append("")
        out[-1] += x
        blank = not x.strip(" \t\r\n") and x.endswith("\n") and (blank or "\n" in out[-1][: -len(x)])
    return [u for u in out if u]


def slow(rows, min_words=25, unit="sentence"):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((d, None, []))
            continue
        kept, spans, run, at = [], [], [], 0
        us = CUT[unit](t)
        norm = [re.sub(r"[ \t\n\r]+", " ", u.lower()).strip(" ") for u in us]

        def close():
            if run and sum(len(n.split(" ")) for n, *_ in run) >= min_words:
                spans.append((run[0][2], run[-1][2] + len(run[-1][1])))
            else:
                kept.extend(u for _, u, _ in run)
            run.clear()

        for u, n in zip(us, norm):
            if n and n in seen:
                run.append((n, u, at))
            else:
                close()
                kept.append(u)
                if n:
                    seen[n] = d
            at += len(u)
        close()
        out.append((d, "".join(kept), spans))
    return out


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))).capitalize() + rng.choice([". ", "! ", ".\n", "?\t"])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(4)]
    rows = []
    for d in range(50):
        t = "".join(sentence() for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.6:
            t += rng.choice(passages) + "".join(sentence() for _ in range(3))
        rows.append((d, t))
    return rows + [(70, None), (71, ""), (72, "..."), (73, "no end"), (74, "Junk line. " * 500), (75, rows[3][1])]


def test_against_brute_force(documents):
    rows = corpus()
    got = substrings.dedup(documents(rows, "spans,k,u"), unit="sentence", min_words=25, out="gone")
    assert got.columns[-4:] == ["spans", "k", "u", "gone"]
    have = sorted((r["doc_id"], r["text"], [tuple(s) for s in r["gone"]]) for r in got.collect())
    assert have == slow(rows)
    assert sum(bool(s) for *_, s in have) > 10


def test_oracle_agrees(documents):
    rows = corpus()
    documents_table = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents_table)
    want = sorted(con.execute(substrings.oracle()).fetchall())
    assert want == [(d, t, ",".join(f"{a}-{b}" for a, b in s)) for d, t, s in slow(rows)]


def test_repeated_rows_and_null_ids(documents):
    long = " ".join(f"word{k}" for k in range(30)) + "."
    rows = [(1, long), (1, long), (2, "Before. " + long.upper()), (None, "Unlike.")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in substrings.dedup(documents(rows), unit="sentence", min_words=25).collect())
    assert got == [("1", long), ("1", long), ("2", "Before. "), ("None", "Unlike.")]
    assert substrings.dedup(documents([])).count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph"])
@pytest.mark.parametrize("least", [1, 6])
def test_lines_and_paragraphs(documents, unit, least):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 3))) + rng.choice(["\n", "\n", " \n\n", "\n \n\n", ""])
    rows = [(d, "".join(line() for _ in range(rng.randint(0, 14)))) for d in range(60)] + [(70, None), (71, "\n"), (72, "A B\n\na  b"), (73, "a b")]
    got = substrings.dedup(documents(rows, "__id,__h,__runs,__new,__cut"), unit=unit, min_words=least)
    have = sorted((r["doc_id"], r["text"], [tuple(s) for s in r["spans"]]) for r in got.collect())
    assert have == slow(rows, least, unit)
    assert got.columns[-6:-1] == ["__id", "__h", "__runs", "__new", "__cut"] and got.filter("__id <> 'kept' or __runs <> 'kept'").count() == 0


def test_unknown_unit(documents):
    with pytest.raises(ValueError):
        substrings.dedup(documents([]), unit="word")
