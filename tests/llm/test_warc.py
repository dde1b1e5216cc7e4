import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from helixframe.llm import warc

SCHEMA = "page_id long, url string, html string, type string, digest string, bytes int, payload string"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x", "y", 1, "z") for i, u, h in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    bodies = ["<p>" + rng.choice("abcdeé") * n + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" for n in (3, 990, 1500, 2000, 4000)]
    rows = [(k, f"http://h/{k % 7}", rng.choice(bodies) if rng.random() < 0.7 else f"{k} " * rng.randint(0, 600)) for k in range(120)]
    rows += [(500 + k, "http://copy/", bodies[2]) for k in range(40)]
    rows += [(7, None, None), (8, "", ""), (8, "", ""), (None, "http://null/", bodies[3]), (None, None, "n" * 1200), (None, None, "n" * 1200), (None, "x", "n" * 1200)]
    rows += [(900, "same", bodies[2])] * 3 + [(900, "other", bodies[2]), (901, "a b\r\nWARC-Type: metadata\r\n", "é" * 500), (902, "http://é/", "é" * 500), (903, "big", "x" * 3_000_000)]
    rows += [(-5, "least", "q" * 999), (5, "least", "q" * 999), (6, "edge", "q" * 1000), (-6, "edge", "q" * 1000)]
    return rows


def slow(rows):
    groups = defaultdict(list)
    for k, (i, u, h) in enumerate(rows):
        groups[(h or "").encode()].append((i is not None, i or 0, k))
    out = []
    for body, members in groups.items():
        top = max(members)
        for m in members:
            i = rows[m[2]][0]
            again = len(body) >= 1000 and m != top
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", rows[top[2]][0] if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("most,bound", [(warc.MOST_BROADCAST, warc.SIEVE_KEYS), (0, warc.SIEVE_KEYS), (0, 0)])
def test_round_trip(pages, monkeypatch, most, bound):
    """The three ways from a row to its original are one result."""
    monkeypatch.setattr(warc, "SIEVE_KEYS", bound)
    rows = corpus()
    got = found(warc.round_trip(pages(rows).repartition(3), most=most))
    assert got == slow(rows) and len({r[3] for r in got}) == 2


def test_oracle(pages):
    rows = corpus()
    con = duckdb.connect()
    con.register("pages", pa.Table.from_pandas(pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})))
    assert sorted(con.execute(warc.oracle()).fetchall(), key=repr) == found(warc.round_trip(pages(rows)))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, pages, tmp_path, compression):
    """The files are WARC by a reader of another make: lengths, digests, ids, and what revisits say of their originals."""
    rows = corpus()
    warc.write(pages(rows), f"{tmp_path}/out", date="2026-01-02T03:04:05Z", compression=compression, per_file=50)
    files = sorted(Path(tmp_path, "out").glob("part-*"))
    assert len(files) >= len(rows) // 50
    seen, revisits = {}, []
    for file in files:
        data = gzip.decompress(file.read_bytes()) if compression == "gzip" else file.read_bytes()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.split(b"\r\n")
            f = dict(x.split(b": ", 1) for x in lines)
            assert version == b"WARC/1.1" and len(f) == len(lines) and f[b"WARC-Date"] == b"2026-01-02T03:04:05Z"
            n = int(f[b"Content-Length"])
            block, data = data[:n], data[n:]
            assert data.startswith(b"\r\n\r\n") and f[b"WARC-Record-ID"] not in seen
            data = data[4:]
            seen[f[b"WARC-Record-ID"]] = f
            body = block.split(b"\r\n\r\n", 1)[1]
            if f[b"WARC-Type"] == b"response":
                assert f[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body).hexdigest().encode()
            else:
                assert body == b"" and f[b"WARC-Type"] == b"revisit" and f[b"WARC-Profile"] == warc.PROFILE.encode()
                revisits.append(f)
    assert len(seen) == len(rows) and sum(r[3] == "revisit" for r in slow(rows)) == len(revisits) > 50
    for f in revisits:
        of = seen[f[b"WARC-Refers-To"]]
        assert of[b"WARC-Type"] == b"response" and of[b"WARC-Payload-Digest"] == f[b"WARC-Payload-Digest"]
        assert f.get(b"WARC-Refers-To-Target-URI") == of.get(b"WARC-Target-URI")
    recs = warc.read(spark, f"{tmp_path}/out")
    assert recs.count() == len(rows) and recs.filter("type = 'revisit' and payload is not null").count() == 0


def test_empty_and_broken(spark, pages, tmp_path):
    assert warc.round_trip(pages([])).collect() == []
    file = tmp_path / "a.warc"
    file.write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc")
    with pytest.raises(Exception, match="is cut"):
        warc.read(spark, str(file)).collect()
    file.write_bytes(b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Refers-To: <urn:uuid:gone>\r\nWARC-Payload-Digest: sha1:ab\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    (r,) = warc.resolve(warc.read(spark, str(file))).collect()
    assert (r["type"], r["digest"], r["original"], r["bytes"]) == ("revisit", "ab", None, None)
