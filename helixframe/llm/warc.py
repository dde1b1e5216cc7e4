"""WARC archives with revisit records: headers are shuffled by payload digest, repeated payloads become revisits of one original
response, and the archives that are written hold each of these payloads once, under fresh headers.

Archives are written by Spark's text sink, whose record separator is WARC's own, so that tasks that are repeated leave one
copy; and read as whole files, record by record after their Content-Length.
"""

from __future__ import annotations

import datetime
import gzip
import io
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SIEVE_BITS, SIEVE_KEYS, cut, freed, release

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads up to which their originals are broadcast (some 200 bytes each), and records in an archive.
MOST_BROADCAST, RECORDS = 200_000, 1000


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing if the value is null."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _plain(c: Column) -> Column:
    """A value for a header line: runs of blanks and control characters stand as %20."""
    return F.regexp_replace(c, r"[\x00-\x20\x7F]+", "%20")


def _urn(digest: Column) -> Column:
    """The record id of the original of a digest, which its revisits refer to: the same whoever makes it."""
    h = F.md5(F.concat(F.lit("response "), digest))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def headers(pages: DataFrame, *, id: str, url: str, payload: str) -> DataFrame:
    """id, url, payload (bytes; null: none), digest (SHA-1 in hex) and bytes of every row."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))


def originals(heads: DataFrame, least: int) -> DataFrame:
    """of (digest), top_id, top_url, same, n: the row of largest id (then url) of the n of each repeated digest; ``same`` rows equal it."""
    some = heads.filter(F.col("bytes") >= least).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("same"))
    groups = some.groupBy(F.col("digest").alias("of")).agg(F.max(F.struct("id", "url", "same")).alias("top"), F.sum("same").alias("n")).filter("n > 1")
    return groups.select("of", F.col("top.id").alias("top_id"), F.col("top.url").alias("top_url"), F.col("top.same").alias("same"), "n")


def _with_originals(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """rows with the columns of their digest's group, or nulls.

    Up to ``most`` groups are broadcast. With more, a bitmap of a few bits for each, up to 64 MB, tells most of the rows that have
    no group, and only the others are shuffled; beyond its bound all are.
    """
    n = groups.count()
    on = F.col("digest") == F.col("of")
    if n <= most:
        return rows.join(F.broadcast(groups), on, "left")
    if n > SIEVE_KEYS:
        return rows.join(groups.hint("merge"), on, "left")
    size = max(1 << 10, 1 << (SIEVE_BITS * n).bit_length())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    word = lambda c: F.floor(bit(c) / 64).cast("int")
    mask = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(c), F.lit(64)).cast("int"))
    words = groups.groupBy(word("of").alias("word")).agg(F.bit_or(mask("of")).alias("bits"))
    told = rows.join(F.broadcast(words), word("digest") == F.col("word"), "left")
    hit = F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(mask("digest")) != 0
    apart = told.filter(~hit).drop("word", "bits")
    for name, kind in groups.dtypes:
        apart = apart.withColumn(name, F.lit(None).cast(kind))
    return apart.unionByName(told.filter(hit).drop("word", "bits").join(groups.hint("merge"), on, "left"))


def records(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, most: int = MOST_BROADCAST) -> DataFrame:
    """id, url, type (response or revisit), digest, original (record id, null if nothing refers to it), refers_url, body of every row.

    Of rows with equal payloads of ``least`` bytes or more that of the largest id is the response (null ids are the least, the
    larger url decides a tie, and of equal rows any one); the others revisit it and have no body. All smaller ones are responses.
    """
    rows = headers(pages, id=id, url=url, payload=payload)
    groups = cut(originals(rows.drop("payload"), least))
    got = _with_originals(rows, groups, most)
    is_top = F.col("id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    alone = F.col("of").isNull() | (is_top & (F.col("same") == 1))
    repeated = F.col("of").isNotNull() & is_top & (F.col("same") > 1)
    original, refers = F.when(F.col("of").isNotNull(), _urn(F.col("digest"))), F.when(F.col("type") == "revisit", F.col("top_url"))
    out = lambda df: df.select("id", "url", "type", "digest", original.alias("original"), refers.alias("refers_url"), F.when(F.col("type") == "response", F.col("payload")).alias("body"))
    all_ = out(got.filter(~repeated).withColumn("type", F.when(alone, "response").otherwise("revisit")))
    if not groups.filter("same > 1").isEmpty():  # rows that are equal to the original in everything
        one = got.filter(repeated).groupBy("of").agg(F.first("payload").alias("payload"), *[F.first(c).alias(c) for c in ("id", "url", "digest", "top_url")]).withColumn("type", F.lit("response"))
        rest = groups.filter("same > 1").withColumn("nth", F.explode(F.sequence(F.lit(2).cast("long"), "same")))
        rest = rest.select(F.col("top_id").alias("id"), F.col("top_url").alias("url"), F.lit("revisit").alias("type"), F.col("of").alias("digest"), "of", "top_url", F.lit(None).cast("binary").alias("payload"))
        all_ = all_.unionByName(out(one)).unionByName(out(rest))
    return all_


def write(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str | None = None, compression: str = "gzip", per_file: int = RECORDS, most: int = MOST_BROADCAST) -> None:
    """Writes archives of all rows of pages into the folder ``path``: see ``records``.

    Each record has a fresh id and the ``date`` (now, unless given), a response the page as an HTTP message, a revisit the id, the date and
    the url of its original. A null url has no WARC-Target-URI. The id of the row stands in the field Page-ID, percent-encoded, or not at
    all if null.
    """
    now = F.lit(date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    rec = records(pages, id=id, url=url, payload=payload, least=least, most=most)
    response = F.col("type") == "response"
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    size = F.octet_length("body")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(response, _line("Content-Length", size.cast("string"))).otherwise(""), F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", angle(F.when(response & F.col("original").isNotNull(), F.col("original")).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid())))),
        _line("WARC-Date", now),
        _line("WARC-Target-URI", _plain(F.col("url"))),
        _line("Page-ID", F.url_encode(F.col("id").cast("string"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(_line("WARC-Refers-To", angle(F.col("original"))), _line("WARC-Refers-To-Target-URI", _plain(F.col("refers_url"))), _line("WARC-Refers-To-Date", now), _line("WARC-Profile", PROFILE))),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", (F.octet_length(http) + F.coalesce(size, F.lit(0))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    whole = F.concat(head.cast("binary"), F.coalesce("body", F.lit(b""))).cast("string")
    rec.select(whole.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).mode("errorifexists").text(path)


def _parse(content: bytes) -> Iterator[dict]:
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record of an archive begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = f.read(n := int(fields["content-length"]))
        if len(block) < n or f.read(4) != END.encode():
            raise ValueError(f"record {fields.get('warc-record-id')} is cut")
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        strip = lambda k: fields[k].strip("<>") if k in fields else None
        yield {
            "type": fields.get("warc-type"),
            "record_id": strip("warc-record-id"),
            "uri": strip("warc-target-uri"),
            "date": fields.get("warc-date"),
            "digest": fields["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in fields else None,
            "refers_to": strip("warc-refers-to"),
            "fields": list(fields.items()),
            "payload": None if fields.get("warc-type") == "revisit" else payload,
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, uri, date, digest, refers_to, fields (a map, names in lower case), payload of all records of the archives in a folder.

    Revisits have no payload. An archive that ends within a record, or holds something else, is an error.
    """
    schema = pa.schema([(c, pa.string()) for c in ("type", "record_id", "uri", "date", "digest", "refers_to")] + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for r in _parse(content.as_py()):
                    held.append(r)
                    size += len(r["payload"] or b"")
                    if size > 8_000_000 or len(held) >= RECORDS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(freed(run), "type string, record_id string, uri string, date string, digest string, refers_to string, fields map<string,string>, payload binary")


def resolve(recs: DataFrame) -> DataFrame:
    """Records of ``read`` joined to the responses that they revisit: original (record id), fields of it as ``of_fields``, bytes, sha1 of the full payload.

    A response is its own original. A revisit whose original is not there, or has another digest, has nulls. Payloads are measured
    before the join, so only headers are shuffled; an original with very many revisits is a hot key, which is split.
    """
    heads = cut(recs.select("type", "record_id", "digest", "refers_to", "fields", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")))
    own = heads.filter("type <> 'revisit' or type is null").select("*", F.col("record_id").alias("original"), F.col("fields").alias("of_fields"))
    of = heads.filter("type = 'response'").select(F.col("record_id").alias("original"), F.col("fields").alias("of_fields"), F.col("bytes").alias("b"), F.col("sha1").alias("s"))
    again = heads.filter("type = 'revisit'").drop("bytes", "sha1").join(of.hint("merge"), (F.col("refers_to") == F.col("original")) & (F.col("digest") == F.col("s")), "left")
    return own.unionByName(again.withColumnsRenamed({"b": "bytes", "s": "sha1"}))


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder beside the session's checkpoints, which all executors share; what is in it goes at the end."""
    sc = spark.sparkContext
    release_me = cut(spark.range(1))  # sets the session's folder where it is unset
    release(release_me)
    path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir(), f"warc-{uuid.uuid4().hex}")
    try:
        yield path.toString()
    finally:
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def round_trip(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, most: int = MOST_BROADCAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, read from archives that are written for it and removed."""
    kind = dict(pages.dtypes)[id]
    with folder(pages.sparkSession) as path:
        write(pages, path, id=id, url=url, payload=payload, least=least, most=most)
        got = resolve(read(pages.sparkSession, path))
    number = lambda fields: F.url_decode(F.col(fields)["page-id"]).cast(kind)
    refers = F.when(F.col("type") == "revisit", number("of_fields"))
    return got.select(number("fields").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), refers.alias("refers_to"))


def oracle(least: int = 1000) -> str:
    """DuckDB SQL for the query."""
    return f"""
    with h as (select page_id, octet_length(encode(coalesce(html, '')))::bigint n, sha1(coalesce(html, '')) d from pages),
    r as (
      select *, row_number() over (partition by d order by page_id desc nulls last) nth,
        first_value(page_id) over (partition by d order by page_id desc nulls last) top from h)
    select page_id, n as payload_bytes, d as payload_digest, case when n >= {least} and nth > 1 then 'revisit' else 'response' end as record_type,
      case when n >= {least} and nth > 1 then top end as refers_to
    from r"""
