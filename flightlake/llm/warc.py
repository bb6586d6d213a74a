"""WARC archives and an external merge of their capture indexes.

Records are written as WARC/1.1 files, one gzip member for each record, and read back by Spark's
reader of binary files.  What one task reads of them gives one locally sorted run of captures; runs are
cut at the same keys into ranges, and each range merges its slices of all runs with a loser tree.  The
ranges follow one another, so the whole is one globally ordered history of (URL key, timestamp).
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, scratch, table

#: Payloads from this many bytes on are stored once; equal ones become revisit records.
LEAST_REVISIT = 0
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Captures that one range of the merge holds on average.
RANGE_ROWS = 50_000

END = "\r\n\r\n"
#: A gzip member without content: it stands between records, so that readers of many members pass over it.
NOTHING = bytes.fromhex("1f8b08000000000000030300" + "00" * 8)


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and joined by commas, then ')', then path and query, in lower case.

    Scheme, user, port 80 or 443, a leading "www." and the fragment do not count; null gives an empty key.
    """
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""))
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_extract(u, r"(?s)^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html, ...) with (payload, digest_hex, refers_to): null for the first page of equal payloads.

    The first is the one with the smallest page_id; payloads below ``least`` bytes never refer.  A page without
    page_id refers to the first one with an id.  The minimum is aggregated before the shuffle, and only
    digests of more than one page are joined.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest_hex", F.sha1(F.col("payload").cast("binary")))
    first = p.where(F.octet_length("payload") >= least).groupBy("digest_hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest_hex", "first")
    later = F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))
    return p.join(first, "digest_hex", "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def record_bytes(page_id, url: str, key: str, stamp: str, digest_hex: str, refers_to, payload: bytes) -> bytes:
    """A WARC/1.1 record of an HTTP answer; a revisit carries the HTTP header and no payload."""
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    again = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode() + (b"" if again else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {url}",
        f"X-URL-Key: {key}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
    ]
    if again:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END.encode() + block + END.encode()


def write_archives(marked: DataFrame, path: str, captured: Column, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row, each a gzip member of its own, in files under ``path`` that are closed at ``archive_bytes``.

    Members are made in the tasks, which count their bytes; Spark's text writer puts them into files byte for byte, with
    an empty member in the place of a line feed.
    """
    import pyarrow as pa

    plain = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    rows = marked.select(
        "page_id", plain(F.coalesce("url", F.lit(""))).alias("url"), plain(url_key(F.col("url"))).alias("key"), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
        "digest_hex", "refers_to", F.col("payload").cast("binary").alias("payload"),
    )

    def pack(batches):
        number = held = 0
        for batch in batches:
            members, numbers = [], []
            for fields in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(z.compress(record_bytes(*fields)) + z.flush())
                numbers.append(number)
                held += len(members[-1]) + len(NOTHING)
                if held >= archive_bytes:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(numbers, pa.int32())], ["member", "number"])

    packed = rows.mapInArrow(pack, "member binary, number int").select(F.col("member").cast("string").alias("value"), "number")
    packed.write.partitionBy("number").option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)


def members(content: bytes):
    """(offset, length, data) of every gzip member that holds something."""
    at, whole = 0, memoryview(content)
    while at < len(content):
        d, p, data = zlib.decompressobj(31), at, []
        while not d.eof:
            if p >= len(content):
                raise ValueError(f"a member is cut off at {at}")
            data.append(d.decompress(whole[p : p + 16384]))
            p += 16384
        stop = min(p, len(content)) - len(d.unused_data)
        if any(data):
            yield at, stop - at, b"".join(data)
        at = stop


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if not lines[0].startswith("WARC/") or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("no WARC record here")
    return head, block


RUN = "run string, pos int, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long"


def read_runs(spark, path: str) -> DataFrame:
    """Locally sorted runs of captures, one for all the archives that a task reads; digests of responses are taken from the payload read back."""
    import pandas as pd

    columns = [c.split()[0] for c in RUN.split(", ")]

    def number(urn: str | None):
        x = (urn or "")[10:-1]
        return int(x) if x else None

    def run(batches):
        rows, name = [], ""
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                archive = "/".join(where.rsplit("/", 2)[-2:])
                name = name or archive
                for at, length, data in members(content):
                    head, block = parsed(data)
                    cut = block.index(b"\r\n\r\n") + 4
                    size = int(block[:cut].lower().split(b"content-length: ")[1].split(b"\r\n")[0])
                    digest = head["WARC-Payload-Digest"].split(":")[1]
                    if head["WARC-Type"] == "response":
                        body = block[cut:]
                        if len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{archive}: damaged record at {at}")
                    rows.append((head.get("X-URL-Key", ""), head["WARC-Date"], number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), archive, at, length))
        rows.sort(key=lambda r: (r[0].encode("utf-8", "surrogatepass"), r[1], r[2] is not None, r[2] or 0, r[7], r[8]))
        for a in range(0, len(rows), 10_000):
            out = pd.DataFrame([(name, a + i, *r) for i, r in enumerate(rows[a : a + 10_000])], columns=columns)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return materialize(files.mapInPandas(run, RUN), "runs")


class LoserTree:
    """k-way merge: inner nodes keep the losers of their matches, so the next winner costs one path to the root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.tree = [0] * self.k
        won = {self.k + i: i for i in range(self.k)}
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            win, lose = (a, b) if self._before(a, b) else (b, a)
            self.tree[node], won[node] = lose, win
        self.winner = won[1]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (self.k + w) // 2
            while node:
                if self._before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs with (range, place): ordered by both, they are ordered by URL key, timestamp and page_id (null first).

    Spark's range partitioning samples the bounds (at most a million keys, whatever the number of captures); they hold
    timestamp, page_id and place of the record too, so that one URL with very many captures is spread over ranges.
    """
    import pandas as pd

    order = ["url_key", "captured", "page_id", "archive", "record_offset"]
    ranges = max(1, -(-runs.count() // range_rows))
    data = [f.name for f in runs.schema if f.name not in ("run", "pos")]

    def merge(batches):
        # slices as they came: the order inside each is the run's
        pdf = pd.concat([*batches] or [pd.DataFrame(columns=[*runs_columns, "range"])], ignore_index=True)
        page = pdf["page_id"].fillna(-(1 << 63)).astype("int64")
        keys = list(zip((k.encode("utf-8", "surrogatepass") for k in pdf["url_key"]), pdf["captured"], page, pdf["archive"], pdf["record_offset"]))
        run = pdf["run"].tolist()
        starts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)] if run else [0]
        slices = [[(keys[i], i) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        out = pdf.iloc[list(LoserTree(slices))].reset_index(drop=True)
        out["place"] = range(len(out))
        yield out[[*data, "range", "place"]]

    runs_columns = runs.columns
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    dealt = runs.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()).sortWithinPartitions("run", "pos")
    return dealt.mapInPandas(merge, ", ".join(f"{c} {kinds[c]}" for c in data) + ", range int, place int")


def with_position(merged: DataFrame) -> DataFrame:
    """Adds position, the number of a capture in the whole history from 0: the rows of the ranges before its own, and its place."""
    merged = materialize(merged, "history")
    per = merged.groupBy("range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("range")) - F.col("_n")  # one row for each range
    return merged.join(per.select("range", before.alias("_before")), "range").withColumn("position", (F.col("_before") + F.col("place")).cast("long")).drop("_before")


def capture_history(pages: DataFrame, captured: Column, least: int = LEAST_REVISIT) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html), read them back and merge their runs.

    One row per page: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, url_key,
    captured, archive, record_offset, record_length, range, place, position.  Null html counts as empty, a
    null url has an empty key; a page without page_id refers to the page with its payload that has the smallest one, and is a
    response if there is none; repeated rows come out repeated (equal page_ids do not refer to one
    another); an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(mark_revisits(pages, least), path, captured)
    return with_position(merge_runs(read_runs(spark, path)))


def op2_warc_history(spark, sf_dir) -> DataFrame:
    # the pages carry no capture time: one second for each page_id from a fixed day on stands for it
    captured = F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)))
    out = capture_history(table(spark, sf_dir, "pages"), captured)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


OP2_SQL = """
WITH p AS (SELECT page_id, lower(regexp_replace(coalesce(url, ''), '(?s)#.*$', '')) AS u, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p GROUP BY d),
k AS (SELECT *, regexp_replace(u, '^[a-z][a-z0-9+.-]*://', '') AS v FROM p),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(v, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\\.', '') AS host, regexp_extract(v, '(?s)^[^/?]*(.*)$', 1) AS rest FROM k),
o AS (SELECT page_id, n, d, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN f < page_id OR (page_id IS NULL AND f IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id OR page_id IS NULL THEN f END AS refers_to, url_key, captured,
  row_number() OVER (ORDER BY encode(url_key), captured, page_id NULLS FIRST) - 1 AS position
FROM o JOIN f USING (d)
"""
