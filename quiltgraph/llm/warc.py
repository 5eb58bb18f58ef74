"""WARC archives with an index.

Writing makes the index: offset, length, URL and digest of each record.
Readers select index rows first, sort the byte ranges and coalesce neighbours
into single reads, so that only the selected records' bytes are read."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import open_store
from quiltgraph.storage import shared_path

#: Payloads from this size on that others equal are stored once.
LEAST_REVISIT_BYTES = 1000
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Ranges with at most this between them are read together, up to MOST_READ bytes at once.
GAP, MOST_READ = 64 << 10, 8 << 20
#: Every record ends with it.
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset bigint, length bigint, page_id {id}, url string, digest string, record_type string, refers_to {id}"


def _page_urn(page: object) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def make_record(page: object, url: str | None, html: bytes, digest: str, refers_to: object) -> bytes:
    """A WARC record; a revisit has the HTTP header alone, with the length of the whole payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    kind = "response" if refers_to is None else "revisit"
    fields = {"WARC-Type": kind, "WARC-Record-ID": _page_urn(page), "WARC-Date": DATE, "WARC-Target-URI": (url or "").replace("\r", "").replace("\n", ""), "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _page_urn(refers_to)}
    block = http if refers_to is not None else http + html
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + END


def find_revisits(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages (page_id, n, digest) that revisit another.

    Of equal payloads of at least ``least`` bytes the one with the largest id
    is the response.  Whichever row has that id is a response, so rows that
    repeat it are too; a row with a null id revisits.  No payload takes part,
    and a payload that very many pages have is joined in parts.
    """
    large = pages.where(F.col("n") >= least).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null").select("digest", "refers_to")
    return large.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page to archives under path, each record a gzip member; returns the index.

    The index (archive, offset, length, page_id, url, digest, record_type,
    refers_to) is a table beside the archives, so it outlives the job.  A null html is an
    empty payload and a null URL an empty one; an empty table writes nothing
    and indexes nothing.  Payloads are shuffled once.  A task writes its
    archive under a name of its own and then moves it to the archive's, so a
    task that runs again replaces what it wrote; the path must be one that
    pyarrow and Spark both reach.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    light = pages.select(F.col(id_col).alias("page_id"), F.octet_length(html).alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    total = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    kind = pages.schema[id_col].dataType.simpleString()

    # A page's revisit row, if it has one, comes just before it.
    revisits = find_revisits(light, least).select("page_id", "digest", F.lit(0).alias("order"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    both = revisits.unionByName(rows.withColumns({"order": F.lit(1), "refers_to": F.lit(None).cast(kind)}))
    dealt = both.withColumn("at", F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)).cast("int")).repartitionById(archives, F.col("at")).sortWithinPartitions("at", "page_id", "digest", "order", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(f"{path}/records")
        sink = own = name = None
        offset, revisit = 0, (None, None, None)

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(own, name)

        for batch in batches:
            out: list[tuple] = []
            id_type = batch.schema.field("page_id").type
            for page, digest, order, url, text, refers, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "order", "url")), batch.column("html").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("refers_to", "at")), strict=True):
                if order == 0:
                    revisit = (page, digest, refers)
                    continue
                if name != f"{folder}/{at:06d}.warc.gz":
                    close()
                    name, offset = f"{folder}/{at:06d}.warc.gz", 0
                    own = f"{name}.{uuid.uuid4().hex}"
                    store.create_dir(folder)
                    sink = store.open_output_stream(own, compression=None)
                to = revisit[2] if revisit[:2] == (page, digest) else None
                gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = gzip.compress(make_record(page, url, text, digest, to)) + gzip.flush()
                sink.write(data)
                out.append((f"{at:06d}.warc.gz", offset, len(data), page, url, digest, "response" if to is None else "revisit", to))
                offset += len(data)
            if out:
                archive, offsets, lengths, ids, urls, digests, types, to = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(archive, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(digests, pa.string()), pa.array(types, pa.string()), pa.array(to, id_type)],
                    names=["archive", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"],
                )
        close()

    dealt.mapInArrow(write, INDEX.format(id=kind)).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX.format(id=kind)).parquet(f"{path}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads: (offset, length, first range, last range + 1)."""
    first = 0
    while first < len(ranges):
        start, end, k = ranges[first][0], sum(ranges[first]), first + 1
        while k < len(ranges) and ranges[k][0] <= end + gap and max(end, sum(ranges[k])) - start <= most:
            end = max(end, sum(ranges[k]))
            k += 1
        yield start, end - start, first, k
        first = k


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC headers, length of the whole payload by the HTTP header, and the payload stored."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return fields, n, payload


def read_warc(index: DataFrame, path: str) -> DataFrame:
    """Read the records of the selected index rows.

    Returns page_id, url, record_type, refers_to, digest, n_payload (of the
    whole payload), payload (null for revisits).  Ranges are sorted within
    each archive and coalesced; only those bytes are read.  Selecting no rows
    reads nothing.
    """
    kind = index.schema["page_id"].dataType.simpleString()

    def page(urn: str | None) -> str | None:
        return None if urn is None or (name := urn[len("<urn:x-page:") : -1]) == "none" else name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(f"{path}/records")
        for batch in batches:
            by_archive: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_archive.setdefault(archive, []).append((offset, length))
            for archive, ranges in by_archive.items():
                ranges.sort()
                with store.open_input_file(f"{folder}/{archive}") as f:
                    for start, n, a, b in coalesced(ranges):
                        data, out = f.read_at(n, start), []
                        for offset, length in ranges[a:b]:
                            fields, n_payload, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                            revisit = fields["WARC-Type"] == "revisit"
                            out.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], page(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha1:"), n_payload, None if revisit else payload))
                        columns = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:5]], pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.binary())], names=["page_id", "url", "record_type", "refers_to", "digest", "n_payload", "payload"])

    # Dealt by the archives' numbers to a fixed number of tasks, which adaptive execution doesn't merge however small the index is.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = index.select("archive", "offset", "length").repartitionById(tasks, F.pmod(F.substring_index("archive", ".", 1).cast("int"), F.lit(tasks))).sortWithinPartitions("archive", "offset").mapInArrow(run, "page_id string, url string, record_type string, refers_to string, digest string, n_payload bigint, payload binary")
    return read.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def digest(read: DataFrame) -> DataFrame:
    """The report columns, from what was read back: a response's own bytes, and of a revisit those that it refers to."""
    own = read.select("page_id", "record_type", "refers_to", "digest", "n_payload", F.octet_length("payload").cast("bigint").alias("n_read"), F.sha1("payload").alias("sha1"))
    response = F.col("record_type") == "response"
    return own.select("page_id", F.when(response, F.col("n_read")).otherwise(F.col("n_payload")).alias("payload_bytes"), F.when(response, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages and read all of their records back."""
    path = path or shared_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to
FROM g"""
