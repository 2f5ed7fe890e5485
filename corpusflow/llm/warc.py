"""WARC archives with an index: written once, read by coalesced byte ranges.

Each task writes one archive of gzip members, a member per record, and returns
a row of the index for each: file, offset, length, URL and digest.  The stored
index names only the files of tasks that ended well; what a lost task left
behind is never read.  A reader takes any selection of index rows, sorts it by
file and offset and fetches neighbouring records with one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.session import work_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP = 64 << 10
SPAN = 8 << 20
BLOCK = 64 << 20

_INDEX = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "file string, offset long, length long")
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file, from a path or a URI as Hadoop writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record.  A revisit has the headers of the page but no payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record has not the length it states")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _writer(target: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(target)
        system.create_dir(root, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        out = None
        offset = 0
        try:
            for batch in batches:
                digests, offsets, lengths = [], [], []
                for page_id, url, html, revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in (
                        "page_id", "url", "html", "revisit", "refers_to"))):
                    out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode()
                    digest = digest_of(payload)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
                    out.write(member)
                    digests.append(digest)
                    offsets.append(offset)
                    lengths.append(len(member))
                    offset += len(member)
                kind = pa.array(["revisit" if r else "response" for r in batch.column("revisit").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), kind, batch.column("refers_to"),
                     pa.array(digests, pa.string()), pa.array([f"{target}/{name}"] * len(batch), pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["page_id", "url", "record_type", "refers_to", "payload_digest", "file", "offset", "length"])
        finally:
            if out:
                out.close()
    return run


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """Pages with revisit and refers_to.

    Only digests that several pages have are joined to the pages, so a list of
    ordinary size is broadcast and no page is moved.
    """
    rows = common.take(pages, "page_id", "url", "html")
    payload = F.coalesce("html", F.lit(""))
    sha = F.sha1(payload.cast("binary"))
    keys = rows.filter(F.octet_length(payload) >= least).select("page_id", sha.alias("sha"))
    repeated = (keys.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
                .filter("n > 1 and last is not null").select("sha", "last"))
    repeated = common.stored(repeated, "repeated_payloads")
    joined = common.join_small(rows.withColumn("sha", sha), repeated, "sha", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"),
                         F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, target: str, least: int = 0, level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` below ``target``; returns the stored index.

    Uses page_id, url and html.  Of pages with an equal payload of ``least``
    bytes or more, the one with the largest page_id is the response and the
    others revisit it.  A null html is an empty payload; a null url is named
    after the page.  A null page_id is below all others; without any page_id
    all are responses, as are repeated rows of the largest one.
    """
    common.ready(pages.sparkSession)
    return common.stored(_marked(pages, least).mapInArrow(_writer(target, level), _INDEX), "warc_index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """(offset, length, numbers of the rows within) of reads that cover ascending (offset, length) rows."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(rows):
        if out:
            begin, size, inside = out[-1]
            end = max(begin + size, offset + length)
            if offset - (begin + size) <= gap and end - begin <= span:
                inside.append(i)
                out[-1] = (begin, end - begin, inside)
                continue
        out.append((offset, length, [i]))
    return out


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            sizes, digests, kinds, bodies = [], [], [], []
            for first, last in _runs(column["file"]):
                system, path = _place(column["file"][first])
                with system.open_input_file(path) as source:
                    rows = [*zip(column["offset"][first:last], column["length"][first:last])]
                    for begin, size, inside in ranges(rows):
                        source.seek(begin)
                        data = source.read(size)
                        for i in inside:
                            at = rows[i][0] - begin
                            head, http, payload = parse(zlib.decompress(data[at:at + rows[i][1]], 31))
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if head["WARC-Type"] == "response" and (
                                    digest_of(payload) != digest or len(payload) != int(http["Content-Length"])):
                                raise ValueError("a payload doesn't agree with its digest")
                            kinds.append(head["WARC-Type"])
                            digests.append(digest)
                            sizes.append(int(http["Content-Length"]))
                            bodies.append(payload)
            arrays = [batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                      pa.array(kinds, pa.string()), batch.column("refers_to"), batch.column("url")]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
            if payloads:
                arrays.append(pa.array(bodies, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def _runs(values: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of equal values."""
    begin = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[begin]:
            yield begin, i
            begin = i


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the given index rows, with payload_bytes and payload_digest as the archives have them.

    payload_bytes and payload_digest of a revisit are those of the full payload,
    as its headers state them; its payload, if asked for, is empty.
    """
    block = F.floor(F.col("offset") / BLOCK).alias("block")
    rows = (index.select("page_id", "url", "refers_to", "file", "offset", "length", block)
            .repartition("file", "block").sortWithinPartitions("file", "offset").drop("block"))
    return rows.mapInArrow(_reader(payloads), _RECORD + (", payload binary" if payloads else ""))


def op3_warc(spark, folder):
    """All pages written as WARC and read back."""
    index = write_archives(common.table(spark, folder, "pages"), work_path(spark, "warc"))
    return read_records(index)


# SHA-1 as base32: eight groups of 20 bits, each as four letters.
OP3_SQL = """
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
last AS (SELECT sha, max(page_id) AS last, count(*) AS n FROM rows GROUP BY sha),
bits AS (
  SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
      CAST('0x' || substr(sha, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * p)) & 31 AS BIGINT) + 1, 1), ''
      ORDER BY g, p) AS digest
  FROM last, (SELECT unnest(range(8)) AS g), (SELECT unnest(range(4)) AS p) GROUP BY sha)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to, url
FROM rows JOIN last USING (sha) JOIN bits USING (sha)
"""
