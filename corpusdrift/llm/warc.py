"""Web archives: a writer with revisit records and a reader that salvages damaged files.

Records are gzip members of their own.  The reader checks every record it finds: the gzip
trailer, the version line, the header block, the content length, the two closing line ends and
the payload digest.  Where a check fails it looks for the next place at which a gzip member or a
version line begins, goes on from there, and logs the bytes between as quarantined.  The content
of a member is read likewise, as far as it can be unpacked.
"""

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift.llm import shared

VERSION = b"WARC/1.1"
#: Files of about so many bytes of records before compression.
FILE_BYTES = 32_000_000
#: Bytes in which the end of a header is looked for at first, and how far the next bytes overlap them.
HEADER_STEP, HEADER_OVERLAP = 65_536, 64
#: Records with payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member; it stands after every record, as the sink wants a separator.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+")
_VERSION = re.compile(rb"WARC/\d")
_FIRST_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_OTHER_LINE = re.compile(rb"\nWARC/\d+\.\d+\r\n")
_START = re.compile(re.escape(MEMBER) + rb"|WARC/\d")
_DATE = b"2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record; a revisit has no block, but the size and digest of the payload it stands for."""
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Date: " + _DATE,
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
        b"Content-Type: text/html; charset=utf-8",
        b"X-Payload-Length: %d" % len(payload),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + b" ".join(url.encode().split()))
    if is_revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    block = b"" if is_revisit else payload
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join([*head, b"", block, b"", b""])


def write(pages: DataFrame, path: str, least_bytes: int = REVISIT_BYTES) -> None:
    """Write one record for each row of ``page_id, url, html`` into archives under ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the largest
    ``page_id`` becomes a response and the others revisit it.  A null html is an empty payload; a null url
    is left out; a null ``page_id`` counts as the smallest, and where all equal pages have none, one is not
    told from the other: all are responses.  Rows of equal ``page_id`` and payload are all responses
    or all revisits.  Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sum", F.unhex(F.sha2("payload", 256)))
    newest = rows.groupBy("sum").agg(F.max("page_id").alias("refers_to"))
    size = F.octet_length("payload")
    revisit = (size >= least_bytes) & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    # Narrow rows settle what each page is; equal payloads may be a large share of all.
    kinds = rows.select("page_id", "sum").distinct().join(newest, "sum").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    keyed = rows.withColumn("key", F.coalesce("page_id", F.lit(shared.NO_ID)))
    kinds = kinds.select(F.coalesce("page_id", F.lit(shared.NO_ID)).alias("key"), "sum", "refers_to")
    marked = keyed.join(kinds, ["key", "sum"], "left").withColumn("revisit", revisit)
    ordered = marked.select("page_id", "url", "payload", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            members = []
            for fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(packer.compress(record(*fields)) + packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    mean = rows.agg(F.avg(F.octet_length("payload") + 400)).first()[0] or FILE_BYTES
    (
        ordered.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))  # the same bytes: the sink takes strings
        .write.option("maxRecordsPerFile", max(1, math.ceil(FILE_BYTES / mean)))
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


class _Damaged(Exception):
    pass


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not _VERSION_LINE.fullmatch(lines[0]):
        raise _Damaged("no version line")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("header line without colon")
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in found or "warc-record-id" not in found:
        raise _Damaged("no type or no record id")
    return found


def _parse(data: bytes, start: int) -> tuple[dict, bytes, int]:
    """The record that starts at a byte of plain data: fields, block, end."""
    if not _FIRST_LINE.match(data, start):
        raise _Damaged("no version line")
    # A header ends before the next version line; looking no further keeps a row of broken headers cheap.
    near = start + HEADER_STEP
    limit = _next(_OTHER_LINE, data, start, near)
    stop = data.find(b"\r\n\r\n", start, limit + 4)
    if stop < 0 and limit == near:
        limit = _next(_OTHER_LINE, data, near - HEADER_OVERLAP)
        stop = data.find(b"\r\n\r\n", start, limit + 4)
    if stop < 0 or stop > limit:
        raise _Damaged("header without end")
    fields = _fields(data[start:stop])
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Damaged("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Damaged("block doesn't end where its length says")
    block = data[begin:end]
    named = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and named.startswith("sha1:") and named[5:] != digest(block):
        raise _Damaged("payload digest differs")
    return fields, block, end + 4


def _member(data: bytes, start: int, step: int = 65_536) -> tuple[bytes, int, str]:
    """The content of the gzip member at a byte, as far as it unpacks, the byte after it, and what is wrong."""
    packer, parts, at = zlib.decompressobj(31), [], start
    while not packer.eof and at < len(data):
        before = packer.copy()
        try:
            parts.append(packer.decompress(data[at : at + step]))
        except zlib.error as error:
            try:  # what comes before the damage
                while at < len(data):
                    parts.append(before.decompress(data[at : at + 1]))
                    at += 1
            except zlib.error:
                pass
            return b"".join(parts), at, f"gzip: {error}"
        at += step
    return b"".join(parts), min(at, len(data)) - len(packer.unused_data), "" if packer.eof else "gzip member cut short"


def _next(pattern: re.Pattern, data: bytes, start: int, end: int | None = None) -> int:
    """The next byte at which the pattern stands, or the end."""
    end = len(data) if end is None else min(end, len(data))
    found = pattern.search(data, start, end)
    return found.start() if found else end


def _unpacked(content: bytes, prove: bool) -> tuple[list[tuple[dict, bytes]], list[str]]:
    """The records of a member's content, and what is wrong between them; ``prove`` takes only
    records whose payload digest is there and right."""
    found, gaps, place, gap, reason = [], [], 0, None, ""
    while place < len(content):
        try:
            fields, block, end = _parse(content, place)
            if prove and (fields["warc-type"] == "revisit" or not fields.get("warc-payload-digest", "").startswith("sha1:")):
                raise _Damaged("no digest proves the record")
        except _Damaged as error:
            if gap is None:
                gap, reason = place, str(error)
            place = _next(_VERSION, content, place + 1)
            continue
        if gap is not None:
            gaps.append(f"{reason}, in bytes {gap} to {place} of the content")
            gap = None
        found.append((fields, block))
        place = end
    if gap is not None:
        gaps.append(f"{reason}, in bytes {gap} to {len(content)} of the content")
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple]:
    """``("record", start, end, fields, block)`` and ``("gap", start, end, reason, None)`` of an archive's bytes.

    Members of the archive may be compressed, plain or mixed.  All offsets are bytes of the file; the reason of
    a gap inside a member also has the bytes of its content.  Records of a damaged member lie in its gap; where
    the damage isn't just a missing tail, only those that their payload digest proves are taken.
    """
    at, gap, reason, kept, reach = 0, None, "", [], 0
    while at < len(data):
        found, problem, inside, end = [], "", [], at
        try:
            if data.startswith(MEMBER, at):
                content, end, problem = _member(data, at)
                found, inside = _unpacked(content, problem.startswith("gzip:"))
            elif _VERSION.match(data, at):
                fields, block, end = _parse(data, at)
                found = [(fields, block)]
            else:
                problem = "neither member nor version line"
        except _Damaged as error:
            problem = str(error)
        if problem:
            if gap is None:
                gap, reason = at, "; ".join([problem, *inside])
            elif found:
                reason += "; " + "; ".join([problem, *inside])
            kept, reach = kept + found, max(reach, end)
            at = _next(_START, data, at + 1)
            continue
        if gap is not None and at < reach and not data.startswith(MEMBER, at) and found[0] in kept:
            at = end  # stored in a member without compression, and unpacked before
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            for fields, block in kept:
                yield "record", gap, at, fields, block
            gap, kept = None, []
        for text in inside:
            yield "gap", at, end, text, None
        for fields, block in found:
            yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None
        for fields, block in kept:
            yield "record", gap, len(data), fields, block


READ = (
    "file string, start long, end long, problem string, record_type string, record_id string, url string, "
    "refers_to string, payload_bytes long, payload_digest string"
)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records of the archives under ``path``, and a row with ``problem`` for each quarantined gap.

    ``start`` and ``end`` are the bytes of the file that hold the record or the gap.  ``payload_bytes`` and
    ``payload_digest`` of a revisit are those of the payload it stands for.  An archive is read by one
    task, whole: archives larger than a task's memory are to be cut when they are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, size = [], 0
                for kind, start, end, told, block in salvage(content.as_py()):
                    if kind == "gap":
                        out.append((file, start, end, told, *[None] * 6) + (None,) * with_payload)
                        continue
                    of = lambda name, f=told: f.get(name)
                    sha = (of("warc-payload-digest") or f"sha1:{digest(block)}").removeprefix("sha1:")
                    length = of("x-payload-length") if of("warc-type") == "revisit" else None
                    length = int(length) if length and length.isdigit() else len(block)
                    row = (file, start, end, None, of("warc-type"), of("warc-record-id"), of("warc-target-uri"))
                    out.append((*row, of("warc-refers-to"), length, sha) + (block,) * with_payload)
                    size += len(block) if with_payload else 0
                    if len(out) >= 10_000 or size > 8_000_000:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = READ + ", payload binary" * with_payload
    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"]
    count = len(rows[0])
    columns = [pa.array([r[i] for r in rows], types[i]) for i in range(count)]
    return pa.RecordBatch.from_arrays(columns, names[:count])


def page_records(records: DataFrame) -> DataFrame:
    """The pages' records as the writer numbered them: ids instead of URNs; gaps are left out."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.where("problem is null").select(
        as_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )
