"""Extraction of parts and sections from gzipped XML title files.

The files are cut at every division start, so one record holds one section, one
appendix, or the head of a larger division.  No record ever holds a whole part:
a part with a third of the corpus is as many small records as it has sections.
A gzip file can only be read from front to back, hence one task per file; the
records are written to a stage table once and everything after that runs in
parallel over the table's row groups.  Comments and instructions are left out, and CDATA blocks
become text, while the records are put together.
"""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.functions import markup

DIVISION = "<DIV"
FILE_TITLE = r"([^/]+?)\.xml\.gz(?:ip)?$"
RECORDS = (
    "title_id string, file_path string, pos bigint, part_seq bigint, level int, type string, "
    "number string, heading string, authority string, ended boolean, unclosed int, value string"
)
_BIGGEST_SPLIT = str(2**62)


def unsplit_session(spark: SparkSession) -> SparkSession:
    """A session, sharing the context, whose file scans never cut a file in two.

    Spark decompresses files named ``.gzip`` but, unlike ``.gz``, also splits
    them, and a gzip stream cannot be entered in the middle.  Split sizes are a
    session setting, so such files are read in a session of their own.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", _BIGGEST_SPLIT)
    session.conf.set("spark.sql.files.openCostInBytes", _BIGGEST_SPLIT)
    return session


_NOT_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>", re.S)
_CLOSERS = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
_DIVISION_START = re.compile(r"([1-9])(?=[\s/>])")
_EMPTY_TAG = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*(?<=/)>""")


def _plain(found: re.Match) -> str:
    """CDATA as escaped text; nothing for comments and instructions."""
    return (found[1] or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Record:
    """A division that is put together from the pieces between two ``<DIV``.

    A piece belongs to the one before if ``<DIV`` stood in a comment, a CDATA block or an
    instruction, or began the name of another element.
    """

    def __init__(self, level: int, piece: str) -> None:
        self.level, self.parts, self.pending, self.closer = level, [], [], ""
        self.add(piece)

    def add(self, piece: str) -> None:
        if self.pending:
            ended = self.closer in self.pending[-1][-2:] + piece
            self.pending.append(piece)
            if not ended:
                return
            piece, self.pending = "".join(self.pending), []
        if "<!" in piece or "<?" in piece:
            piece = _NOT_MARKUP.sub(_plain, piece)
            open_at = min((at for o in _CLOSERS if (at := piece.find(o)) >= 0), default=-1)
            if open_at >= 0:
                opener = next(o for o in _CLOSERS if piece.startswith(o, open_at))
                self.closer, self.pending = _CLOSERS[opener], [piece[open_at:]]
                piece = piece[:open_at]
        self.parts.append(piece)

    def value(self) -> str:
        return "".join(self.parts + self.pending)


def _record_reader(
    part_level: int, batch_bytes: int = 4_000_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that puts each file's records together and numbers them and their parts.

    A file lies whole and in order in one task, so one record and a few counters are all that is
    carried from batch to batch.  Part 0 means outside any part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        path, record, pos, part, inside, size = None, None, 0, 0, False, 0

        def close() -> int:
            nonlocal pos, part, inside
            value = record.value()
            if record.level == part_level:
                part, inside = part + 1, True
            rows.append((path, pos, part if inside else 0, record.level, value))
            if f"</DIV{part_level}" in value or record.level == part_level and _EMPTY_TAG.match(value):
                inside = False
            pos += 1
            return len(value)

        for batch in batches:
            for file, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = _DIVISION_START.match(piece)
                if file != path:
                    size += close() if record else 0
                    path, record, pos, part, inside = file, _Record(0, piece), 0, 0, False
                elif start and not record.pending:
                    size += close()
                    record = _Record(int(start[1]), piece)
                else:
                    record.add(DIVISION + piece)
                if size > batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
        if record:
            close()
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _READ.split(", ")])

    return read


_READ = "file_path string, pos bigint, part_seq bigint, level int, value string"


def scan_records(
    spark: SparkSession,
    paths: str | list[str],
    title_pattern: str = FILE_TITLE,
    ignore_corrupt: bool = True,
) -> DataFrame:
    """Division records of gzipped XML files, see :data:`RECORDS`.

    What parts and checks need is cut out here, so that later steps read the
    ``value`` column for the text of sections only.  Unreadable files are skipped
    unless ``ignore_corrupt`` is off.  Pass a session from :func:`unsplit_session`
    for files named ``.gzip``.
    """
    value, level, tag = F.col("value"), F.col("level"), F.col("tag")
    division = F.concat(F.lit(DIVISION), value)
    closed = F.regexp_count(value, F.lit(r"</DIV[1-9]\s*>"))
    empty = tag.endswith("/>")

    def element(name: str) -> Column:
        return F.when(value.contains(f"<{name}"), markup.first_element(value, name))

    pieces = (
        spark.read.option("lineSep", DIVISION)
        .option("ignoreCorruptFiles", ignore_corrupt)
        .option("recursiveFileLookup", True)
        .text(paths)
        .select(F.col("_metadata.file_path").alias("file_path"), "value")
    )
    scanned = (
        pieces.mapInArrow(_record_reader(fv.PART_LEVEL), _READ)
        .withColumn("tag", F.when(level > 0, F.regexp_extract(division, "^" + markup.open_tag("DIV[1-9]"), 0)).otherwise(""))
        .select(
            F.regexp_extract("file_path", title_pattern, 1).alias("title_id"),
            "file_path",
            "pos",
            "part_seq",
            "level",
            markup.attribute(tag, fv.TYPE_ATTRIBUTE).alias("type"),
            markup.attribute(tag, fv.NUMBER_ATTRIBUTE).alias("number"),
            element(fv.HEADING_ELEMENT).alias("heading"),
            element(fv.AUTHORITY_ELEMENT).alias("authority"),
            (empty | F.regexp_like(value, _end_tag())).alias("ended"),
            ((level > 0).cast("int") - closed - empty.cast("int")).alias("unclosed"),
            "value",
        )
    )
    return scanned


def _end_tag() -> Column:
    """Pattern of the end tag of a record's own division."""
    return F.concat(F.lit("</DIV"), F.col("level").cast("string"), F.lit(r"\s*>"))


def _raw_id(kind: Column, number: Column) -> Column:
    """``TYPE-N``; NULL if either attribute is missing."""
    return F.concat(kind, F.lit("-"), number)


def _divisions(records: DataFrame) -> DataFrame:
    """Sections and appendices that lie inside a part."""
    return records.filter(
        F.col("level").isin(fv.SECTION_LEVEL, fv.APPENDIX_LEVEL) & (F.col("part_seq") > 0)
    ).withColumn("raw_id", _raw_id(F.col("type"), F.col("number")))


def extract_sections(records: DataFrame) -> DataFrame:
    """Sections and appendices of parts as ``title_id, raw_id, section_text``."""
    body = F.get(F.split("value", _end_tag(), 2), F.lit(0))
    # A division that ended without an end tag is an empty one.
    element = F.when(
        F.regexp_like("value", _end_tag()), F.concat(F.lit(DIVISION), body, F.lit("</DIV>"))
    ).otherwise("")
    return (
        _divisions(records)
        .filter(F.col("raw_id").isNotNull() & F.col("ended"))
        .select("title_id", "raw_id", markup.element_text(element).alias("section_text"))
    )


def rejects(records: DataFrame) -> DataFrame:
    """Divisions without id attributes or end tag, with their place in the file."""
    reason = F.when(F.col("raw_id").isNull(), "no id").otherwise("no end")
    return (
        _divisions(records)
        .filter(F.col("raw_id").isNull() | ~F.col("ended"))
        .select("title_id", "file_path", "pos", reason.alias("reason"))
    )


def extract_parts(records: DataFrame) -> DataFrame:
    """Parts as ``title_id, part_id, part_heading, part_authority``.

    Heading and authority are the first such element anywhere in the part, in
    document order.  Only heads, not texts, are shuffled, and only after each
    task has reduced them to one per part.
    """
    number = F.lpad("number", F.greatest(F.lit(fv.ID_WIDTH), F.length("number")), F.lit("0"))
    is_part = F.col("level") == fv.PART_LEVEL
    heads = records.filter(F.col("part_seq") > 0).withColumn(
        "part_id", F.when(is_part, _raw_id(F.col("type"), number))
    )

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("pos")))

    return (
        heads.groupBy("title_id", "file_path", "part_seq")
        .agg(
            F.max("part_id").alias("part_id"),
            first("heading").alias("heading"),
            first("authority").alias("authority"),
        )
        .filter(F.col("part_id").isNotNull())
        .select(
            "title_id",
            "part_id",
            markup.element_text(F.col("heading")).alias("part_heading"),
            markup.element_text(F.col("authority")).alias("part_authority"),
        )
    )


def sound_titles(records: DataFrame) -> DataFrame:
    """Titles all of whose files end as they should, one ``title_id`` each.

    A file that breaks off or is not the expected markup does not close every
    division it opens, or has none; nothing of such a title is kept.
    """
    return (
        records.groupBy("title_id", "file_path")
        .agg(F.sum("unclosed").alias("open"), F.max("level").alias("deepest"))
        .groupBy("title_id")
        .agg(F.max(F.abs("open")).alias("open"), F.min("deepest").alias("deepest"))
        .filter((F.col("open") == 0) & (F.col("deepest") > 0))
        .select("title_id")
    )
