"""Quality rules for documents, with lines that are frequent across a host's documents.

Navigation, notices and other boilerplate stand in many documents of one host.  Lines are
normalised and hashed; a line that stands in more than a share of the host's distinct
documents is removed, and a document that loses most of its words that way is rejected.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusdrift.llm import shared

#: A line is frequent in more than so many percent of a host's distinct documents, and at least so many of them.
LINE_PERCENT, LINE_DOCUMENTS = 1, 5
#: A document that keeps fewer than so many percent of its words is depleted.
KEPT_PERCENT = 50
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_DIGITS = str.maketrans("123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "000000000" + "abcdefghijklmnopqrstuvwxyz")
_SYMBOLS = "#*$%&|<>"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FACTS = (
    "doc_id long, host string, content long, "
    + ", ".join(f"{c} long" for c in _BASE)
    + ", lines array<struct<line: long, words: long>>"
)


def normal_line(line: str) -> str:
    """A line without regard to A-Z's case, to digits and to white space; empty if it has no word."""
    return _SPACE.sub(" ", line.translate(_DIGITS)).strip(" ")


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - 2**63


def repeated_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` words that are found twice or more."""
    windows = shared.window_hashes(hashes, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    covered = np.zeros(len(hashes), bool)
    for shift in range(size):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def _facts(docs: DataFrame, host: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            base, contents, lines = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw = text.encode()
                words = shared.word_hashes(raw)
                seen: dict[int, list[int]] = {}
                exact, repeated = set(), 0
                for line in text.split("\n"):
                    plain = normal_line(line)
                    if plain:
                        repeated += line in exact
                        exact.add(line)
                        seen.setdefault(line_hash(plain), []).append(plain.count(" ") + 1)
                blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
                base.append(
                    (
                        len(words),
                        len(text) - blanks,
                        sum(map(text.count, _SYMBOLS)),
                        repeated,
                        repeated_words(words),
                    )
                )
                contents.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                lines.append([{"line": k, "words": sum(v)} for k, v in seen.items()])
            kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
            columns = [batch.column(0), batch.column(2), pa.array(contents, pa.int64())]
            columns += [pa.array([b[i] for b in base], pa.int64()) for i in range(len(_BASE))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, kind)], ["doc_id", "host", "content", *_BASE, "lines"]
            )

    named = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    return shared.texts(docs, named).mapInArrow(run, FACTS)


def frequent_lines(facts: DataFrame, percent: int, documents: int) -> DataFrame:
    """``host, line`` of the lines above both limits; equal texts count as one document."""
    distinct = facts.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    lines = facts.select("host", "content", F.explode("lines.line").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.where(F.col("n") >= documents)
        .join(distinct, "host")
        .where(F.col("n") * 100 > F.col("of") * percent)
        .select("host", "line")
    )


def judge_documents(
    docs: DataFrame,
    host: str = "source",
    percent: int = LINE_PERCENT,
    documents: int = LINE_DOCUMENTS,
    kept_percent: int = KEPT_PERCENT,
    with_text: bool = False,
) -> DataFrame:
    """Figures and verdict for every document, and if asked for its text without frequent lines.

    Takes ``doc_id``, ``text`` and the host column; other columns are ignored.  Returns one row for
    each input row: ``doc_id``, the base figures, ``base_failed``, ``n_words_removed`` (words in frequent
    lines), ``kept`` (neither the base rules failed nor the document is depleted) and, if asked for,
    ``clean_text``.  A null text counts as empty, which fails the base rules; a null host counts as
    the host named by the empty string.  Repeated rows count as one document and get the same
    result.  Lines without a word are ignored.
    """
    facts = shared.written(_facts(docs, host))
    frequent = shared.written(frequent_lines(facts, percent, documents))
    each = facts.select("host", "doc_id", "content", F.explode("lines").alias("l"))
    removed = (
        each.select("host", "doc_id", "content", "l.line", "l.words")
        .distinct()
        .join(frequent, ["host", "line"])
        .withColumn("key", F.coalesce("doc_id", F.lit(shared.NO_ID)))
        .groupBy("key", "host", "content")
        .agg(F.sum("words").alias("n_words_removed"), F.collect_set("line").alias("gone"))
    )
    keyed = facts.drop("lines").withColumn("key", F.coalesce("doc_id", F.lit(shared.NO_ID)))
    gone = F.coalesce("n_words_removed", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    depleted = (F.col("n_words") - gone) * 100 < F.col("n_words") * kept_percent
    judged = keyed.join(removed, ["key", "host", "content"], "left").select(
        "doc_id",
        *_BASE,
        failed.alias("base_failed"),
        gone.alias("n_words_removed"),
        (~failed & ~depleted).alias("kept"),
        *(["key", "host", "content", "gone"] if with_text else []),
    )
    return _with_text(docs, judged, host) if with_text else judged


def _with_text(docs: DataFrame, judged: DataFrame, host: str) -> DataFrame:
    """The judged rows with their texts, without the lines that are gone."""
    columns = [c for c in judged.columns if c not in ("key", "host", "content", "gone")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            texts = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for x in text.split("\n") if line_hash(normal_line(x)) not in gone)
                texts.append(text)
            rest = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*columns, "clean_text"])

    named = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    texts = _content(shared.texts(docs, named)).withColumn("key", F.coalesce("doc_id", F.lit(shared.NO_ID)))
    one = judged.dropDuplicates(["key", "host", "content"]).drop("doc_id")
    joined = texts.join(one, ["key", "host", "content"]).select("text", "gone", *columns)
    schema = StructType([*judged.select(*columns).schema.fields, StructField("clean_text", StringType())])
    return joined.mapInArrow(run, schema)


def _content(rows: DataFrame) -> DataFrame:
    """The rows with the same hash of the text that the figures carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            found = [xxhash.xxh3_64_intdigest(t or b"") - 2**63 for t in shared.raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "content"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", LongType())]))
