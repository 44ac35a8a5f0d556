"""Removal of repeated passages, found by difference-cover anchors.

A passage of ``window`` words that stands in two places is to be found without hashing every
window of the corpus.  Positions are looked at modulo a period, and only those of a
difference cover are hashed: for any two positions there is a shift, smaller than the period,
that takes both to cover positions.  So whenever two windows are equal, some anchor (a run of
``window - period + 1`` words) at the same shift in both is hashed in both.  Anchors that
occur once in the corpus are dropped; the others are extended to the whole windows that
hold them, and these are compared by a hash of all their words.

With the period 13 and its cover of 4 positions, 31 of 100 positions are hashed.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusdrift.llm import shared

WINDOW = 20
#: For each period, positions whose differences give every residue.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
LEAST_ANCHOR = 4

#: A document takes one or more slots of so many words; slots are numbered in the order of documents.
#: A position is a slot and a word in it, so one number says where in the corpus a window is, and which is first.
_SLOT_BITS = 10
#: The bit of a place that says it is known to be repeated; the others are the position.
_SURE = 47
#: An anchor's place holds the first slot, 15 bits of the position and 1 bit that says it is known to be repeated.
_PLACES = 2**15


def cover(window: int) -> tuple[int, np.ndarray]:
    """The largest period that leaves an anchor of enough words, and its cover as flags."""
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=1)
    flags = np.zeros(period, bool)
    flags[list(COVERS.get(period, (0,)))] = True
    return period, flags


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _packed(rows: DataFrame) -> DataFrame:
    """``doc_id, content, content_2, rest, packed``: texts as they are shuffled, once for all steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in shared.slices(batches):
            packed = [packer.compress(text) for text in shared.raw_texts(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], _PACKED)

    given = rows.select("doc_id", "content", "content_2", "rest", "text")
    return given.mapInArrow(run, StructType([*given.schema.fields[:4], StructField("packed", BinaryType())]))


_PACKED = ["doc_id", "content", "content_2", "rest", "packed"]
#: A document: an id, and which of its texts.
_KEY = ["doc_id", "content", "content_2"]


def _texts(column: pa.Array) -> list[bytes]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(x) for x in column.to_pylist()]


def _repeats(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: whether a row's key is that of the row before, and where its key begins."""
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    for x in more:
        same[1:] &= x[1:] == x[:-1]
    return same, np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """``hash`` and ``place``, one row for each cover position.

    Anchors that a batch holds twice are marked as known to be repeated, and but for one go
    under hashes of their own: no hash has more rows than there are batches.
    """
    period, flags = cover(window)
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            found, places = [], []
            for slot, text in zip(batch.column(5).to_pylist(), _texts(batch.column(4)), strict=True):
                words = shared.word_hashes(text)
                if len(words) < window:
                    continue
                runs = shared.window_hashes(words, length)
                at = np.flatnonzero(flags[np.arange(len(runs)) % period])
                found.append(runs[at] >> np.uint64(16))
                places.append((slot << 16) | ((at % _PLACES) << 1))
            if found:
                value, place = np.concatenate(found), np.concatenate(places)
                order = np.argsort(value, kind="stable")
                same, first = _repeats(value[order])
                again = same.copy()
                again[first[same]] = True
                place[order] |= again
                spread = shared.mixed(value ^ shared.mixed(place.view(np.uint64))) >> np.uint64(16)
                value[order[same]] = spread[order[same]]
                yield pa.RecordBatch.from_arrays([_signed(value), pa.array(place)], ["hash", "place"])

    return docs.select(*_PACKED, "slot").mapInArrow(run, "hash long, place long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``hash``, 16 bits of a second hash, and ``place`` of the windows that hold a repeated anchor.

    Of equal windows in one batch the first goes on; the others are known to be repeated
    and go under hashes of their own, so that no hash has more rows than there are batches.
    """
    period, _ = cover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            found, checks, places = [], [], []
            columns = batch.column(5).to_pylist(), _texts(batch.column(4)), batch.column(6)
            for slot, text, anchors in zip(*columns, strict=True):
                values = shared.word_hashes(text)
                count = len(values) - window + 1
                if count <= 0:
                    continue
                edge = np.zeros(count + 1, np.int64)
                low = anchors.values.to_numpy()  # positions modulo _PLACES
                for base in range(0, len(values), _PLACES):
                    at = low + base
                    at = at[at < count + period - 1]
                    np.add.at(edge, np.maximum(at - period + 1, 0), 1)
                    np.add.at(edge, np.minimum(at + 1, count), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                found.append(shared.window_hashes(values, window)[starts])
                checks.append((shared.window_hashes(values, window, 1)[starts] >> np.uint64(64 - 16)).astype(np.int64))
                places.append(starts + (slot << _SLOT_BITS))
            if found:
                value, check, place = map(np.concatenate, (found, checks, places))
                order = np.lexsort((place, check, value))
                value, check, place = value[order], check[order], place[order]
                sure, first = _repeats(value, check)
                sure &= place != place[first]  # a row that stands twice in the table isn't a repeat of itself
                spread = shared.mixed(place.view(np.uint64))
                place = place | (sure.astype(np.int64) << _SURE)
                columns = [_signed(np.where(sure, spread, value)), pa.array(check), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "check", "place"])

    return docs.select(*_PACKED, "slot", "anchors").mapInArrow(run, "hash long, check long, place long")


def _numbered(documents: DataFrame) -> DataFrame:
    """The distinct documents with ``slot``, their first one, and ``slots``, how many they take, in their order.

    Ranges of documents are numbered by themselves, then moved behind the ranges before, of which
    there is a row for each.
    """
    schema = StructType([*documents.select(*_KEY, "slots").schema.fields]).add("part", "long").add("before", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            slots = batch.column(3).to_numpy()
            ends = before + np.cumsum(slots)
            columns = [*batch.columns, pa.array(np.full(len(slots), part, np.int64)), pa.array(ends - slots)]
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    spread = documents.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "slots")
    rows = shared.written(spread.mapInArrow(run, schema))
    parts = rows.groupBy("part").agg(F.sum("slots").alias("taken"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("taken").over(earlier), F.lit(0)).alias("base"))
    return rows.join(parts, "part").select(*_KEY, (F.col("base") + F.col("before")).alias("slot"), "slots")


def _cut(docs: DataFrame, window: int, as_given: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            sizes, gone, kept = [], [], []
            for text, copy, starts in zip(
                _texts(batch.column(4)), batch.column(5).to_pylist(), batch.column(6), strict=True
            ):
                words = text.split()
                sizes.append(len(words))
                if copy and len(words) >= window:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    at = at[at <= len(words) - window]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, out in zip(words, covered.tolist(), strict=True) if not out]
                gone.append(sizes[-1] - len(words))
                kept.append(text if as_given and not gone[-1] else b" ".join(words))
            numbers = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), *numbers, pa.array(kept, pa.binary()).cast(pa.string())],
                ["key", "rest", "n_words", "n_removed", "kept_text"],
            )

    given = docs.select(F.col("doc_id").alias("key"), "content", "content_2", "rest", "packed", "copy", "starts")
    key, rest = (given.schema[c] for c in ("key", "rest"))
    out = StructType([key, rest]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return given.mapInArrow(run, out)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, keep: Sequence[str] = (), as_given: bool = False
) -> DataFrame:
    """Remove each word that a repeated window covers; of equal windows the first one stays.

    Takes ``doc_id``, ``text`` and the columns to ``keep``; others are ignored.  Words are what stands between
    ASCII white space.  A window is ``window`` consecutive words of one document; it is repeated if
    the same words also start earlier (smaller ``doc_id``, or same document and earlier start),
    judged on the input, not on what is left.

    Returns one row for each input row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one
    space) and the columns to keep.  With ``as_given`` texts of which nothing is removed come back as they
    are, null ones too.  A null or empty text has no words.  A missing ``doc_id`` counts as the smallest.  Rows
    of equal ``doc_id`` and equal text count as one document and get the same result;
    rows of equal ``doc_id`` and different text are documents of their own, in the order of a hash
    of the text.  Texts shorter than a window stay whole.
    """
    rest = F.struct(F.col("text").isNull().alias("no_text"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(shared.NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        rest.alias("rest"),
    )
    hashed = rows.withColumns({"content": F.xxhash64("text"), "content_2": F.xxhash64(F.lit(1), "text")})
    # Every step reads the same five columns of this, so that Spark shuffles them once.
    keyed = _packed(hashed)

    # One narrow row for each document: its slots, and whether an earlier one has the same text.
    # Such a copy is repeated as a whole.  A text of n characters has at most n / 2 + 1 words.
    slots = F.shiftright(F.length("text"), _SLOT_BITS + 1).cast("long") + 1
    narrow = shared.written(hashed.select(*_KEY, slots.alias("slots")).distinct())
    firsts = narrow.groupBy("content", "content_2").agg(F.min("doc_id").alias("first_id"))
    numbered = _numbered(narrow).join(firsts, ["content", "content_2"])
    facts = shared.written(numbered.select(*_KEY, "slot", "slots", (F.col("doc_id") > F.col("first_id")).alias("copy")))
    whole = facts.where("not copy").select(*_KEY, "slot")

    # Columns as they are shuffled: an expression here would travel as one more.
    same = Window.partitionBy("hash")
    repeated = (
        _anchors(keyed.join(whole, _KEY), window)
        .withColumn("n", F.count(F.lit(1)).over(same))
        .where((F.col("n") > 1) | (F.col("place").bitwiseAND(1) == 1))
        .groupBy(F.shiftright("place", 16).alias("slot"))
        .agg(F.collect_set(F.shiftright(F.col("place").bitwiseAND(0xFFFF), 1).cast("int")).alias("anchors"))
    )
    candidates = keyed.join(repeated.join(whole, "slot"), _KEY)

    position = F.col("place").bitwiseAND(2**_SURE - 1)
    equal = Window.partitionBy("hash", "check").orderBy("place")
    # Slots lead to documents; the starts in all slots of a document are its starts.
    of_slot = facts.select(*_KEY, F.col("slot").alias("first"), F.explode(F.expr("sequence(slot, slot + slots - 1)")).alias("slot"))
    within, shift = position.bitwiseAND(2**_SLOT_BITS - 1).cast("int"), (F.col("slot") - F.col("first")) * 2**_SLOT_BITS
    later = (
        _windows(candidates, window)
        .withColumn("rank", F.rank().over(equal))
        .where((F.shiftright("place", _SURE) == 1) | (F.col("rank") > 1))
        .groupBy(F.shiftright(position, _SLOT_BITS).alias("slot"))
        .agg(F.collect_set(within).alias("starts"))
        .join(of_slot, "slot")
        .groupBy(*_KEY)
        .agg(F.flatten(F.collect_list(F.transform("starts", lambda s: s + shift))).alias("starts"))
    )
    found = facts.join(later, _KEY, "left").where("copy or starts is not null")
    marked = keyed.join(found.select(*_KEY, "copy", "starts"), _KEY, "left")
    result = _cut(marked, window, as_given)
    text = F.when(~(F.col("rest.no_text") & F.lit(as_given)), F.col("kept_text"))
    return result.select(
        F.when(F.col("key") != shared.NO_ID, F.col("key")).alias("doc_id"),
        "n_words",
        "n_removed",
        text.alias("kept_text"),
        *(F.col(f"rest.kept_{c}").alias(c) for c in keep),
    )
