"""Token ids of documents as compressed binary files with random access.

A data set is a folder with ``dictionary`` (one row: the shared zstandard dictionary and its
SHA-256) and ``shards`` (binary files in ascending ``doc_id`` order).  A file is a row of
shards, each followed by ``END``.  A shard, all numbers little-endian:

    magic      8 bytes
    file       uint32, the file's number in the order of all documents
    dictionary 32 bytes, SHA-256 of the dictionary the frames need
    documents  uint32
    index      documents x (doc_id int64, has_id uint8, start uint64 in the file's ids,
               n_tokens uint64, frame offset uint64, frame size uint64)
    frames     one zstandard frame for each document: its ids as uint32

One document is read by seeking its frame through the index; no other frame is touched.
"""

import hashlib
import json
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusdrift.llm import shared

MAGIC = b"TIDSHRD2"
END = "\nTIDSEND\n"
INDEX = np.dtype(
    [("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n_tokens", "<u8"), ("offset", "<u8"), ("size", "<u8")]
)

DICTIONARY_BYTES = 64 * 1024
#: About so many documents, spread over all by a hash, and at most so many bytes of ids train the dictionary.
DICTIONARY_DOCUMENTS = 2_000
DICTIONARY_SAMPLE_BYTES = 24_000_000
SHARD_BYTES = 2_000_000
FILE_BYTES = 16_000_000


class Encoder:
    """The tokenizers library; byte-level vocabularies are given to it word by word.

    Such a vocabulary never merges over the cuts between words, so the ids are those of the
    whole text, and each word is encoded once as long as it is remembered.
    """

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(content)
        before, added = data["pre_tokenizer"] or {}, data["added_tokens"]
        by_words = (
            data["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not data["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
        )
        self.model, self.letters = self.tokenizer.model, {b: ord(c) for c, b in shared.byte_letters().items()}
        self.pieces = shared.PieceEncoder(self._word, {t["content"]: t["id"] for t in added}) if by_words else None

    def _whole(self, text: str) -> bytes:
        return shared.id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        raw = word if word.isascii() else word.encode().decode("latin-1")
        tokens = self.model.tokenize(raw.translate(self.letters))
        return shared.id_bytes([token.id for token in tokens])

    def encode(self, text: str) -> bytes:
        return self.pieces.encode(text) if self.pieces else self._whole(text)


@cache
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, content, end_id: int) -> bytes:
    """A dictionary from the ids of some documents; empty if there are too few to train one."""
    count = docs.count()
    every = max(1, count // DICTIONARY_DOCUMENTS)
    # By the text too, so that rows without id don't all come or stay away together.
    chosen = shared.texts(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples, total = _encoder(content.value), [], 0
        for batch in shared.slices(batches):
            for text in batch.column(1).to_pylist():
                if total < DICTIONARY_SAMPLE_BYTES:
                    samples.append(encoder.encode(text or "") + end_id.to_bytes(4, "little"))
                    total += len(samples[-1])
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
        except zstandard.ZstdError:
            raw = b""
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["dictionary"])

    # repartition(1): the few chosen rows meet in one task, after a parallel scan.
    rows = chosen.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    trained = [row.dictionary for row in rows.mapInArrow(train, "dictionary binary").collect()]
    return bytes(trained[0]) if trained else b""


def _frames(docs: DataFrame, content, raw: bytes, end_id: int) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw))
        for batch in shared.slices(batches):
            sizes, frames = [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "") + end
                sizes.append(len(ids) // 4)
                frames.append(compressor.compress(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())],
                ["doc_id", "n_tokens", "frame"],
            )

    return shared.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def _shard(rows: list[tuple], start: int, dictionary_hash: bytes, file: int) -> bytes:
    index = np.zeros(len(rows), INDEX)
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    tokens = np.array([r[1] for r in rows], np.int64)
    index["doc_id"] = [r[0] or 0 for r in rows]
    index["has_id"] = [r[0] is not None for r in rows]
    index["start"] = start + np.cumsum(tokens) - tokens
    index["n_tokens"], index["size"] = tokens, sizes
    head = len(MAGIC) + 40 + index.nbytes
    index["offset"] = head + np.cumsum(sizes) - sizes
    parts = [MAGIC, file.to_bytes(4, "little"), dictionary_hash, len(rows).to_bytes(4, "little"), index.tobytes()]
    return b"".join(parts + [r[2] for r in rows])


def write(docs: DataFrame, path: str, vocabulary_file: str, end_id: int, first_file: int = 0) -> None:
    """Encode every whole text, append ``end_id`` and write the data set to ``path``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A null text counts as empty (the end
    id alone).  Documents without id come first; rows of equal id are all kept, one after
    another, in as many files as they take.  An empty table gives a data set without documents; a very long text
    is one frame.  Files are numbered from ``first_file`` on.
    """
    spark = docs.sparkSession
    with open(vocabulary_file, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())  # one file, a few MB
    raw = train_dictionary(docs, content, end_id)
    digest = hashlib.sha256(raw).digest()
    row = spark.createDataFrame([(digest.hex(), bytearray(raw))], "sha256 string, dictionary binary")
    row.coalesce(1).write.parquet(f"{path}/dictionary")
    # Written first: choosing the ranges would otherwise encode everything twice.
    frames = shared.written(_frames(docs, content, raw, end_id))
    total = frames.agg(F.sum(F.length("frame") + 64)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, start, file = [], 0, 0, first_file + TaskContext.get().partitionId()
        for batch in shared.slices(batches):
            for r in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if rows and size + len(r[2]) > SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([_shard(rows, start, digest, file)], pa.binary())], ["value"])
                    start, rows, size = start + sum(x[1] for x in rows), [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([_shard(rows, start, digest, file)], pa.binary())], ["value"])

    # Rows of one id may be a large share of all: they are dealt out by their content, copies by chance.
    order = [F.col("doc_id").asc_nulls_first(), "content", "deal"]
    (
        frames.withColumns({"content": F.xxhash64("frame"), "deal": F.rand(7)})
        .repartitionByRange(max(1, math.ceil(total / FILE_BYTES)), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))  # the same bytes: the sink takes strings
        .write.option("lineSep", END)
        .text(f"{path}/shards")
    )


def parse_shards(content: bytes, raw: bytes, wanted: set[int] | None = None) -> Iterator[tuple]:
    """``doc_id, start, ids, file`` of a file's documents; of the wanted ones only, if ids are given."""
    digest, end = hashlib.sha256(raw).digest(), END.encode()
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    at = 0
    while at < len(content):
        head = at + len(MAGIC) + 40
        if content[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        file = int.from_bytes(content[at + len(MAGIC) : at + len(MAGIC) + 4], "little")
        if content[at + len(MAGIC) + 4 : head - 4] != digest:
            raise ValueError("the shard was written with another dictionary")
        count = int.from_bytes(content[head - 4 : head], "little")
        index = np.frombuffer(content, INDEX, count, head)
        for entry in index:
            doc_id = int(entry["doc_id"]) if entry["has_id"] else None
            if wanted is None or doc_id in wanted:
                begin = at + int(entry["offset"])
                ids = reader.decompress(content[begin : begin + int(entry["size"])])
                if len(ids) != 4 * int(entry["n_tokens"]):
                    raise ValueError(f"document {doc_id} has another length than its index says")
                yield doc_id, int(entry["start"]), ids, file
        at += int(index[-1]["offset"]) + int(index[-1]["size"])
        if content[at : at + len(end)] != end:
            raise ValueError(f"the shard before byte {at} is cut short")
        at += len(end)


def read(
    spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False
) -> DataFrame:
    """The documents of a data set: ``doc_id, file, file_start, n_tokens, ids_crc32`` and, if
    asked for, ``ids``; of the given ids only, if there are some.

    ``file`` is the number that the file has in itself, whatever its name; ``file_start`` counts its ids before the document.
    """
    found = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(found.dictionary)  # at most DICTIONARY_BYTES
    if hashlib.sha256(raw).hexdigest() != found.sha256:
        raise ValueError("the dictionary isn't the one that its hash names")
    wanted = None if doc_ids is None else set(doc_ids)
    names = ["doc_id", "file", "file_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for doc_id, start, ids, file in parse_shards(content.as_py(), raw, wanted):
                    out.append((doc_id, file, start, len(ids) // 4, zlib.crc32(ids), ids))
                    size += len(ids) if with_ids else 0
                    if len(out) >= 10_000 or size > 8_000_000:
                        yield _batch(out, names)
                        out, size = [], 0
                if out:
                    yield _batch(out, names)

    schema = "doc_id long, file long, file_start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/shards")
    return files.select("content").mapInArrow(rows, schema + ", ids array<long>" * with_ids)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    if len(names) > 5:
        columns.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names)


def with_starts(documents: DataFrame) -> DataFrame:
    """Replace ``file`` and ``file_start`` by ``start``: the ids of all documents before.

    Files hold ranges of ``doc_id`` in ascending order, numbered in that order; the sums run over one
    row for each file.
    """
    rows = shared.written(documents)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, "file").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )
