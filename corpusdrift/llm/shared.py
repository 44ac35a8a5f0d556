"""What the operators of this package have in common."""

import os
import re
import sys
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing id where rows are matched or ordered; no table may use it as an id.
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares for cut lineages.

    Where ``spark.checkpoint.dir`` is unset, as in tests, the warehouse stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, lineage cut, safe
    against lost executors."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and the named columns, whatever else the table has."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most_bytes``, or a single row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, most_bytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


_rng = np.random.default_rng(77)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER_BYTES = _BYTES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PART = 1 << 18  # bytes hashed at once


def _powers(base: int) -> np.ndarray:
    powers = np.full(_PART, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


_UP, _DOWN = _powers(0x9E3779B97F4A7C15), _powers(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _part_hashes(raw: np.ndarray, of_byte: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(_BLANK[raw].view(np.int8), prepend=1, append=1))
    starts, ends = edges[0::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(of_byte[raw] * _UP[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8; ``lower`` takes A-Z as a-z.

    Words are what stands between ASCII white space.  A word's hash is a polynomial in its bytes, taken
    from one running sum over the text.
    """
    raw = raw or b""
    of_byte, data, out, at = _LOWER_BYTES if lower else _BYTES, np.frombuffer(raw, np.uint8), [], 0
    while at < len(raw):
        end = min(at + _PART, len(raw))
        if end - at == _PART:
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if not len(blanks):  # a word longer than a part
                rest = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(raw)
                word = raw[at:end].lower() if lower else raw[at:end]
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                at = end
                continue
            end = at + int(blanks[-1]) + 1
        out.append(_part_hashes(data[at:end], of_byte))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on all bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of ``length`` words, from the words' hashes."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factor, power = _MULTIPLIERS[seed], 1
    total = np.zeros(count, np.uint64)
    for shift in range(length):
        total += hashes[shift : shift + count] * np.uint64(power)
        power = power * factor % 2**64
    return mixed(total)


#: Bits of an array that says which numbers of a set there may be: 16 MB, however large the set.
FILTER_BITS = 27


def bit_filter(numbers: DataFrame) -> np.ndarray | None:
    """A bit for each value that the last bits of the numbers in a table of one column have; None if it is empty.

    Tasks combine the bits to words; all words together have a fixed size.
    """
    name = numbers.columns[0]
    bits = F.expr(f"bit_or(shiftleft(1L, CAST({name} & 63 AS int)))").alias("bits")
    found = numbers.groupBy(F.shiftright(F.col(name).bitwiseAND(2**FILTER_BITS - 1), 6).alias("word")).agg(bits).toArrow()
    if not found.num_rows:
        return None
    words = np.zeros(2**FILTER_BITS // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def in_filter(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each of the numbers may be in the set; all that are in it are."""
    at = (numbers & numbers.dtype.type(2**FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


_SPACE_AFTER_SPACE = re.compile(r"\s ")
_BREAK = re.compile(r"(?<=\S) ")


def space_pieces(text: str) -> tuple[str, list[str]]:
    """Cut a text before each space that follows a character other than white space.

    Returns the first piece and the others without their leading space.  A byte-level
    pre-tokenizer always cuts at these places, so pieces can be encoded one by one.
    """
    if _SPACE_AFTER_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    cuts = [m.start() for m in _BREAK.finditer(text)]
    if not cuts:
        return text, []
    ends = [*cuts[1:], len(text)]
    return text[: cuts[0]], [text[a + 1 : b] for a, b in zip(cuts, ends, strict=True)]


#: Fixed value: how byte-level vocabularies cut a text before the merges.
BYTE_LEVEL_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Remembered(dict):
    """What ``make`` gave for a key, for the keys seen lately.

    When ``most`` keys are known they become the old ones, and the old ones are forgotten;
    an old key that is asked for again is taken over.
    """

    def __init__(self, make, most: int, longest: int = 40) -> None:
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_PLAIN = "\u0250"  # letters below are letters in every version of Unicode


class PieceEncoder:
    """Encodes texts by a byte-level vocabulary, piece by piece and word by word.

    Words and pieces that were encoded before are remembered, so that ``encode_word``, which
    gives a word's ids as bytes, sees few of them twice.  ``special`` has the ids of
    strings that count as one token wherever they stand.
    """

    def __init__(
        self, encode_word: Callable[[str], bytes], special: dict[str, int], most: int = 400_000
    ) -> None:
        self.encode_word, self.special = encode_word, special
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = Remembered(encode_word, most // 4)
        self.first = Remembered(self._encode, most // 8)
        self.later = Remembered(self._encode_later, most)

    def _encode_later(self, piece: str) -> bytes:
        """Ids of a piece after a space; most pieces are a word, or a word and a full stop or comma."""
        if piece.isalpha():
            if piece.isascii() or max(piece) < _PLAIN:
                return self.encode_word(" " + piece)
        elif piece[-1:] in (".", ","):
            word = piece[:-1]
            if word.isalpha() and (word.isascii() or max(word) < _PLAIN):
                return self.later[word] + self.words[piece[-1]]
        return self._encode(" " + piece)

    def _encode(self, piece: str) -> bytes:
        ids: list[bytes] = []
        start = 0
        for found in self.cut.finditer(piece) if self.cut else ():
            ids += map(self.words.__getitem__, BYTE_LEVEL_WORDS.findall(piece[start : found.start()]))
            ids.append(self.special[found[0]].to_bytes(4, "little"))
            start = found.end()
        ids += map(self.words.__getitem__, BYTE_LEVEL_WORDS.findall(piece[start:]))
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        first, rest = space_pieces(text)
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
