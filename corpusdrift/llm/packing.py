"""Documents packed into sequences by vector best-fit.

Every piece of a document has several sizes: its tokens, one document, and the cost of attention within it
(the square of its tokens).  A sequence has a capacity for each.  Pieces are placed from the largest to
the smallest; of the sequences that can take a piece under every capacity, one is chosen by what
it has left: the one whose weighted remainder after placing is shortest (``norm``), or the one whose remainder
points most the way of the piece (``dot``).

Only narrow rows travel: where a piece is and how long, never its ids.  They are dealt out over groups of bounded
size, each packed by one task; sequences that a group could not fill are packed again across groups.
"""

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import shared, token_store

#: About so many pieces are packed together.
GROUP_PIECES = 16_384
#: Sequences of the first packing with a larger share of tokens left are packed again.
LOOSE = 0.002


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds, and how the remainders are weighted."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        """The longest piece that an empty sequence can take."""
        return min(self.tokens, math.isqrt(self.attention))

    def __post_init__(self) -> None:
        if self.documents < 1 or self.longest < 1 or self.rule not in ("norm", "dot"):
            raise ValueError("every sequence must hold a document of a token, by the rule norm or dot")


class _Bins:
    """Open sequences by what they have left; those of equal remainders are one row."""

    def __init__(self, capacities: Capacities) -> None:
        self.capacities, self.made = capacities, 0
        self.full = np.array([capacities.tokens, capacities.documents, capacities.attention], np.int64)
        self.weights = np.array(capacities.weights)
        self.left, self.counts = np.empty((256, 3), np.int64), np.zeros(256, np.int64)
        self.rows: dict[tuple, int] = {}
        self.numbers: list[list[int]] = []

    def _add(self, left: np.ndarray, numbers: list[int]) -> None:
        key = tuple(left.tolist())
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.numbers)
            self.numbers.append([])
            if row == len(self.left):
                self.left, self.counts = np.concatenate([self.left, self.left]), np.concatenate([self.counts, 0 * self.counts])
            self.left[row] = left
        self.numbers[row] += numbers
        self.counts[row] += len(numbers)

    def _best(self, piece: np.ndarray) -> int | None:
        used = len(self.numbers)
        left = self.left[:used]
        fits = np.flatnonzero((self.counts[:used] > 0) & (left >= piece).all(axis=1))
        if not len(fits):
            return None
        if self.capacities.rule == "dot":
            return int(fits[np.argmax((left[fits] / self.full * (piece / self.full)) @ self.weights)])
        rest = (left[fits] - piece) / self.full
        return int(fits[np.argmin((rest * rest) @ self.weights)])

    def place(self, length: int, count: int) -> list[int]:
        """Sequences for so many pieces of one length, as if they were placed one by one."""
        piece, out = np.array([length, 1, length * length], np.int64), []
        while len(out) < count:
            row = self._best(piece)
            if row is None:
                left, numbers = self.full, None
            else:
                left, numbers = self.left[row].copy(), self.numbers[row]
            # By the norm, a sequence that was best before it took a piece is still the best after it.
            each = int((left // piece).min()) if self.capacities.rule == "norm" else 1
            each = min(each, count - len(out))
            bins = (count - len(out)) // each if self.capacities.rule == "norm" else 1
            if numbers is None:
                chosen = list(range(self.made, self.made + bins))
                self.made += bins
            else:
                chosen = numbers[-bins:][::-1]
                del numbers[-bins:]
                self.counts[row] -= len(chosen)
            out += [b for b in chosen for _ in range(each)]
            self._add(left - each * piece, chosen)
        return out


def pack(lengths: np.ndarray, capacities: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the place in it of each piece; lengths come in falling order."""
    bins, out = _Bins(capacities), []
    edges = np.flatnonzero(np.diff(lengths, prepend=-1, append=-1))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out += bins.place(int(lengths[start]), end - start)
    numbers = np.array(out, np.int64)
    order = np.argsort(numbers, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    offsets = np.empty(len(numbers), np.int64)
    offsets[order] = before - np.repeat(before[first], np.diff(first, append=len(numbers)))
    return numbers, offsets


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, content, end_id: int, longest: int) -> DataFrame:
    """One row for each piece: ``row`` (a number of its own), ``doc_id, piece, start, length, ids_crc32``.

    The last pieces are ``longest`` tokens long, the first takes what is left.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = token_store._encoder(content.value), TaskContext.get().partitionId() << 40
        for batch in shared.slices(batches):
            owner, numbers = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % longest or longest, total + 1, longest)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    numbers.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    owner.append(i)
            k, start, length, crc = np.array(numbers, np.int64).reshape(-1, 4).T
            rows = row + np.arange(len(k))
            row += len(k)
            columns = [pa.array(rows), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(k.astype(np.int32))]
            columns += [pa.array(np.ascontiguousarray(c)) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return shared.texts(docs).mapInArrow(run, PIECES)


PLACED = f"{PIECES}, sequence_id long, offset long, loose boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(rows: DataFrame, count: int, capacities: Capacities, level: int) -> DataFrame:
    """The rows with their sequence, their place in it and whether it has room left; each task packs whole groups."""
    groups = max(1, math.ceil(count / GROUP_PIECES))
    most_left = LOOSE * capacities.tokens

    def one(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        lengths = table.column("length").to_numpy()
        numbers, offsets = pack(lengths, capacities)
        left = capacities.tokens - np.bincount(numbers, lengths)
        first = (level << 56) | (table.column("group")[0].as_py() << 24)
        more = [pa.array(first + numbers), pa.array(offsets), pa.array(left[numbers] > most_left)]
        return pa.RecordBatch.from_arrays([*table.columns[:-1], *more], _names(PLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column("group").to_numpy()
            edges = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[-1].column("group")[0].as_py() != of[a]:
                    yield one(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held)

    group = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("group")
    dealt = rows.select(*_names(PIECES), group).repartition(groups, "group")
    return dealt.sortWithinPartitions("group", F.col("length").desc(), "row").mapInArrow(run, PLACED)


def pack_documents(
    docs: DataFrame, vocabulary_file: str, end_id: int, capacities: Capacities = Capacities()
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and pack the documents into sequences.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A document longer than a sequence takes is cut into
    pieces of the greatest length, of which the first may be shorter; no other document is cut.  No sequence
    passes any capacity.

    Returns one row for each piece: ``doc_id, piece`` (from 0), ``start`` (its document's ids before it), ``length,
    ids_crc32, sequence_id, offset`` (its place there; the pieces of a sequence leave no gap).  A null or empty
    text is one piece, the end id.  Rows of equal or missing ``doc_id`` are documents of their own.  A very long text
    gives as many pieces as it takes.  No row gives no row.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # one file, a few MB
    longest = capacities.longest
    rows = shared.written(pieces(docs, content, end_id, longest))
    # Nothing goes beside the longest pieces where they use a capacity up; these needn't be packed.
    filled = longest == capacities.tokens or longest * longest == capacities.attention or capacities.documents == 1
    alone = (F.col("length") == longest) & F.lit(filled)
    done = rows.where(alone).select(*_names(PIECES), (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, level = rows.where(~alone), 1
    while count := todo.count():
        placed = shared.written(_packed(todo, count, capacities, level))
        loose = placed.where("loose").count()
        # Once more across groups, as long as that leaves much fewer pieces to look at.
        last = count <= GROUP_PIECES or loose > count // 2
        done = done.union((placed if last else placed.where("not loose")).drop("loose"))
        if last:
            break
        todo, level = placed.where("loose"), level + 1
    return done.drop("row")
