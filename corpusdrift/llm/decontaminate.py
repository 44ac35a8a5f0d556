"""Benchmark decontamination by templates.

A question that was re-parameterised keeps its wording and changes its numbers, names and units.  So
these are replaced by placeholders of their kind, and windows of the canonical words are joined
by hash.  Where a document shares windows with an item, both are laid side by side: the
run must be long enough, and what fills the slots must be consistent (equal fillers of the
item stand against equal fillers of the document, and different ones against different ones).

A copy in capitals makes names of words, and one in small letters words of names.  So windows are also
joined blind to case, with placeholders for numbers, quantities and units only.  Windows that hold little but
placeholders would meet everywhere; these are joined by their plain lower-cased words, and what they find
must be literally in the document.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import shared

#: Canonical words in a window, and how many of them must be words rather than placeholders.
WINDOW, LITERALS = 8, 4
#: A run must be as long as this, or as the item if that is shorter.
RUN = 13
#: The last two bits of a hash tell the kinds of windows: with names as placeholders, of plain words, blind to case.
_NAMED, _LITERAL, _BLIND = range(3)
_KIND = np.uint64(3)
#: Benchmarks with more windows aren't sent to every task but joined by a shuffle.
MOST_WINDOWS = 1_000_000

_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
_QUANTITY = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(\w{1,3})")
_EDGES = ".,;:!?\"'()[]{}«»“”’"
_ENDS = (".", "!", "?", ":", '."', '!"', '?"', ".)", "…")
#: Words that count as units.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s h min hour hours minute minutes second seconds day days week weeks month months "
    "year years mile miles inch inches foot feet yard yards pound pounds ounce ounces gram grams kilogram "
    "kilograms ton tons liter liters litre litres meter meters metre metres kilometer kilometers percent dollar "
    "dollars euro euros cent cents degree degrees".split()
)


def canonical(word: str) -> tuple[str, str]:
    """A word's kind and its canonical form: itself, or the placeholder of its kind."""
    bare = word.strip(_EDGES) or word
    if _NUMBER.fullmatch(bare):
        return "number", "<number>"
    if (found := _QUANTITY.fullmatch(bare)) and found[1].lower() in UNITS:
        return "quantity", "<quantity>"
    if len(bare) > 1 and bare.lower() in UNITS:
        return "unit", "<unit>"
    return "word", bare.lower()


def plain(word: str) -> str:
    """A word as it is, but for case and the marks around it."""
    return (word.strip(_EDGES) or word).lower()


_NAME = xxhash.xxh3_64_intdigest(b"<name>")


class Words(dict):
    """What is known of each word, in arrays: hashes as the first word of a sentence and
    elsewhere, where a capital makes it a name, and of the plain word; whether the first two are words;
    whether a sentence ends."""

    def __init__(self, most: int = 250_000) -> None:
        self.most = most
        self.first, self.later, self.literal = (np.zeros(most, np.uint64) for _ in range(3))
        self.plain_first, self.plain_later, self.ends = (np.zeros(most, bool) for _ in range(3))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            raise OverflowError
        at = self[word] = len(self)
        kind, form = canonical(word)
        digest = xxhash.xxh3_64_intdigest
        if kind == "word":  # its canonical form is the plain word
            self.first[at] = self.later[at] = self.literal[at] = digest(form.encode("utf-8", "replace"))
            name = word.lstrip(_EDGES)[:1].isupper()
            if name:
                self.later[at] = _NAME
            self.plain_first[at], self.plain_later[at] = True, not name
        else:
            self.first[at] = self.later[at] = digest(form.encode())
            self.literal[at] = digest(plain(word).encode("utf-8", "replace"))
            self.plain_first[at] = self.plain_later[at] = False
        self.ends[at] = word.endswith(_ENDS)
        return at

    def look(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Hashes of the canonical words, which of them are words, both again as if every
        word were the first of a sentence, and hashes of the plain words."""
        if len(self) + len(words) > self.most:
            self.clear()
            if len(words) > self.most:
                middle = len(words) // 2
                one, two = self.look(words[:middle]), self.look(words[middle - 1 :])
                return tuple(np.concatenate([a, b[1:]]) for a, b in zip(one, two, strict=True))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        opens = np.ones(len(at), bool)
        opens[1:] = self.ends[at[:-1]]
        first, plain = self.first[at], self.plain_first[at]
        later, plain_later = self.later[at], self.plain_later[at]
        return np.where(opens, first, later), np.where(opens, plain, plain_later), first, plain, self.literal[at]


def windows(looked: tuple[np.ndarray, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and where each begins; a window may have several.

    With names as placeholders and blind to case, if enough of the words aren't placeholders; else of the plain
    words.  What stands before a window doesn't count: its first word is taken as the first of a sentence.
    """
    hashes, plain, first, plain_first, literals = looked
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = min(LITERALS, size)
    rest = shared.window_hashes(hashes[1:], size - 1) if size > 1 else np.zeros(count, np.uint64)
    total = np.concatenate([[0], np.cumsum(plain)])
    named = total[size:] - total[1 : count + 1] + plain_first[:count] >= least
    total = np.concatenate([[0], np.cumsum(plain_first)])
    blind = total[size:] - total[:count] >= least
    kinds = [(_NAMED, named, shared.mixed(rest * np.uint64(0x9E3779B97F4A7C15) + first[:count]))]
    kinds.append((_BLIND, blind, shared.window_hashes(first, size)))
    if not named.all():
        kinds.append((_LITERAL, ~named, shared.window_hashes(literals, size, 1)))
    at = [np.flatnonzero(chosen) for _, chosen, _ in kinds]
    found = [(x[i] + np.uint64(size)) & ~_KIND | np.uint64(kind) for (kind, _, x), i in zip(kinds, at, strict=True)]
    return np.concatenate(found), np.concatenate(at)


def _slots(words: list[str], names: bool = True) -> list[tuple[str, str]]:
    """Kind and filler of each word; fillers only where there is a slot.  Without ``names`` capitals make none."""
    out, opens = [], True
    for word in words:
        kind, form = canonical(word)
        if names and kind == "word" and not opens and word.lstrip(_EDGES)[:1].isupper():
            kind = "name"
        bare = word.strip(_EDGES) or word
        out.append((kind, form if kind == "word" else bare if names else bare.lower()))
        opens = word.endswith(_ENDS)
    return out


def _same(mine: tuple[str, str], theirs: tuple[str, str], opens: bool) -> bool:
    """Whether a document's word may stand for an item's; ``opens`` for the item's first word."""
    if opens and theirs[0] == "word" and mine[0] == "name":
        return mine[1].lower() == theirs[1]
    return mine[0] == theirs[0] and (mine[0] != "word" or mine[1] == theirs[1])


def align(
    doc: list[str], item: list[str], seeds: list[tuple[int, int]], run: int = RUN, names: bool = True
) -> tuple | None:
    """The best run of an item in a document through one of the seeds (positions in both).

    Returns ``start in the document, words, slots, changed slots``, or None if no run is long enough with
    consistent slots.  Where a slot contradicts the ones before it the run ends there.
    """
    left, right = _slots(doc, names), _slots(item, names)
    best, done = None, {}  # for each diagonal, where its last run ends; seeds come in their order in the document
    for at, of in seeds:
        if at < done.get(at - of, 0):
            continue
        start, end = at, at
        while start > 0 and of - (at - start) > 0 and _same(left[start - 1], right[of - (at - start) - 1], of - (at - start) == 1):
            start -= 1
        while end < len(left) and of + end - at < len(right) and _same(left[end], right[of + end - at], of + end == at):
            end += 1
        done[at - of] = end
        begin = start
        while begin < end:
            there, back, slots, changed, stop = {}, {}, 0, 0, begin
            while stop < end:
                (_, mine), (kind, theirs) = left[stop], right[stop - at + of]
                if kind != "word":
                    if there.setdefault((kind, theirs), mine) != mine or back.setdefault((kind, mine), theirs) != theirs:
                        break
                    slots, changed = slots + 1, changed + (mine != theirs)
                stop += 1
            if stop - begin >= min(run, len(item)) and (best is None or stop - begin > best[1]):
                best = begin, stop - begin, slots, changed
            begin = max(stop, begin + 1)
    return best


def align_literally(doc: list[str], item: list[str], seeds: list[tuple[int, int]], run: int = RUN) -> tuple | None:
    """As :func:`align`, for runs of the same words: nothing fills a slot otherwise."""
    left, right = [plain(w) for w in doc], [plain(w) for w in item]
    best, done = None, {}
    for at, of in seeds:
        if at < done.get(at - of, 0):
            continue
        start, end = at, at
        while start > 0 and of - (at - start) > 0 and left[start - 1] == right[of - (at - start) - 1]:
            start -= 1
        while end < len(left) and of + end - at < len(right) and left[end] == right[of + end - at]:
            end += 1
        done[at - of] = end
        if end - start >= min(run, len(item)) and (best is None or end - start > best[1]):
            slots = sum(kind != "word" for kind, _ in _slots(item)[start - at + of : end - at + of])
            best = start, end - start, slots, 0
    return best


class Index:
    """The windows of all items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW) -> None:
        self.size, self.items = size, {}
        words, found = Words(), []
        for item_id, text in items:
            own = (text or "").split()
            if own:
                number = len(self.items)
                self.items[number] = (item_id, own)
                hashes, starts = windows(words.look(own), min(size, len(own)))
                found += zip(hashes.tolist(), [number] * len(hashes), starts.tolist(), strict=True)
        found.sort()
        self.hashes = np.array([f[0] for f in found], np.uint64)
        self.places = [f[1:] for f in found]
        self.sizes = sorted({min(size, len(own)) for _, own in self.items.values()})

    def matches(self, text: str | None, words: Words) -> list[tuple]:
        """``item, start, words, slots, changed`` for every item that the text holds."""
        own = (text or "").split()
        if not own or not len(self.hashes):
            return []
        looked = words.look(own)
        seeds: dict[tuple[int, int], list] = {}
        for size in self.sizes:
            found, starts = windows(looked, size)
            at = np.searchsorted(self.hashes, found)
            hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == found)
            for place in hit.tolist():
                i = int(at[place])
                while i < len(self.hashes) and self.hashes[i] == found[place]:
                    number, of = self.places[i]
                    seeds.setdefault((number, int(found[place] & _KIND)), []).append((int(starts[place]), of))
                    i += 1
        best: dict[int, tuple] = {}
        for (number, kind), pairs in sorted(seeds.items()):
            item = self.items[number][1]
            one = align_literally(own, item, pairs) if kind == _LITERAL else align(own, item, pairs, names=kind == _NAMED)
            if one and (number not in best or one[1] > best[number][1]):
                best[number] = one
        return [(self.items[n][0], *one, len(self.items[n][1])) for n, one in sorted(best.items())]


FOUND = (
    "doc_id long, item_id long, first_word long, n_words long, n_slots long, n_changed long, "
    "n_item_words long, reparameterised boolean"
)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, item_id, start, words, slots, changed, item words)."""
    columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(7)]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([*columns, pa.array([f[5] > 0 for f in found], pa.bool_())], names)


def find_leaks(docs: DataFrame, items: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row for each document and benchmark item that it holds.

    Takes ``doc_id, text`` and ``item_id, text``; other columns are ignored.  Columns: where the run starts
    in the document, its words, its slots, how many of them are filled otherwise than in the item, the
    item's words, and whether it is re-parameterised (some slot is).  Null and empty texts hold nothing and
    are held by nothing.  Repeated rows, of documents or items, give repeated result rows.
    A benchmark of up to ``most_windows`` windows is sent to every task; a larger one is joined with a shuffle.
    """
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    index = _index(bench, most_windows)
    if index is None:
        return _find_by_shuffle(docs, bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in shared.slices(batches):
            found = [
                (doc_id, *match)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for match in index.value.matches(text, words)
            ]
            if found:
                yield _rows(found)

    return shared.texts(docs).mapInArrow(run, FOUND)


def without_leaks(docs: DataFrame, items: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    As :func:`find_leaks`; rows are dropped where they are read, without a shuffle, unless the
    benchmark is larger than ``most_windows``.  Repeated rows stay or go together.
    """
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    index = _index(bench, most_windows)
    if index is None:
        # By the number of a row, as ids may be missing or repeated; the other columns go along as one.
        numbered = shared.written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
        keyed = numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))
        leaks = _find_by_shuffle(keyed, bench).select(F.col("doc_id").alias("number")).distinct()
        kept = numbered.join(leaks, "number", "left_anti")
        return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in shared.slices(batches):
            clean = [not index.value.matches(text, words) for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _index(bench: DataFrame, most_windows: int):
    """The items' windows for every task, or None if there are too many."""
    size = bench.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > most_windows:
        return None
    rows = bench.orderBy("item_id", "text").collect()  # its size is checked above
    return bench.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows]))


def _find_by_shuffle(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The same for any benchmark: windows meet in a join, then the texts of each pair found."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {min(WINDOW, len((text or "").split())) for text in batch.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["size"])

    # The words that the windows are made of; at most WINDOW sizes.
    sizes = [r.size for r in bench.select("text").mapInArrow(lengths, "size long").distinct().collect() if r.size]

    def hashed(of_items: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in shared.slices(batches, 1_000_000):
                hashes, keys = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = (text or "").split()
                    looked = words.look(own)
                    for size in [min(WINDOW, len(own))] if of_items else sizes:
                        found = np.unique(windows(looked, size)[0]) if size else np.empty(0, np.uint64)
                        hashes.append(found)
                        keys += [key] * len(hashes[-1])
                if keys:
                    values = np.concatenate(hashes).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(keys, pa.int64())], ["hash", "key"])

        return run

    # Row numbers tell repeated rows apart; the numbered rows are written, so they stay as they are.
    left = shared.written(shared.texts(docs).withColumn("key", F.monotonically_increasing_id()))
    right = shared.written(bench.withColumn("key", F.monotonically_increasing_id()))
    a = left.select("key", "text").mapInArrow(hashed(False), "hash long, key long").withColumnRenamed("key", "doc")
    b = right.select("key", "text").mapInArrow(hashed(True), "hash long, key long").withColumnRenamed("key", "item")
    pairs = a.join(b, "hash").select("doc", "item").distinct()
    both = (
        pairs.join(left.select(F.col("key").alias("doc"), "doc_id", F.col("text").alias("doc_text")), "doc")
        .join(right.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text")), "item")
        .select("doc_id", "doc_text", "item_id", "item_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in shared.slices(batches):
            found = []
            for doc_id, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(doc_id, *match) for match in Index([(item_id, item)]).matches(text, words)]
            if found:
                yield _rows(found)

    return both.mapInArrow(run, FOUND)
