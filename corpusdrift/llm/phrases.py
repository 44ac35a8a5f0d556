"""Frequent phrases of a corpus and how firmly their words go together.

Words are hashed by prefix polynomials: one running sum over a text's bytes gives all words' hashes, one over the
words' hashes the fingerprint of every run of words (Rabin and Karp's rolling hash, for whole arrays at
once).  A run can only be frequent if the shorter runs in it are, so fingerprints are counted by
length: words, pairs of frequent words, then longer runs of frequent pairs.  What is frequent reaches
the tasks as a bit array of a fixed size; where it lets a rare run through, that run is counted and then dropped.

The shuffle adds up fingerprints, each with a pointer to one document that holds it and the least and the largest of
a second, independent hash.  Only frequent fingerprints are then looked up in the documents they point to, hashed
again there, and turned into text.  Where the second hashes differ, several phrases share a fingerprint:
these, and no others, are counted again by their text.  Frequencies are exact however fingerprints collide.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdrift.llm import shared

LONGEST = 5
LEAST_COUNT = 100
SCALE = 1000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in per cent.
INSIDE_PERCENT = 100
TOP = 2000

#: Fingerprints that a task holds before it combines equal ones and gives them out.
TASK_PRINTS = 2_000_000
#: Bytes hashed at once; a text is cut only where a piece ends.
PART_BYTES = 1 << 18
#: Rows of a language that are ranked together before the final ranking.
RANK_DEALS = 64

_rng = np.random.default_rng(1_987)
#: Numbers for bytes in words' hashes, for fingerprints and for the hashes that check them.
_BYTES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
#: Spreads a pointer of 32 bits over 63 bits.
_SPREAD = 2**31 - 19
#: What ends a piece, and what ends a word within a piece.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_END, _IS_BLANK = np.zeros(256, bool), np.zeros(256, bool)
_IS_END[list(_ENDS)] = True
_IS_BLANK[list(_BLANKS)] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as are asked for."""

    def __init__(self, base: int) -> None:
        self.bases, self.known = (base, pow(base, -1, 2**64)), [np.ones(1, np.uint64)] * 2

    def __call__(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < count:
            size = 1 << (count - 1).bit_length()
            for i, base in enumerate(self.bases):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                self.known[i] = np.cumprod(powers)
        up, down = self.known
        return up[:count], down[:count]


_byte_powers, _word_powers = _Powers(_BASES[0]), _Powers(_BASES[1])


class Part:
    """The words of some texts: where they stand, their hashes, and which stand in one piece."""

    def __init__(self, raw: bytes, starts: np.ndarray, languages: np.ndarray) -> None:
        """``starts``: where each text begins in ``raw``; ``languages``: a hash of its language."""
        self.raw = _LOWER[np.frombuffer(raw, np.uint8)]
        ends = _IS_END[self.raw]
        inside = ~(ends | _IS_BLANK[self.raw])
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.piece = np.cumsum(ends, dtype=np.int32)[self.starts]
        self.text = np.searchsorted(starts, self.starts, "right") - 1
        up, down = _byte_powers(len(self.raw) + 1)
        sizes, total, self.hashes = (self.ends - self.starts).astype(np.uint64), np.zeros(len(self.raw) + 1, np.uint64), []
        for of_byte in _BYTES:
            np.cumsum(of_byte[self.raw] * up[:-1], out=total[1:])
            plain = (total[self.ends] - total[self.starts]) * down[self.starts] + sizes
            self.hashes.append(shared.mixed(plain ^ languages[self.text]))

    def _runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """A hash of the run of words that begins at each word; only runs within a piece mean something."""
        count = len(hashes)
        up, down = _word_powers(count + 1)
        total = np.zeros(count + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        runs = max(0, count - length + 1)
        return shared.mixed((total[length : length + runs] - total[:runs]) * down[:runs] + np.uint64(length))

    def prints(self, length: int, mask: np.uint64) -> np.ndarray:
        return self._runs(self.hashes[0], length) & mask

    def checks(self, length: int) -> np.ndarray:
        """31 bits of a second hash."""
        return (self._runs(self.hashes[1], length) >> np.uint64(33)).astype(np.int64)

    def whole(self, length: int) -> np.ndarray:
        """Whether the run of words that begins at each word lies within a piece."""
        runs = max(0, len(self.piece) - length + 1)
        return self.piece[:runs] == self.piece[length - 1 : length - 1 + runs]

    def word_numbers(self, words: np.ndarray) -> np.ndarray:
        """A number for each of the given words, the same for equal bytes and for no others."""
        _, first, number = np.unique(self.hashes[0][words], return_index=True, return_inverse=True)
        like = words[first][number]
        sizes = self.ends[words] - self.starts[words]
        if (sizes == self.ends[like] - self.starts[like]).all():
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            here, there = (self.raw[np.repeat(self.starts[w], sizes) + offset] for w in (words, like))
            if (here == there).all():
                return number
        known: dict[tuple, int] = {}
        spans = zip(self.text[words].tolist(), self.starts[words].tolist(), self.ends[words].tolist(), strict=True)
        return np.array([known.setdefault(self.raw[a:b].tobytes(), len(known)) for _, a, b in spans], np.int64)

    def phrase(self, first: int, length: int) -> bytes:
        spans = range(first, first + length)
        return b" ".join(self.raw[self.starts[i] : self.ends[i]].tobytes() for i in spans)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, list[str], np.ndarray]]:
    """Texts in parts of about ``PART_BYTES``, and the language and the pointer of each text of a part.

    Texts are joined by line ends, which end a piece; a longer text goes on in the next part after the last
    end of a piece.
    """
    held, size, languages, pointers = [], 0, [], []

    def part() -> tuple[Part, list[str], np.ndarray]:
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        codes = np.array([xxhash.xxh3_64_intdigest(x) for x in languages], np.uint64)
        return Part(b"\n".join(held), starts, codes), languages, np.array(pointers, np.int64)

    for batch in shared.slices(batches):
        columns = shared.raw_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, language, pointer in zip(*columns, strict=True):
            rest = text or b""
            while rest:
                piece, rest = rest, b""
                if len(piece) > PART_BYTES:
                    cut = 1 + max(piece.rfind(bytes([e]), 0, PART_BYTES) for e in _ENDS)
                    if not cut:
                        found = [at for e in _ENDS if (at := piece.find(bytes([e]), PART_BYTES)) >= 0]
                        cut = 1 + min(found, default=len(piece) - 1)
                    piece, rest = piece[:cut], piece[cut:]
                if held and size + len(piece) > PART_BYTES:
                    yield part()
                    held, size, languages, pointers = [], 0, [], []
                held.append(piece)
                languages.append(language)
                pointers.append(pointer)
                size += len(piece) + 1
    if held:
        yield part()


COUNTED = "print long, n long, low long, high long"


def _counted(rows: DataFrame, lengths: range, inner: tuple[int, object] | None, least: int, mask: np.uint64) -> DataFrame:
    """The frequent fingerprints of runs of these lengths: ``print, n``, the smallest place and the largest check.

    A place is a check and, in its last 32 bits, the pointer of the document.  ``inner``: the length of shorter runs,
    and which of these are frequent; a run counts if all in it are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.RecordBatch:
            prints, places = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(prints)
            prints, places = prints[order], places[order]
            first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])[: len(prints)])
            columns = [prints[first].view(np.int64), np.diff(first, append=len(prints))]
            if len(first):
                columns += [np.minimum.reduceat(places, first), np.maximum.reduceat(places, first) >> 32]
            else:
                columns += [places, places]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["print", "n", "low", "high"])

        for part, _, pointers in _parts(batches):
            for length in lengths:
                at = np.flatnonzero(_open(part, length, inner, mask))
                places = (part.checks(length)[at] << 32) | pointers[part.text[at]]
                held.append((part.prints(length, mask)[at], places))
                size += len(at)
            if size > TASK_PRINTS:
                yield combined()
                held, size = [], 0
        if held:
            yield combined()

    sums = F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    found = rows.mapInArrow(run, COUNTED).groupBy("print").agg(*sums)
    return shared.written(found.where(F.col("n") >= least))


def _open(part: Part, length: int, inner: tuple[int, object] | None, mask: np.uint64) -> np.ndarray:
    """Whether the run at each word lies within a piece and all shorter runs in it may be frequent."""
    out = part.whole(length)
    if inner is not None:
        short, known = inner
        frequent = shared.in_filter(known.value, part.prints(short, mask)) & part.whole(short)
        for shift in range(length - short + 1):
            out = out & frequent[shift : shift + len(out)]
    return out


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, bits: int = 64) -> DataFrame:
    """``lang, size, phrase, n``: how often each phrase of 1 to ``longest`` words stands in the texts, if at least ``least`` times.

    One row of size 0 for each language has the number of all its words.  ``bits`` of a fingerprint are used.
    """
    mask = np.uint64(2**bits - 1)

    def broadcast(numbers: DataFrame):
        held = shared.bit_filter(numbers)
        nothing = np.zeros(2**shared.FILTER_BITS // 64, np.int64)
        return docs.sparkSession.sparkContext.broadcast(nothing if held is None else held)  # of a fixed size

    rows = docs.select(
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.xxhash64(F.col("text").cast("string")).bitwiseAND(2**32 - 1).alias("pointer"),
    )
    found, inner = [_counted(rows, range(1, 2), None, least, mask)], None
    for lengths in (range(2, 3), range(3, longest + 1)):
        if lengths.start <= longest:
            inner = (lengths.start - 1, broadcast(found[-1].select("print")))
            found.append(_counted(rows, lengths, inner, least, mask))
    every = reduce(DataFrame.union, found)
    check, pointer = F.shiftright("low", 32), F.col("low").bitwiseAND(2**32 - 1)
    sure = every.where(check == F.col("high")).select("print", "n", check.alias("check"), pointer.alias("pointer"))
    named = shared.written(_named(rows, sure, range(1, longest + 1), mask, broadcast))
    same = ["print", "check", "pointer"]
    texts = named.where("size > 0").dropDuplicates(["print", "check", "pointer"]).join(sure, same)
    totals = named.where("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("words").alias("n"))
    shared_prints = every.where(check != F.col("high"))
    columns = ["lang", "size", "phrase", "n"]
    out = texts.select(*columns).union(totals.select(*columns))
    if shared_prints.isEmpty():
        return out
    again = _recounted(rows, range(1, longest + 1), broadcast(shared_prints.select("print")), mask)
    return out.union(again.where(F.col("n") >= least).join(texts.select("lang", "size", "phrase"), ["lang", "size", "phrase"], "left_anti"))


NAMED = "print long, check long, pointer long, lang string, size int, phrase string, words long"


def _named(rows: DataFrame, sure: DataFrame, lengths: range, mask: np.uint64, broadcast) -> DataFrame:
    """The text of each fingerprint, from the documents it points to; and each language's number of words."""
    pair = F.col("print").bitwiseXOR(F.col("pointer") * _SPREAD)
    known = [broadcast(sure.select(x.alias("x"))) for x in (F.col("print"), pair, F.shiftright(pair, 31))]
    names = [c.split()[0] for c in NAMED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for part, languages, pointers in _parts(batches):
            for text, n in zip(*(x.tolist() for x in np.unique(part.text, return_counts=True)), strict=True):
                words[languages[text]] = words.get(languages[text], 0) + n
            out = []
            for length in lengths:
                prints = part.prints(length, mask)
                at = np.flatnonzero(part.whole(length) & shared.in_filter(known[0].value, prints))
                both = prints[at].view(np.int64) ^ (pointers[part.text[at]] * _SPREAD)
                at = at[shared.in_filter(known[1].value, both) & shared.in_filter(known[2].value, both >> 31)]
                at = at[np.unique(prints[at], return_index=True)[1]]
                checks = part.checks(length)
                for i in at.tolist():
                    text = part.text[i]
                    row = int(prints[i].view(np.int64)), int(checks[i]), int(pointers[text]), languages[text], length
                    out.append((*row, part.phrase(i, length).decode(), 0))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], _NAMED_TYPES)
        totals = [dict(zip(names, (0, 0, 0, lang, 0, "", n), strict=True)) for lang, n in words.items()]
        yield pa.RecordBatch.from_pylist(totals, _NAMED_TYPES)

    return rows.mapInArrow(run, NAMED)


_NAMED_TYPES = pa.schema(
    [("print", pa.int64()), ("check", pa.int64()), ("pointer", pa.int64()), ("lang", pa.string()), ("size", pa.int32()),
     ("phrase", pa.string()), ("words", pa.int64())]
)


def _recounted(rows: DataFrame, lengths: range, known, mask: np.uint64) -> DataFrame:
    """Frequencies by text of the phrases whose fingerprint is among the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for part, languages, _ in _parts(batches):
            _, of_language = np.unique(languages, return_inverse=True)
            language = of_language[part.text]
            for length in lengths:
                at = np.flatnonzero(part.whole(length) & shared.in_filter(known.value, part.prints(length, mask)))
                if not len(at):
                    continue
                words = part.word_numbers((at[:, None] + np.arange(length)).ravel()).reshape(-1, length)
                of_row = np.concatenate([words, language[at][:, None]], axis=1)
                _, first, n = np.unique(of_row, axis=0, return_index=True, return_counts=True)
                for count, i in zip(n.tolist(), at[first].tolist(), strict=True):
                    key = (languages[part.text[i]], length, part.phrase(i, length))
                    counts[key] = counts.get(key, 0) + count
            if len(counts) > TASK_PRINTS // 10:
                yield _batch(counts)
                counts = {}
        yield _batch(counts)

    given = rows.mapInArrow(run, "lang string, size int, phrase string, n long")
    return given.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _batch(counts: dict[tuple, int]) -> pa.RecordBatch:
    languages, sizes, phrases = zip(*counts, strict=True) if counts else ((), (), ())
    columns = [pa.array(languages, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["lang", "size", "phrase", "n"])


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, bits: int = 64
) -> DataFrame:
    """The phrases of each language whose words stand together more often than by chance.

    Takes ``text`` and ``lang`` (null: ``und``); other columns are ignored.  A-Z count as a-z.  Texts are cut
    into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs.  Candidates are phrases of 2 to
    ``longest`` words with ``a`` of at least ``least`` occurrences, overlapping ones included.  A cut after ``k`` words
    scores ``floor(1000 * a * n / (l * r))``, where ``l`` and ``r`` count the parts' occurrences and ``n`` all words of
    the language; the lowest score counts, of equal ones that with the smallest ``k``.  Candidates
    inside a longer one of the same frequency go.

    Returns each language's first ``top`` by score and ``a`` (both falling) and phrase: ``lang, rank, phrase, a, l, r, n,
    score``.  Null and empty texts have no words; repeated rows count each time; a very long text is read in
    parts that end where a piece does.  An empty table gives no row.
    """
    counted = shared.written(frequencies(docs, longest, least, bits))
    phrases = counted.where("size > 0").select("lang", "size", "phrase", "n")
    totals = counted.where("size = 0").select("lang", F.col("n").alias("n_all"))
    candidates = phrases.where("size > 1").withColumnRenamed("n", "a")

    inside = candidates.withColumn("words", F.split("phrase", " "))
    spans = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), s -> array_join(slice(words, s, k), ' '))))")
    inside = inside.where("size > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a"))).drop("longer")

    cuts = kept.withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("left"),
        F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("right"),
    )
    named = lambda side, n: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = cuts.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    over, under = exact("a") * exact("n_all") * SCALE, exact("l") * exact("r")
    scored = cuts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n_all").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    found = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_all").alias("n"), "cut.score")

    # No language meets in one task: its rows are ranked in deals first, of which the first ones go on.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(RANK_DEALS)).alias("deal")
    first = Window.partitionBy("lang", "deal").orderBy(*order)
    dealt = found.select("*", deal).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
