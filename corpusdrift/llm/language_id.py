"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams, most frequent first.  A document's
own n-grams are ranked the same way, and the distance to a language is the sum of how far
out of place each of them stands in the language's profile.  The nearest language wins.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdrift.llm import shared

#: N-grams in a language's profile, and of a document that are compared with it.
PROFILE, DOCUMENT = 400, 300
#: Profiles go to every task; with them their size is bounded.
MOST_LANGUAGES = 5_000
UNKNOWN = "und"

_BITS = np.uint64(21)
_BREAK = 0x110001  # stands between words; letters are their code point + 1


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, step: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters of a text and how often they stand in it.

    Letters are lower-cased; anything between two words counts as one break.  An n-gram is
    one letter, two letters or a letter and a break, or three of which the middle is a letter.
    ``step`` characters are looked at together with the two codes before them, so its size doesn't matter.
    """
    grams, counts, text = np.empty(0, np.uint64), np.empty(0, np.int64), text.lower()
    before, in_word = np.array([_BREAK], np.uint64), False
    for start in range(0, len(text) + 1, step):
        points = np.frombuffer(text[start : start + step].encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(letter):
            keep[0] |= in_word
            in_word = bool(letter[-1])
        new = np.where(letter, points + 1, _BREAK)[keep].astype(np.uint64)
        if start + step > len(text):
            new = np.append(new, np.uint64(_BREAK))
        codes = np.concatenate([before, new])
        word = codes != _BREAK
        pairs = (codes[:-1] << _BITS) | codes[1:]
        triples = (pairs[:-1] << _BITS) | codes[2:]
        held = len(before)  # what ends in these codes was counted
        found = [codes[held:][word[held:]], pairs[held - 1 :][(word[:-1] | word[1:])[held - 1 :]]]
        found.append(triples[max(0, held - 2) :][word[1:-1][max(0, held - 2) :]])
        before = codes[-2:]
        every = np.concatenate(found)
        every.sort()
        new = np.ones(len(every) + 1, bool)
        np.not_equal(every[1:], every[:-1], out=new[1:-1])
        first = np.flatnonzero(new)
        part, n = every[first[:-1]], first[1:] - first[:-1]
        if not len(grams):
            grams, counts = part, n
        else:
            grams, place = np.unique(np.concatenate([grams, part]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their codes."""
    if len(grams) > most:  # all that may be among them
        least = -np.partition(-counts, most - 1)[most - 1]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Languages' profiles, for comparing documents with."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.empty(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for row, name in enumerate(self.names):
            place = np.searchsorted(self.grams, profiles[name])
            self.ranks[row, place] = np.arange(len(place))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of equally near ones the first by name) and 1 minus its
        distance's share of the largest possible one."""
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        top = ranked(grams, counts, DOCUMENT)
        place = np.searchsorted(self.grams, top)
        known = self.grams[np.minimum(place, len(self.grams) - 1)] == top
        ranks = self.ranks[:, np.where(known, place, len(self.grams))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))), PROFILE).sum(axis=1)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (PROFILE * len(top)))


def learn_profiles(docs: DataFrame, language: str = "lang") -> DataFrame:
    """``lang, gram, rank``: the profiles of the languages that label the documents.

    Takes ``text`` and the language column; rows that lack either are ignored.  All rows' n-grams are
    counted: per batch in numpy, then added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            by_language: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(lang, []).append(text)
            for lang, texts in by_language.items():
                grams, counts = gram_counts("\n".join(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())],
                    ["lang", "gram", "n"],
                )

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(language).cast("string").alias("lang"))
    counts = rows.dropna().mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank")


def collect_profiles(learned: DataFrame) -> Profiles:
    """Profiles for the tasks: at most ``PROFILE`` rows for each language."""
    rows = learned.limit(PROFILE * MOST_LANGUAGES + 1).toPandas().sort_values(["lang", "rank"])
    if len(rows) > PROFILE * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles({k: v["gram"].to_numpy(np.int64).view(np.uint64) for k, v in rows.groupby("lang")})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text alone.

    A text that is null or has no letter, and any text if there are no profiles, gets ``und`` and the
    score 0.  Repeated rows get equal results; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            found = [sent.value.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return shared.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
