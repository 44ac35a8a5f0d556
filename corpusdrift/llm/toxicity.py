"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the mean of the vectors that its hashes name: of the word, of its
beginnings and of its end, so that unseen forms of a word are not strangers.  Filters of several
widths run over the words, each filter's largest answer is kept, and a linear layer adds
them up.  The threshold is calibrated for each language and moved to 0.5.

All labelled documents are learned from.  They are dealt over parts; in each pass every part is trained on by
itself, from one network, and the parts' changes are averaged.
"""

import copy
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import language_id, shared
from corpusdrift.operators import sketch

BUCKETS, SIZE = 2**15, 16
WIDTHS, FILTERS = (1, 2, 3), 16
#: A part has about so many documents.
PART = 4_096
#: Each step looks at this many documents.  All documents are passed over so often, and on until so many were looked at.
STEP, PASSES, VISITS = 16, 4, 45_000
RATE, DECAY = 0.08, 1e-5
#: A language with fewer calibration rows of either kind gets the threshold of all languages.
LEAST_CALIBRATION = 15
#: Thresholds lie between whole parts of this size; logits beyond the limit count as the limit.
FINENESS, LIMIT = 1 / 1024, 32
#: Neighbouring words' vectors that are averaged together.
BLOCK = 128
#: When scoring, words that are looked up at once, words among them that are added up at once, and bytes of text cut into words at once.
GROUP, NEW, SLICE = 8_000, 1_000, 1_000_000

PAD = max(WIDTHS) - 1

FORMS = 7
_SPACE = np.uint32(0x20)
_ONE, _THREE, _SPREAD = np.uint64(1), np.uint64(3), np.uint64(0x9E3779B97F4A7C15)


def word_buckets(words: list[str] | pa.Array, step: int = 20_000) -> np.ndarray:
    """Buckets of each word, its beginnings of 3 to 7 bytes and its last 4; words are as ``_text_words`` finds them."""
    out = np.empty((len(words), FORMS), np.min_scalar_type(BUCKETS - 1))
    for i in range(0, len(words), step):
        some = words[i : i + step]
        out[i : i + step] = _word_buckets(some.to_pylist() if isinstance(some, pa.Array) else some)
    return out


def _word_buckets(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode("utf-8", "replace")
    padded = bytes(4) + raw + bytes(8)
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    sizes = (ends - starts).astype(np.uint64)
    head = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))[starts + 4]
    tail = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))[ends].astype(np.uint64)  # the 4 bytes before the end
    forms = [shared.word_hashes(raw)]
    for size in map(np.uint64, range(3, 8)):
        forms.append(head & ((_ONE << (np.minimum(sizes, size) << _THREE)) - _ONE))
    forms.append(tail >> ((np.uint64(4) - np.minimum(sizes, np.uint64(4))) << _THREE))
    mixed = shared.mixed(np.stack(forms, axis=1) + np.arange(1, FORMS + 1, dtype=np.uint64) * _SPREAD)
    return mixed % np.uint64(BUCKETS)


def _summed(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each word the sum of its buckets' rows."""
    out = np.take(table, buckets[:, 0], axis=0)
    for k in range(1, FORMS):
        out += np.take(table, buckets[:, k], axis=0)
    return out


class Network:
    """Embeddings, filters and the layer above them; ``shift`` has each language's threshold."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, (w * SIZE) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        # What the steps' sizes follow from: the sums of squared changes so far.
        self.seen = [np.full_like(p, 1e-3) for p in self.dense()]
        self.seen_words = np.full(BUCKETS, 1e-3, np.float32)
        self.shift: dict[str, float] = {}
        self.common = 0.0
        self.profiles: language_id.Profiles | None = None

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bases, self.out, self.base]

    def joint(self) -> np.ndarray:
        """All filters' slices side by side: one product answers for every word and slice."""
        return np.concatenate([weights[j] for weights in self.filters for j in range(len(weights))], axis=1)

    def _totals(self, answers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each width, its filters' bases and their sums from every word on; ``answers`` has a column for each word, and the rows of ``joint``."""
        row = 0
        for width, base in zip(WIDTHS, self.bases, strict=True):
            count = answers.shape[1] - width + 1
            total = answers[row : row + FILTERS, :count]
            for j in range(1, width):
                row += FILTERS
                total = total + answers[row : row + FILTERS, j : j + count]
            row += FILTERS
            yield width, base, total

    def pooled(self, answers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer over each of many texts, at least 0, and where it stands.

        The texts stand side by side, each with ``PAD`` columns of zeros after it.
        """
        values, places = [], []
        for width, base, total in self._totals(answers):
            edges = zip(starts.tolist(), (ends - width + 1).tolist(), strict=True)
            place = np.stack([total[:, i:j].argmax(axis=1) for i, j in edges]) + starts[:, None]
            values.append(np.maximum(total[np.arange(FILTERS), place] + base, 0))
            places.append(place)
        return np.concatenate(values, axis=1), np.concatenate(places, axis=1)

    def tops(self, answers: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same answers without places."""
        values, starts = [], np.append(0, ends[:-1])
        for width, base, total in self._totals(answers):
            # Between two texts there are places where a filter would reach from one into the other.
            edges = np.stack([starts, ends - width + 1], axis=1).ravel()[:-1]
            values.append(np.maximum(np.maximum.reduceat(total, edges, axis=1)[:, ::2].T + base, 0))
        return np.concatenate(values, axis=1)


@cache
def _in_words() -> np.ndarray:
    """Whether ``\\w`` finds a character, by code point."""
    return np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(0x110000)), bool, 0x110000)


def _text_words(text: str | None) -> list[str]:
    """What ``\\w+`` finds in the lower-cased text."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(_in_words()[points], points, _SPACE).tobytes().decode("utf-32-le").split()


def _steps(labels: np.ndarray, rng: np.random.Generator) -> Iterator[list[tuple[int, float]]]:
    """One pass: each step's documents and their weights.

    Every document has its turn; those of the rarer kind again, until they are a fourth of each step.  Both kinds weigh the same.
    """
    fewer, more = sorted((np.flatnonzero(labels == k) for k in (1, 0)), key=len)
    own = min(STEP // 2, max(STEP // 4, -(-STEP * len(fewer) // len(labels)))) if len(fewer) else 0
    more = rng.permutation(more)
    count = -(-len(more) // (STEP - own))
    again = [rng.permutation(fewer) for _ in range(-(-count * own // len(fewer)))] if own else []
    again = np.concatenate([np.empty(0, np.int64), *again])
    for i in range(count):
        step = [(d, STEP / 2 / (STEP - own)) for d in more[i * (STEP - own) : (i + 1) * (STEP - own)].tolist()]
        yield step + [(d, STEP / 2 / own) for d in again[i * own : (i + 1) * own].tolist()]


def train(net: Network, rows: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, passes: int, seed: list[int]) -> np.ndarray:
    """Change a network by passes over documents, given as numbers of words; how often each word vector was changed."""
    rng, pad = np.random.default_rng(seed), np.full(PAD, -1)
    dense, turns = net.dense(), np.zeros(BUCKETS, np.int64)
    for chosen in (step for _ in range(passes) for step in _steps(labels, rng)):
        words, place = np.unique(np.concatenate([x for d, _ in chosen for x in (rows[d], pad)]), return_inverse=True)
        vectors = np.concatenate([np.zeros((1, SIZE), np.float32), _summed(net.words, buckets[words[1:]]) / FORMS])
        answers = net.joint().T @ np.take(vectors, place, axis=0).T
        ends = np.cumsum([len(rows[d]) + PAD for d, _ in chosen])
        starts = ends - [len(rows[d]) + PAD for d, _ in chosen]
        top, at = net.pooled(answers, starts, ends)
        top = top * (rng.random(top.shape) > 0.2) / 0.8
        wanted = np.where(labels[[d for d, _ in chosen]] == 1, 0.97, 0.03)
        error = 1 / (1 + np.exp(-np.clip(top @ net.out + net.base[0], -30, 30))) - wanted
        error *= [weight for _, weight in chosen]
        back = np.where(top > 0, error[:, None] * net.out, 0).astype(np.float32)
        grads = [np.zeros_like(p) for p in dense]
        grads[-2] += error @ top
        grads[-1] += error.sum()
        touched, changes = [], []
        for k, weights in enumerate(net.filters):
            part, here = (a[:, k * FILTERS : (k + 1) * FILTERS] for a in (back, at))
            grads[len(WIDTHS) + k] += part.sum(axis=0)
            for j in range(len(weights)):
                own = place[here + j]  # 0 stands for the zeros after a text
                grads[k][j] += np.einsum("dfs,df->sf", vectors[own], part)
                real = (own > 0) & (part != 0)
                touched.append(words[own[real]])
                changes.append((weights[j].T * part[:, :, None])[real])
        for p, g, s in zip(dense, grads, net.seen, strict=True):
            g = g / STEP + DECAY * p
            s += g * g
            p -= RATE * g / np.sqrt(s)
        form = buckets[np.concatenate(touched)].ravel()
        if len(form):
            order = np.argsort(form, kind="stable")  # by digits where 16 bits do
            form = form.astype(np.int64)
            first = np.flatnonzero(np.diff(form[order], prepend=-1))
            g = np.add.reduceat(np.concatenate(changes)[order // FORMS], first) / (FORMS * STEP)
            changed = form[order[first]]
            net.seen_words[changed] += (g * g).mean(axis=1)
            net.words[changed] -= RATE * g / np.sqrt(net.seen_words[changed])[:, None]
            turns[changed] += 1
    return turns


_CHANGES = "block int, part long, places binary, weights binary, values binary"


def _changes(old: Network, new: Network, part: int, turns: np.ndarray, documents: int) -> Iterator[tuple]:
    """A row for each block of word vectors that changed, and one, block -1, for everything else.

    ``values`` has what was added to each of the block's vectors and to its sum of squares; ``weights`` what they count for.
    """
    pairs = zip([*new.dense(), *new.seen], [*old.dense(), *old.seen], strict=True)
    rest = np.concatenate([(a - b).ravel() for a, b in pairs])
    yield -1, part, np.zeros(1, np.int64), np.array([documents]), rest
    changed = np.flatnonzero(turns)
    values = np.column_stack([new.words[changed] - old.words[changed], new.seen_words[changed] - old.seen_words[changed]])
    for places in np.split(np.arange(len(changed)), np.flatnonzero(np.diff(changed // BLOCK)) + 1) if len(changed) else ():
        yield int(changed[places[0]] // BLOCK), part, changed[places], turns[changed[places]], values[places]


def average(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block, their weights in all parts and the parts' weighted means, summed in the order of the parts."""
    rows = sorted(rows, key=lambda r: r[1])
    places, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    weights = np.concatenate([r[3] for r in rows])
    values = np.concatenate([r[4].reshape(len(r[2]), -1) for r in rows]).astype(np.float64)
    total, sums = np.bincount(at, weights, len(places)), np.zeros((len(places), values.shape[1]))
    np.add.at(sums, at, values * weights[:, None])
    return places, total, (sums / total[:, None]).astype(np.float32)


def apply(net: Network, block: int, places: np.ndarray, values: np.ndarray) -> None:
    """Add mean changes to a network."""
    if block >= 0:
        net.words[places] += values[:, :-1]
        net.seen_words[places] += values[:, -1]
        return
    start, values = 0, values.ravel()
    for p in [*net.dense(), *net.seen]:
        p += values[start : start + p.size].reshape(p.shape)
        start += p.size


def _threshold(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the gap that parts the labels with the fewest errors of either kind.

    ``values`` are different; the others say how many documents of either kind have them.
    """
    order = np.argsort(values)
    values, toxic, clean = values[order], toxic[order], clean[order]
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    alarms = 1 - np.concatenate([[0], np.cumsum(clean)]) / max(1, clean.sum())
    edges = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    errors = missed + 2 * alarms
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edges[best].mean())


def calibrate(net: Network, logits: DataFrame) -> None:
    """Set the threshold of each language with enough rows of both labels, and that of the others.

    Takes ``lang, level, toxic``, of which ``level`` is a logit in whole steps of ``FINENESS``.  Levels are counted by
    Spark, so a language has ``2 * LIMIT / FINENESS`` counts at most, however many rows.
    """

    def threshold(table: pa.Table) -> pa.Table:
        toxic, clean = (table.column(c).to_numpy() for c in ("toxic", "clean"))
        found = _threshold(table.column("level").to_numpy() * FINENESS, toxic, clean)
        least = min(toxic.sum(), clean.sum())
        return pa.table({"lang": table.column("lang")[:1], "least": pa.array([least], pa.int64()), "threshold": pa.array([found])})

    both = F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang")  # each language, and all of them as null
    counted = logits.select(both, "level", "toxic").groupBy("lang", "level").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    for row in counted.groupBy("lang").applyInArrow(threshold, "lang string, least long, threshold double").collect():  # one row for each language
        if row.lang is None:
            net.common = row.threshold if row.least else 0.0
        elif row.least >= LEAST_CALIBRATION:
            net.shift[row.lang] = row.threshold


class Scorer:
    """Scores texts; remembers the vectors of words seen lately.

    Words are looked up ``GROUP`` at a time, so that a worker holds little beside the network and what it remembers.
    """

    def __init__(self, net: Network, most: int = 4 * GROUP) -> None:
        self.net, self.most = net, most
        self.joint = np.ascontiguousarray(net.joint().T)
        #: Rows of ``known``, numbered as words come; the empty word stands for the zeros after a text.
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.known = np.zeros((most, SIZE), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's row of ``known``."""
        if len(self.place) + len(words) >= self.most:
            self.place.clear()
        start = self.place[""] + 1 if not self.place else len(self.place)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if count := len(self.place) - start:
            new = list(islice(reversed(self.place), count))[::-1]
            for i in range(0, count, NEW):
                some = new[i : i + NEW]
                self.known[start + i : start + i + len(some)] = _summed(self.net.words, word_buckets(some)) / FORMS
        return at

    def logit(self, text: str | None, step: int = GROUP) -> float:
        return next(self.logits([_text_words(text)], step))

    def logits(self, texts: Iterable[list[str]], step: int = GROUP) -> Iterator[float]:
        """Of each text's words; texts of up to ``step`` words together are looked up at once."""
        group, size = [], 0
        for words in texts:
            if group and size + len(words) > step:
                yield from self._logits(group)
                group, size = [], 0
            # Long texts in overlapping parts of the words and the zeros after them: the largest answers of all are those of the whole.
            if len(words) > step:
                parts = [self._tops([words[i : i + step + PAD]], max(0, i + step + PAD - len(words))) for i in range(0, len(words), step)]
                yield from self._summed_up(np.max(parts, axis=0))
                continue
            group.append(words)
            size += len(words) + PAD + 1
        yield from self._logits(group)

    def _logits(self, group: list[list[str]]) -> list[float]:
        return self._summed_up(self._tops(group, PAD)) if group else []

    def _summed_up(self, tops: np.ndarray) -> list[float]:
        """Row by row, so that a text's logit doesn't depend on those beside it."""
        return ((np.ascontiguousarray(tops) * self.net.out).sum(axis=1) + self.net.base[0]).tolist()

    def _tops(self, group: list[list[str]], zeros: int) -> np.ndarray:
        """Each text's largest answers, with some zeros after it."""
        padded = [words + [""] * (zeros if words else PAD + 1) for words in group]
        at = self.places(list(chain.from_iterable(padded)))
        return self.net.tops(self.joint @ np.take(self.known, at, axis=0).T, np.cumsum([len(words) for words in padded]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1; each language's threshold is moved to 0.5."""
        logits = np.fromiter(self.logits(map(_text_words, texts)), np.float64, len(texts))
        told = self.net.profiles and self.net.shift
        limits = [self.net.shift.get(self.net.profiles.predict(t)[0] if told else "", self.net.common) for t in texts]
        return 1 / (1 + np.exp(-np.clip(logits - limits, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, language: str | None = "lang") -> Network:
    """Fit on all labelled documents for which ``learn`` (of ``doc_id``) holds.

    Takes ``doc_id, text`` and, unless ``language`` is None, the language column, from which the profiles
    that tell languages apart are learned, from all rows for which ``learn`` holds; and ``doc_id, toxic`` of ``labels``.  Rows without id, text
    or label are ignored; of several labels of one id the largest counts, and each row of an id teaches.  A quarter of
    the ids calibrates the thresholds, the others train.  Without rows of both labels all scores are far on one side.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    given = given.dropna().where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    given = shared.written(given.join(rows_of, "doc_id"))
    counts = given.groupBy(held.alias("held"), "toxic").agg(F.sum("rows").alias("count")).collect()
    kinds = {r.toxic for r in counts if not r.held}
    net = Network()
    if len(kinds) < 2:
        net.base[0] = 4.0 if kinds == {1} else -4.0 if kinds else 0.0
        return net
    if language is not None:
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(language).alias("lang"))
        net.profiles = language_id.collect_profiles(shared.written(language_id.learn_profiles(named.dropna().where(learn))))
    trained = sum(r["count"] for r in counts if not r.held)
    parts, passes = -(-trained // PART), max(PASSES, -(-VISITS // trained))
    packed = _packed(docs, given, held, parts, net.profiles)
    # A single part has all its passes in one job.
    for i in range(1 if parts == 1 else passes):
        _pass(net, packed.where("not held"), i, passes if parts == 1 else 1)
    calibrate(net, _logits(net, packed.where("held")))
    return net


def _packed(docs: DataFrame, given: DataFrame, held: Column, parts: int, profiles: language_id.Profiles | None) -> DataFrame:
    """The labelled documents, part by part, as numbers of words; ``words`` has the part's different words, ``buckets`` theirs where it trains.

    An id's part follows from the id, so that texts are shuffled once, to their labels; the rows of an id with more than a part's
    documents are dealt over several.  Texts of other documents are kept out of the shuffle by a Bloom filter of the labelled ids.
    """

    def pack(key: tuple, table: pa.Table, labels: pa.Table) -> pa.Table:
        toxic = dict(zip(labels.column("doc_id").to_pylist(), labels.column("toxic").to_pylist(), strict=True))
        at = pc.sort_indices(table, [("order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        at = at.filter(pa.array([i in toxic for i in table.column("doc_id").take(at).to_pylist()], pa.bool_()))
        if not len(at):
            return pa.Table.from_pylist([], pa.schema(_PACKED))
        table = table.select(["doc_id", "text"]).take(at)  # the only copy of the texts
        own, part = (k.as_py() for k in key)
        known: dict[str, int] = {}
        rows, langs = [], []
        for some in shared.slices(iter(table.to_batches()), SLICE):
            for text in some.column("text").to_pylist():
                rows.append(np.array([known.setdefault(w, len(known)) for w in _text_words(text)], np.int32))
                langs.append(profiles.predict(text)[0] if profiles and own else "")
        words = list(known)
        row = {
            "part": part,
            "held": own,
            "words": words,
            "buckets": None if own else word_buckets(words).tobytes(),
            "places": np.concatenate(rows).tobytes(),
            "sizes": [len(r) for r in rows],
            "toxic": [toxic[i] for i in table.column("doc_id").to_pylist()],
            "langs": langs,
        }
        return pa.Table.from_pylist([row], pa.schema(_PACKED))

    def dealt(rows: DataFrame, salt: Column, *columns: str | Column) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(11), "doc_id", salt.cast("long")), F.lit(parts))
        return rows.select("doc_id", *columns, held.alias("held"), part.alias("part")).groupBy("held", "part")

    shares = F.ceil(F.col("rows") / PART).cast("int").alias("shares")
    many = F.broadcast(given.where(F.col("rows") > PART).select("doc_id", shares))  # at most the number of parts
    labelled = shared.texts(docs).dropna().where(sketch.screen(given, "doc_id")(F.col("doc_id"))).join(many, "doc_id", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("text"), F.col("shares")), F.lit(0))
    texts = dealt(labelled, salt, "text", F.xxhash64("doc_id", "text").alias("order"))
    labels = dealt(given.withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1))), F.col("salt"), "toxic")
    schema = "part long, held boolean, words array<string>, buckets binary, places binary, sizes array<int>, toxic array<int>, langs array<string>"
    return shared.written(texts.cogroup(labels).applyInArrow(pack, schema))


_PACKED = [
    ("part", pa.int64()),
    ("held", pa.bool_()),
    ("words", pa.list_(pa.string())),
    ("buckets", pa.binary()),
    ("places", pa.binary()),
    ("sizes", pa.list_(pa.int32())),
    ("toxic", pa.list_(pa.int32())),
    ("langs", pa.list_(pa.string())),
]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[np.ndarray], np.ndarray]]:
    """Each part's row, its documents that have words as numbers of words, and which of its documents these are."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = one.to_pylist()[0]
            sizes = np.array(row["sizes"])
            rows = np.split(np.frombuffer(row["places"], np.int32), np.cumsum(sizes)[:-1])
            yield row, rows, np.flatnonzero(sizes)


def _pass(net: Network, packed: DataFrame, number: int, passes: int) -> None:
    """Train on every part from this network and add the parts' mean changes to it.

    Word vectors are averaged over the parts that changed them, by how often they did; everything else by documents.
    """
    sent = packed.sparkSession.sparkContext.broadcast(net)  # some MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, filled in _unpacked(batches):  # texts without words teach nothing
            if not len(filled):
                continue
            new, labels = copy.deepcopy(sent.value), np.array(row["toxic"])[filled]
            buckets = np.frombuffer(row["buckets"], np.min_scalar_type(BUCKETS - 1)).reshape(-1, FORMS)
            turns = train(new, [rows[d] for d in filled], buckets, labels, passes, [11, number, row["part"]])
            found = [(b, p, *(x.tobytes() for x in arrays)) for b, p, *arrays in _changes(sent.value, new, row["part"], turns, len(filled))]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "places", "weights", "values"])

    def mean(table: pa.Table) -> pa.Table:
        read = lambda r: (r["block"], r["part"], *(np.frombuffer(r[c], t) for c, t in (("places", np.int64), ("weights", np.int64), ("values", np.float32))))
        places, total, values = average([read(r) for r in table.to_pylist()])
        row = [table.column("block")[0].as_py(), 0, places.tobytes(), total.tobytes(), values.tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], table.column_names)

    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    means = packed.select("part", "buckets", "places", "sizes", "toxic").mapInArrow(run, _CHANGES).groupBy("block").applyInArrow(mean, _CHANGES)
    for row in means.collect():  # a network's size at most
        places = np.frombuffer(row.places, np.int64)
        apply(net, row.block, places, np.frombuffer(row.values, np.float32).reshape(len(places), -1))
    sent.destroy()


def _logits(net: Network, packed: DataFrame) -> DataFrame:
    """``lang, level, toxic`` of every document."""
    sent = packed.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for row, rows, _ in _unpacked(batches):
            words = row["words"]
            logits = np.fromiter(scorer.logits([words[w] for w in own.tolist()] for own in rows), np.float64, len(rows))
            levels = np.rint(np.clip(logits, -LIMIT, LIMIT) / FINENESS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["langs"], pa.string()), pa.array(levels), pa.array(row["toxic"], pa.int32())], ["lang", "level", "toxic"])

    return packed.mapInArrow(run, "lang string, level int, toxic int")


def score_documents(docs: DataFrame, net: Network, *keep: str | Column) -> DataFrame:
    """``doc_id, score, predicted`` for every row, from the whole text alone, and the columns to keep.

    ``predicted`` is 1 for scores of 0.5 and more.  Null and empty texts are scored as texts without words.
    Repeated rows get equal results; other columns are ignored.  Very long texts are scored whole, part by part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some MB, whatever the corpus

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # only texts go to Python, and only scores come back
        scorer = Scorer(sent.value)
        for batch in batches:
            parts = shared.slices(iter([pa.record_batch([batch], ["text"])]), SLICE)
            yield pa.array(np.concatenate([np.empty(0), *(scorer.scores(part.column(0).to_pylist()) for part in parts)]))

    rows = shared.texts(docs, *keep)
    # A filter by the result must not score once more.
    scored = rows.select("doc_id", score.asNondeterministic()("text").alias("__score"), *rows.columns[2:])
    predicted = (F.col("__score") >= 0.5).cast("int")
    return scored.select("doc_id", F.col("__score").alias("score"), predicted.alias("predicted"), *rows.columns[2:])
