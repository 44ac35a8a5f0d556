"""Near-duplicate documents by an LSH forest over word shingles.

Every document gets several short MinHash signatures, one for each tree.  A tree is its
signatures in sorted order; documents that stand next to each other and share a long
prefix are likely to be alike.  Documents that share ``LEAST_DEPTH`` hashes are a region.  A region of a few
rows is compared whole; in a larger one each row goes down to the depth at which few rows are left, and is compared
with those and with the next row of the region.

The first trees are read for the next rows only.  The links they give join most copies up, and rows of one
component are not compared again.  What is left then are large regions that hold several components: all
documents of these are joined exactly at the end.  Shingles are ordered rarest first, and two sets that are alike
enough have one of the first few of each in common (prefix, length and positional filters).

Candidates of all steps are confirmed on their full shingle sets.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import components, shared

SHINGLE_WORDS = 5
TREES, HASHES = 24, 6
#: A pair of similarity 0.75 shares 3 hashes in some tree but for 2 in a million.
LEAST_DEPTH = 3
#: Trees whose next rows are linked before all trees are read.
FIRST_TREES = 4
#: Rows of a region that are all compared with each other.
REGION = 6
#: Bits of the buckets in which the exact join counts shingles; any order of shingles gives the same pairs.
BUCKET_BITS = 21

_rng = np.random.default_rng(20_240_607)
_FACTORS = _rng.integers(0, 2**31, TREES * HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 2**32, TREES * HASHES, dtype=np.uint32)


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingles' hashes; of fewer words, the whole sequence is one shingle."""
    words = shared.word_hashes(text, lower=True)
    if not len(words):
        return words
    length = min(size, len(words))
    found = shared.window_hashes(words, length)
    return np.unique(found if length == size else shared.mixed(found + np.uint64(length)))


def _signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the least value that each of the hash functions gives any shingle."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 256):
        hashed = np.multiply.outer(values[start : start + 256], _FACTORS)
        hashed += _OFFSETS
        np.minimum(least, hashed.min(axis=0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")


FACTS = "id long, text_1 long, text_2 long, row long, n_shingles long, set_1 long, set_2 long, signature binary"
_SAME_SET = ["set_1", "set_2", "n_shingles"]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _facts(docs: DataFrame) -> DataFrame:
    """For each row a number, the size and the fingerprint of its shingle set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in shared.slices(batches):
            sizes, ones, twos, signatures = [], [], [], []
            for text in shared.raw_texts(batch.column(3)):
                found = shingles(text)
                sizes.append(len(found))
                ones.append(found.sum(dtype=np.uint64))
                twos.append(shared.mixed(found + np.uint64(1)).sum(dtype=np.uint64))
                signatures.append(_signature(found).tobytes() if len(found) else None)
            numbers = pa.array(row + np.arange(batch.num_rows))
            row += batch.num_rows
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ones, twos)]
            columns = [*batch.columns[:3], numbers, pa.array(sizes, pa.int64()), *prints, pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _names(FACTS))

    return docs.select("id", "text_1", "text_2", "text").mapInArrow(run, FACTS)


TREE = "key_1 long, key_2 long, node long, component long"
_ORDER = ["key_1", "key_2", "node"]


def _keys(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of every tree's signature, a row for each document; the first begins with the tree's number."""
    hashed = np.frombuffer(b"".join(packed.to_pylist()), "<u2").reshape(-1, TREES, HASHES).astype(np.int64)
    halves = [(hashed[:, :, i] << 32) | (hashed[:, :, i + 1] << 16) | hashed[:, :, i + 2] for i in (0, 3)]
    return halves[0] | (np.arange(TREES) << 48), halves[1]


def _trees(sets: DataFrame, trees: int) -> DataFrame:
    """One row for each of the first trees and each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            columns = [half[:, :trees].ravel() for half in _keys(batch.column(2))]
            columns += [np.repeat(batch.column(i).to_numpy(), trees) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), _names(TREE))

    return sets.select("node", "component", "signature").mapInArrow(run, TREE)


def _shared_depth(first: np.ndarray, second: np.ndarray, step: int) -> np.ndarray:
    """How many leading hashes each row shares with the row ``step`` places further; 0 for fewer than three."""
    other = second[:-step] ^ second[step:]
    return np.where(first[:-step] == first[step:], 3 + (other < 1 << 32) + (other < 1 << 16) + (other == 0), 0)


NEIGHBOURS = "kind int, a long, b long, key_1 long, key_2 long, component long"
_PAIR, _EDGE, _CROWDED = range(3)


def _look(part: tuple[np.ndarray, ...], only_next: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in sorted rows that are to be compared, and places in large regions where components meet."""
    first, second, _, groups = part
    count, deepest = len(first), np.zeros(len(first), np.int64)
    if count > REGION:
        far = _shared_depth(first, second, REGION)
        for shift in range(REGION + 1):
            at = slice(shift, shift + len(far))
            deepest[at] = np.maximum(deepest[at], far)
    pairs, crowded = [np.empty((0, 2), np.int64)], np.empty(0, np.int64)
    for step in range(1, min(2 if only_next else REGION, count)):
        depth = _shared_depth(first, second, step)
        other = groups[:-step] != groups[step:]
        least = LEAST_DEPTH if step == 1 else np.maximum(LEAST_DEPTH, deepest[:-step] + 1)
        at = np.flatnonzero(other & (depth >= least))
        pairs.append(np.stack([at, at + step], axis=1))
        if step == 1:
            crowded = np.flatnonzero(other & (depth >= LEAST_DEPTH) & (deepest[:-1] >= LEAST_DEPTH))
    return np.concatenate(pairs), crowded


def _neighbours(rows: DataFrame, only_next: bool, edges: bool) -> DataFrame:
    """Pairs ``a, b`` of near rows of sorted trees, of different ``component``.

    The first and last rows of each partition come out once more as edges, to be compared across the border;
    so does one row for each large region in which components meet.
    """
    context = 2 * REGION

    def batch_of(kind, a, b, *more):
        zeros = np.zeros(len(a), np.int64)
        columns = [np.full(len(a), kind, np.int32), a, b, *more, *[zeros] * (3 - len(more))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], _names(NEIGHBOURS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for batch in batches:
            part = tuple(c.to_numpy() for c in batch.columns)
            if edges and seen < context:
                head = [x[: context - seen] for x in part]
                yield batch_of(_EDGE, head[2], head[2], head[0], head[1], head[3])
            seen += batch.num_rows
            if held is not None:
                part = tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            pairs, crowded = _look(part, only_next)
            one, two = part[2][pairs[:, 0]], part[2][pairs[:, 1]]
            yield batch_of(_PAIR, np.minimum(one, two), np.maximum(one, two))
            regions = np.unique(part[0][crowded])
            yield batch_of(_CROWDED, regions, regions)
            held = tuple(x[-context:] for x in part)
        if edges and seen > context:  # rows that weren't among the first
            tail = [x[-min(context, seen - context) :] for x in held]
            yield batch_of(_EDGE, tail[2], tail[2], tail[0], tail[1], tail[3])

    return rows.select(*_names(TREE)).mapInArrow(run, NEIGHBOURS)


def _near_pairs(rows: DataFrame, only_next: bool) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs in sorted trees, and the crowded regions."""
    spread = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = shared.written(_neighbours(spread, only_next, edges=True))
    # At most 4 x REGION rows for each partition.
    border = found.where(F.col("kind") == _EDGE).select("key_1", "key_2", F.col("a").alias("node"), "component")
    border = border.repartition(F.shiftright("key_1", 48)).sortWithinPartitions(*_ORDER)
    both = found.union(shared.written(_neighbours(border, only_next, edges=False)))
    pairs = both.where((F.col("kind") == _PAIR) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    return pairs, both.where(F.col("kind") == _CROWDED).select(F.col("a").alias("region"))


def _in_crowds(sets: DataFrame, regions: DataFrame) -> DataFrame:
    """The sets that stand in a crowded region of any tree; once each, and a few others."""
    bits = shared.bit_filter(regions.select("region"))
    if bits is None:
        return sets.where("false")
    known = sets.sparkSession.sparkContext.broadcast(bits)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            first, _ = _keys(batch.column("signature"))
            held = shared.in_filter(known.value, first.ravel()).reshape(first.shape).any(axis=1)
            yield batch.filter(pa.array(held))

    return sets.mapInArrow(run, sets.schema)


def _texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, packed``: the text of each of ``node, text_1, text_2``, compressed, found again by its two hashes."""
    bits = shared.bit_filter(sets.select("text_1"))
    known = docs.sparkSession.sparkContext.broadcast(bits)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in shared.slices(batches):
            at, packed = [], []
            for i in np.flatnonzero(shared.in_filter(known.value, batch.column(0).to_numpy())).tolist():
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key not in seen:
                    seen.add(key)
                    at.append(i)
                    packed.append(packer.compress(batch.column(2)[i].as_buffer()))
            chosen = [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*chosen, pa.array(packed, pa.binary())], ["text_1", "text_2", "packed"])

    if bits is None:
        return sets.select("node", F.lit(b"").alias("packed")).where("false")
    given = docs.where("text is not null").select("text_1", "text_2", F.col("text").cast("binary").alias("text"))
    found = given.mapInArrow(run, "text_1 long, text_2 long, packed binary").dropDuplicates(["text_1", "text_2"])
    return shared.written(sets.join(found, ["text_1", "text_2"]).select("node", "packed"))


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Shingle sets of packed texts; one that stands several times in a row is made once."""
    reader, last, found = zstandard.ZstdDecompressor(), None, None
    for packed in column:
        raw = packed.as_py()
        if raw != last:
            last, found = raw, shingles(reader.decompress(raw))
        yield found


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose shingle sets reach the similarity; ``texts`` are ``node, packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches):
            linked = []
            for left, right in zip(_sets_of(batch.column(2)), _sets_of(batch.column(3)), strict=True):
                low, high = sorted((len(left), len(right)))
                both = len(np.intersect1d(left, right, assume_unique=True)) if 100 * low >= percent * high else 0
                linked.append(100 * both >= percent * (low + high - both) and both > 0)
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """About how many texts hold a shingle, by the first bits of its hash; one array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**BUCKET_BITS, np.int64)
        for batch in shared.slices(batches):
            for found in _sets_of(batch.column(0)):
                np.add.at(total, (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select("packed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found, out = counted.toArrow(), np.zeros(2**BUCKET_BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


PREFIXES = "shingle long, id long, component long, n long, behind long, short boolean"


def _prefixes(crowd: DataFrame, percent: int) -> DataFrame:
    """The first shingles of each text of ``node, component, packed``, rarest first.

    A linked pair's first common shingle is among these for the longer set, and among those marked
    ``short`` for the shorter one.  ``behind`` counts the shingles from there to the end.
    """
    known = crowd.sparkSession.sparkContext.broadcast(_bucket_counts(crowd))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, 500_000):
            out: list[list[np.ndarray]] = []
            ids, groups = (batch.column(i).to_numpy() for i in (0, 1))
            for i, found in enumerate(_sets_of(batch.column(2))):
                n = len(found)
                counts = known.value[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                first = np.lexsort((found, counts))[: n - -(-percent * n // 100) + 1]
                place = np.arange(len(first))
                full = lambda x, like=place: np.full(len(like), x, np.int64)
                short = place < n - -(-2 * percent * n // (100 + percent)) + 1
                out.append([found[first].view(np.int64), full(ids[i]), full(groups[i]), full(n), n - place, short])
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, _names(PREFIXES))

    return crowd.select("node", "component", "packed").mapInArrow(run, PREFIXES)


def _exact_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a, b`` of different components whose sets may be alike enough; none that is, is left out.

    Components are joined first, each as one row for a shingle, so that the rows of a large one
    aren't compared with each other.  Shingles that only one component has go before that.  The largest and
    most frequent shingles' rows are split by Spark's skew join; no row is repeated for that.
    """
    rows = shared.written(_prefixes(crowd, percent))
    of_shingle = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    met = of_shingle.where("low != high").select("shingle")
    rows = shared.written(rows.join(met, "shingle", "left_semi"))
    by_group = ["shingle", "component"]
    figures = F.min("n").alias("least"), F.max("n").alias("most"), F.max("behind").alias("behind")
    named = lambda table, end: table.select("shingle", *(F.col(c).alias(f"{c}_{end}") for c in table.columns if c != "shingle"))
    longer, shorter = (table.groupBy(*by_group).agg(*figures) for table in (rows, rows.where("short")))
    enough = lambda n, m: F.least("behind_a", "behind_b") * (100 + percent) >= percent * (F.col(n) + F.col(m))
    groups = (
        named(longer, "a").join(named(shorter, "b"), "shingle")
        .where("component_a != component_b and least_b <= most_a")
        .where((100 * F.col("most_b") >= percent * F.col("least_a")) & enough("least_a", "least_b"))
        .select("shingle", "component_a", "component_b")
    )
    one, two = named(rows.drop("short"), "a"), named(rows.where("short").drop("short"), "b")
    found = shared.written(groups).join(one, ["shingle", "component_a"]).join(two, ["shingle", "component_b"])
    found = found.where((F.col("n_b") <= F.col("n_a")) & (100 * F.col("n_b") >= percent * F.col("n_a")) & enough("n_a", "n_b"))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with their component: the smallest node reachable over the links."""
    found = components.components(links).withColumnRenamed("component", "found")
    return sets.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("found", "node")).drop("found")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of documents linked by ``100 * shared shingles >= percent * all shingles``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A shingle is five consecutive words
    (between ASCII white space, A-Z lower-cased); of fewer words the whole sequence is one.

    Returns one row for each input row: ``doc_id, n_shingles, component_id`` (the smallest ``doc_id``
    reachable over links), ``kept`` (whether it is that one).  Null and empty texts have no
    shingles and no links.  Rows of equal ``doc_id`` are one document: linked with what any of them is
    linked with, and all kept or none.  A missing ``doc_id`` counts as the smallest and comes back
    as null, and so does a ``component_id`` that is missing.  A very long text is one set like any other.
    """
    texts = F.col("text")
    rows = shared.texts(docs).select(F.coalesce("doc_id", F.lit(shared.NO_ID)).alias("id"), "text")
    rows = rows.withColumns({"text_1": F.xxhash64(texts), "text_2": F.xxhash64(F.lit(1), texts)})
    facts = shared.written(_facts(rows))
    # Documents with the same set are one node; what distinguishes nodes is the number of a row, never an id.
    found = facts.where("n_shingles > 0").groupBy(*_SAME_SET)
    firsts = [F.first(c).alias(c) for c in ("signature", "text_1", "text_2")]
    sets = found.agg(F.min("row").alias("node"), F.min("id").alias("least_id"), *firsts)
    sets = shared.written(sets.withColumn("component", F.col("node")))

    def confirmed(pairs: DataFrame, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = reduce(DataFrame.union, more, pairs.select(F.explode(F.array("a", "b")).alias("node")))
        ends = shared.written(sets.select("node", "text_1", "text_2").join(ends, "node", "left_semi"))
        wanted = _texts_of(rows, ends)
        return shared.written(confirm(pairs, wanted, percent)), wanted

    first = shared.written(_near_pairs(_trees(sets, FIRST_TREES), only_next=True)[0])
    links, _ = confirmed(first)
    joined = shared.written(_labelled(sets, links))
    pairs, regions = _near_pairs(_trees(joined, TREES), only_next=False)
    pairs = shared.written(pairs.join(first, ["a", "b"], "left_anti"))
    crowd = shared.written(_in_crowds(joined, regions).select("node"))
    new, wanted = confirmed(pairs, crowd)
    links = links.union(new)
    # Rows of one id are one document: ids that have rows of several sets, or of a set and of none.
    ends = [f(c).alias(f"{name}_{c}") for c in _SAME_SET for name, f in (("low", F.min), ("high", F.max))]
    several = facts.groupBy("id").agg(*ends).where(" or ".join(f"low_{c} != high_{c}" for c in _SAME_SET)).select("id")
    several = shared.written(several)
    no_several = several.isEmpty()
    if not no_several:
        members = facts.where("n_shingles > 0").join(several, "id").join(sets.select(*_SAME_SET, "node"), _SAME_SET)
        members = shared.written(members.select("id", "node").distinct())
        least = members.groupBy("id").agg(F.min("node").alias("a"))
        links = links.union(members.join(least, "id").where("a < node").select("a", F.col("node").alias("b")))
    joined = shared.written(_labelled(sets, links).select(*_SAME_SET, "node", "least_id", "component"))
    if not crowd.isEmpty():
        crowded = joined.select("node", "component").join(crowd, "node", "left_semi").join(wanted, "node")
        late = _exact_pairs(crowded, percent).join(first.union(pairs), ["a", "b"], "left_anti")
        late = shared.written(confirm(shared.written(late), wanted, percent))
        if not late.isEmpty():
            joined = shared.written(_labelled(sets, links.union(late)).select(*_SAME_SET, "node", "least_id", "component"))
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_set = joined.join(least, "component").select(*_SAME_SET, "node", "component_id")
    result = facts.select("id", *_SAME_SET).join(per_set.drop("node"), _SAME_SET, "left")
    if not no_several:
        # Rows without shingles belong to the other rows of their id.
        of_id = members.join(per_set.select("node", "component_id"), "node").groupBy("id").agg(F.min("component_id").alias("of_id"))
        result = result.join(of_id, "id", "left").withColumn("component_id", F.coalesce("component_id", "of_id"))
    component = F.coalesce("component_id", "id")
    unset = lambda c: F.when(c != shared.NO_ID, c)
    return result.select(
        unset(F.col("id")).alias("doc_id"),
        "n_shingles",
        unset(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
