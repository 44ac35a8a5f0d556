"""Centroid clustering and best-fit packing against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from corpusdrift.llm import centroids, packing, queries, shared

FILE = shared.tokenizer_file(queries.VOCABULARY)


# Clustering.


def brute_clusters(rows, spec):
    kept = [
        (i, [max(-centroids.MOST, min(centroids.MOST, math.floor(spec.scale * x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == spec.size and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"{spec.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=key)[: spec.count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(middle))
    for _ in range(spec.rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(middle)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == k]
            middle[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else middle[k]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, c, d in found if c == k) for k in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    bounded = lambda x: x if x < 2**63 else None
    return sorted(((i, c, d, bounded(sums[c]), bounded(sum(sums)), digest[c]) for i, c, d in found), key=repr)


def clustered(spark, rows, spec):
    table = spark.createDataFrame([(i, v, 1, [0]) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v array<int>")
    return sorted(map(tuple, centroids.cluster(table, spec).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    spec = centroids.Centroids(size=3, scale=8, count=4, rounds=3, seed=seed)
    rows = [(i if i % 7 else None, [rng.gauss(3 * (i % 3), 1) for _ in range(3)]) for i in range(80)]
    rows += rows[:9]  # repeated rows
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0]), (504, [1.0, math.nan, 0.0]), (505, [math.inf, 0.0, 0.0])]
    rows += [(506, [1e300, -1e300, 0.0]), (507, [-0.0, 0.124999, -0.125]), (508, [1.0] * 4)]
    found = clustered(spark, rows, spec)
    assert found == brute_clusters(rows, spec) and len(found) == 91


def test_ties_and_empty_clusters_and_few_vectors(spark):
    spec = centroids.Centroids(size=2, scale=1, count=3, rounds=2)
    same = [(i, [5.0, -5.0]) for i in range(10)]  # all at the first centroid; the others stay empty
    assert clustered(spark, same, spec) == brute_clusters(same, spec)
    few = [(1, [0.0, 0.0]), (2, [9.0, 9.0])]
    assert clustered(spark, few, spec) == brute_clusters(few, spec)
    assert clustered(spark, [], spec) == [] and clustered(spark, [(1, None)], spec) == []


def test_clustering_is_left_to_the_jvm(spark):
    plan = queries.op11_centroids(spark, DATA)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("MapInArrow", "ArrowEval", "BatchEvalPython", "Pandas"))


# Packing.


def check_bins(lengths, numbers, offsets, capacities):
    bins = {}
    for length, number, offset in zip(lengths, numbers, offsets, strict=True):
        bins.setdefault(number, []).append((offset, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacities.tokens and len(own) <= capacities.documents
        assert sum(n * n for _, n in own) <= capacities.attention
    return len(bins)


def one_by_one(lengths, capacities):
    """Each piece where the weighted remainder is shortest after it; the oldest of equal ones doesn't matter for the count."""
    full = np.array([capacities.tokens, capacities.documents, capacities.attention])
    left = []
    for n in lengths:
        piece = np.array([n, 1, n * n])
        fits = [(float((((x - piece) / full) ** 2) @ np.array(capacities.weights)), i) for i, x in enumerate(left) if (x >= piece).all()]
        if fits:
            i = min(fits)[1]
            left[i] = left[i] - piece
        else:
            left.append(full - piece)
    return len(left)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("bounds", [(64, 64, 64 * 64), (64, 3, 64 * 64), (64, 64, 900), (50, 4, 1_200)])
def test_packing_keeps_every_capacity(rule, bounds):
    capacities = packing.Capacities(*bounds, rule=rule)
    rng = np.random.default_rng(sum(bounds))
    for count in (0, 1, 2, 50, 700):
        lengths = np.sort(rng.integers(1, capacities.longest + 1, count))[::-1]
        numbers, offsets = packing.pack(lengths, capacities)
        used = check_bins(lengths, numbers, offsets, capacities)
        least = max(math.ceil(lengths.sum() / bounds[0]), math.ceil(count / bounds[1]), math.ceil((lengths**2).sum() / bounds[2]))
        assert least <= used <= 1.4 * least + 2
        if rule == "norm":
            assert used == one_by_one(lengths, capacities)


def test_impossible_capacities_are_refused():
    for bad in ((0, 1, 1), (10, 0, 10), (10, 10, 0)):
        with pytest.raises(ValueError):
            packing.Capacities(*bad)


def packed(spark, rows, monkeypatch, group=20, **more):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, sequence_id int, row int")
    return packing.pack_documents(docs, FILE, 2, packing.Capacities(**more)).collect()


def check_packing(found, rows, library, capacities):
    ids = [np.append(library.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4") for _, t in rows]
    expected = []
    for (doc_id, _), own in zip(rows, ids, strict=True):
        first = len(own) % capacities.longest or capacities.longest
        cuts = [0, *range(first, len(own) + 1, capacities.longest)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    return check_bins([r.length for r in found], [r.sequence_id for r in found], [r.offset for r in found], capacities)


AWKWARD = [(3, None), (1, ""), (None, "no id"), (None, "no id"), (5, "same"), (5, "same"), (4, "many words, " * 9_000), (6, "word" * 700)]


@pytest.mark.parametrize("more", [{}, {"tokens": 64, "documents": 3, "attention": 2_000}, {"rule": "dot", "tokens": 128, "attention": 128 * 128}])
def test_awkward_documents_are_packed_whole(spark, monkeypatch, more):
    library = Tokenizer.from_file(FILE)
    rng = random.Random(5)
    rows = AWKWARD + [(100 + i, "some text here " * rng.randrange(40)) for i in range(150)]
    check_packing(packed(spark, rows, monkeypatch, **more), rows, library, packing.Capacities(**more))
    assert packed(spark, [], monkeypatch) == []


def test_query_packs_all_documents_tightly(spark):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, DATA, "documents").collect()]
    found = queries.op13_best_fit(spark, DATA).collect()
    used = check_packing(found, rows, Tokenizer.from_file(FILE), packing.Capacities())
    assert used <= math.ceil(sum(r.length for r in found) / 1024) + 2
