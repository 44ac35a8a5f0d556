"""Half precision, distances, encoders and centroids against numpy."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusdrift.functions import vectors
from corpusdrift.operators import embedding, sections


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(0)
    exponents = rng.uniform(-26, 17, 20_000)
    values = (rng.choice([-1, 1], 20_000) * 2.0**exponents).astype(np.float32)
    special = [0.0, 1.0, -1.0, 2**-14, 2**-24, 2**-25, 3 * 2**-25, 65504, 65519.99, 65520, 1 + 2**-11, 1 + 3 * 2**-11]
    values = np.concatenate([values, np.array(special, np.float32)])
    table = spark.createDataFrame([(values.tolist(),)], "v array<float>")
    found = np.array(table.select(vectors.quantize_half(F.col("v"))).first()[0])
    with np.errstate(over="ignore"):
        expected = values.astype(np.float16).astype(np.float64)
    assert np.array_equal(found, expected)


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ([1.0, 2.0], [1.0, 2.0], 0.0),
        ([1.0, 2.0], [10.0, 20.0], 0.0),
        ([1.0, 2.0], [-1.0, -2.0], 1.0),
        ([1.0, 0.0], [0.0, 3.0], 0.5),
        ([0.0, 0.0], [1.0, 1.0], None),
        (None, [1.0], None),
        ([1.0], None, None),
    ],
)
def test_rescaled_distance(spark, left, right, expected):
    table = spark.createDataFrame([(left, right)], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert table.select(vectors.rescaled_distance(a, b)).first()[0] == expected


def _sections(spark, data):
    table = spark.createDataFrame(
        data, "title_id string, part_id string, section_id string, section_name string, section_text string"
    )
    return sections.with_hash(table)


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        ("T-2024", "Part-0001", "s1", "1.1", "alpha beta"),
        ("T-2024", "Part-0001", "s2", "1.2", "alpha beta"),
        ("T-2024", "Part-0001", "s3", "1.3", "gamma"),
        ("T-2024", "Part-0002", "s1", "2.1", "alpha beta"),
        ("T-2023", "Part-0001", "s1", "1.1", "alpha beta"),
        ("T-2023", "Part-0001", "s2", "1.2", "old"),
    ]
    return _sections(spark, data)


def test_bag_of_words(spark, corpus):
    texts = embedding.focal_texts(corpus)
    assert texts.count() == 2
    found = {r.section_hash: r.section_embedding for r in embedding.bag_of_words(texts, 8).collect()}
    assert all(len(v) == 8 and np.isclose(np.linalg.norm(v), 1) for v in found.values())
    assert len(found) == 2


def test_any_encoder(corpus):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)

    encoded = embedding.encode(embedding.focal_texts(corpus), load, batch=1)
    assert rows(encoded, "section_embedding") == [([10.0, 3.0],), ([5.0, 2.0],)]


def test_centroids_weight_copies(spark, corpus):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], float)

    encoded = embedding.encode(embedding.focal_texts(corpus), load)
    centroids = {
        (r.title_id, r.part_id): r.part_embedding
        for r in embedding.part_centroids(corpus, encoded).collect()
    }
    assert centroids.keys() == {("T-2024", "Part-0001"), ("T-2024", "Part-0002")}
    assert np.allclose(centroids["T-2024", "Part-0001"], [(10 + 10 + 5) / 3, 1.0])


def test_propagate_keeps_rows_and_counts_copies(spark, corpus):
    encoded = embedding.bag_of_words(embedding.focal_texts(corpus), 4)
    plain = embedding.propagate(corpus, encoded)
    assert plain.count() == corpus.count()
    assert plain.filter("section_embedding is null").count() == 1
    copies = embedding.propagate(corpus, encoded, multiplicity=True)
    found = {(r.title_id, r.part_id, r.section_id): r.copies for r in copies.collect()}
    assert found["T-2023", "Part-0001", "s1"] == 3
    assert found["T-2023", "Part-0001", "s2"] == 1
    assert found["T-2024", "Part-0001", "s3"] == 1


def _weighted(spark, seed=4):
    rng = np.random.default_rng(seed)
    scale = rng.choice([1e-7, 1e-3, 1, 60_000], (3000, 5))
    values = (rng.normal(size=(3000, 5)) * scale).clip(-65_000, 65_000).astype(np.float16).astype(float)
    data = [(f"p{i % 7}" if i % 11 else None, values[i].tolist(), int(rng.integers(1, 9)), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "part string, v array<float>, copies bigint, i int")


def test_means_are_equal_to_the_last_bit_in_any_order(spark):
    data, table = _weighted(spark)
    expected = {}
    for part in {d[0] for d in data}:
        own = [d for d in data if d[0] == part]
        total = sum(d[2] for d in own)
        sums = [sum(Fraction(d[1][k]) * d[2] for d in own) for k in range(5)]
        expected[part] = [float(s * 2**24) / (total * 2.0**24) for s in sums]
    for parts in (1, 7, 200):
        shuffled = table.orderBy(F.xxhash64("i", F.lit(parts))).repartition(parts)
        found = vectors.exact_means(shuffled, ["part"], "v", "copies").collect()
        assert {r["part"]: list(r["mean"]) for r in found} == expected


def test_means_of_odd_vectors(spark):
    schema = "part string, v array<float>, copies bigint"
    rows = [("a", [1.0, float("inf")], 1), ("a", [2.0, 1.0], 3), ("b", None, 1), ("c", [], 2)]
    found = {r["part"]: r["mean"] for r in vectors.exact_means(spark.createDataFrame(rows, schema), ["part"], "v", "copies").collect()}
    assert found["a"][0] == 1.75 and np.isnan(found["a"][1]) and "b" not in found
    assert vectors.exact_means(spark.createDataFrame([], schema), ["part"], "v", "copies").collect() == []
    uneven = spark.createDataFrame([("a", [1.0], 1), ("a", [1.0, 2.0], 1)], schema)
    for table in (uneven.coalesce(1), uneven.repartition(2)):
        with pytest.raises(Exception, match="different length"):
            vectors.exact_means(table, ["part"], "v", "copies").collect()


def test_texts_are_encoded_with_others_of_similar_length(spark):
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(5, 200, 900), rng.integers(2_000, 20_000, 100), [300_000]])
    rng.shuffle(sizes)
    data = [(f"h{i}", "x" * int(n)) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(data, "section_hash string, section_text string").coalesce(1)
    plain = [sizes[i : i + 32] for i in range(0, len(sizes), 32)]
    padded = sum(len(part) * part.max() for part in plain)

    def load():
        # Every vector also tells how long its batch was when padded.
        return lambda texts: np.array([[len(t), max(map(len, texts)), len(texts)] for t in texts], float)

    found = {r.section_hash: list(r.section_embedding) for r in embedding.encode(table, load).collect()}
    assert {h: v[0] for h, v in found.items()} == {h: len(t) for h, t in data}
    assert sum(v[1] for v in found.values()) < padded / 2
    assert all(v[2] <= 32 and (v[1] * v[2] <= embedding.BATCH_LENGTH or v[2] == 1) for v in found.values())


def test_batches_hold_every_text_once():
    for lengths in ([], [0], [5, 0, 5, 9, 100], [10] * 70):
        parts = list(embedding.length_batches(lengths, 32, 50))
        assert sorted(i for part in parts for i in part) == list(range(len(lengths)))
