"""The pipeline's stages against what the operators alone and brute force say."""

import hashlib

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_repeats
from tokenizers import Tokenizer

from corpusdrift.llm import decontaminate, queries, shared, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def short_training():
    usual, toxicity.VISITS = toxicity.VISITS, 3_000
    yield
    toxicity.VISITS = usual


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage."""
    docs, out = shared.table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, FOLDER))
        out.append(docs)
    return [shared.table(spark, FOLDER, "documents"), *out]


def plain(table):
    return sorted(map(tuple, table.collect()))


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontaminate", "bpe"]


def test_each_stage_returns_documents(steps):
    for table in steps[1:-1]:
        assert table.dtypes == steps[0].dtypes
    counts = [t.count() for t in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2


def test_toxic_documents_go(spark, steps):
    net = toxicity.fit(steps[0], shared.table(spark, FOLDER, "labels"), queries.toxic_training())
    gone = {r.doc_id for r in toxicity.score_documents(steps[0], net).where("predicted = 1").collect()}
    assert plain(steps[1]) == [r for r in plain(steps[0]) if r[0] not in gone]


def test_one_of_each_group_stays(steps):
    kept = {c[0] for c in brute_components([(r.doc_id, r.text) for r in steps[1].collect()]) if c[3]}
    assert plain(steps[2]) == [r for r in plain(steps[1]) if r[0] in kept]


def test_repeated_passages_go(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    expected = {}
    for doc_id, kept, gone, _ in brute_repeats([(d, r.text) for d, r in before.items()]):
        if kept or not gone:
            expected[doc_id] = kept if gone else before[doc_id].text
    found = {r.doc_id: r for r in steps[3].collect()}
    assert {d: r.text for d, r in found.items()} == expected
    assert all(r.n_chars == (len(r.text) if r.text != before[d].text else before[d].n_chars) for d, r in found.items())


def test_documents_with_benchmark_items_go(spark, steps):
    leaks = {r.doc_id for r in decontaminate.find_leaks(steps[3], shared.table(spark, FOLDER, "benchmark")).collect()}
    assert plain(steps[4]) == [r for r in plain(steps[3]) if r[0] not in leaks]


def test_what_is_left_is_encoded(spark, steps):
    library = Tokenizer.from_file(shared.tokenizer_file(queries.VOCABULARY))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids), sha(r.text)) for r in steps[4].collect()]
    assert plain(steps[5].select("doc_id", "n_tokens", "decoded_sha256")) == sorted(expected)
    assert plain(corpus_pipeline.run(spark, FOLDER)) == plain(steps[5])


def test_few_texts_go_to_python_at_once(spark):
    docs, rows = shared.table(spark, FOLDER, "documents"), {}

    def batches(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.num_rows]})

    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER)
        rows[name] = max(r.n for r in spark.range(12_000, numPartitions=1).mapInArrow(batches, "n long").collect())
    # The others cut their batches of texts themselves.
    assert rows == {"toxicity": 2_000, "near_duplicates": 2_000, "substring_dedup": 10_000, "decontaminate": 10_000, "bpe": 2_000}


def test_awkward_rows_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50_000, None, None, 1), (3, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, shared.table(spark, FOLDER, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        again = stage(spark, docs.limit(0), FOLDER)
        assert again.count() == 0
        docs = shared.written(stage(spark, docs, FOLDER))
    assert docs.select(F.countDistinct("doc_id")).first()[0] >= 2


def test_other_columns_may_have_any_name(spark):
    docs = shared.table(spark, FOLDER, "documents")
    names = ["score", "predicted", "n_words", "n_removed", "kept_text", "other", "whole_text", "component_id", "kept", "copy", "row", "odd name"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found, plain = stage(spark, wide, FOLDER), stage(spark, docs, FOLDER)
        assert found.columns == wide.columns, name
        assert sorted(map(tuple, found.select(*docs.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        assert found.where(" or ".join(f"`{n}` != concat('{n}', doc_id)" for n in names)).isEmpty()
    narrow = docs.select("text", "doc_id")
    assert corpus_pipeline.STAGES[2][1](spark, narrow, FOLDER).columns == ["text", "doc_id"]
