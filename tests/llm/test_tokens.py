"""Token store and BPE operator against the tokenizers library."""

import gc
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusdrift.llm import bpe, queries, shared, token_store

FILE = shared.tokenizer_file(queries.VOCABULARY)
SCHEMA = "doc_id long, text string, n_tokens string, file string, start int"
AWKWARD = [
    (3, None, "x", None, 1),
    (1, "", None, None, None),
    (None, "no id", None, None, None),
    (2, "a  b\n\n c<|endoftext|> d  \u0085 é日本語" + " " * 500, "y", "f", 2),
    (5, "same", None, None, None),
    (5, "same", None, None, None),
    (4, "word" * 30_000 + " " + "many words, " * 30_000, None, None, None),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_the_library_on_random_texts(library):
    words, rng = bpe.Vocabulary(open(FILE).read()), random.Random(3)
    letters = " \n\t ab'sreAz19.,é日 \u0085\x1c"
    for k in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        text = text.replace("z", "<|endoftext|>") if k % 5 == 0 else text
        ids = np.frombuffer(words.encode(text), "<u4")
        assert ids.tolist() == ids_of(library, text).tolist()
        assert words.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    words = bpe.Vocabulary(open(FILE).read())
    assert all(words.encode_word(t) == [i] for i, t in words.bytes_of.items() if i not in words.special.values())


def test_op9_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in shared.table(spark, DATA, "documents").collect()}
    found = queries.op9_bpe(spark, DATA).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op9_awkward_rows(spark, library):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    found = sorted(map(tuple, bpe.encode_documents(docs, FILE).collect()), key=repr)
    expected = [
        (d, len(i := ids_of(library, t)), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, *_ in AWKWARD
    ]
    assert found == sorted(expected, key=repr)
    assert bpe.encode_documents(docs.limit(0), FILE, with_ids=True).collect() == []


def expected_store(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(ids_of(library, text), np.uint32(2)).astype("<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op1_equals_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, DATA, "documents").collect()]
    found = sorted(map(tuple, queries.op1_token_store(spark, DATA).collect()))
    assert found == expected_store(library, rows)


def test_op1_awkward_rows_many_files_and_single_documents(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 200)
    monkeypatch.setattr(token_store, "SHARD_BYTES", 60)
    docs, path = spark.createDataFrame(AWKWARD, SCHEMA), str(tmp_path / "ids")
    token_store.write(docs, path, FILE, 2)
    found = token_store.with_starts(token_store.read(spark, path)).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == expected_store(library, [r[:2] for r in AWKWARD])
    one = token_store.read(spark, path, doc_ids=[2], with_ids=True).collect()
    assert [r.ids for r in one] == [[*ids_of(library, AWKWARD[3][1]).tolist(), 2]]


def test_op1_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    token_store.write(docs, str(tmp_path / "none"), FILE, 2)
    assert token_store.with_starts(token_store.read(spark, str(tmp_path / "none"))).collect() == []


def test_damaged_shards_are_refused(spark, library, tmp_path):
    docs, path = shared.table(spark, DATA, "documents").where(F.col("doc_id") < 9), str(tmp_path / "d")
    token_store.write(docs, path, FILE, 2)
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    content = next((tmp_path / "d/shards").glob("part-*")).read_bytes()
    assert len(list(token_store.parse_shards(content, raw))) > 0
    for broken in (content[:-1], b"x" + content[1:]):
        with pytest.raises(ValueError):
            list(token_store.parse_shards(broken, raw))
    with pytest.raises(ValueError, match="dictionary"):
        list(token_store.parse_shards(content, raw + b"x"))


def test_files_are_ordered_by_the_number_they_hold(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 200)
    rows = [(i, f"text {i} " * (i % 5 + 1)) for i in range(60)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids")
    token_store.write(docs, path, FILE, 2, first_file=99_998)
    read = token_store.read(spark, path)
    numbers = {r.file for r in read.select("file").distinct().collect()}
    assert {99_999, 100_000} < numbers
    assert sorted(map(tuple, token_store.with_starts(read).collect())) == expected_store(library, rows)


def test_rows_without_id_are_dealt_out(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 300)
    rows = [(None if i % 10 < 7 else i, ["same text", f"own text {i}"][i % 2]) for i in range(200)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids")
    token_store.write(docs, path, FILE, 2)
    read = token_store.read(spark, path)
    assert read.where("doc_id is null").select("file").distinct().count() > 3
    found = sorted(map(tuple, token_store.with_starts(read).collect()), key=lambda r: r[1])
    starts = np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    assert [r[1] for r in found] == starts and len(found) == 200
    assert [r[0] for r in found] == sorted((r[0] for r in found), key=lambda d: (d is not None, d or 0))


def test_workers_keep_no_vocabulary(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").repartition(1)
    assert bpe.encode_documents(docs, shared.tokenizer_file("byte_bpe_50k.json")).count() == 20

    def kept(batches):
        gc.collect()
        held = sum(type(x).__name__ in ("Vocabulary", "PieceEncoder") for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()] * batch.num_rows, "held": [held] * batch.num_rows})

    found = spark.range(0, 64, 1, 64).mapInArrow(kept, "pid long, held long").collect()
    assert {r.held for r in found} == {0}
