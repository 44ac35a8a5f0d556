"""Tables that appear together, the vector store, and stages that break off."""

import gzip

import numpy as np
import pytest
from conftest import rows
from test_markup import SAMPLE

from corpusdrift.plans import stages
from corpusdrift.sources import publication, tables

NUMBERS = "title_id string, n int"


def numbers(spark, *pairs):
    return spark.createDataFrame(list(pairs), NUMBERS)


def test_tables_appear_together(spark, tmp_path):
    root = str(tmp_path / "out")
    with publication.begin(spark, root) as new:
        new.write("a", numbers(spark, ("x", 1)))
        new.write("b", numbers(spark, ("x", 1)), "csv")
    with pytest.raises(RuntimeError, match="killed"), publication.begin(spark, root) as new:
        new.write("a", numbers(spark, ("y", 2)))
        raise RuntimeError("killed between two tables")
    assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x")]
    assert rows(publication.read(spark, root, "b", NUMBERS)) == [(1, "x")]
    assert len(list((tmp_path / "out" / "a").iterdir())) == 1
    # A process that dies can't tidy up; its folders are named by no manifest.
    lost = publication.begin(spark, root)
    lost.write("a", numbers(spark, ("z", 3)))
    assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x")]
    with publication.begin(spark, root) as new:
        new.append("a", numbers(spark, ("y", 2)))
        assert rows(new.read("a", NUMBERS)) == [(1, "x"), (2, "y")]
        assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x")]
    assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x"), (2, "y")]
    assert rows(publication.read(spark, root, "a", NUMBERS, 1)) == [(1, "x")]
    assert publication.retire(spark, root) == [f"a/version={lost.version}"]
    assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x"), (2, "y")]
    assert publication.read_or_none(spark, root, "none", NUMBERS).count() == 0


def test_of_two_runs_one_publishes(spark, tmp_path):
    root = str(tmp_path / "out")
    one, two = publication.begin(spark, root), publication.begin(spark, root)
    one.write("a", numbers(spark, ("x", 1)))
    two.write("a", numbers(spark, ("y", 2)))
    one.commit()
    with pytest.raises(publication.Conflict):
        two.commit()
    assert rows(publication.read(spark, root, "a", NUMBERS)) == [(1, "x")]
    assert len(list((tmp_path / "out" / publication.MANIFESTS).glob("[!.]*"))) == 1


def test_titles_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path / "out")
    for pairs in ([("x", 1), ("y", 2), ("y", 3)], [("y", 4)], [("z", 5)]):
        with publication.begin(spark, root) as new:
            new.write_titles("t", numbers(spark, *pairs))
    assert rows(publication.read(spark, root, "t", NUMBERS)) == [(1, "x"), (4, "y"), (5, "z")]
    assert len(publication.retire(spark, root, keep=1)) == 0  # x is still read from the first version
    assert rows(publication.read(spark, root, "t", NUMBERS)) == [(1, "x"), (4, "y"), (5, "z")]


@pytest.fixture
def corpus(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for name, xml in {"Title-01-2024": SAMPLE, "Title-01-2023": SAMPLE.replace("app</P>", "old</P>")}.items():
        with gzip.open(raw / f"{name}.xml.gzip", "wt", encoding="utf-8") as file:
            file.write(xml)
    stages.extract(spark, str(raw), root)
    return root


def counting(folder):
    """An encoder that leaves a file for each text it is given."""

    def load():
        def encode(texts):
            for text in texts:
                (folder / f"{len(text)}-{np.random.default_rng().integers(2**60)}").write_text(text)
            return np.array([[len(t), t.count("e") + 1, 1.0] for t in texts]) / 64

        return encode

    return load


def vectors_of(spark, root):
    return {r.section_hash: tuple(r.section_embedding) for r in stages.read_vectors(spark, root).collect()}


def centroids_of(spark, root):
    table = publication.read(spark, root, "embedded_part", "title_id string, part_id string, part_embedding array<double>")
    return rows(table, "title_id", "part_id", "part_embedding")


def test_known_texts_are_not_encoded_again(spark, corpus, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    seen = lambda: len(list(calls.iterdir()))
    stages.embed(spark, corpus, 2024, counting(calls), encoder="counting-1")
    first, texts, means = seen(), vectors_of(spark, corpus), centroids_of(spark, corpus)
    assert first == len(texts) > 2
    stages.embed(spark, corpus, 2024, counting(calls), encoder="counting-1")
    assert seen() == first
    assert vectors_of(spark, corpus) == texts and centroids_of(spark, corpus) == means
    # Another edition shares most texts; only its own are encoded, and only its vectors are read.
    stages.embed(spark, corpus, 2023, counting(calls), encoder="counting-1")
    other = vectors_of(spark, corpus)
    assert seen() == first + len(set(other) - set(texts)) > first
    stages.embed(spark, corpus, 2024, counting(calls), encoder="counting-1")
    assert seen() == first + len(set(other) - set(texts))
    assert vectors_of(spark, corpus) == texts and centroids_of(spark, corpus) == means
    before = seen()
    stages.embed(spark, corpus, 2024, counting(calls), encoder="counting-2")
    assert seen() == before + first
    assert vectors_of(spark, corpus) == texts and centroids_of(spark, corpus) == means


def test_encoders_are_told_apart_by_what_they_hold(tmp_path):
    assert stages.fingerprint(None) == stages.fingerprint(None)
    assert stages.fingerprint(counting(tmp_path)) == stages.fingerprint(counting(tmp_path))
    assert stages.fingerprint(counting(tmp_path)) != stages.fingerprint(counting(tmp_path / "x"))


def test_a_stage_that_breaks_off_leaves_the_tables_of_before(spark, corpus, monkeypatch):
    stages.embed(spark, corpus, 2024)
    stages.quantify(spark, corpus)
    names = ["section_scores", "notable_sections", "part_data_focal", "part_data_temporal"]
    state = lambda: {n: publication.entry(spark, corpus, n) for n in names}
    before, written = state(), []
    plain = tables.export_table

    def breaking(table, path, fmt="parquet"):
        if "part_data_temporal" in path:
            raise OSError("disk full")
        written.append(path)
        plain(table, path, fmt)

    monkeypatch.setattr(tables, "export_table", breaking)
    with pytest.raises(OSError, match="disk full"):
        stages.quantify(spark, corpus, deviants_n=2)
    assert len(written) == 3 and state() == before
    assert not [p for p in written if publication._children(spark, p)]
    assert not publication._children(spark, f"{corpus}/{tables.SCRATCH}")
