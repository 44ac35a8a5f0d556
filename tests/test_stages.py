"""Rosters and the whole pipeline on a small folder of title files."""

import gzip

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_markup import SAMPLE

from corpusdrift.plans import stages
from corpusdrift.sources import inventory, publication, roster, schemas, tables


def test_roster(spark):
    bounds = roster.corpus_bounds(spark, years=(2019, 2018), titles=(9, 10), this_year=2025)
    present = spark.createDataFrame([("Title-10-2018",)], "title_id string")
    found = roster.title_roster(bounds, present, "raw/")
    assert found.count() == 4
    row = found.filter("status = 'Present'").first()
    assert (row.title, row.year, row.filename) == (10, 2018, "Title-10-2018.xml.gzip")
    assert row.file_path == "raw/Title-10-2018.xml.gzip"
    assert row.url.endswith("/2018-12-31/title-10.xml")
    assert rows(roster.status_tally(found), "status", "files") == [("Absent", 3), ("Present", 1)]


@pytest.mark.parametrize(
    ("years", "titles"), [((2016, 2020), None), ((2017, 2025), None), (None, (0, 5)), (None, (1, 51))]
)
def test_bounds_are_checked_when_the_plan_is_built(spark, years, titles):
    with pytest.raises(ValueError):
        roster.corpus_bounds(spark, years, titles, this_year=2025)


def test_default_bounds(spark):
    assert tuple(roster.corpus_bounds(spark, this_year=2025).first()) == (1, 50, 2017, 2024)


def test_fetch_outcomes(spark):
    log = spark.createDataFrame(
        [
            (1, "Absent", True, False, 200),
            (2, "Absent", True, True, None),
            (3, "Absent", True, False, 429),
            (4, "Absent", True, False, 500),
            (5, "Absent", False, False, None),
            (6, "Present", True, False, 200),
        ],
        "id int, status string, queried boolean, timed_out boolean, response_code int",
    )
    found = roster.classify_fetches(log)
    assert rows(found, "id", "status", "response_code", "rate_limited") == [
        (1, "Acquired", 200, False),
        (2, "Failed", 599, False),
        (3, "Failed", 429, True),
        (4, "Failed", 500, False),
        (5, "Absent", 299, False),
        (6, "Present", 299, False),
    ]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, xml in {
        "Title-01-2024": SAMPLE,
        "Title-01-2023": SAMPLE.replace("PART 2 [RESERVED]", "PART 2").replace("app</P>", "old</P>"),
    }.items():
        with gzip.open(folder / f"{name}.xml.gzip", "wt", encoding="utf-8") as file:
            file.write(xml)
    (folder / "Title-02-2024.xml.gzip").write_bytes(b"garbage")
    (folder / "notes.txt").write_text("x")
    return folder


def test_inventory(spark, raw):
    found = inventory.inventory(spark, str(raw))
    assert rows(found, "title_id", "raw") == [
        ("Title-01-2023", True), ("Title-01-2024", True), ("Title-02-2024", True)
    ]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_pipeline(spark, raw, tmp_path):
    root = str(tmp_path / "out")
    outcome = stages.extract(spark, str(raw), root)
    assert rows(outcome, "title_id", "parsed", "new_lines") == [
        ("Title-01-2023", True, 5), ("Title-01-2024", True, 5), ("Title-02-2024", False, -1)
    ]
    again = stages.extract(spark, str(raw), root)
    assert rows(again, "title_id", "parsed", "new_lines") == [
        ("Title-01-2023", True, 0), ("Title-01-2024", True, 0), ("Title-02-2024", False, -1)
    ]
    found = stages.read_sections(spark, root)
    assert found.count() == 10
    assert found.schema == spark.createDataFrame([], schemas.PARSED_SECTION).schema
    assert stages.read_parts(spark, root).count() == 8

    stages.embed(spark, root)
    assert stages.read_facts(spark, root).count() == 10
    assert stages.embedded_sections(spark, root).filter("section_embedding is null").count() == 1
    stages.quantify(spark, root, formats=("parquet", "csv"))

    focal = publication.read(spark, root, "part_data_focal", schemas.PART_FOCAL)
    assert rows(focal, "title_id", "part_id") == [
        ("Title-01", "Part-0001"), ("Title-01", "Part-0002"), ("Title-01", "Part-0004"), ("Title-01", "Part-12345")
    ]
    temporal = publication.read(spark, root, "part_data_temporal", schemas.PART_TEMPORAL)
    first = {r.year_id: r for r in temporal.filter("part_id = 'Part-0001'").collect()}
    assert first["2024"].focal_year_match == 1.0
    assert first["2023"].focal_year_match == pytest.approx(2 / 3)
    assert first["2024"].section_count == 3 and first["2024"].authority_count == 3
    notable = publication.read(spark, root, "notable_sections", schemas.NOTABLE_SECTIONS)
    assert {r.notable_deviant for r in notable.collect()} == {"Least", "Most"}
    assert {r.year_id for r in notable.collect()} == {"2024"}
    csv = publication.read(spark, root, "notable_sections_csv", schemas.NOTABLE_SECTIONS)
    assert rows(csv.select("section_id", "section_text")) == rows(notable.select("section_id", "section_text"))

    titles = spark.createDataFrame([("Title-01", "One", 1, "Title 1 - One")], schemas.TITLES)
    browser = stages.browse(spark, root, titles, ["2023", "2024"])
    assert browser["noteworthy"].count() == 1
    assert browser["words"].count() == 4
    assert browser["titles"].count() == 1
    part = stages.browse(spark, root, titles, ["2023", "2024"], ("Title-01", "Part-0001"))
    assert part["lookup"].count() == 1 and part["parts"].count() == 4 and part["distribution"].count() == 4
    with pytest.raises(Exception, match="year that is not listed"):
        stages.browse(spark, root, titles, ["2024"])["words"].collect()
    assert not (tmp_path / "out" / tables.SCRATCH).exists()
    assert browser["focal"].filter("title_name_full = 'Title 1 - One'").count() == 4


def test_stages_agree_on_year_and_vectors(spark, raw, tmp_path):
    root = str(tmp_path / "out")
    stages.extract(spark, str(raw), root)
    stages.embed(spark, root, year=2023)
    with pytest.raises(ValueError, match="2023, not of 2024"):
        stages.quantify(spark, root, year=2024)
    stages.quantify(spark, root, multiplicity=True)
    scores = publication.read(spark, root, "section_scores", stages.SECTION_SCORES)
    assert {r.notable_deviant for r in scores.collect()} >= {"Least", "Neither"}
    assert scores.count() == 10
    some = stages.read_vectors(spark, root).limit(1).collect()
    with publication.begin(spark, root) as new:
        new.write("text_embedding", spark.createDataFrame(some, stages.TEXT_EMBEDDING))
    with pytest.raises(ValueError, match="no vector"):
        stages.quantify(spark, root)


def test_rejects_of_all_runs_are_kept_and_titles_without_sections_are_done(spark, tmp_path):
    source, root = tmp_path / "raw", str(tmp_path / "out")
    source.mkdir()
    found = []
    for title in ("Title-01-2024", "Title-02-2024", "Title-03-2024"):
        xml = '<T><DIV5 N="1" TYPE="PART"><HEAD>h</HEAD>'
        xml += '<DIV8 TYPE="SECTION">no number</DIV8>' if title[7] != "3" else ""
        with gzip.open(source / f"{title}.xml.gzip", "wt") as file:
            file.write(xml + "</DIV5></T>")
        found.append((title, True, 0))
        outcome = rows(stages.extract(spark, str(source), root), "title_id", "parsed", "new_lines")
        assert outcome == found
    rejects = publication.read(spark, root, "rejects", "title_id string")
    assert rows(rejects) == [("Title-01-2024",), ("Title-02-2024",)]
    done = publication.read(spark, root, "parsed", inventory.PARSED)
    assert done.count() == 3
    assert not (tmp_path / "out" / tables.SCRATCH).exists()


def test_roster_stage(spark, raw):
    found = stages.title_roster(spark, str(raw), (2023, 2024), (1, 2), 2025)
    assert rows(found["tally"], "status", "files") == [("Absent", 1), ("Present", 3)]


def test_only_titles_at_hand_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "title_id string, n int")
    tables.write_titles(both, path)
    tables.write_titles(both.filter("title_id = 'a'").withColumn("n", F.lit(9)), path)
    assert rows(spark.read.parquet(path), "title_id", "n") == [("a", 9), ("b", 2)]


def test_shared_folder_is_the_one_the_session_names(spark):
    first, second = tables.shared_folder(spark), tables.shared_folder(spark)
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


TYPED = "id bigint, name string, score double, day date"


def test_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,name,score,day\n1,"one, or ""1""",0.5,2024-01-31\n2,two,oops,2024-01-31\n3,"line\nbreak",,\nx,four,y,2024-13-01\n5,five\n6,six,1,2024-01-01,more\n'
    )
    (tmp_path / "b.csv").write_text("id,name,score,day\n7,,-1e3,2024-02-29\n")
    good, rejects = tables.read_checked(spark, str(tmp_path), TYPED)
    assert rows(good.select("id", "name", "score")) == [(1, 'one, or "1"', 0.5), (3, "line\nbreak", None), (7, None, -1000.0)]
    assert good.schema == spark.createDataFrame([], TYPED).schema
    found = {r.reason: r for r in rejects.collect()}
    assert set(found) == {
        "score: 'oops' is no double", "id: 'x' is no bigint; score: 'y' is no double; day: '2024-13-01' is no date",
        "wrong number of fields",
    }
    assert rejects.count() == 4 and rejects.filter("file like '%a.csv'").count() == 4
    assert '"name":"two"' in found["score: 'oops' is no double"].record
    assert {r.record for r in rejects.filter("reason like 'wrong%'").collect()} == {"5,five", "6,six,1,2024-01-01,more"}
    # Counting alone, or one column alone, tells the same rows apart.
    assert (good.count(), good.select("name").count(), rejects.select("file").count()) == (3, 3, 4)
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, str(tmp_path), TYPED, "csv").select("name").collect()
