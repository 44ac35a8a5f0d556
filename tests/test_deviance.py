"""Ranking and part figures against brute force over the joined rows."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusdrift.operators import deviance, panels, parts, sections

SCHEMA = (
    "title_id string, part_id string, section_id string, section_name string, section_type string, "
    "section_text string, section_hash string, section_word_count bigint, section_deviance double, "
    "focal_year_match int"
)


def _data(seed, hot=False):
    """Few ids and few scores, so that ids repeat and scores tie."""
    rng = random.Random(seed)
    data = []
    for i in range(160):
        part = "Part-0001" if hot and i % 3 == 0 else f"Part-{rng.randrange(2, 7):04d}"
        words = rng.randrange(1, 5)
        text = " ".join(rng.choice("abc") for _ in range(words))
        title = f"Title-01-{rng.choice([2023, 2024, 2024])}"
        score = rng.choice([None, 0.1, 0.2, 0.2, 0.3]) if title.endswith("2024") else None
        section = rng.choice([f"Section-{rng.randrange(6):04d}"] * 9 + [None])
        data.append(
            (title, part, section, f"n{rng.randrange(3)}", "APPENDIX", text, f"h{text}", words, score, rng.randrange(2))
        )
    return data


def _joined(data):
    """The rows of a join of sections to texts on title, part and section id."""
    texts = defaultdict(list)
    for row in data:
        if row[2] is not None:
            texts[row[:3]].append((row[5], row[7]))
    return [(row, text) for row in data for text in (texts.get(row[:3]) or [(None, None)])]


@pytest.mark.parametrize("seed", [1, 2])
def test_part_aggregates_equal_joined_rows(spark, seed):
    data = _data(seed, hot=True)
    expected = defaultdict(list)
    for row, text in _joined(data):
        expected[row[:2]].append((row, text))
    found = {
        (r.title_id, r.part_id): r
        for r in parts.part_aggregates(spark.createDataFrame(data, SCHEMA)).collect()
    }
    assert found.keys() == expected.keys()
    for key, joined in expected.items():
        scores = [row[8] for row, _ in joined if row[8] is not None]
        words = [text[1] for _, text in joined if text[1] is not None]
        got = found[key]
        assert got.section_count == sum(row[2] is not None for row, _ in joined)
        assert got.part_word_count == (sum(words) if words else None)
        assert got.focal_year_match == pytest.approx(sum(r[9] for r, _ in joined) / len(joined))
        if scores:
            assert got.deviance_mean == pytest.approx(sum(scores) / len(scores), abs=6e-7)
        else:
            assert got.deviance_mean is None


@pytest.mark.parametrize("n", [1, 2, 50])
@pytest.mark.parametrize("seed", [3, 4])
def test_notable_sections_equal_ranking_of_all_joined_rows(spark, seed, n):
    data = [row for row in _data(seed, hot=True) if row[2] is not None]
    ranked = defaultdict(list)
    for row, (text, _) in _joined(data):
        if row[8] is not None:
            # deviance, section id, hash, name, text: every column that decides a tie.
            ranked[row[:2]].append((row[8], row[2], row[6], row[3], text))
    expected = []
    for key, group in ranked.items():
        group.sort()
        for i, row in enumerate(group):
            if i < n or i >= len(group) - n:
                label = "Least" if i < n else "Most"
                expected.append((*key, row[1], row[3], row[4], row[0], label))
    table = spark.createDataFrame(data, SCHEMA)
    found = deviance.notable_sections(table.drop("section_text"), table, n)
    assert rows(found, *found.columns) == sorted(expected, key=repr)


def test_one_section_part_is_least_only(spark):
    data = [("T-2024", "P", "s", "n", "APPENDIX", "text", "h", 1, 0.2, 1)]
    table = spark.createDataFrame(data, SCHEMA)
    found = deviance.notable_sections(table, table).collect()
    assert [r.notable_deviant for r in found] == ["Least"]


def test_unscored_sections_are_never_notable(spark):
    data = [
        ("T-2024", "P", "s1", "n", "APPENDIX", "text", "h", 1, None, 1),
        ("T-2024", "P", "s2", "n", "APPENDIX", "text", "h", 1, 0.3, 1),
        ("T-2024", "P", "s3", "n", "APPENDIX", "text", "h", 1, 0.4, 1),
    ]
    table = spark.createDataFrame(data, SCHEMA)
    found = {r.section_id: r.notable_deviant for r in deviance.notable_sections(table, table).collect()}
    assert found == {"s2": "Least", "s3": "Most"}


@pytest.mark.parametrize("n", [1, 3, 100])
def test_labels_keep_every_row_and_copy(spark, n):
    """Rows that are equal in every column are labelled as often as their rank says."""
    data = _data(6, hot=True)
    data = data + data[:40]
    expected, groups = [], defaultdict(list)
    for row in data:
        if row[8] is None:
            expected.append((*row, "Neither"))
        else:
            groups[row[:2]].append(row)
    for group in groups.values():
        # Scored rows have ids here or None, which sorts first in Spark.
        group.sort(key=lambda r: (r[8], r[2] or "", r[6], r[3], r[4], r[5], r[7], r[9]))
        for i, row in enumerate(group):
            label = "Least" if i < n else "Most" if i >= len(group) - n else "Neither"
            expected.append((*row, label))
    found = deviance.label_sections(spark.createDataFrame(data, SCHEMA), n)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert rows(found, *names, "notable_deviant") == sorted(expected, key=repr)


def test_deviance_does_not_depend_on_hot_keys(spark):
    data = [("T-2024", f"P{i % 2}" if i % 3 else "hot", f"s{i}", f"h{i % 17}", i) for i in range(90)]
    # One text stands in every part.
    data += [("T-2024", f"Q{i}", "s", "h3", 1) for i in range(40)]
    table = spark.createDataFrame(
        data, "title_id string, part_id string, section_id string, section_hash string, section_word_count bigint"
    )
    vectors = spark.createDataFrame(
        [(f"h{i}", [float(i % 5) + 1, float(i % 3), 1.0]) for i in range(15)],
        "section_hash string, section_embedding array<double>",
    )
    part_table = table.select("title_id", "part_id").distinct().filter("part_id <> 'P1'")
    for multiplicity in (False, True):
        cold = parts.quantify(table, vectors, part_table, multiplicity=multiplicity)
        hot = parts.quantify(table, vectors, part_table, multiplicity=multiplicity, hot_rows=2)
        assert rows(cold) == rows(hot)
    assert cold.filter("section_deviance is null and part_id <> 'P1'").count() == sum(
        row[3] in ("h15", "h16") and row[1] != "P1" for row in data
    )
    assert cold.filter("section_deviance is not null and part_id = 'P1'").count() == 0


def test_word_counts_keep_rows(spark):
    table = spark.createDataFrame(_data(5), SCHEMA)
    counted = deviance.attach_text_counts(table, table, hot_rows=2)
    assert counted.count() == table.count()
    assert counted.agg(F.sum("text_rows")).first()[0] == len(_joined(_data(5)))


FOCAL = "year_id string, title_id string, part_id string, part_heading string, part_authority string, deviance_mean double"


@pytest.fixture(scope="module")
def focal(spark):
    data = [
        ("2024", "Title-01", "Part-0001", "A", None, 1.0),
        ("2024", "Title-01", "Part-0002", "B", None, 2.0),
        ("2024", "Title-01", "Part-0003", "C", None, 4.0),
        ("2024", "Title-01", "Part-0004", None, None, None),
        ("2024", "Title-01", "Part-0005", "[RESERVED]", None, 90.0),
        ("2024", "Title-02", "Part-0001", None, None, 3.0),
        ("2024", "Title-02", "Part-0002", "D", None, 3.0),
    ]
    return spark.createDataFrame(data, FOCAL)


def test_medians_and_noteworthy_part(focal):
    assert rows(panels.title_medians(focal), "title_id", "median_deviance") == [("Title-01", 2.0), ("Title-02", 3.0)]
    assert rows(panels.noteworthy_part(focal), "title_id", "part_id") == [("Title-02", "Part-0001")]


def test_distribution_positions(focal):
    found = panels.deviance_distribution(focal, "Title-01", "Part-0002").collect()
    assert [(r.position, r.part_number, r.highlighted) for r in found] == [
        (0, "0005", False), (1, "0003", False), (2, "0002", True), (3, "0001", False), (4, "0004", False)
    ]
    assert panels.deviance_distribution(focal, "Title-09", "x").count() == 0


def test_distribution_numbers_ties_by_part(focal):
    found = panels.deviance_distribution(focal, "Title-02", "x").collect()
    assert [(r.position, r.part_id) for r in found] == [(0, "Part-0001"), (1, "Part-0002")]


def test_lookup_and_options(spark, focal):
    titles = spark.createDataFrame(
        [("Title-01", "One", 1, "Title 1 - One"), ("Title-99", "x", 99, "x")],
        "title_id string, title_name string, title_num int, title_name_full string",
    )
    named = panels.with_title_names(focal, titles)
    assert named.count() == focal.count()
    assert rows(panels.part_lookup(named, "Title-01", "Part-0002"), "title_name_full", "part_heading") == [("Title 1 - One", "B")]
    assert panels.part_lookup(named, "Title-01", "Part-9999").count() == 0
    options = panels.dropdown_options(focal, "part_id", ("title_id", "Title-02")).collect()
    assert [(r.label, r.value) for r in options] == [("Part 1", "Part-0001"), ("Part 2", "Part-0002")]


def test_display_rounding_is_half_even(spark):
    table = spark.createDataFrame([(0.0005,), (0.0015,), (0.1234,)], "deviance_mean double")
    assert [r[0] for r in panels.display_scores(table).collect()] == [0.0, 0.002, 0.123]


def test_panel_and_its_duplicate_guard(spark):
    data = [("2023", "T", "P", 1), ("2024", "T", "P", 2), ("2024", "T", "Q", None)]
    table = spark.createDataFrame(data, "year_id string, title_id string, part_id string, n bigint")
    wide = panels.panel(table, "n", ["2022", "2023", "2024"])
    assert rows(wide, "part_id", "2022", "2023", "2024") == [("P", None, 1, 2), ("Q", None, None, None)]
    with pytest.raises(Exception, match="more than one n"):
        panels.panel(table.union(table), "n", ["2023", "2024"]).collect()


def test_part_temporal_keeps_all_years_of_focal_parts(spark):
    data = [("T-2023", "P", 1, 1, 1, 1.0, 0.1), ("T-2024", "P", 2, 1, 1, 1.0, 0.1), ("T-2023", "gone", 1, 1, 1, 1.0, 0.1)]
    table = spark.createDataFrame(
        data,
        "title_id string, part_id string, section_count int, authority_count int, part_word_count int, "
        "focal_year_match double, deviance_mean double",
    )
    assert rows(parts.part_temporal(table), "part_id", "year_id") == [("P", "2023"), ("P", "2024")]


def test_reading_order(spark):
    data = [("T", "P2", "SECTION", "a"), ("T", "P1", "APPENDIX", "a"), ("T", "P1", "SECTION", "b"), ("T", "P1", "SECTION", "a")]
    table = spark.createDataFrame(data, "title_id string, part_id string, section_type string, section_id string")
    found = [tuple(r)[1:] for r in sections.in_reading_order(table).collect()]
    assert found == [("P1", "SECTION", "a"), ("P1", "SECTION", "b"), ("P1", "APPENDIX", "a"), ("P2", "SECTION", "a")]


@pytest.mark.parametrize("n", [1, 40, 5_000])
def test_ranking_by_levels_equals_ranking_whole_groups(spark, monkeypatch, n):
    rng = random.Random(n)
    data = [
        (f"Title-0{rng.randrange(2)}-2024", rng.choice(["P1", "P1", "P1", "P2", None]), f"s{i % 50}", f"n{i}", f"h{i}",
         rng.choice([None, 0.25, 0.25, 0.25, round(rng.random(), 6)]))
        for i in range(9_000)
    ]
    columns = "title_id string, part_id string, section_id string, section_name string, section_hash string, section_deviance double"
    table = spark.createDataFrame(data, columns)
    monkeypatch.setattr(deviance, "PLAIN_RANKS", 10**9)
    plain = [rows(f(table, n)) for f in (deviance.least_deviant, deviance.most_deviant)]
    monkeypatch.setattr(deviance, "PLAIN_RANKS", 0)
    assert [rows(f(table, n)) for f in (deviance.least_deviant, deviance.most_deviant)] == plain
    level = F.round(F.col("section_deviance") * 1_000_000).cast("bigint")
    order = deviance._lowest(deviance.RANK_ORDER)
    known = table.filter("section_deviance is not null")
    dealt = deviance.first_by_level(known, deviance.PART_KEY, order, n, level, deal_rows=100, hot_rows=200)
    assert rows(dealt) == plain[0]
