"""Identifiers and texts on the awkward values."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusdrift.functions import ids, text
from corpusdrift.operators import sections


def _value(spark, function, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    columns = [F.col(f"c{i}") for i in range(len(values))]
    return spark.createDataFrame([values], schema).select(function(*columns)).first()[0]


def _normalized(spark, raw_ids, **options):
    table = spark.createDataFrame([("t", raw, "x") for raw in raw_ids], "title_id string, raw_id string, section_text string")
    found = sections.normalize(table, **options).collect()
    return [(r.section_type, r.section_name, r.part_id, r.section_id) for r in found]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("SECTION-1.401(a)-1", ("SECTION", "1.401(a)", "Part-0001", "Section-401(")),
        ("SECTION-", ("SECTION", "0.", "Part-000.", "Section-0000")),
        ("SECTION-1.2.3", ("SECTION", "1.2.3", "Part-0001", "Section-0003")),
        ("SECTION-13", ("SECTION", "0.13", "Part-0000", "Section-0013")),
        ("SECTION-10234.5", ("SECTION", "10234.5", "Part-1023", "Section-0005")),
        ("SECTION-1.", ("SECTION", "1.", "Part-001.", "Section-0000")),
        ("SECTION-.5", ("SECTION", ".5", "Part-0000", "Section-00.5")),
        ("APPENDIX-Appendix A to Part 50", ("APPENDIX", "Appendix A to Part 50", "Part-0050", "Appendix-A")),
        (
            "APPENDIX-Appendixes A to C to Subpart B of Part 7",
            ("APPENDIX", "Appendixes A to C to Subpart B of Part 7", "Part-0007", "Appendix-A"),
        ),
        ("APPENDIX-Appendix to § 1.2", ("APPENDIX", "Appendix to § 1.2", "Part-§ 1.", "Appendix")),
        ("APPENDIX-Appendix A", ("APPENDIX", "Appendix A", "Part-Appe", "Appendix-A")),
    ],
)
def test_normalize(spark, raw, expected):
    assert _normalized(spark, [raw]) == [expected]


def test_other_types_and_missing_names(spark):
    assert _normalized(spark, ["NOTE-1.1"]) == []
    assert _normalized(spark, ["SECTION"]) == [("SECTION", None, None, None)]


def test_repaired(spark):
    assert _normalized(spark, ["SECTION-10234.401(a)-12345"], repaired=True) == [
        ("SECTION", "10234.401(a)-12345", "Part-10234", "Section-401(a)-12345")
    ]


def test_section_text_name_as_literal_and_as_pattern(spark):
    literal = text.clean_section_text

    def regex(value, name):
        return text.clean_section_text(value, name, regex_names=True)

    assert _value(spark, regex, "§ 1.1 Scope § 1x1", "§ 1.1") == " Scope "
    assert _value(spark, literal, "§ 1.1 Scope § 1x1", "§ 1.1") == " Scope § 1x1"
    assert _value(spark, regex, "§ 1.401(a) Scope", "§ 1.401(a)") == "§ 1.401(a) Scope"
    assert _value(spark, literal, "§ 1.401(a) Scope", "§ 1.401(a)") == " Scope"
    assert _value(spark, literal, "§ 1.401(a Scope", "§ 1.401(a") == " Scope"
    with pytest.raises(Exception, match="PATTERN"):
        _value(spark, regex, "§ 1.401(a Scope", "§ 1.401(a")


@pytest.mark.parametrize(("value", "count"), [(" a b ", 4), ("", 1), (None, None), ("a\n\tb", 2)])
def test_word_count(spark, value, count):
    assert _value(spark, text.word_count, value) == count


@pytest.mark.parametrize(
    ("value", "cleaned", "count"),
    [
        (
            "\n Authority: 44 U.S.C. 1506, 5 U.S.C. 2, and sec. 6. \n",
            "44 U.S.C. 1506, 5 U.S.C. 2, sec. 6",
            3,
        ),
        ("\n Authority: \n 5 U.S.C. 1; 2.\n", "Authority:5 U.S.C. 1; 2", 1),
        ("abc.", "abc", 1),
        ("abc", "ab", 1),
        ("", "", 1),
        (None, None, None),
    ],
)
def test_authority(spark, value, cleaned, count):
    assert _value(spark, text.clean_authority, value) == cleaned
    assert _value(spark, lambda c: text.authority_count(text.clean_authority(c)), value) == count


def test_years_and_labels(spark):
    assert _value(spark, ids.year_id, "Title-31-2024") == "2024"
    assert _value(spark, ids.bare_title_id, "Title-31-2024") == "Title-31"
    assert _value(spark, ids.year_id, "Title-31") == ""
    assert _value(spark, ids.bare_title_id, "Title-31") == "Title-31"
    assert _value(spark, ids.human_label, "Part-0586") == "Part 586"
    assert _value(spark, ids.part_number, "Part-0586") == "0586"
    assert _value(spark, ids.compiled_part_id, "PART-0001") == "Part-0001"


def test_edition_counts(spark):
    table = spark.createDataFrame([("Title-01-2024",), ("Title-01-2023",), ("Title-02-2024",)], "title_id string")
    counted = sections.edition_counts(table, table.limit(1))
    assert rows(counted, "section_count", "section_count_now", "part_count") == [(3, 2, 1)]
