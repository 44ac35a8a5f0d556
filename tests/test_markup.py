"""Markup expressions and extraction, with Python's XML parser as the judge."""

import gzip
import xml.etree.ElementTree as ET

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusdrift.functions import markup
from corpusdrift.sources import markup as source

SAMPLE = """<?xml version="1.0" encoding="UTF-8"?>
<ECFR><DIV1 N="1" TYPE="TITLE"><HEAD>Title 1</HEAD>
<DIV9 N="Appendix outside" TYPE="APPENDIX"><HEAD>lost</HEAD></DIV9>
<DIV5 N="1" TYPE="PART"><HEAD>PART 1&#x2014;A &amp; B</HEAD>
<AUTH>
<HED>Authority:</HED><PSPACE>44 U.S.C. 1506, 5 U.S.C. 2, and sec. 6.</PSPACE>
</AUTH>
<DIV6 N="A" TYPE="SUBPART"><DIV8 N="1.1" TYPE="SECTION">
<HEAD>§ 1.1 Defs.</HEAD>
<P>x <I>it</I> y &lt; z</P><!-- note --></DIV8>
<DIV8 N="1.401(a)-1" TYPE="SECTION"><HEAD>§ 1.401(a)-1 T</HEAD><P/></DIV8></DIV6>
<DIV9 N="Appendix A to Part 1" TYPE="APPENDIX"><HEAD>Appendix A to Part 1</HEAD><P>app</P></DIV9>
</DIV5>
<DIV8 N="9.9" TYPE="SECTION"><HEAD>between parts</HEAD></DIV8>
<DIV5 N="2" TYPE="PART"><HEAD>PART 2 [RESERVED]</HEAD></DIV5>
<DIV5 N="12345" TYPE="PART"><DIV6 N="A" TYPE="SUBPART"><HEAD>Subpart A</HEAD>
<DIV8 N="3.1" TYPE="SECTION"/>
<DIV8 N='3.2 "q"' TYPE="SECTION"><HEAD>§ 3.2</HEAD><AUTH>late</AUTH></DIV8></DIV6></DIV5>
<DIV5 N="4" TYPE="PART"/>
<DIV9 N="Appendix after" TYPE="APPENDIX"><HEAD>lost</HEAD></DIV9>
</DIV1></ECFR>
"""


def _joined(element):
    return None if element is None else " ".join(element.itertext())


def _expected(xml):
    parts, sections = [], []
    for part in ET.fromstring(xml).findall(".//DIV5"):
        parts.append(
            (
                part.attrib["TYPE"] + "-" + part.attrib["N"].zfill(4),
                _joined(part.find(".//HEAD")),
                _joined(part.find(".//AUTH")),
            )
        )
        for level in ("DIV8", "DIV9"):
            for section in part.findall(f".//{level}"):
                sections.append(
                    (section.attrib["TYPE"] + "-" + section.attrib["N"], _joined(section))
                )
    return sorted(parts, key=repr), sorted(sections, key=repr)


def _write(folder, name, content):
    with gzip.open(folder / name, "wb") as file:
        file.write(content.encode() if isinstance(content, str) else content)


def _extracted(records):
    parts = rows(source.extract_parts(records), "part_id", "part_heading", "part_authority")
    return parts, rows(source.extract_sections(records), "raw_id", "section_text")


def test_sample_equals_parser(spark, tmp_path):
    _write(tmp_path, "Title-01-2024.xml.gz", SAMPLE)
    records = source.scan_records(spark, str(tmp_path))
    assert _extracted(records) == _expected(SAMPLE)
    assert rows(source.sound_titles(records)) == [("Title-01-2024",)]
    assert rows(source.rejects(records)) == []


def test_gzip_suffix_is_read_whole(spark, tmp_path):
    """A file named .gzip that is larger than a split is neither cut nor lost."""
    section = '<DIV8 N="1.{0}" TYPE="SECTION"><P>{1}</P></DIV8>'
    body = "".join(section.format(i, f"{i * 7919 % 104729:x}" * 40) for i in range(5000))
    xml = f'<ECFR><DIV1 N="1"><DIV5 N="1" TYPE="PART"><HEAD>h</HEAD>{body}</DIV5></DIV1></ECFR>'
    _write(tmp_path, "Title-07-2023.xml.gzip", xml)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = source.scan_records(
            source.unsplit_session(spark), str(tmp_path), ignore_corrupt=False
        )
        assert _extracted(records) == _expected(xml)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_state_crosses_batches_and_files(spark, tmp_path):
    """Many small files in one task and several batches per file."""
    xmls = {}
    for i in range(6):
        sections = "".join(f'<DIV8 N="{i}.{j}" TYPE="SECTION"><P>s{j}</P></DIV8>' for j in range(40))
        outside = '<DIV9 N="x" TYPE="APPENDIX"><P>lost</P></DIV9>'
        xmls[f"Title-{i:02d}-2024"] = (
            f'<E><DIV1 N="1">{outside}<DIV5 N="{i}" TYPE="PART"><HEAD>h{i}</HEAD>{sections}</DIV5>'
            f'{outside}<DIV5 N="9{i}" TYPE="PART">{sections}</DIV5></DIV1></E>'
        )
    for name, xml in xmls.items():
        _write(tmp_path, f"{name}.xml.gz", xml)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        records = source.scan_records(spark, str(tmp_path)).coalesce(1)
        found = rows(source.extract_sections(records), "title_id", "raw_id", "section_text")
        heads = rows(source.extract_parts(records), "title_id", "part_id", "part_heading")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert found == sorted(
        ((name, *section) for name, xml in xmls.items() for section in _expected(xml)[1]), key=repr
    )
    assert heads == sorted(
        ((name, *part[:2]) for name, xml in xmls.items() for part in _expected(xml)[0]), key=repr
    )


def test_faulty_files_and_divisions(spark, tmp_path):
    _write(tmp_path, "Title-01-2024.xml.gz", SAMPLE)
    whole = gzip.compress(SAMPLE.encode() * 50)
    (tmp_path / "Title-02-2024.xml.gz").write_bytes(b"garbage")
    (tmp_path / "Title-03-2024.xml.gz").write_bytes(whole[: len(whole) // 2])
    _write(tmp_path, "Title-04-2024.xml.gz", SAMPLE[: SAMPLE.index("<P/>")])
    _write(tmp_path, "Title-05-2024.xml.gz", "no markup at all")
    records = source.scan_records(spark, str(tmp_path))
    assert rows(source.sound_titles(records)) == [("Title-01-2024",)]
    _write(
        tmp_path,
        "Title-06-2024.xml.gz",
        '<E><DIV1 N="1"><DIV5 N="1" TYPE="PART"><DIV8 TYPE="SECTION"><P>a</P></DIV8>'
        '<DIV8 N="1.2" TYPE="SECTION"><P>b</P></DIV8></DIV5></DIV1></E>',
    )
    records = source.scan_records(spark, str(tmp_path / "Title-06-2024.xml.gz"))
    assert rows(source.extract_sections(records), "raw_id", "section_text") == [("SECTION-1.2", "b")]
    assert rows(source.rejects(records), "title_id", "reason") == [("Title-06-2024", "no id")]


TEXT = st.text(st.characters(codec="utf-8", exclude_categories=["C", "Zl", "Zp"]), max_size=8)
TEXTS = TEXT.map(
    lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
) | st.sampled_from(["&#65;", "&#x1F600;", "&amp;lt;", "&amp;#38;", "&quot;", "a\r\nb", "\n", " ", ">"])


@st.composite
def _elements(draw, depth=3):
    name = draw(st.sampled_from(["P", "I", "HED"]))
    attribute = draw(st.sampled_from(["", ' a="1"', " a='x > y'", ' b="&quot;"']))
    if draw(st.booleans()) and depth < 3:
        return f"<{name}{attribute}/>"
    children = _elements(depth - 1) if depth else TEXTS
    comments = st.just("<!-- a > b -->") | st.just("<?x y?>")
    inner = "".join(draw(st.lists(TEXTS | children | comments, max_size=4)))
    return f"<{name}{attribute}>{inner}</{name}>"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_elements(), min_size=40, max_size=60))
def test_element_text_equals_parser(spark, elements):
    elements = list(dict.fromkeys(elements))
    table = spark.createDataFrame([(e,) for e in elements], "xml string")
    found = {r.xml: r.text for r in table.withColumn("text", markup.element_text(F.col("xml"))).collect()}
    assert found == {e: " ".join(ET.fromstring(e).itertext()) for e in elements}


def test_attributes_and_escaping(spark):
    values = ['a & "b" < c', "plain", "", "x > y"]
    table = spark.createDataFrame([(v,) for v in values], "v string")
    tag = F.concat(F.lit('<DIV8 TYPE="T" N="'), markup.escape(F.col("v")), F.lit('">'))
    found = table.select(
        "v",
        markup.attribute(tag, "N").alias("n"),
        markup.attribute(tag, "X").alias("x"),
        markup.element_text(
            F.concat(F.lit("<P>"), markup.escape(F.col("v")), F.lit("</P>"))
        ).alias("t"),
    )
    assert all(r.v == r.n == r.t and r.x is None for r in found.collect())


def test_first_element(spark):
    table = spark.createDataFrame(
        [("<HEADER>no</HEADER><HEAD a='>'>one</HEAD><HEAD>two</HEAD>",), ("<HEAD/><HEAD>x</HEAD>",), ("none",)],
        "m string",
    )
    found = [r[0] for r in table.select(markup.first_element(F.col("m"), "HEAD")).collect()]
    assert found == ["<HEAD a='>'>one</HEAD>", "<HEAD/>", None]


@pytest.mark.parametrize("size", [200_000])
def test_long_runs_of_tags_do_not_overflow(spark, size):
    xml = "<P>" + "<B a='1'>" * size + "x" + "</B>" * size + "y</P>"
    table = spark.createDataFrame([(xml,)], "xml string")
    assert table.select(markup.element_text(F.col("xml"))).first()[0] == "x y"


ODD = """<?xml version="1.0"?>
<T><!-- a <DIV5 N="0" TYPE="PART"> that is not --><DIV5 N="1" TYPE="PART"><HEAD>h</HEAD>
<DIV8 N="1.1" TYPE="SECTION"><P>blank in the end tag</P></DIV8 >
<DIV8 N="1.2" TYPE="SECTION"><DIVIDEND>paid <DIVX/>twice</DIVIDEND></DIV8>
<DIV8 N="1.3" TYPE="SECTION"><![CDATA[a < b & <DIV8 N="x"> c]]><P>d</P></DIV8>
<DIV8 N="1.4" TYPE="SECTION">x<!-- hidden <DIV8 N="9.9" TYPE="SECTION"> text <DIV5> </DIV8> -->y<?p <DIV8 ?>z</DIV8>
<DIV9 N="A" TYPE="APPENDIX"/></DIV5
><DIV5 N="2" TYPE="PART"><HEAD>no sections</HEAD></DIV5></T>
"""


def test_odd_markup_equals_parser(spark, tmp_path):
    _write(tmp_path, "Title-01-2024.xml.gz", ODD)
    records = source.scan_records(spark, str(tmp_path))
    assert _extracted(records) == _expected(ODD)
    assert rows(source.sound_titles(records)) == [("Title-01-2024",)]
    assert source.rejects(records).count() == 0
