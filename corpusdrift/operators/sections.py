"""From raw divisions to identified sections, and parts in their final spelling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.functions import ids, text

PART_KEY = ["title_id", "part_id"]
SECTION_KEY = ["title_id", "part_id", "section_id"]


def normalize(divisions: DataFrame, repaired: bool = False) -> DataFrame:
    """Sections and appendices with type, name, part id and section id.

    ``divisions`` has ``raw_id`` (``TYPE-NUMBER``); other columns pass through.
    Divisions of any other type are dropped.  Both kinds come out of one pass
    over the input, as if each had been normalised alone and the two united.
    """
    kind = ids.raw_type(F.col("raw_id"))
    name = ids.raw_name(F.col("raw_id"), repaired)
    dotted = ids.dotted_name(name)
    is_appendix = kind == fv.APPENDIX_TYPE
    return (
        divisions.filter(kind.isin(fv.APPENDIX_TYPE, fv.SECTION_TYPE))
        .withColumns(
            {
                "section_name": F.when(is_appendix, name).otherwise(dotted),
                "section_type": kind,
                "part_id": F.when(is_appendix, ids.appendix_part_id(name, repaired)).otherwise(
                    ids.section_part_id(dotted, repaired)
                ),
                "section_id": F.when(is_appendix, ids.appendix_section_id(name)).otherwise(
                    ids.section_number_id(dotted, repaired)
                ),
            }
        )
        .drop("raw_id")
    )


def appendices(sections: DataFrame) -> DataFrame:
    """Only the appendices."""
    return sections.filter(F.col("section_type") == fv.APPENDIX_TYPE)


def in_reading_order(sections: DataFrame) -> DataFrame:
    """Within titles by part, then sections before appendices, then by section id."""
    return sections.orderBy("title_id", "part_id", F.desc("section_type"), "section_id")


def compile_parts(parts: DataFrame) -> DataFrame:
    """Parts with the spelling of part ids that sections use."""
    return parts.withColumn("part_id", ids.compiled_part_id(F.col("part_id")))


def with_hash(sections: DataFrame) -> DataFrame:
    """Add the identity of the text, taken before any cleaning."""
    return sections.withColumn("section_hash", text.content_hash(F.col("section_text")))


def clean(sections: DataFrame, regex_names: bool = False) -> DataFrame:
    """Section text on one line without its own name, and its number of words."""
    shown = text.display_name(F.col("section_type"), F.col("section_name"))
    return sections.withColumn(
        "section_text", text.clean_section_text(F.col("section_text"), shown, regex_names)
    ).withColumn("section_word_count", text.word_count(F.col("section_text")))


def clean_parts(parts: DataFrame) -> DataFrame:
    """Authority list cleaned, and its number of entries."""
    return parts.withColumn(
        "part_authority", text.clean_authority(F.col("part_authority"))
    ).withColumn("authority_count", text.authority_count(F.col("part_authority")))


def split_year(table: DataFrame) -> DataFrame:
    """Move the year out of the title id into a column of its own."""
    return table.withColumn("year_id", ids.year_id(F.col("title_id"))).withColumn(
        "title_id", ids.bare_title_id(F.col("title_id"))
    )


def edition_counts(sections: DataFrame, parts: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Sections and parts in all editions and in one, as a single row."""
    focal = ids.in_year(F.col("title_id"), year)

    def counts(table: DataFrame, kind: str) -> DataFrame:
        return table.agg(
            F.count(F.lit(1)).alias(f"{kind}_count"), F.count_if(focal).alias(f"{kind}_count_now")
        )

    both = counts(sections, "section").unionByName(counts(parts, "part"), allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))
