"""Section and authority text as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv


def content_hash(text: Column) -> Column:
    """Identity of a text across editions: its SHA-256 in hex."""
    return F.sha2(text, 256)


def display_name(section_type: Column, name: Column) -> Column:
    """Section names get a section sign, all others stay."""
    return F.when(
        section_type == fv.SECTION_TYPE, F.concat_ws(" ", F.lit(fv.SECTION_SIGN), name)
    ).otherwise(name)


def clean_section_text(text: Column, shown_name: Column, regex_names: bool = False) -> Column:
    """Put the text on one line and take its own name out.

    By default the name is removed as literal text.  ``regex_names=True`` reads
    the name as a pattern: dots match any character, brackets group, and a name
    with an unbalanced bracket fails the job.
    """
    line = F.regexp_replace(text, fv.LINE_BREAK, " ")
    if regex_names:
        return F.regexp_replace(line, shown_name, F.lit(""))
    return F.replace(line, shown_name, F.lit(""))


def word_count(text: Column) -> Column:
    """Pieces between blanks: an empty text counts 1, a leading blank adds 1, NULL stays NULL."""
    return F.size(F.split(text, fv.BLANKS)).cast("bigint")


def clean_authority(text: Column) -> Column:
    """Authority list on one line, without its heading and without its last character."""
    line = F.regexp_replace(text, fv.LINE_BREAK, "")
    listed = F.regexp_replace(
        F.regexp_replace(line, fv.AUTHORITY_HEAD, ""), fv.AUTHORITY_AND, fv.AUTHORITY_SEPARATOR
    )
    return F.regexp_replace(listed, fv.LAST_CHARACTER, "")


def authority_count(cleaned: Column) -> Column:
    """Number of entries in a cleaned authority list; NULL stays NULL."""
    return F.size(F.split(cleaned, fv.AUTHORITY_SEPARATOR)).cast("bigint")
