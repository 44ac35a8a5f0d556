"""Identifiers of titles, parts and sections as column expressions.

Every function takes and returns a Column.  ``repaired=True`` gives the form
without the two known losses of the default: numbers longer than four
characters being cut, and names being cut at their second hyphen.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv


def padded(number: Column, repaired: bool = False) -> Column:
    """Left-pad with zeros to four characters; longer input is cut unless repaired."""
    if repaired:
        return F.lpad(number, F.greatest(F.lit(fv.ID_WIDTH), F.length(number)), F.lit("0"))
    return F.lpad(number, fv.ID_WIDTH, "0")


def raw_type(raw_id: Column) -> Column:
    """``SECTION`` of ``SECTION-1.1``."""
    return F.get(F.split(raw_id, fv.RAW_ID_SEPARATOR), F.lit(0))


def raw_name(raw_id: Column, repaired: bool = False) -> Column:
    """``1.1`` of ``SECTION-1.1``; NULL when there is no hyphen."""
    pieces = F.split(raw_id, fv.RAW_ID_SEPARATOR, 2 if repaired else -1)
    return F.get(pieces, F.lit(1))


def dotted_name(name: Column) -> Column:
    """Section names without a dot belong to part zero."""
    return F.when(name.contains("."), name).otherwise(F.concat(F.lit("0."), name))


def section_part_id(dotted: Column, repaired: bool = False) -> Column:
    """Part id from what precedes the first dot of a section name."""
    return F.concat(
        F.lit(fv.PART_PREFIX), padded(F.regexp_replace(dotted, fv.AFTER_FIRST_DOT, ""), repaired)
    )


def section_number_id(dotted: Column, repaired: bool = False) -> Column:
    """Section id from what follows the last dot of a section name."""
    return F.concat(
        F.lit(fv.SECTION_PREFIX), padded(F.regexp_replace(dotted, fv.UP_TO_LAST_DOT, ""), repaired)
    )


def appendix_part_id(name: Column, repaired: bool = False) -> Column:
    """Part id from the tail of ``Appendix A to Part 50``."""
    tail = F.regexp_replace(name, fv.UP_TO_LAST_TO, "")
    return F.concat(
        F.lit(fv.PART_PREFIX), padded(F.regexp_replace(tail, fv.UP_TO_LAST_PART, ""), repaired)
    )


def appendix_section_id(name: Column) -> Column:
    """``Appendix-A`` of ``Appendix A to Part 50``."""
    return F.regexp_replace(
        F.regexp_replace(name, fv.FROM_FIRST_TO, ""), fv.APPENDIX_WORD, fv.APPENDIX_PREFIX
    )


def compiled_part_id(part_id: Column) -> Column:
    """``Part-0001`` of ``PART-0001``."""
    return F.regexp_replace(part_id, fv.RAW_PART_PREFIX, fv.PART_PREFIX)


def year_id(title_id: Column) -> Column:
    """Trailing four-digit year, or the empty string."""
    return F.regexp_extract(title_id, fv.TRAILING_YEAR, 1)


def bare_title_id(title_id: Column) -> Column:
    """Title id without its trailing year."""
    return F.regexp_replace(title_id, fv.TRAILING_YEAR, "")


def in_year(title_id: Column, year: int) -> Column:
    """Rows of one yearly edition; a suffix test, which parquet scans can push down."""
    return title_id.endswith(f"-{year}")


def human_label(identifier: Column) -> Column:
    """``Part 586`` of ``Part-0586``."""
    return F.regexp_replace(identifier, fv.LABEL_PREFIX, fv.LABEL_REPLACEMENT)


def part_number(part_id: Column) -> Column:
    """Part id without its prefix, as shown when hovering over a bar."""
    return F.replace(part_id, F.lit(fv.PART_PREFIX), F.lit(""))
