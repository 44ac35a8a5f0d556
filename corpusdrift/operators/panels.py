"""Year-by-year panels and the queries behind the part browser."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.functions import ids
from corpusdrift.operators.sections import PART_KEY


def panel(temporal: DataFrame, figure: str, years: list[str]) -> DataFrame:
    """One row per part, one column per year.

    Two values for one cell are an error, and so is a row of a year that isn't listed.
    """
    single = F.when(F.count(F.lit(1)) <= 1, F.max(figure)).otherwise(
        F.raise_error(F.lit(f"more than one {figure} per part and year"))
    )
    unlisted = F.concat(F.lit("a row of a year that is not listed: "), F.coalesce("year_id", F.lit("NULL")))
    listed = F.when(F.col("year_id").isin(years), F.col("year_id")).otherwise(F.raise_error(unlisted))
    return temporal.withColumn("year_id", listed).groupBy(*PART_KEY).pivot("year_id", years).agg(single)


def _rankable(focal: DataFrame) -> DataFrame:
    """Parts with a score that are not reserved."""
    return focal.filter(
        F.col("deviance_mean").isNotNull()
        & ~F.coalesce("part_heading", F.lit("")).contains(fv.RESERVED)
    )


def title_medians(focal: DataFrame) -> DataFrame:
    """Exact median score per title.

    Scores have six digits, so a group holds at most a million distinct values.
    """
    return (
        _rankable(focal)
        .groupBy("title_id")
        .agg(F.median("deviance_mean").alias("median_deviance"))
    )


def noteworthy_part(focal: DataFrame) -> DataFrame:
    """In the title with the highest median score, the part with the highest score."""
    top = title_medians(focal).orderBy(F.desc("median_deviance"), "title_id").limit(1)
    return (
        _rankable(focal)
        .join(top.select("title_id"), "title_id", "left_semi")
        .orderBy(F.desc("deviance_mean"), "part_id")
        .limit(1)
        .select("title_id", "part_id", "deviance_mean")
    )


def display_scores(focal: DataFrame) -> DataFrame:
    """Scores with three digits, ties to even."""
    return focal.withColumn("deviance_mean", F.bround("deviance_mean", fv.DISPLAY_DIGITS))


def with_title_names(focal: DataFrame, titles: DataFrame) -> DataFrame:
    """Add the full title name; Spark broadcasts the titles if they are as small as they should be."""
    return focal.join(titles.select("title_id", "title_name_full"), "title_id", "left")


def part_lookup(focal: DataFrame, title_id: str, part_id: str) -> DataFrame:
    """Details of one part: every row of that key; no row if there is no such part."""
    return focal.filter((F.col("title_id") == title_id) & (F.col("part_id") == part_id)).select(
        "title_name_full", "part_heading", "part_authority", "deviance_mean"
    )


def dropdown_options(focal: DataFrame, column: str, where: tuple[str, str] | None = None) -> DataFrame:
    """Distinct values of a column with readable labels, in order."""
    if where:
        focal = focal.filter(F.col(where[0]) == where[1])
    return (
        focal.select(F.col(column).alias("value"))
        .distinct()
        .orderBy("value")
        .select(ids.human_label(F.col("value")).alias("label"), "value")
    )


def deviance_distribution(focal: DataFrame, title_id: str, part_id: str) -> DataFrame:
    """Parts of one title by falling score, with position and a mark on the chosen part.

    The position is the number of parts with a higher score plus the place among
    equals.  The first comes from one row per distinct score, at most a million
    of them; only parts with the very same score are numbered side by side.
    """
    score = F.col("deviance_mean")
    level = F.coalesce(score, F.lit(-1.0))
    rows = (
        focal.filter(F.col("title_id") == title_id)
        .select("title_id", "part_id", "deviance_mean")
        .withColumn("level", level)
    )
    # Keep the windows apart from the rows: the first sees one row per score.
    above = Window.partitionBy("title_id").orderBy(F.desc("level"))
    offsets = (
        rows.groupBy("title_id", "level")
        .agg(F.count(F.lit(1)).alias("parts"))
        .withColumn("above", F.sum("parts").over(above) - F.col("parts"))
        .drop("parts")
    )
    equals = Window.partitionBy("title_id", "level").orderBy("part_id")
    chosen: Column = F.col("part_id") == part_id
    return (
        rows.withColumn("place", F.row_number().over(equals) - 1)
        .join(offsets, ["title_id", "level"])
        .select(
            "title_id",
            "part_id",
            "deviance_mean",
            (F.col("above") + F.col("place")).alias("position"),
            F.coalesce(chosen, F.lit(False)).alias("highlighted"),
            ids.part_number(F.col("part_id")).alias("part_number"),
        )
        .orderBy("position")
    )
