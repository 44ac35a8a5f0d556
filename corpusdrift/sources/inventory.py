"""What files exist, which titles still need work, and how extraction went."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv


def inventory(
    spark: SparkSession,
    directory: str,
    suffix: str = fv.TITLE_FILE_SUFFIX,
    prefix: str = fv.TITLE_FILE_PREFIX,
    label: str = "raw",
) -> DataFrame:
    """Files of a folder by name, as ``title_id, <label> = true, path, length``.

    Only names and sizes are read: the content column is pruned from the scan.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .load(directory)
        .select("path", "length")
        .filter(name.startswith(prefix) & name.endswith(suffix))
        .select(
            F.replace(name, F.lit(suffix), F.lit("")).alias("title_id"),
            F.lit(True).alias(label),
            "path",
            "length",
        )
    )


PARSED = "title_id string, parsed boolean"


def parsed_inventory(spark: SparkSession, directory: str) -> DataFrame:
    """Titles that extraction has marked as done, which it does last; none if there is no mark yet.

    A title without sections is done all the same.
    """
    try:
        return spark.read.schema(PARSED).parquet(directory).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PARSED)


def extract_roster(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Raw files with a flag for those already parsed, in title order."""
    return (
        raw.join(parsed.select("title_id", "parsed"), "title_id", "left")
        .na.fill(False, ["parsed"])
        .orderBy("title_id")
    )


def pending(roster: DataFrame) -> DataFrame:
    """Titles that still have to be parsed."""
    return roster.filter(~F.col("parsed"))


def extract_outcomes(roster: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows gained per title: 0 if it was parsed before, -1 if it could not be read.

    ``counts`` holds ``title_id, lines`` of the titles read without fault.
    """
    lines = (
        F.when(F.col("parsed"), F.lit(0))
        .otherwise(F.coalesce(F.col("lines"), F.lit(-1)))
        .cast("bigint")
    )
    return (
        roster.join(counts.select("title_id", "lines"), "title_id", "left")
        .withColumn("new_lines", lines)
        .withColumn("parsed", F.col("new_lines") != -1)
        .drop("lines")
    )
