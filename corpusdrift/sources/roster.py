"""The list of title files a corpus should have, and what became of each fetch."""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv


def corpus_bounds(
    spark: SparkSession,
    years: tuple[int, int] | None = None,
    titles: tuple[int, int] | None = None,
    this_year: int | None = None,
) -> DataFrame:
    """One row with the first and last title and year, checked when the plan is built.

    Ranges may be given in either order.  Editions exist from the first digital
    year up to last year; titles are numbered 1 to 50.
    """
    this_year = this_year or datetime.date.today().year
    years = years or (fv.FIRST_YEAR, this_year - 1)
    titles = titles or (fv.FIRST_TITLE, fv.LAST_TITLE)
    if min(years) < fv.FIRST_YEAR or max(years) >= this_year:
        raise ValueError(f"years must lie in {fv.FIRST_YEAR}..{this_year - 1}: {years}")
    if min(titles) < fv.FIRST_TITLE or max(titles) > fv.LAST_TITLE:
        raise ValueError(f"titles must lie in {fv.FIRST_TITLE}..{fv.LAST_TITLE}: {titles}")
    return spark.range(1).select(
        F.lit(min(titles)).alias("first_title"),
        F.lit(max(titles)).alias("last_title"),
        F.lit(min(years)).alias("first_year"),
        F.lit(max(years)).alias("last_year"),
    )


def title_roster(bounds: DataFrame, present: DataFrame, directory: str) -> DataFrame:
    """One row per title and year, both ends included, marked Present or Absent.

    ``present`` holds the ``title_id`` of the files that exist, as
    :func:`corpusdrift.sources.inventory.inventory` lists them.
    """
    wanted = (
        bounds.withColumn("title", F.explode(F.sequence("first_title", "last_title")))
        .withColumn("year", F.explode(F.sequence("first_year", "last_year")))
        .select(
            F.col("year").cast("int"),
            F.col("title").cast("int"),
            F.format_string(fv.TITLE_FILE_FORMAT, "title", "year").alias("filename"),
            F.format_string(fv.TITLE_URL_FORMAT, "year", "title").alias("url"),
        )
        .withColumn("file_path", F.concat(F.lit(directory.rstrip("/") + "/"), "filename"))
        .withColumn("title_id", F.replace("filename", F.lit(fv.TITLE_FILE_SUFFIX), F.lit("")))
    )
    found = present.select("title_id").distinct().withColumn("found", F.lit(True))
    return wanted.join(found, "title_id", "left").select(
        "year",
        "title",
        "filename",
        "file_path",
        "url",
        F.when(F.col("found"), fv.STATUS_PRESENT).otherwise(fv.STATUS_ABSENT).alias("status"),
    )


def classify_fetches(log: DataFrame) -> DataFrame:
    """Outcome of each fetch from ``status, queried, timed_out, response_code``.

    Only absent files that were queried change: a timeout counts as its own
    code, the success code gives Acquired, anything else Failed.  All other rows
    keep their status and get the code for "not queried".
    """
    asked = (F.col("status") == fv.STATUS_ABSENT) & F.col("queried")
    answer = F.when(F.col("timed_out"), fv.CODE_TIMEOUT).otherwise(F.col("response_code"))
    code = F.when(asked, answer).otherwise(fv.CODE_NOT_QUERIED)
    outcome = F.when(code == fv.CODE_OK, fv.STATUS_ACQUIRED).otherwise(fv.STATUS_FAILED)
    return log.withColumns(
        {
            "status": F.when(asked, outcome).otherwise(F.col("status")),
            "response_code": code,
            "rate_limited": F.coalesce(code == fv.CODE_RATE_LIMITED, F.lit(False)),
        }
    ).drop("queried", "timed_out")


def status_tally(roster: DataFrame) -> DataFrame:
    """Number of files per status."""
    return roster.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
