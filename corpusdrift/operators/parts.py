"""Statistics of parts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.operators.deviance import TEXT_KEY, editions, text_deviance
from corpusdrift.operators.joins import HOT_ROWS, join_one
from corpusdrift.operators.sections import PART_KEY, SECTION_KEY, clean_parts, split_year
from corpusdrift.operators.sketch import Screen


def quantify(
    sections: DataFrame,
    embedded: DataFrame,
    parts: DataFrame,
    year: int = fv.FOCAL_YEAR,
    multiplicity: bool = False,
    hot_rows: int = HOT_ROWS,
    screen: Screen | None = None,
) -> DataFrame:
    """Sections with deviance and focal match, without text and vectors.

    ``sections`` has ``section_hash`` and ``section_word_count``.  ``screen`` tells hashes that may be among the embedded
    ones; sections of other editions that it keeps out match nothing and are not shuffled.
    ``multiplicity`` as in :func:`corpusdrift.operators.embedding.propagate`.
    """
    focal, others = editions(sections.drop("section_text"), year)
    scores = text_deviance(sections, embedded, parts, year, hot_rows)
    known = embedded.select("section_hash")
    if multiplicity:
        copies = focal.groupBy("section_hash").agg(F.count(F.lit(1)).alias("copies"))
        known = known.join(copies, "section_hash")
        # One text may have a score in every part.
        scores = join_one(scores, copies, ["section_hash"], "inner", hot_rows)
    else:
        known = known.withColumn("copies", F.lit(1).cast("bigint"))
        scores = scores.withColumn("copies", F.lit(1).cast("bigint"))
    # Every section takes part in one join only.  In the focal edition a text is
    # known if it is among the scored ones, whatever its score.
    matched = join_one(_screened(others, screen), known, ["section_hash"], hot_rows=hot_rows)
    if screen is not None:
        alone = others.filter(~screen(F.col("section_hash"))).withColumn("copies", F.lit(None).cast("bigint"))
        matched = matched.unionByName(alone)
    found = join_one(focal, scores, TEXT_KEY, hot_rows=hot_rows).unionByName(
        matched.withColumn("section_deviance", F.lit(None).cast("double"))
    )
    return found.withColumn(
        "focal_year_match", F.when(F.col("copies").isNotNull(), 1).otherwise(0)
    ).withColumn("copies", F.coalesce("copies", F.lit(1)))


def _screened(sections: DataFrame, screen: Screen | None) -> DataFrame:
    """The sections that may match."""
    return sections if screen is None else sections.filter(screen(F.col("section_hash")))


def part_aggregates(quantified: DataFrame, fan_out: bool = True) -> DataFrame:
    """All figures of a part that come from its sections, in one grouping.

    With ``fan_out`` the figures are those of the rows that a join of sections to
    texts on the (not unique) section id would give.  Such a join returns each
    section as often as its id occurs, so the id's sums are weighted by that
    number instead.  ``copies`` weights a section as often as its vector occurs.
    Scores are summed as whole millionths, so the mean does not depend on the
    order in which tasks finish.
    """
    keyed = F.lit(True)
    for column in SECTION_KEY:
        keyed = keyed & F.col(column).isNotNull()
    copies = F.col("copies") if "copies" in quantified.columns else F.lit(1)
    scale = 10**fv.SCORE_DIGITS
    score = F.round(F.col("section_deviance") * scale).cast("bigint")
    words = F.col("section_word_count")
    per_id = quantified.groupBy(*SECTION_KEY).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(copies).alias("rows"),
        F.sum(words).alias("words"),
        F.sum(words * copies).alias("own_words"),
        F.sum(score * copies).alias("score"),
        F.sum(F.when(score.isNotNull(), copies)).alias("scored"),
        F.sum(F.col("focal_year_match") * copies).alias("matched"),
    )
    weight = F.when(keyed, F.col("texts")).otherwise(F.lit(1)) if fan_out else F.lit(1)
    joined_words = F.when(keyed, F.col("words") * F.col("rows")) if fan_out else F.col("own_words")
    rows = F.sum(F.col("rows") * weight)
    named = F.when(F.col("section_id").isNotNull(), F.col("rows") * weight).otherwise(F.lit(0))
    return (
        per_id.groupBy(*PART_KEY)
        .agg(
            (
                F.round(F.sum(F.col("score") * weight) / F.sum(F.col("scored") * weight)) / scale
            ).alias("deviance_mean"),
            F.sum(named).alias("section_count"),
            F.sum(joined_words).alias("part_word_count"),
            (F.sum(F.col("matched") * weight) / rows).alias("focal_year_match"),
        )
    )


def part_statistics(parts: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Parts with cleaned authorities and the figures of their sections."""
    return clean_parts(parts).join(aggregates, PART_KEY, "left")


def part_focal(statistics: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Parts of one edition with heading, authorities and mean deviance, scored or not."""
    return (
        split_year(statistics)
        .filter(F.col("year_id") == str(year))
        .select(
            "year_id", "title_id", "part_id", "part_heading", "part_authority", "deviance_mean"
        )
    )


def part_temporal(statistics: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Yearly figures of the parts that the focal edition still has."""
    yearly = split_year(statistics)
    focal = yearly.filter(F.col("year_id") == str(year)).select("title_id", "part_id")
    return yearly.select(
        "year_id",
        "title_id",
        "part_id",
        "section_count",
        "authority_count",
        "part_word_count",
        "focal_year_match",
    ).join(focal, PART_KEY, "left_semi")
