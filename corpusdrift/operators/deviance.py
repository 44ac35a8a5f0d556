"""How far each section lies from the average of its part, and which stand out."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.functions import ids, vectors
from corpusdrift.operators import sections as section_operators
from corpusdrift.operators.embedding import centroids_of_pairs, embedded_pairs
from corpusdrift.operators.joins import HOT_ROWS, join_one
from corpusdrift.operators.sections import PART_KEY, SECTION_KEY

TEXT_KEY = [*PART_KEY, "section_hash"]
Order = Callable[[list[str]], list[Column]]


def text_deviance(
    sections: DataFrame,
    embedded: DataFrame,
    parts: DataFrame,
    year: int = fv.FOCAL_YEAR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Deviance per part and distinct embedded text of the focal edition.

    No row per section and no vectors come out.  Parts that are not listed in
    ``parts`` have no centroid to compare with, and their texts a NULL score.
    """
    pairs = embedded_pairs(sections, embedded, year, hot_rows)
    centroids = centroids_of_pairs(pairs).join(parts.select(*PART_KEY), PART_KEY, "left_semi")
    # Sections, not pairs, are counted: a part's pairs are never more than its sections.
    counted, _ = editions(sections, year)
    return join_one(pairs, centroids, PART_KEY, "left", hot_rows, counted).select(
        *TEXT_KEY,
        vectors.rescaled_distance(F.col("section_embedding"), F.col("part_embedding")).alias("section_deviance"),
    )


def editions(sections: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """The sections of one edition, and those of all others."""
    focal = ids.in_year(F.col("title_id"), year)
    return sections.filter(focal), sections.filter(~F.coalesce(focal, F.lit(False)))


def attach_text_counts(sections: DataFrame, texts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a join of sections to text rows on title, part and section id would give, without pairs.

    Section ids are not unique, so that join returns each section once per text
    row of the same id.  Here each section stays one row with ``text_rows``, the
    number of those rows, and ``joined_words``, the words they hold together.
    Sections without any text row count as one row without words.
    """
    per_key = texts.groupBy(*SECTION_KEY).agg(
        F.count(F.lit(1)).alias("text_rows"), F.sum("section_word_count").alias("joined_words")
    )
    return join_one(sections, per_key, SECTION_KEY, hot_rows=hot_rows).withColumn(
        "text_rows", F.coalesce("text_rows", F.lit(1))
    )


def _lowest(columns: list[str]) -> list[Column]:
    return [F.asc(c) for c in columns]


def _highest(columns: list[str]) -> list[Column]:
    return [F.desc(c) for c in columns]


RANK_ORDER = ["section_deviance", "section_id", "section_hash", "section_name"]


def first_per_group(
    rows: DataFrame, keys: list[str], order: list[Column], n: int = fv.DEVIANTS_N
) -> DataFrame:
    """The first ``n`` rows of each group, with their ``deviance_rank``.

    Each task cuts its own share of a group to ``n`` rows before the shuffle, so no
    group is ever gathered whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("deviance_rank", F.row_number().over(window)).filter(
        F.col("deviance_rank") <= n
    )


#: Beyond so many rows of a group, rankings look for the group's cut-off first.
PLAIN_RANKS = 1_000
#: Rows of equal score at a cut-off that one task ranks.
DEAL_ROWS = 1_000_000


def first_by_level(
    rows: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    level: Column,
    deal_rows: int = DEAL_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As :func:`first_per_group`, for any ``n``; no group meets in one task but for about its first ``n`` rows.

    ``level`` is a whole number that never falls in the order, such as a score in millionths.  Rows are counted by
    level, where tasks combine their counts; the level at which a group has ``n`` rows is its cut-off, and only rows up
    to it go on.  Many rows may share the cut-off: the rows of a level are ranked in deals first.
    """
    leveled = rows.withColumn("__level", level)
    counts = leveled.groupBy(*keys, "__level").agg(F.count(F.lit(1)).alias("__rows"))
    # A row for each level of a group, not for each of its rows.
    upto = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__level"))
    found = counts.withColumn("__upto", upto).groupBy(*keys)
    cut = found.agg(
        F.min(F.when(F.col("__upto") >= n, F.col("__level"))).alias("__cut"),
        F.min(F.when(F.col("__upto") >= n, F.struct("__level", "__rows")))["__rows"].alias("__tied"),
    )
    within = join_one(leveled, cut, keys, "left", hot_rows)
    within = within.filter(F.col("__cut").isNull() | (F.col("__level") <= F.col("__cut")))
    deals = F.ceil(F.coalesce(F.col("__tied"), F.lit(1)) / deal_rows).cast("bigint")
    deal = F.pmod(F.xxhash64(*rows.columns), deals).alias("__deal")
    dealt = within.select(*rows.columns, deal)
    first = Window.partitionBy(*keys, "__deal").orderBy(*order)
    dealt = dealt.withColumn("deviance_rank", F.row_number().over(first)).filter(F.col("deviance_rank") <= n)
    return first_per_group(dealt.drop("__deal", "deviance_rank"), keys, order, n)


def _first(rows: DataFrame, order: list[Column], n: int, sign: int) -> DataFrame:
    if n <= PLAIN_RANKS:
        return first_per_group(rows, PART_KEY, order, n)
    level = F.round(F.col("section_deviance") * 10**fv.SCORE_DIGITS).cast("bigint") * sign
    return first_by_level(rows, PART_KEY, order, n, level)


def least_deviant(
    scored: DataFrame, n: int = fv.DEVIANTS_N, ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` most typical sections per part.  Sections without a score have no rank.

    ``ties`` are columns that decide where :data:`RANK_ORDER` does not.
    """
    known = scored.filter(F.col("section_deviance").isNotNull())
    return _first(known, _lowest([*RANK_ORDER, *ties]), n, 1)


def most_deviant(
    scored: DataFrame, n: int = fv.DEVIANTS_N, ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` least typical sections per part, as :func:`least_deviant` from the other end."""
    known = scored.filter(F.col("section_deviance").isNotNull())
    return _first(known, _highest([*RANK_ORDER, *ties]), n, -1)


def _not_least(ranked: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Rows ranked from the top that are not among the ``n`` lowest as well.

    A row ranked r from the top of c rows is ranked c + 1 - r from the bottom:
    beyond n of them while r <= c - n.
    """
    return (
        ranked.join(sizes, PART_KEY)
        .filter(F.col("deviance_rank") <= F.col("ranked_rows") - n)
        .drop("ranked_rows")
    )


def label_sections(scored: DataFrame, n: int = fv.DEVIANTS_N) -> DataFrame:
    """Every section with its label: Least, else Most, else Neither.

    Only the picked rows, at most ``2 n`` of a part, are ranked.  They are joined back to all rows on all
    columns; of rows that are equal in all of them as many get the label as were picked.
    """
    columns = scored.columns
    ties = [c for c in columns if c not in (*PART_KEY, *RANK_ORDER)]
    low = least_deviant(scored, n, ties).withColumn("label", F.lit(fv.LEAST))
    high = _not_least(most_deviant(scored, n, ties), _ranked_rows(scored, False), n).withColumn(
        "label", F.lit(fv.MOST)
    )
    picked = low.unionByName(high).groupBy(*columns).agg(
        F.count_if(F.col("label") == fv.LEAST).alias("least"),
        F.count_if(F.col("label") == fv.MOST).alias("most"),
    )
    marked = F.struct(*(F.col(c) for c in columns))
    key = F.xxhash64(marked)
    narrow = picked.select(
        key.alias("__key"), marked.alias("__row"), "least", "most"
    )
    found = (
        scored.withColumn("__key", key)
        .join(narrow, "__key", "left")
        .filter(F.col("__row").isNull() | marked.eqNullSafe(F.col("__row")))
        .drop("__row")
    )
    # Equal rows are numbered only where some of them were picked.
    same = Window.partitionBy("__key", *columns).orderBy(F.lit(1))
    place = F.row_number().over(same)
    label = (
        F.when(F.col("place") <= F.col("least"), fv.LEAST)
        .when(F.col("place") <= F.col("least") + F.col("most"), fv.MOST)
        .otherwise(fv.NEITHER)
    )
    rest = found.filter("least is null").withColumn("notable_deviant", F.lit(fv.NEITHER))
    some = found.filter("least is not null").withColumn("place", place).withColumn("notable_deviant", label)
    return some.select(*columns, "notable_deviant").unionByName(rest.select(*columns, "notable_deviant"))


def notable_sections(
    scored: DataFrame,
    texts: DataFrame,
    n: int = fv.DEVIANTS_N,
    fan_out: bool = True,
    regex_names: bool = False,
    keep: Callable[[DataFrame], DataFrame] = lambda table: table,
    hot_rows: int = HOT_ROWS,
    year: int = fv.FOCAL_YEAR,
) -> DataFrame:
    """The least and most deviant sections per part, with cleaned text.

    ``scored`` holds all sections without text, ``texts`` the same with raw text, of which only
    the edition with scores is read.
    A row that is among the ``n`` lowest is Least even if it is also among the
    ``n`` highest.  With ``fan_out`` the ranking runs over the rows that a join
    on the (not unique) section id would give; only the at most ``n`` rows per
    section id that can be among the first ``n`` of their part are built.
    Without it each section keeps its own text.  ``keep`` may store the two
    tables that are read more than once, so that all texts are scanned only once.
    """
    scored = scored.select(*SECTION_KEY, "section_name", "section_hash", "section_deviance")
    picked = least_deviant(scored, n).withColumn("notable_deviant", F.lit(fv.LEAST)).unionByName(
        most_deviant(scored, n).withColumn("notable_deviant", F.lit(fv.MOST))
    )
    picked = keep(picked.drop("deviance_rank"))
    own = SECTION_KEY if fan_out else [*SECTION_KEY, "section_name", "section_hash"]
    texts = editions(texts, year)[0].select(
        *dict.fromkeys([*own, "section_name", "section_type", "section_text"])
    )
    counted = editions(scored, year)[0]
    wanted = join_one(
        texts, picked.select(*own).distinct(), own, "left_semi", hot_rows, counted, ["section_name"]
    )
    wanted = keep(section_operators.clean(wanted, regex_names).select(*own, "section_text"))
    low = _ranked(picked, wanted, fv.LEAST, _lowest, own, n)
    high = _ranked(picked, wanted, fv.MOST, _highest, own, n)
    return low.unionByName(_not_least(high, _ranked_rows(scored, fan_out), n)).select(
        *SECTION_KEY, "section_name", "section_text", "section_deviance", "notable_deviant"
    )


def _ranked(
    picked: DataFrame, texts: DataFrame, label: str, order: Order, own: list[str], n: int
) -> DataFrame:
    """One end of the ranking, after joining each picked section to its texts.

    Only the first ``n`` texts of a section id can matter.
    """
    first = first_per_group(texts, own, order(["section_text"]), n).drop("deviance_rank")
    if own != SECTION_KEY:
        first = first.dropDuplicates(own)
    rows = picked.filter(F.col("notable_deviant") == label).join(first, own, "left")
    return _first(rows, order([*RANK_ORDER, "section_text"]), n, 1 if label == fv.LEAST else -1)


def _ranked_rows(scored: DataFrame, fan_out: bool) -> DataFrame:
    """Number of ranked rows per part, with or without the join to text rows."""
    per_id = scored.groupBy(*SECTION_KEY).agg(
        F.count(F.lit(1)).alias("texts"), F.count("section_deviance").alias("scored")
    )
    weight = F.when(F.col("section_id").isNotNull(), F.col("texts")).otherwise(F.lit(1))
    rows = F.col("scored") * weight if fan_out else F.col("scored")
    return per_id.groupBy(*PART_KEY).agg(F.sum(rows).alias("ranked_rows"))


def focal_notable(notable: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Notable sections of one edition, with the year in a column of its own."""
    return (
        notable.filter(ids.in_year(F.col("title_id"), year))
        .withColumn("year_id", ids.year_id(F.col("title_id")))
        .withColumn("title_id", ids.bare_title_id(F.col("title_id")))
    )
