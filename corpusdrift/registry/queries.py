"""The named queries.  Each takes a session and a data folder and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift.functions import ids, markup, text, vectors
from corpusdrift.operators import deviance, embedding, panels, parts, sections
from corpusdrift.registry.fixture import YEARS, Corpus
from corpusdrift.sources import inventory, markup as source, roster, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TITLE, PART = "Title-01", "Part-0003"


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Corpus(spark, folder))
    return build


# Tables shared by the queries below.


def _sections(corpus: Corpus, repaired: bool = False) -> DataFrame:
    divisions = corpus.divisions().drop("div_type", "div_n")
    return sections.normalize(divisions, repaired)


def _hashed(corpus: Corpus) -> DataFrame:
    return sections.with_hash(_sections(corpus))


def _cleaned(corpus: Corpus) -> DataFrame:
    return sections.clean(_hashed(corpus))


def _parts(corpus: Corpus) -> DataFrame:
    return sections.compile_parts(corpus.raw_parts())


def _facts(corpus: Corpus, words: bool = True) -> DataFrame:
    """Sections without their text: ids, hash and, if wanted, word count.

    A stage table, written once so that the steps after it read no text.
    """
    rows = _cleaned(corpus) if words else _hashed(corpus)
    return tables.settle(rows.drop("section_text"))


def _embedded(corpus: Corpus, facts: DataFrame) -> DataFrame:
    """Vectors of the focal edition's texts, another stage table."""
    return tables.settle(embedding.at_half_precision(corpus.vectors(facts)))


def _scored(corpus: Corpus, words: bool = True, multiplicity: bool = False) -> DataFrame:
    """Sections with deviance and focal match."""
    facts = _facts(corpus, words)
    return parts.quantify(
        facts, _embedded(corpus, facts), _parts(corpus), multiplicity=multiplicity
    )


def _statistics(corpus: Corpus, fan_out: bool = True, multiplicity: bool = False) -> DataFrame:
    aggregates = parts.part_aggregates(_scored(corpus, multiplicity=multiplicity), fan_out)
    return parts.part_statistics(_parts(corpus), aggregates)


def _focal(corpus: Corpus) -> DataFrame:
    """The exported parts of the focal edition, which the browser queries read."""
    return tables.settle(parts.part_focal(_statistics(corpus)))


def _temporal(corpus: Corpus) -> DataFrame:
    return parts.part_temporal(tables.settle(_statistics(corpus)))


IDS = ["section_name", "section_type", "part_id", "section_id"]
SECTION = ["title_id", "part_id", "section_id"]


# Rosters and inventories.


@query
def ingest_roster(corpus: Corpus) -> DataFrame:
    present = corpus.title_ids()
    number = F.substring("title_id", 7, 2).cast("int")
    year = ids.year_id(F.col("title_id")).cast("int")
    bounds = present.agg(
        F.min(number).alias("first_title"),
        (F.max(number) + 2).alias("last_title"),
        (F.min(year) - 1).alias("first_year"),
        F.max(year).alias("last_year"),
    )
    return roster.title_roster(bounds, present, "corpus/raw")


def _fetches(corpus: Corpus) -> DataFrame:
    page = F.col("page_id")
    timed_out = page % 7 == 3
    code = F.when(page % 3 != 0, 200).when(page % 2 == 0, 429).otherwise(404)
    log = corpus.table("pages").select(
        "page_id",
        F.when(page % 5 == 0, "Present").otherwise("Absent").alias("status"),
        (page % 4 != 0).alias("queried"),
        timed_out.alias("timed_out"),
        F.when(~timed_out, code).alias("response_code"),
    )
    return roster.classify_fetches(log)


@query
def classify_fetch(corpus: Corpus) -> DataFrame:
    return _fetches(corpus)


@query
def roster_status_tally(corpus: Corpus) -> DataFrame:
    return roster.status_tally(_fetches(corpus))


def _extract_roster(corpus: Corpus) -> DataFrame:
    titles = corpus.title_ids()
    raw = titles.withColumn("raw", F.lit(True))
    done = titles.filter(~ids.in_year(F.col("title_id"), 2024)).withColumn("parsed", F.lit(True))
    return inventory.extract_roster(raw, done)


@query
def pending_titles(corpus: Corpus) -> DataFrame:
    return inventory.pending(_extract_roster(corpus))


@query
def extract_outcomes(corpus: Corpus) -> DataFrame:
    # The edition after the last one is on file but gives no sections: it couldn't be read.
    roster_rows = _extract_roster(corpus)
    unread = roster_rows.select(
        F.concat(ids.bare_title_id(F.col("title_id")), F.lit("-2025")).alias("title_id"),
        F.lit(True).alias("raw"),
        F.lit(False).alias("parsed"),
    ).distinct()
    counts = _sections(corpus).groupBy("title_id").agg(F.count(F.lit(1)).alias("lines"))
    return inventory.extract_outcomes(roster_rows.unionByName(unread), counts)


# Extraction from markup files.


def _records(corpus: Corpus, elements: DataFrame) -> DataFrame:
    """Write elements as gzipped title files and scan them as extraction does."""
    path = tables.shared_folder(corpus.spark)
    tables.write_text(elements, path)
    return source.scan_records(
        corpus.spark, path, title_pattern="title_id=([^/]+)/", ignore_corrupt=False
    )


@query
def extract_parts(corpus: Corpus) -> DataFrame:
    authority = F.concat(
        F.lit("<AUTH>"), markup.escape(F.col("part_authority")), F.lit("</AUTH>")
    )
    element = F.concat(
        F.lit('<DIV5 N="'),
        F.regexp_extract("part_id", "([0-9])$", 1),
        F.lit('" TYPE="PART"><HEAD>'),
        markup.escape(F.col("part_heading")),
        F.lit("</HEAD>"),
        F.coalesce(authority, F.lit("")),
        F.lit("</DIV5>"),
    )
    raw = corpus.raw_parts().select("title_id", element.alias("value"))
    return source.extract_parts(_records(corpus, raw))


@query
def extract_sections(corpus: Corpus) -> DataFrame:
    level = F.when(F.col("div_type") == "SECTION", "8").otherwise("9")
    element = F.concat(
        F.lit('<DIV5 N="1" TYPE="PART"><HEAD>h</HEAD><DIV'),
        level,
        F.lit(' TYPE="'),
        F.col("div_type"),
        F.lit('" N="'),
        markup.escape(F.col("div_n")),
        F.lit('"><P>'),
        markup.escape(F.col("section_text")),
        F.lit("</P></DIV"),
        level,
        F.lit("></DIV5>"),
    )
    raw = corpus.divisions().select("title_id", element.alias("value"))
    return source.extract_sections(_records(corpus, raw))


@query
def page_title_text(corpus: Corpus) -> DataFrame:
    title = markup.element_text(markup.first_element(F.col("html"), "title"))
    return corpus.table("pages").select("page_id", title.alias("title_text"))


# Identifiers and texts.


@query
def normalize_sections(corpus: Corpus) -> DataFrame:
    return _sections(corpus).select("doc_id", "title_id", *IDS)


@query
def normalize_sections_repaired(corpus: Corpus) -> DataFrame:
    return _sections(corpus, repaired=True).select("doc_id", "title_id", *IDS)


@query
def normalize_appendices(corpus: Corpus) -> DataFrame:
    return sections.appendices(_sections(corpus)).select("doc_id", "title_id", *IDS)


@query
def ordered_sections(corpus: Corpus) -> DataFrame:
    return sections.in_reading_order(_sections(corpus).select("title_id", *IDS))


@query
def compile_parts(corpus: Corpus) -> DataFrame:
    return _parts(corpus)


@query
def roundtrip_parquet(corpus: Corpus) -> DataFrame:
    path = tables.shared_folder(corpus.spark)
    tables.write_titles(_hashed(corpus).drop("section_text"), path)
    stored = corpus.spark.read.schema(
        "doc_id bigint, section_name string, section_type string, part_id string, "
        "section_id string, section_hash string, title_id string"
    ).parquet(path)
    return stored


@query
def section_hash(corpus: Corpus) -> DataFrame:
    return corpus.divisions().select(
        "doc_id", text.content_hash(F.col("section_text")).alias("section_hash")
    )


def _headed(corpus: Corpus, regex_names: bool) -> DataFrame:
    headed = sections.normalize(corpus.headed().drop("div_type", "div_n"))
    return sections.clean(headed, regex_names).select(
        "doc_id",
        text.display_name(F.col("section_type"), F.col("section_name")).alias("section_name"),
        "section_text",
    )


@query
def clean_section_text(corpus: Corpus) -> DataFrame:
    return _headed(corpus, regex_names=False)


@query
def clean_section_text_regex(corpus: Corpus) -> DataFrame:
    return _headed(corpus, regex_names=True)


@query
def section_word_count(corpus: Corpus) -> DataFrame:
    return _cleaned(corpus).select("doc_id", "section_word_count")


@query
def clean_authority(corpus: Corpus) -> DataFrame:
    return sections.clean_parts(_parts(corpus)).select("title_id", "part_id", "part_authority")


@query
def authority_count(corpus: Corpus) -> DataFrame:
    return sections.clean_parts(_parts(corpus)).select("title_id", "part_id", "authority_count")


@query
def split_title_year(corpus: Corpus) -> DataFrame:
    return sections.split_year(corpus.divisions().select("doc_id", "title_id"))


@query
def focal_counts(corpus: Corpus) -> DataFrame:
    return sections.edition_counts(_sections(corpus), _parts(corpus))


# Vectors.


@query
def quantize_half(corpus: Corpus) -> DataFrame:
    return corpus.table("embeddings").select(
        "vec_id",
        F.posexplode(vectors.quantize_half(F.col("embedding"))).alias("place", "half_value"),
    ).withColumn("half_value", F.col("half_value").cast("double"))


@query
def embed_sections(corpus: Corpus) -> DataFrame:
    embedded = embedding.bag_of_words(embedding.focal_texts(_hashed(corpus)))
    return (
        embedded.select("section_hash", F.posexplode("section_embedding").alias("place", "weight"))
        .filter(F.col("weight") != 0.0)
        .withColumn("weight", F.round("weight", 6))
    )


def _shown(propagated: DataFrame) -> DataFrame:
    vector = F.col("section_embedding")
    return propagated.select(
        "doc_id",
        *SECTION,
        "section_hash",
        vector.isNotNull().alias("embedded"),
        F.round(vectors.dot(vector, vector), 6).alias("squared_length"),
        *(["copies"] if "copies" in propagated.columns else []),
    )


@query
def propagate_embeddings(corpus: Corpus) -> DataFrame:
    facts = _facts(corpus, words=False)
    return _shown(embedding.propagate(facts, _embedded(corpus, facts)))


@query
def propagate_embeddings_copies(corpus: Corpus) -> DataFrame:
    facts = _facts(corpus, words=False)
    return _shown(embedding.propagate(facts, _embedded(corpus, facts), multiplicity=True))


def _centroids(corpus: Corpus) -> DataFrame:
    facts = _facts(corpus, words=False)
    return embedding.part_centroids(facts, _embedded(corpus, facts))


@query
def part_centroid(corpus: Corpus) -> DataFrame:
    means = F.posexplode("part_embedding").alias("place", "mean")
    centroids = _centroids(corpus).select("title_id", "part_id", means)
    return centroids.withColumn("mean", F.round("mean", 6))


@query
def part_centroid_join(corpus: Corpus) -> DataFrame:
    joined = embedding.join_centroids(_parts(corpus), _centroids(corpus))
    return joined.select(
        "title_id",
        "part_id",
        "part_heading",
        F.col("part_embedding").isNotNull().alias("averaged"),
        F.round(vectors.norm(F.col("part_embedding")), 6).alias("part_norm"),
    )


@query
def section_deviance(corpus: Corpus) -> DataFrame:
    return _scored(corpus, words=False).select("doc_id", *SECTION, "section_hash", "section_deviance")


# Notable sections.


@query
def attach_text_counts(corpus: Corpus) -> DataFrame:
    facts = _facts(corpus)
    counted = deviance.attach_text_counts(facts, facts)
    return counted.select("doc_id", *SECTION, "text_rows", "joined_words")


@query
def least_deviant(corpus: Corpus) -> DataFrame:
    return deviance.least_deviant(_scored(corpus, words=False), 3).select(
        *SECTION, "section_hash", "section_deviance", "deviance_rank"
    )


@query
def most_deviant(corpus: Corpus) -> DataFrame:
    return deviance.most_deviant(_scored(corpus, words=False), 3).select(
        *SECTION, "section_hash", "section_deviance", "deviance_rank"
    )


@query
def labelled_sections(corpus: Corpus) -> DataFrame:
    columns = ["doc_id", *SECTION, "section_name", "section_hash", "section_deviance"]
    return deviance.label_sections(tables.settle(_scored(corpus, words=False).select(*columns)), 3)


def _notable(corpus: Corpus, n: int, fan_out: bool) -> DataFrame:
    notable = deviance.notable_sections(
        tables.settle(_scored(corpus, words=False)), _hashed(corpus), n, fan_out, keep=tables.settle
    )
    return deviance.focal_notable(notable)


@query
def notable_sections(corpus: Corpus) -> DataFrame:
    return _notable(corpus, 1, fan_out=True)


@query
def notable_sections_three(corpus: Corpus) -> DataFrame:
    return _notable(corpus, 3, fan_out=True)


@query
def notable_sections_own_text(corpus: Corpus) -> DataFrame:
    return _notable(corpus, 3, fan_out=False)


# Part statistics.


@query
def part_deviance(corpus: Corpus) -> DataFrame:
    return parts.part_aggregates(_scored(corpus)).select(
        "title_id", "part_id", "deviance_mean", "section_count"
    )


@query
def part_word_count(corpus: Corpus) -> DataFrame:
    return parts.part_aggregates(_scored(corpus)).select("title_id", "part_id", "part_word_count")


@query
def focal_year_match(corpus: Corpus) -> DataFrame:
    return parts.part_aggregates(_scored(corpus)).select("title_id", "part_id", "focal_year_match")


@query
def part_statistics(corpus: Corpus) -> DataFrame:
    return _statistics(corpus)


@query
def part_statistics_own_text(corpus: Corpus) -> DataFrame:
    return _statistics(corpus, fan_out=False)


@query
def part_statistics_copies(corpus: Corpus) -> DataFrame:
    return _statistics(corpus, multiplicity=True)


@query
def part_focal(corpus: Corpus) -> DataFrame:
    return parts.part_focal(_statistics(corpus))


@query
def part_temporal(corpus: Corpus) -> DataFrame:
    return _temporal(corpus)


# Panels and the part browser.


@query
def panel_sections(corpus: Corpus) -> DataFrame:
    return panels.panel(_temporal(corpus), "section_count", YEARS)


@query
def panel_authorities(corpus: Corpus) -> DataFrame:
    return panels.panel(_temporal(corpus), "authority_count", YEARS)


@query
def panel_words(corpus: Corpus) -> DataFrame:
    return panels.panel(_temporal(corpus), "part_word_count", YEARS)


@query
def panel_match(corpus: Corpus) -> DataFrame:
    return panels.panel(_temporal(corpus), "focal_year_match", YEARS)


@query
def title_median_deviance(corpus: Corpus) -> DataFrame:
    return panels.title_medians(_focal(corpus)).withColumn(
        "median_deviance", F.round("median_deviance", 9)
    )


@query
def noteworthy_part(corpus: Corpus) -> DataFrame:
    return panels.noteworthy_part(_focal(corpus))


@query
def focal_display_scores(corpus: Corpus) -> DataFrame:
    return panels.display_scores(_focal(corpus)).select("title_id", "part_id", "deviance_mean")


def _browser(corpus: Corpus) -> DataFrame:
    return panels.with_title_names(panels.display_scores(_focal(corpus)), corpus.titles())


@query
def enrich_titles(corpus: Corpus) -> DataFrame:
    return _browser(corpus)


@query
def part_lookup(corpus: Corpus) -> DataFrame:
    return panels.part_lookup(_browser(corpus), TITLE, PART)


@query
def dropdown_options(corpus: Corpus) -> DataFrame:
    focal = _focal(corpus)
    titles = panels.dropdown_options(focal, "title_id")
    chosen = panels.dropdown_options(focal, "part_id", ("title_id", TITLE))
    return titles.unionByName(chosen)


@query
def deviance_distribution(corpus: Corpus) -> DataFrame:
    return panels.deviance_distribution(_focal(corpus), TITLE, PART)
