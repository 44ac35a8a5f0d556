"""The stages of the pipeline, each from stored tables to stored tables.

Every stage reads its input once, writes narrow tables, and leaves the rest to
Spark; what a later stage needs more than once is on disk by then, so a lost
executor costs the tasks it ran and nothing else.  Stages run jobs; the operators
they are made of only build plans.

Tables under ``root``: ``section``, ``part``, ``rejects`` and ``parsed`` (extraction),
``section_facts``, ``text_embedding``, ``embedded_part`` and ``embedding_run`` (embedding),
``section_scores``, ``notable_sections``, ``part_data_focal`` and ``part_data_temporal`` (results).
All tables of a stage are published together (:mod:`corpusdrift.sources.publication`), so a stage that breaks off leaves
the tables of before.  While a stage runs its scratch tables lie there too; it removes them at its end.
"""

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.operators import deviance, embedding, panels, parts, sections, sketch
from corpusdrift.sources import inventory, markup, publication, roster, schemas, tables

SECTION_FACTS = (
    "section_name string, section_type string, part_id string, section_id string, "
    "section_hash string, section_word_count bigint, title_id string"
)
TEXT_EMBEDDING = "section_hash string, section_embedding array<float>"
EMBEDDING_RUN = "year int, regex_names boolean"
SECTION_SCORES = (
    SECTION_FACTS
    + ", section_deviance double, copies bigint, focal_year_match int, notable_deviant string"
)


def title_roster(
    spark: SparkSession,
    raw_folder: str,
    years: tuple[int, int] | None = None,
    titles: tuple[int, int] | None = None,
    this_year: int | None = None,
) -> dict[str, DataFrame]:
    """Which title files there should be, which are present, and how many of each."""
    bounds = roster.corpus_bounds(spark, years, titles, this_year)
    present = inventory.inventory(spark, raw_folder).select("title_id")
    found = roster.title_roster(bounds, present, raw_folder)
    return {"roster": found, "tally": roster.status_tally(found)}


def extract(
    spark: SparkSession,
    raw_folder: str,
    root: str,
    repaired: bool = False,
    suffix: str = fv.TITLE_FILE_SUFFIX,
) -> DataFrame:
    """Parse the title files that have not been parsed yet; returns the outcome per title.

    The marks of parsed titles are published with their rows, so what a broken run left behind is not seen.
    """
    try:
        return _extract(spark, raw_folder, root, repaired, suffix)
    finally:
        tables.clear_scratch(spark, root)


def _extract(spark: SparkSession, raw_folder: str, root: str, repaired: bool, suffix: str) -> DataFrame:
    raw = inventory.inventory(spark, raw_folder, suffix)
    known = publication.read_or_none(spark, root, "parsed", inventory.PARSED).distinct()
    work = tables.settle(inventory.extract_roster(raw, known), root)
    # One short path per unread file: at most fifty titles for each year.
    paths = [row.path for row in inventory.pending(work).select("path").toLocalIterator()]
    with publication.begin(spark, root) as new:
        if paths:
            records = _read_once(spark, paths, root)
            sound = tables.settle(markup.sound_titles(records), root)
            kept = records.join(sound, "title_id", "left_semi")
            found = sections.normalize(markup.extract_sections(kept), repaired)
            new.write_titles("part", sections.compile_parts(markup.extract_parts(kept)))
            new.write_titles("rejects", markup.rejects(kept))
            new.write_titles("section", found)
            lines = markup.extract_sections(kept).groupBy("title_id").agg(F.count(F.lit(1)).alias("counted"))
            counts = lines.join(sound, "title_id", "right").select(
                "title_id", F.coalesce("counted", F.lit(0)).alias("lines")
            )
        else:
            counts = spark.createDataFrame([], "title_id string, lines bigint")
        outcome = inventory.extract_outcomes(work, counts).drop("path", "length")
        # A row for each title file; small enough to return as values, so scratch can go.
        done = spark.createDataFrame(outcome.collect(), outcome.schema)
        fresh = done.filter("parsed and new_lines >= 0").select("title_id", "parsed")
        new.append("parsed", fresh.join(known, "title_id", "left_anti").coalesce(1))
    return done


def _read_once(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Records of the files, stored so that all later work is spread over all executors."""
    path = tables.shared_folder(spark, root)
    markup.scan_records(markup.unsplit_session(spark), paths).write.parquet(path)
    return spark.read.schema(markup.RECORDS).parquet(path)


def read_sections(spark: SparkSession, root: str) -> DataFrame:
    return publication.read(spark, root, "section", schemas.PARSED_SECTION)


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    return publication.read(spark, root, "part", schemas.PARSED_PART)


def fingerprint(load_encoder: Callable[[], embedding.Encoder] | None) -> str:
    """What tells encoders apart: the built-in one by its name, others by their code and the values in it."""
    if load_encoder is None:
        return "bag-of-words-64"
    return hashlib.sha256(cloudpickle.dumps(load_encoder)).hexdigest()


def embed(
    spark: SparkSession,
    root: str,
    year: int = fv.FOCAL_YEAR,
    load_encoder: Callable[[], embedding.Encoder] | None = None,
    regex_names: bool = False,
    encoder: str | None = None,
) -> None:
    """Embed the focal edition's distinct texts, and average them per part.

    Without ``load_encoder`` the built-in bag of words stands in for a model.  Vectors are kept by the hash
    of their text and the fingerprint of the encoder, which ``encoder`` may name: only texts without a stored vector
    are encoded.  Another fingerprint starts a store of its own.  The year and ``regex_names`` are
    stored with the vectors; :func:`quantify` takes them from there.
    """
    try:
        _embed(spark, root, year, load_encoder, regex_names, encoder or fingerprint(load_encoder))
    finally:
        tables.clear_scratch(spark, root)


def _embed(spark, root, year, load_encoder, regex_names, encoder) -> None:
    hashed = sections.with_hash(read_sections(spark, root))
    with publication.begin(spark, root) as new:
        new.write_titles("section_facts", sections.clean(hashed, regex_names).drop("section_text"))
        facts = new.read("section_facts", SECTION_FACTS)
        known = new.before["tables"].get("text_embedding", {}).get("encoder") == encoder
        stored = new.read("text_embedding", TEXT_EMBEDDING) if known else spark.createDataFrame([], TEXT_EMBEDDING)
        texts = embedding.unstored_texts(hashed, facts, stored, year, keep=lambda table: tables.settle(table, root))
        if texts is not None or not known:
            if texts is None:
                texts = hashed.select("section_hash", "section_text").where("false")
            vectors = embedding.encode(texts, load_encoder) if load_encoder else embedding.bag_of_words(texts)
            store = new.append if known else new.write
            store("text_embedding", embedding.at_half_precision(vectors), encoder=encoder)
        used = _focal_vectors(facts, new.read("text_embedding", TEXT_EMBEDDING), year)
        centroids = embedding.part_centroids(facts, used, year)
        new.write("embedded_part", embedding.join_centroids(new.read("part", schemas.PARSED_PART), centroids))
        run = spark.createDataFrame([(year, regex_names)], EMBEDDING_RUN)
        new.write("embedding_run", run.coalesce(1))


def _focal_vectors(facts: DataFrame, stored: DataFrame, year: int) -> DataFrame:
    """The stored vectors of the texts that one edition has."""
    focal, _ = deviance.editions(facts, year)
    return stored.join(focal.select("section_hash").distinct(), "section_hash", "left_semi")


def embedding_run(spark: SparkSession, root: str, year: int | None = None) -> tuple[int, bool]:
    """Year and ``regex_names`` of the stored vectors, which must be of ``year`` and complete."""
    run = publication.read(spark, root, "embedding_run", EMBEDDING_RUN).first()
    if year is not None and year != run.year:
        raise ValueError(f"the stored vectors are of {run.year}, not of {year}: embed that year first")
    focal, _ = deviance.editions(read_facts(spark, root), run.year)
    stored = publication.read(spark, root, "text_embedding", TEXT_EMBEDDING)
    bare = focal.select("section_hash").distinct().join(stored.select("section_hash"), "section_hash", "left_anti")
    if not bare.isEmpty():
        raise ValueError(f"texts of {run.year} have no vector: embed again")
    return run.year, run.regex_names


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    return publication.read(spark, root, "section_facts", SECTION_FACTS)


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The vectors of the texts of the embedded edition; the store may hold others too."""
    run = publication.read(spark, root, "embedding_run", EMBEDDING_RUN).first()
    stored = publication.read(spark, root, "text_embedding", TEXT_EMBEDDING)
    return _focal_vectors(read_facts(spark, root), stored, run.year)


def embedded_sections(spark: SparkSession, root: str) -> DataFrame:
    """Every section with the vector of its text, if the focal edition has that text."""
    return embedding.propagate(read_facts(spark, root), read_vectors(spark, root))


def quantify(
    spark: SparkSession,
    root: str,
    year: int | None = None,
    deviants_n: int = fv.DEVIANTS_N,
    fan_out: bool = True,
    multiplicity: bool = False,
    formats: tuple[str, ...] = ("parquet",),
) -> None:
    """Score and label sections, sum up parts, and publish the result tables, all at once.

    The year is that of the stored vectors; another one is an error, and so is a focal text
    without a vector.
    """
    year, regex_names = embedding_run(spark, root, year)
    try:
        with publication.begin(spark, root) as new:
            _quantify(spark, root, new, year, regex_names, deviants_n, fan_out, multiplicity, formats)
    finally:
        tables.clear_scratch(spark, root)


def _quantify(spark, root, new, year, regex_names, deviants_n, fan_out, multiplicity, formats) -> None:
    part_table = read_parts(spark, root)
    facts, vectors = read_facts(spark, root), read_vectors(spark, root)
    # Which texts the focal edition has is told by a small filter, before the other editions' sections are shuffled.
    focal, _ = deviance.editions(facts, year)
    screen = sketch.screen(focal.select("section_hash").distinct(), "section_hash")
    scored = tables.settle(parts.quantify(facts, vectors, part_table, year, multiplicity, screen=screen), root)
    new.write("section_scores", deviance.label_sections(scored, deviants_n))
    notable = deviance.notable_sections(
        scored,
        sections.with_hash(read_sections(spark, root)),
        deviants_n,
        fan_out,
        regex_names,
        keep=lambda table: tables.settle(table, root),
        year=year,
    )
    statistics = tables.settle(
        parts.part_statistics(part_table, parts.part_aggregates(scored, fan_out)), root
    )
    results = {
        "notable_sections": deviance.focal_notable(notable, year),
        "part_data_focal": parts.part_focal(statistics, year),
        "part_data_temporal": parts.part_temporal(statistics, year),
    }
    for name, table in results.items():
        for fmt in formats:
            new.write(name if fmt == "parquet" else f"{name}_{fmt}", table, fmt)


def browse(
    spark: SparkSession,
    root: str,
    titles: DataFrame,
    years: list[str],
    chosen: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the part browser, from the exported results.

    With a ``chosen`` title and part also its details, the parts to choose from, and how the
    title's parts are distributed.
    """
    # All of one manifest, also if another run publishes meanwhile.
    number = publication.manifest(spark, root)["number"]
    focal = publication.read(spark, root, "part_data_focal", schemas.PART_FOCAL, number)
    temporal = publication.read(spark, root, "part_data_temporal", schemas.PART_TEMPORAL, number)
    shown = panels.with_title_names(panels.display_scores(focal), titles)
    details = {} if chosen is None else {
        "lookup": panels.part_lookup(shown, *chosen),
        "parts": panels.dropdown_options(focal, "part_id", ("title_id", chosen[0])),
        "distribution": panels.deviance_distribution(focal, *chosen),
    }
    return details | {
        "titles": panels.dropdown_options(focal, "title_id"),
        "noteworthy": panels.noteworthy_part(focal),
        "focal": shown,
        "notable": publication.read(spark, root, "notable_sections", schemas.NOTABLE_SECTIONS, number),
        "sections": panels.panel(temporal, "section_count", years),
        "authorities": panels.panel(temporal, "authority_count", years),
        "words": panels.panel(temporal, "part_word_count", years),
        "match": panels.panel(temporal, "focal_year_match", years),
    }
