"""Embedding each distinct text once, and averaging the vectors of a part."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift import fixed_values as fv
from corpusdrift.functions import ids, vectors
from corpusdrift.operators.joins import HOT_ROWS, join_one
from corpusdrift.operators.sections import PART_KEY

Encoder = Callable[[list[str]], np.ndarray]


def focal_texts(sections: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Each distinct text of one edition, with its hash.

    Copies are dropped before the shuffle and again after it, so a text that
    makes up much of the edition costs no more than any other.
    """
    return (
        sections.filter(ids.in_year(F.col("title_id"), year))
        .select("section_hash", "section_text")
        .dropDuplicates(["section_hash"])
    )


def unstored_texts(
    sections: DataFrame,
    facts: DataFrame,
    stored: DataFrame,
    year: int = fv.FOCAL_YEAR,
    keep: Callable[[DataFrame], DataFrame] = lambda table: table,
) -> DataFrame | None:
    """One edition's distinct texts, with their hash, of which no vector is stored; None if there are none.

    ``facts`` has the same rows as ``sections`` without the text: which texts are missing is found there, and only
    these are read, so nothing is read if all are stored.  ``keep`` stores the list of missing hashes.
    """
    focal = facts.filter(ids.in_year(F.col("title_id"), year)).select("section_hash").distinct()
    missing = keep(focal.join(stored.select("section_hash"), "section_hash", "left_anti"))
    if missing.isEmpty():
        return None
    return focal_texts(sections.join(missing, "section_hash", "left_semi"), year)


def bag_of_words(texts: DataFrame, size: int = 64) -> DataFrame:
    """Default encoder: hashed word counts, scaled to length one.

    A word's place is given by the first 32 bits of its MD5.  The input is spread
    by hash once; both groupings below then find their rows in place.  No text
    yields more than ``size`` buckets, which bounds what is gathered per text.
    """
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % size
    counts = (
        texts.repartition("section_hash")
        .select("section_hash", F.explode(F.split("section_text", fv.BLANKS)).alias("word"))
        .select("section_hash", bucket.alias("bucket"))
        .groupBy("section_hash", "bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("words"))
    )
    by_bucket = F.map_from_entries(F.collect_list(F.struct("bucket", "words")))
    scale = F.sqrt(F.sum(F.col("words") * F.col("words")))
    return (
        counts.groupBy("section_hash")
        .agg(by_bucket.alias("filled"), scale.alias("scale"))
        .select(
            "section_hash",
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")),
                lambda i: F.coalesce(F.col("filled")[i], F.lit(0.0)) / F.col("scale"),
            ).alias("section_embedding"),
        )
    )


#: Texts, and characters of texts, that a task sorts by length before it cuts them into batches.
BUFFER_TEXTS, BUFFER_LENGTH = 4_096, 32_000_000
#: Characters of a batch, as if all its texts were as long as the longest.
BATCH_LENGTH = 262_144


def length_batches(lengths: list[int], most: int, length: int = BATCH_LENGTH) -> Iterator[list[int]]:
    """Places of texts in batches of similar length: at most ``most`` of them, or of ``length`` characters when padded.

    A longer text is a batch by itself.
    """
    part: list[int] = []
    for place in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if part and (len(part) == most or (len(part) + 1) * lengths[place] > length):
            yield part
            part = []
        part.append(place)
    if part:
        yield part


def encode(
    texts: DataFrame, load_encoder: Callable[[], Encoder], batch: int = fv.ENCODER_BATCH
) -> DataFrame:
    """Embed texts with any model: ``load_encoder`` runs once per task and returns
    a function from a list of whole texts to a matrix with one row per text.

    A model pads a batch to its longest text, so every task sorts some texts by length and batches similar ones.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        held: list[tuple[str, str]] = []
        size = 0

        def encoded() -> Iterator[pd.DataFrame]:
            for places in length_batches([len(text) for _, text in held], batch):
                matrix = np.asarray(encoder([held[i][1] for i in places]), dtype=np.float64)
                yield pd.DataFrame({"section_hash": [held[i][0] for i in places], "section_embedding": list(matrix)})

        for frame in frames:
            for key, text in zip(frame["section_hash"].tolist(), frame["section_text"].tolist(), strict=True):
                held.append((key, text))
                size += len(text)
                if len(held) >= BUFFER_TEXTS or size >= BUFFER_LENGTH:
                    yield from encoded()
                    held, size = [], 0
        yield from encoded()

    return texts.select("section_hash", "section_text").mapInPandas(
        run, "section_hash string, section_embedding array<double>"
    )


def at_half_precision(embedded: DataFrame) -> DataFrame:
    """Vectors as they are kept: rounded to half precision, one row per text."""
    return embedded.withColumn(
        "section_embedding", vectors.quantize_half(F.col("section_embedding"))
    )


def propagate(
    sections: DataFrame,
    embedded: DataFrame,
    multiplicity: bool = False,
    year: int = fv.FOCAL_YEAR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every section, of any edition, the vector of its text if the focal edition has it.

    One row per section.  ``multiplicity=True`` adds ``copies``, the number of
    focal sections with the same text: a join to one vector per focal section,
    rather than per text, would return each row that many times.
    """
    right = embedded
    if multiplicity:
        copies = (
            sections.filter(ids.in_year(F.col("title_id"), year))
            .groupBy("section_hash")
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        right = embedded.join(copies, "section_hash", "left")
    kept = sections.drop("section_text")
    joined = join_one(kept, right, ["section_hash"], hot_rows=hot_rows)
    if multiplicity:
        joined = joined.withColumn("copies", F.coalesce("copies", F.lit(1)))
    return joined


def focal_pairs(sections: DataFrame, year: int = fv.FOCAL_YEAR) -> DataFrame:
    """Distinct texts per part of one edition, with how many sections have each."""
    return (
        sections.filter(ids.in_year(F.col("title_id"), year))
        .groupBy(*PART_KEY, "section_hash")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def embedded_pairs(
    sections: DataFrame,
    embedded: DataFrame,
    year: int = fv.FOCAL_YEAR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Focal pairs with the vector of their text.

    One text may stand in every part, so hashes with many pairs are dealt out.
    """
    vectors_of_texts = embedded.select("section_hash", "section_embedding")
    return join_one(
        focal_pairs(sections, year), vectors_of_texts, ["section_hash"], "inner", hot_rows
    )


def part_centroids(
    sections: DataFrame, embedded: DataFrame, year: int = fv.FOCAL_YEAR
) -> DataFrame:
    """Mean vector of the sections of each part of one edition.

    Sections with equal text enter once, weighted by their number, so vectors are
    joined to texts rather than to rows; each task averages its share of a part
    before the shuffle.
    """
    return centroids_of_pairs(embedded_pairs(sections, embedded, year))


def centroids_of_pairs(pairs: DataFrame) -> DataFrame:
    """Weighted mean of ``section_embedding`` per part, weights ``copies``; exact, so task order doesn't matter."""
    return vectors.exact_means(pairs, PART_KEY, "section_embedding", "copies").withColumnRenamed("mean", "part_embedding")


def join_centroids(parts: DataFrame, centroids: DataFrame) -> DataFrame:
    """Parts with their mean vector; NULL outside the focal edition."""
    return parts.join(centroids, PART_KEY, "left")
