"""A corpus made from the generic tables: divisions, parts, vectors and titles.

``documents`` become divisions of three titles in three yearly editions, with
the awkward identifiers a real corpus has; ``embeddings`` become the vectors of
the focal edition's texts.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift.functions import ids

YEARS = ["2022", "2023", "2024"]


class Corpus:
    """The fixture tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _numbered(self) -> DataFrame:
        return self.table("documents").withColumn(
            "p", F.floor(F.col("doc_id") / 3).cast("bigint") % 7
        )

    @staticmethod
    def _title_id() -> Column:
        number = F.substring("source", 4, 10).cast("int") % 3 + 1
        year = F.lit(2022) + F.col("doc_id") % 3
        return F.format_string("Title-%02d-%d", number, year)

    def divisions(self) -> DataFrame:
        """``doc_id, title_id, div_type, div_n, raw_id, section_text``."""
        doc, part = F.col("doc_id"), F.col("p").cast("string")
        kind = (
            F.when(doc % 101 == 7, "NOTE")
            .when((doc % 11 == 0) | (doc % 19 == 0), "APPENDIX")
            .otherwise("SECTION")
        )
        number = (
            F.when(doc % 11 == 0, F.concat(F.lit("Appendix A to Part "), part))
            .when(doc % 19 == 0, F.concat(F.lit("Appendixes B to C to Subpart A of Part "), part))
            .when(doc % 13 == 0, doc.cast("string"))
            .when(doc % 17 == 0, F.concat(part, F.lit("."), doc.cast("string"), F.lit("(a)-1")))
            .otherwise(F.concat(part, F.lit("."), (doc * 37).cast("string")))
        )
        return self._numbered().select(
            "doc_id",
            self._title_id().alias("title_id"),
            kind.alias("div_type"),
            number.alias("div_n"),
            F.concat(kind, F.lit("-"), number).alias("raw_id"),
            F.col("text").alias("section_text"),
        )

    def raw_parts(self) -> DataFrame:
        """``title_id, part_id, part_heading, part_authority`` as extraction would give them."""
        p = F.col("p")
        reserved = F.when(p == 3, " [RESERVED]").otherwise(" - RULES")
        authority = F.concat(
            F.lit("\n Authority: 1 U.S.C. 1"),
            F.repeat(F.lit(", 5 U.S.C. 2"), p.cast("int")),
            F.lit(", and sec. 6. \n"),
        )
        return (
            self._numbered()
            .select(self._title_id().alias("title_id"), "p")
            .distinct()
            .select(
                "title_id",
                F.concat(F.lit("PART-"), F.lpad(p.cast("string"), 4, "0")).alias("part_id"),
                F.concat(F.lit("PART "), p.cast("string"), reserved).alias("part_heading"),
                F.when(p != 5, authority).alias("part_authority"),
            )
        )

    def vectors(self, sections: DataFrame) -> DataFrame:
        """``section_hash, section_embedding``: one vector per distinct focal text of ``sections``."""
        focal = sections.filter(ids.in_year(F.col("title_id"), 2024))
        count = self.table("embeddings").agg(F.count(F.lit(1))).scalar()
        keys = focal.groupBy("section_hash").agg(F.min("doc_id").alias("first_id"))
        keys = keys.select("section_hash", (F.col("first_id") % count).alias("vec_id"))
        stored = self.table("embeddings").select(
            "vec_id", F.col("embedding").alias("section_embedding")
        )
        return keys.join(stored, "vec_id").select("section_hash", "section_embedding")

    def headed(self) -> DataFrame:
        """Divisions whose text begins with their own name."""
        heading = F.concat(
            F.lit("\n § "), F.col("div_n"), F.lit(" Heading. \n"), F.col("section_text")
        )
        return self.divisions().withColumn("section_text", heading)

    def title_ids(self) -> DataFrame:
        """The distinct title-years."""
        return self._numbered().select(self._title_id().alias("title_id")).distinct()

    def titles(self) -> DataFrame:
        """The titles dimension."""
        number = F.substring("title_id", 7, 2).cast("int")
        return (
            self.title_ids()
            .select(ids.bare_title_id(F.col("title_id")).alias("title_id"))
            .distinct()
            .select(
                "title_id",
                F.concat(F.lit("Rules "), number.cast("string")).alias("title_name"),
                number.alias("title_num"),
                F.format_string("Title %d - Rules %d", number, number).alias("title_name_full"),
            )
        )
