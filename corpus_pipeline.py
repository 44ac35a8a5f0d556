"""Documents through the filters of ``corpusdrift.llm`` to token ids.

Each stage takes the rows that the one before kept, with the columns of ``documents``, and its
decisions take effect; the last one returns what encoding gives.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift.llm import bpe, decontaminate, near_duplicates, shared, substring_dedup, toxicity
from corpusdrift.llm.queries import VOCABULARY, toxic_training

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that go to Python at once: Spark's usual number, and that of stages whose rows hold whole texts.  A task holds
#: a batch several times over outside its heap, as Arrow vectors, as bytes to send and in Python.
ROWS, TEXTS = 10_000, 2_000


def _at_once(spark: SparkSession, rows: int) -> None:
    """Holds for what is run from now on, until the next stage says otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the other columns as one, so that no operator's column has the name of one of them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).alias("none")]).alias("other"))


def _unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns as they were, in their order, but for those that are given."""
    own = {c: F.col(c) for c in ("doc_id", "text")} | changed
    return rows.select(*(own.get(c, F.col("other").getField(c)).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go."""
    _at_once(spark, TEXTS)
    net = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"), toxic_training())
    scored = toxicity.score_documents(_packed(docs), net, F.col("text").alias("whole_text"), "other")
    return _unpacked(scored.where("predicted = 0"), docs.columns, text=F.col("whole_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    _at_once(spark, TEXTS)
    gone = near_duplicates.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages go, and with them documents of which nothing is left.

    Texts without a repeated passage stay as they are.
    """
    _at_once(spark, ROWS)
    found = substring_dedup.remove_repeats(_packed(docs), keep=["other"], as_given=True)
    found = found.where("n_removed < n_words or n_removed = 0")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        size = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(F.col("other.n_chars"))
    return _unpacked(found, docs.columns, **changed)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    _at_once(spark, ROWS)
    return decontaminate.without_leaks(docs, shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding of what is left, checked by decoding it."""
    _at_once(spark, TEXTS)
    return bpe.encode_documents(docs, shared.tokenizer_file(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else shared.written(docs), sf_dir)
    return docs
