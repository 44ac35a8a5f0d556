"""Stage tables and exports."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


SCRATCH = "_scratch"
#: How csv files are read; all fields are parsed, also those that nobody asks for, so that faults don't depend on the query.
CSV = {"header": True, "multiLine": True, "escape": '"', "columnPruning": False}


def shared_folder(spark: SparkSession, root: str | None = None) -> str:
    """A fresh path for a table that later steps read.

    It lies under ``root``, from where :func:`clear_scratch` removes it, or else in the folder that the
    cluster shares for cut lineages, or, if none is named, in the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/{SCRATCH}" if root else shared
    return f"{folder.rstrip('/')}/corpusdrift-{uuid.uuid4().hex}"


def settle(table: DataFrame, root: str | None = None) -> DataFrame:
    """Write a table to scratch and read it back.

    For tables that several later steps read: they are computed once, their
    lineage ends here, and each reader scans only the columns it needs.
    """
    path = shared_folder(table.sparkSession, root)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def clear_scratch(spark: SparkSession, root: str) -> None:
    """Remove what a stage has settled under ``root``, at the end of the stage."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{SCRATCH}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_titles(table: DataFrame, path: str) -> None:
    """Write one partition folder per title, replacing only the titles at hand.

    The rebalance hint gathers a title's rows in few files and splits titles that
    are much larger than the rest over several tasks.
    """
    (
        table.hint("rebalance", F.col("title_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("title_id")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read with a declared schema, columns in its order; csv files are expected to have a header.

    A csv row that doesn't fit the schema is an error; :func:`read_checked` sets such rows aside.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV, mode="FAILFAST")
    return reader.format(fmt).load(path).select(*StructType.fromDDL(schema).names)


REJECTS = "file string, reason string, record string"


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of csv files that fit the schema, and the others as ``file, reason, record``.

    Every row is in one of the two.  A row doesn't fit if a field isn't of its column's type, or if it has too few
    or too many fields; ``reason`` names all faulty fields, ``record`` has the row as it stands in the file where the
    number of fields is wrong, else its fields as JSON.  Empty fields are missing values and fit.
    """
    fields = StructType.fromDDL(schema).fields
    texts = StructType([StructField(f.name, StringType()) for f in fields]).add(_RECORD, StringType())
    read = spark.read.schema(texts).options(**CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD).csv(path)
    faults = [F.when(F.col(_RECORD).isNotNull(), F.lit("wrong number of fields"))]
    typed = []
    for f in fields:
        value = F.col(f"`{f.name}`").try_cast(f.dataType)
        typed.append(value.alias(f.name))
        kind = f.dataType.simpleString()
        fault = F.concat(F.lit(f"{f.name}: '"), F.col(f"`{f.name}`"), F.lit(f"' is no {kind}"))
        faults.append(F.when(F.col(f"`{f.name}`").isNotNull() & value.isNull(), fault))
    reason = F.concat_ws("; ", *faults)
    found = read.select("*", reason.alias(_REASON), F.col("_metadata.file_path").alias(_FILE))
    fields_of = F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in fields)))
    rejects = found.filter(F.col(_REASON) != "").select(
        F.col(_FILE).alias("file"), F.col(_REASON).alias("reason"), F.coalesce(_RECORD, fields_of).alias("record")
    )
    return found.filter(F.col(_REASON) == "").select(*typed), rejects


_RECORD, _REASON, _FILE = "__record", "__reason", "__file"


def export_table(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table as parquet or as csv with a header; texts keep their blanks."""
    writer = table.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.format(fmt).save(path)


def write_text(lines: DataFrame, path: str, partition_by: str = "title_id") -> None:
    """Write a ``value`` column as gzipped text, one folder per partition value."""
    (
        lines.select(partition_by, "value")
        .hint("rebalance", F.col(partition_by))
        .write.mode("overwrite")
        .option("compression", "gzip")
        .partitionBy(partition_by)
        .text(path)
    )
