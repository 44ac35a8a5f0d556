"""Tables of one run that appear together or not at all.

A run writes every table to a folder of its own version, ``root/<table>/version=<v>``, which nobody reads
yet.  At its end one small file, a manifest, names the folders of all tables, new and old; it gets its name
by one rename, which fails if another run has taken the number meanwhile.  Readers take the manifest
with the largest number.  A run that breaks off leaves folders that no manifest names.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpusdrift.sources import tables

MANIFESTS = "_manifests"
_PARTITION = "title_id"


class Conflict(RuntimeError):
    """Another run published meanwhile."""


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[str]:
    place, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _remove(spark: SparkSession, folder: str) -> None:
    place, files = _path(spark, folder)
    files.delete(place, True)


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The newest manifest, or the one with this number: ``number`` and ``tables``; of no run, empty."""
    found = [int(name.removesuffix(".json")) for name in _children(spark, f"{root}/{MANIFESTS}") if name.endswith(".json")]
    if number is None:
        number = max(found, default=0)
    if number == 0:
        return {"number": 0, "tables": {}}
    place, files = _path(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, root: str, content: dict) -> None:
    """Write a manifest under another name, then give it its own, unless that is taken."""
    folder, jvm = f"{root}/{MANIFESTS}", spark._jvm
    hidden, files = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = files.create(hidden, False)
    stream.write(bytearray(json.dumps(content, indent=1, sort_keys=True).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, "NONE")
    target = _path(spark, f"{folder}/{content['number']:012d}.json")[0]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(hidden), files.makeQualified(target), options)
    except Exception as error:
        files.delete(hidden, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"manifest {content['number']} of {root} is there already") from error
        raise


@dataclass
class Publication:
    """The tables that a run is about to publish.  Used as a context: they appear at its end, unless it raises."""

    spark: SparkSession
    root: str
    before: dict
    version: str
    new: dict = field(default_factory=dict)

    def __enter__(self) -> "Publication":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()
        else:
            self.abandon()

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}/version={self.version}"

    def write(self, name: str, table: DataFrame, fmt: str = "parquet", **more: object) -> None:
        """A whole table, in place of what it was before; ``more`` is kept in the manifest."""
        tables.export_table(table, self.folder(name), fmt)
        self.new[name] = {"folders": [self.folder(name)], "format": fmt, **more}

    def append(self, name: str, table: DataFrame, **more: object) -> None:
        """More rows for a table, whose folders stay as they are."""
        tables.export_table(table, self.folder(name))
        folders = self.before["tables"].get(name, {"folders": []})["folders"]
        self.new[name] = {"folders": [*folders, self.folder(name)], "format": "parquet", **more}

    def write_titles(self, name: str, table: DataFrame) -> None:
        """Some titles of a table, in place of what these were before; the others stay."""
        tables.write_titles(table, self.folder(name))
        titles = dict(self.before["tables"].get(name, {}).get("titles", {}))
        # One folder for each title and year.
        for child in _children(self.spark, self.folder(name)):
            if child.startswith(f"{_PARTITION}="):
                titles[child] = f"{self.folder(name)}/{child}"
        self.new[name] = {"titles": titles, "format": "parquet"}

    def read(self, name: str, schema: str) -> DataFrame:
        """A table as it will be when this is published."""
        return _read(self.spark, self.root, name, schema, self.before["tables"] | self.new)

    def commit(self) -> int:
        content = {"number": self.before["number"] + 1, "tables": self.before["tables"] | self.new}
        _put(self.spark, self.root, content)
        return content["number"]

    def abandon(self) -> None:
        for name in self.new:
            _remove(self.spark, self.folder(name))


def begin(spark: SparkSession, root: str) -> Publication:
    """A publication on top of what is published now."""
    before = manifest(spark, root)
    return Publication(spark, root, before, f"{before['number'] + 1}-{uuid.uuid4().hex}")


def _read(spark: SparkSession, root: str, name: str, schema: str, known: dict) -> DataFrame:
    entry = known.get(name)
    if entry is None:  # written without a manifest
        return tables.read_table(spark, f"{root}/{name}", schema)
    folders = [*entry["titles"].values()] if "titles" in entry else entry["folders"]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{root}/{name}")
    if entry["format"] == "csv":
        reader = reader.options(**tables.CSV, mode="FAILFAST")
    return reader.format(entry["format"]).load(folders).select(*StructType.fromDDL(schema).names)


def read(spark: SparkSession, root: str, name: str, schema: str, number: int | None = None) -> DataFrame:
    """A published table, of the newest manifest or the one with this number.

    A table that no manifest names is read from ``root/<name>``.
    """
    return _read(spark, root, name, schema, manifest(spark, root, number)["tables"])


def read_or_none(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """As :func:`read`; no rows if there is no such table yet."""
    try:
        return read(spark, root, name, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def entry(spark: SparkSession, root: str, name: str) -> dict:
    """What the newest manifest says of a table."""
    return manifest(spark, root)["tables"].get(name, {})


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the manifests before the last ``keep``, and the folders that none of these names.

    Only for times at which no run is writing: the folders of a run are not named before its end.
    """
    numbers = [name for name in _children(spark, f"{root}/{MANIFESTS}") if name.endswith(".json")]
    kept = [manifest(spark, root, int(name.removesuffix(".json"))) for name in numbers[-keep:]]
    named, names = set(), set()
    for content in kept:
        for name, found in content["tables"].items():
            names.add(name)
            named |= {f.rsplit(f"/{_PARTITION}=")[0] for f in [*found.get("titles", {}).values(), *found.get("folders", [])]}
    removed = []
    for name in sorted(names):
        for child in _children(spark, f"{root}/{name}"):
            if child.startswith("version=") and f"{root}/{name}/{child}" not in named:
                _remove(spark, f"{root}/{name}/{child}")
                removed.append(f"{name}/{child}")
    for name in numbers[:-keep]:
        _remove(spark, f"{root}/{MANIFESTS}/{name}")
    return removed
