"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from corpusdrift.operators import deviance, embedding, panels, parts, sections
from corpusdrift.sources import tables


def _plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """A stored stage table with one row per section."""
    path = str(tmp_path_factory.mktemp("facts") / "t")
    spark.range(2000).select(
        F.concat(F.lit("Title-01-"), (F.col("id") % 3 + 2022).cast("string")).alias("title_id"),
        F.concat(F.lit("Part-"), (F.col("id") % 5).cast("string")).alias("part_id"),
        F.concat(F.lit("Section-"), (F.col("id") % 400).cast("string")).alias("section_id"),
        F.col("id").cast("string").alias("section_name"),
        F.lit("SECTION").alias("section_type"),
        F.sha2((F.col("id") % 700).cast("string"), 256).alias("section_hash"),
        F.repeat(F.lit("word "), F.col("id").cast("int") % 9).alias("section_text"),
        (F.col("id") % 9).alias("section_word_count"),
        (F.col("id") % 97 / 100).alias("section_deviance"),
        F.lit(1).alias("focal_year_match"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_ranking_cuts_groups_before_the_shuffle(facts):
    plan = _plan(deviance.least_deviant(facts))
    partial, exchange = plan.index(", Partial"), plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan
    # Plans are printed from the last step to the first.
    assert exchange < partial


def test_edition_filter_reaches_the_scan_and_columns_are_pruned(facts):
    plan = _plan(embedding.focal_pairs(facts))
    assert "StringEndsWith(title_id,-2024)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"title_id", "part_id", "section_hash"}


def test_part_figures_take_two_partial_groupings_and_one_scan(facts):
    plan = _plan(parts.part_aggregates(facts))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 2
    assert plan.count("partial_sum") >= 2
    assert "section_text" not in plan


def test_bag_of_words_shuffles_each_text_once(facts):
    hashed = sections.with_hash(facts.drop("section_hash"))
    plan = _plan(embedding.bag_of_words(embedding.focal_texts(hashed)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_only_hot_keys_are_broadcast_by_force(spark, facts):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = facts.select("section_hash", F.array(F.lit(1.0)).alias("section_embedding"))
        plan = _plan(embedding.propagate(facts, vectors.dropDuplicates(["section_hash"])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin [section_hash" in plan
    for broadcast in plan.split("BroadcastExchange")[1:]:
        assert re.search(r"Filter \(rows#\d+L > 1000000\)", broadcast)


def test_panels_need_one_shuffle(facts):
    temporal = facts.withColumn("year_id", F.lit("2024"))
    plan = _plan(panels.panel(temporal, "section_word_count", ["2023", "2024"]))
    assert plan.count("Exchange") <= 2


def test_settled_tables_have_no_lineage(spark, facts):
    plan = _plan(tables.settle(facts.groupBy("part_id").count()))
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_texts_of_other_editions_stay_on_disk(spark, facts, tmp_path):
    path = str(tmp_path / "t")
    facts.write.partitionBy("title_id").parquet(path)
    hashed = sections.with_hash(spark.read.parquet(path).drop("section_hash"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kept = []
    try:
        deviance.notable_sections(facts, hashed, keep=lambda t: kept.append(t) or tables.settle(t))
        plan = _plan(kept[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = [x for x in plan.split("FileScan")[1:] if "section_text" in x.split("ReadSchema")[-1].split("\n")[0]]
    assert scans and all("EndsWith(title_id" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert "sha2" not in plan
