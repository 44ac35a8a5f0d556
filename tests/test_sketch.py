"""The Bloom filter before joins."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusdrift.operators import parts, sketch


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_no_key_is_kept_out_and_few_others_come_through(spark):
    held = sketch.screen(keys(spark, [f"k{i}" for i in range(5_000)] + [None]), "key")
    found = keys(spark, [f"k{i}" for i in range(20_000)] + [None]).withColumn("held", held(F.col("key")))
    kept = {r.key for r in found.filter("held").collect()}
    assert {f"k{i}" for i in range(5_000)} <= kept and None not in kept
    assert len(kept) < 5_000 + 0.02 * 15_000
    nothing = sketch.screen(keys(spark, []), "key")
    assert found.filter(nothing(F.col("key"))).isEmpty()


def test_filters_of_parts_are_put_together(spark):
    whole = keys(spark, [f"k{i}" for i in range(500)])
    bits = sketch.size_for(500)
    halves = [sketch.words_of(whole.filter(f"hash(key) % 2 {op} 0"), "key", bits) for op in ("=", "!=")]
    joined = halves[0].union(halves[1]).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    assert rows(joined) == rows(sketch.words_of(whole, "key", bits))


def test_size_follows_the_number_of_keys_up_to_a_bound():
    assert sketch.size_for(0) == sketch.size_for(1) == 1_024
    assert sketch.size_for(1_000) >= 12_000 and sketch.size_for(10**12) == sketch.MOST_BITS


SECTIONS = (
    "title_id string, part_id string, section_id string, section_name string, section_hash string, section_word_count bigint"
)


@pytest.mark.parametrize("multiplicity", [False, True])
def test_screened_sections_give_the_same_and_shuffle_less(spark, tmp_path, multiplicity):
    data = [(f"Title-01-{2021 + i % 4}", f"P{i % 5}", f"s{i}", "n", None if i % 50 == 49 else f"h{i % 7 if i % 4 == 3 else i}", 3) for i in range(4_000)]
    facts = spark.createDataFrame(data, SECTIONS)
    facts.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.schema(facts.schema).parquet(str(tmp_path / "facts"))
    embedded = spark.createDataFrame([(f"h{i}", [float(i), 1.0]) for i in range(7)], "section_hash string, section_embedding array<float>")
    listed = facts.select("title_id", "part_id").distinct()
    focal = facts.filter("title_id like '%2024'").select("section_hash")
    screen = sketch.screen(focal.distinct(), "section_hash")
    plain = parts.quantify(facts, embedded, listed, 2024, multiplicity)
    screened = parts.quantify(facts, embedded, listed, 2024, multiplicity, screen=screen)
    assert rows(plain) == rows(screened.select(*plain.columns))
    others = facts.filter("title_id not like '%2024'")
    assert parts._screened(others, screen).count() < 0.1 * others.count()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written = [_shuffled(parts.quantify(facts, embedded, listed, 2024, multiplicity, screen=s)) for s in (None, screen)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written[1] < written[0] - 2_500


def _shuffled(table):
    """Rows that all exchanges of a query have written."""
    table.collect()
    seen, total, todo = set(), 0, [table._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if re.search("QueryStage", name):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined() and node.id() not in seen:
            seen.add(node.id())
            total += metric.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
