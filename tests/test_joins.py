"""The join that is safe against hot keys gives what a plain join gives."""

import random

import pytest
from conftest import rows

from corpusdrift.operators.joins import hot_keys, join_one


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    left = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i % 2, i) for i in range(600)]
    left += [(None, 0, 1000 + i) for i in range(20)] + [("k1", None, 2000)]
    right = [("hot", 0, "h0"), ("hot", 1, "h1")] + [(f"k{i}", i % 2, f"v{i}") for i in range(30)]
    return (
        spark.createDataFrame(left, "key string, half int, id int"),
        spark.createDataFrame(right, "key string, half int, value string"),
    )


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [1, 10, 1_000_000])
def test_same_as_plain_join(sides, how, hot_rows):
    left, right = sides
    found = join_one(left, right, ["key", "half"], how, hot_rows)
    assert rows(found) == rows(left.join(right, ["key", "half"], how))


def test_hot_keys_are_few_and_dealt_out(sides):
    left, _ = sides
    hot = {r.key: r[1] for r in hot_keys(left, ["key"], 50).collect()}
    assert hot == {"hot": 4}


def test_hot_rows_reach_several_salts(spark, sides):
    """With salting on, the hot key's rows are spread over as many join keys as planned."""
    left, right = sides
    plan = join_one(left, right, ["key", "half"], "left", 10)._jdf.queryExecution().toString()
    assert "xxhash64" in plan and "__salt" in plan
