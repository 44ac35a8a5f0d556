"""Left joins to a side with one row per key, safe against hot keys.

A shuffle join sends all rows of a key to one task.  Where one key may hold a
large share of all rows, its rows are dealt out over several salts and the single
matching row is repeated once per salt.  Only keys above ``hot_rows`` rows are
treated so; there are at most (all rows / hot_rows) of them, which bounds both
the broadcast list of hot keys and the number of repeated rows.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000

_FAN = "__fan"
_SALT = "__salt"


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and how many tasks to deal each out to."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > hot_rows)
        .select(*keys, F.ceil(F.col("rows") / F.lit(hot_rows)).cast("int").alias(_FAN))
    )


def join_one(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Join every row of ``left`` to at most one row of ``right``.

    ``right`` must be unique on ``keys``.  Hot keys are looked for in ``counted``:
    a table with the same rows as ``left`` that is cheaper to read.  The salt is a function of the row's
    content, so a task that runs again deals out its rows the same way; ``salt_by`` names
    the columns it is taken from, where the others are long.  Rows with
    a NULL key match nothing and are spread over all tasks.
    """
    hot = F.broadcast(hot_keys(left if counted is None else counted, keys, hot_rows))
    content = F.xxhash64(*(salt_by or [c for c in left.columns if c not in keys]))
    unmatched = reduce(or_, [F.col(key).isNull() for key in keys])
    salt = (
        F.when(unmatched, content)
        .when(F.col(_FAN).isNotNull(), F.pmod(content, F.col(_FAN).cast("bigint")))
        .otherwise(F.lit(0).cast("bigint"))
    )
    dealt = left.join(hot, keys, "left").withColumn(_SALT, salt).drop(_FAN)
    repeated = (
        right.join(hot, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_FAN, F.lit(1)) - 1)))
        .withColumn(_SALT, F.col(_SALT).cast("bigint"))
        .drop(_FAN)
    )
    return dealt.join(repeated, [*keys, _SALT], how).drop(_SALT)
