"""Dense vectors stored as arrays.

Half precision and distances work on whole Arrow batches in NumPy: a vector's numbers are one
block of memory there, where the JVM's higher-order functions take them one by one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructType

from corpusdrift import fixed_values as fv


def _numbers(column: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of vectors, and where each vector begins; NULL vectors are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@F.arrow_udf(ArrayType(FloatType()))
def _half(column: pa.Array) -> pa.Array:
    values, starts = _numbers(column, np.float32)
    nulls = column.flatten().is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        rounded = values.astype(np.float16).astype(np.float32)
    vectors = pa.array(rounded, pa.float32(), mask=nulls)
    mask = column.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), vectors, mask=pa.array(mask))


def quantize_half(vector: Column) -> Column:
    """Single precision, then half precision, returned as single precision, which holds it exactly."""
    return _half(vector)


@F.arrow_udf(DoubleType())
def _distance(left: pa.Array, right: pa.Array) -> pa.Array:
    a, starts = _numbers(left, np.float64)
    b, others = _numbers(right, np.float64)
    known = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    if not np.array_equal(sizes[known], np.diff(others)[known]):
        raise ValueError("vectors of different length")
    out = np.full(len(known), np.nan)
    rows = np.flatnonzero(known & (sizes > 0))
    for size in np.unique(sizes[rows]):
        own = rows[sizes[rows] == size]
        steps = np.arange(size)
        x, y = a[starts[own][:, None] + steps], b[others[own][:, None] + steps]
        lengths = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[own] = np.where(lengths != 0, (1 - np.einsum("ij,ij->i", x, y) / lengths) / 2, np.nan)
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def rescaled_distance(left: Column, right: Column) -> Column:
    """Cosine distance moved to 0 (same) .. 0.5 (unrelated) .. 1 (opposite).

    NULL if a vector is NULL, empty or of length zero.
    """
    return F.round(_distance(left, right), fv.SCORE_DIGITS)


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision; NULL if either side is NULL."""
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(vector, vector))


#: Half precision holds multiples of 2^-24 below 2^16, so a number is a whole one of 41 bits and a sign.
_FRACTION_BITS = 24
#: Whole numbers are summed in two parts, so that 2^42 of them don't pass 64 bits.
_LOW_BITS = 20
#: Groups that a task holds before it gives their sums out.
_TASK_GROUPS = 2_000


def exact_means(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean vector of each group, the same to the last bit in whatever order the rows come.

    ``keys``, and ``mean`` as an array of doubles.  Vectors are read to the nearest 2^-24, which holds half precision
    exactly; weights are whole numbers.  Every task sums up its share of a group in whole numbers before the
    shuffle, so a group of any size sends one row from each task and component.  A component of which some
    number isn't finite has the mean NaN.  Vectors of one group must be of one length.  Missing vectors
    don't count; a group without any is left out.
    """
    schema = StructType([rows.schema[k] for k in keys])
    for name in ("high", "low", "odd"):
        schema = schema.add(name, ArrayType(LongType()))
    schema = schema.add("weight", "long")
    arrow_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            columns = [[key[i] for key in held] for i in range(arrow_keys)]
            columns += [[sums[i].tolist() for sums in held.values()] for i in range(3)]
            columns.append([sums[3] for sums in held.values()])
            names = [*keys, "high", "low", "odd", "weight"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        types = None
        for batch in batches:
            batch = batch.filter(batch.column(vector).is_valid())
            if types is None:
                types = [*(f.type for f in batch.schema)][:arrow_keys] + [pa.list_(pa.int64())] * 3 + [pa.int64()]
            if not batch.num_rows:
                continue
            numbers, starts = _numbers(batch.column(vector), np.float64)
            sizes, of_key = np.diff(starts), list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(of_key):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                size = int(sizes[at[0]])
                if (sizes[at] != size).any() or key in held and len(held[key][0]) != size:
                    raise ValueError("vectors of different length")
                values = numbers[starts[at][:, None] + np.arange(size)]
                finite = np.isfinite(values)
                whole = np.rint(np.where(finite, values, 0) * 2.0**_FRACTION_BITS).astype(np.int64)
                by = weights[at][:, None]
                sums = held.setdefault(key, [np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), 0])
                sums[0] += ((whole >> _LOW_BITS) * by).sum(axis=0)
                sums[1] += ((whole & (2**_LOW_BITS - 1)) * by).sum(axis=0)
                sums[2] += (~finite).sum(axis=0)
                sums[3] += int(weights[at].sum())
            if len(held) >= _TASK_GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = rows.select(*keys, vector, weight).mapInArrow(run, schema)
    # One shuffle of a few rows for each group; both groupings below find theirs in place.
    each = parts.repartition(*keys).select(*keys, "weight", F.posexplode(F.arrays_zip("high", "low", "odd")).alias("place", "sums"))
    sums = each.groupBy(*keys, "place").agg(
        F.sum("sums.high").alias("high"), F.sum("sums.low").alias("low"), F.sum("sums.odd").alias("odd"),
        F.sum("weight").alias("weight"),
    )
    total = (F.col("high").cast("decimal(38,0)") * 2**_LOW_BITS + F.col("low")).cast("double")
    mean = F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(total / (F.col("weight") * float(2**_FRACTION_BITS)))
    means = sums.select(*keys, F.struct("place", mean.alias("mean"), "weight").alias("of_place"))
    # As many entries as a vector has components.
    found = means.groupBy(*keys).agg(F.array_sort(F.collect_list("of_place")).alias("found"))
    same = F.array_min("found.weight") == F.array_max("found.weight")
    error = F.raise_error(F.lit("vectors of different length")).cast("array<double>")
    return found.select(*keys, F.when(same, F.col("found.mean")).otherwise(error).alias("mean"))
