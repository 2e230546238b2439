"""Statistics over daily prices and generic series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourseflow.functions.dates import month_label
from bourseflow.functions.numbers import percent_text
from bourseflow.operators.prices import with_change


def average_daily_move(daily: DataFrame) -> DataFrame:
    """Mean of |y_t - y_(t-1)| / y_t per symbol: the divisor is the current close."""
    changes = with_change(daily).na.drop("any")
    moves = changes.groupBy("symbol").agg(F.avg(F.abs(F.col("change") / F.col("y"))).alias("avg_price_change"))
    return moves.withColumn("avg_price_change_pct", percent_text(F.col("avg_price_change"))).orderBy(
        F.col("symbol").cast("string")
    )


def month_end_close(daily: DataFrame) -> DataFrame:
    """Last known close of each month; ``max_by`` alone could return a null close."""
    known = daily.where(F.col("y").isNotNull())
    return known.groupBy("symbol", F.last_day("ds").alias("month_end")).agg(F.max_by("y", "ds").alias("y"))


def price_panel(long: DataFrame, symbols: Sequence[str], key: str = "month_end") -> DataFrame:
    """One column per symbol; a date is kept when any symbol has it."""
    return long.groupBy(key).pivot("symbol", list(symbols)).agg(F.first("y", ignorenulls=True))


def standardize(daily: DataFrame, value: str = "y") -> DataFrame:
    """z-score per symbol with the population deviation; a flat series is divided by 1."""
    series = Window.partitionBy("symbol")
    deviation = F.stddev_pop(value).over(series)
    divisor = F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
    return daily.withColumn("z", (F.col(value) - F.avg(value).over(series)) / divisor)


def five_numbers(long: DataFrame, key: str, value: str, n_series: int | None = None) -> DataFrame:
    """Minimum, quartiles (linear interpolation) and maximum of the series at each key.

    A group holds one value per symbol. With ``n_series`` given, the quartiles
    of a key at which some series is missing are null, as a NaN would make them.
    """
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = long.groupBy(key).agg(
        F.min(value).alias("min"),
        quartiles.alias("q"),
        F.max(value).alias("max"),
        F.count(value).alias("n_series"),
    )
    complete = F.lit(True) if n_series is None else F.col("n_series") == n_series
    pick = lambda i: F.when(complete, F.col("q")[i])
    return stats.select(
        key,
        "min",
        pick(0).alias("q1"),
        pick(1).alias("median"),
        pick(2).alias("q3"),
        "max",
        "n_series",
    )


def monthly_boxplot(daily: DataFrame, n_series: int | None = None) -> DataFrame:
    """Boxplot table of standardised month-end closes; the running month is left out."""
    scaled = standardize(month_end_close(daily))
    running_month = scaled.agg(F.max("month_end")).scalar()
    table = five_numbers(scaled.where(F.col("month_end") < running_month), "month_end", "z", n_series)
    return table.withColumn("month", month_label(F.col("month_end")))


def row_mean(long: DataFrame, key: str, value: str) -> DataFrame:
    """Mean over the symbols at each key."""
    return long.groupBy(key).agg(F.avg(value).alias("mean"))


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum.

    The exact quartiles keep a count per distinct value, so this is meant for
    values of limited precision (scores), not for free doubles.
    """
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        q.alias("q"),
        F.max(value).alias("max"),
    )
    return stats.select(
        *keys,
        "count",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
        "max",
    )


#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 32 << 20
#: Rows of one series that a task holds.
PART_ROWS = 1_000_000


def _co_moments(values: np.ndarray) -> np.ndarray:
    """For every pair of columns, over the rows that have both: count, mean of the first, its squared deviations, co-deviations."""
    there = ~np.isnan(values)
    first = np.where(there.any(axis=0), values[there.argmax(axis=0), np.arange(values.shape[1])], 0.0)
    # taken from a value of the column itself: a flat column has deviations of exactly 0
    shifted, there = np.where(there, values - first, 0.0), there.astype(np.float64)
    n = there.T @ there
    sums = shifted.T @ there
    mean = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
    return np.stack([n, mean + first[:, None], (shifted**2).T @ there - sums * mean, shifted.T @ shifted - sums * mean.T])


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    # where one side has no rows its mean does not count
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + apart * share, b[1])
    weight = a[0] * share
    return np.stack([n, mean, a[2] + b[2] + apart**2 * weight, a[3] + b[3] + apart * apart.T * weight])


def _key_arrays(schema: pa.Schema, keys: Sequence[str], rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], schema.field(k).type) for i, k in enumerate(keys)]


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlations of all column pairs, long form, pairwise complete.

    A task multiplies blocks of rows: per group it keeps counts, means and
    co-deviations of all pairs (matrices of the columns, whatever the rows), and
    only these are shuffled and added up. Means travel with the sums, so nothing
    large cancels. Null and NaN are missing. Columns that correlate with nothing
    (no data, or flat) are dropped like all-null rows of a matrix.
    """
    columns, keys = list(columns), list(keys)
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    size, most = len(columns), max(1, HELD_BYTES // (32 * max(1, len(columns)) ** 2))

    def blocks(batches):
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def out():
            arrays = [*_key_arrays(schema, keys, list(held)), pa.array([m.tobytes() for m in held.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "_sums"])

        for batch in batches:
            schema = batch.schema
            values = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]], axis=1)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(keys)])) if keys else [()] * len(batch)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                found = _co_moments(values[rows])
                held[key] = _added(held[key], found) if key in held else found
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    def total(table: pa.Table) -> pa.Table:
        parts = (np.frombuffer(x).reshape(4, size, size) for x in table.column("_sums").to_pylist())
        n, _, spread, together = reduce(_added, parts)
        scale = np.sqrt(spread * spread.T)
        i, j = np.nonzero((n > 0) & (scale > 0))
        group = [pa.array([table.column(k)[0].as_py()] * len(i), table.schema.field(k).type) for k in keys]
        names = pa.array(columns, pa.string())
        return pa.table([*group, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(together[i, j] / scale[i, j])], names=[*keys, "left", "right", "corr"])

    key_fields = [df.schema[k] for k in keys]
    sums = narrow.mapInArrow(blocks, T.StructType([*key_fields, T.StructField("_sums", T.BinaryType())]))
    cells = [T.StructField("left", T.StringType()), T.StructField("right", T.StringType()), T.StructField("corr", T.DoubleType())]
    return sums.groupBy(*keys).applyInArrow(total, T.StructType([*key_fields, *cells]))


def autocorrelation(df: DataFrame, value: str, order: str, keys: Sequence[str], max_lag: int = 50) -> DataFrame:
    """``keys, n, lag, acf, band``: autocorrelation for lags 0..max_lag with the half width of Bartlett's 95 % band.

    The rows are dealt in ranges of (keys, order), so one long series is several
    tasks. In one pass a task gives, per series in its range, the sums of lagged
    products and the first and last ``max_lag`` values; a series' ranges, a row
    each, are then put together, products across borders from these values. Null
    values are left out; a flat series has no autocorrelation.
    """
    keys, edge = list(keys), max_lag
    known = df.select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = known.repartitionByRange(n_ranges, *keys, "_order").sortWithinPartitions(*keys, "_order")

    def part_of(values: np.ndarray) -> dict:
        shifted = values - values[0]
        products = [float(shifted[: len(shifted) - k] @ shifted[k:]) if k < len(shifted) else 0.0 for k in range(edge + 1)]
        return {"_n": len(values), "_shift": float(values[0]), "_sum": float(shifted.sum()), "_products": products, "_head": values[:edge].tolist(), "_tail": values[max(0, len(values) - edge) :].tolist()}

    def ranges(batches):
        number, place, schema = TaskContext.get().partitionId(), 0, None
        current, held, count = None, [], 0

        def out():
            row = part_of(np.concatenate(held))
            kinds = [pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3]
            arrays = [*_key_arrays(schema, keys, [current]), pa.array([number]), pa.array([place])]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([v], t) for v, t in zip(row.values(), kinds))], names=[*keys, "_range", "_place", *row])

        for batch in batches:
            schema = batch.schema
            values = batch.column("_v").to_numpy()
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * len(batch)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                # a long stretch is passed on in parts
                if held and (names[a] != current or count >= PART_ROWS):
                    yield out()
                    place, held, count = place + 1, [], 0
                current = names[a]
                held.append(values[a:b])
                count += b - a
        if held:
            yield out()

    def joined(table: pa.Table) -> pa.Table:
        parts = table.sort_by([("_range", "ascending"), ("_place", "ascending")]).to_pylist()
        n = sum(p["_n"] for p in parts)
        start = parts[0]["_shift"]
        mean = start + sum((p["_shift"] - start) * p["_n"] + p["_sum"] for p in parts) / n
        total, before = np.zeros(edge + 1), np.zeros(0)
        for p in parts:
            head, tail = np.array(p["_head"]), np.array(p["_tail"])
            off, lags = p["_shift"] - mean, np.arange(edge + 1)
            left = np.maximum(p["_n"] - lags, 0)
            # of the sum of a part without its first, or last, k values; parts are longer than k, or have no such products
            first = np.concatenate(([0.0], np.cumsum(head - p["_shift"])))[np.minimum(lags, len(head))]
            last = np.concatenate(([0.0], np.cumsum(tail[::-1] - p["_shift"])))[np.minimum(lags, len(tail))]
            inner = np.array(p["_products"]) + off * (2 * p["_sum"] - first - last) + left * off * off
            total += np.where(left > 0, inner, 0.0)
            # products across the border: the i-th value from the end of what came before, and the (k - i)-th of this part
            if len(before):
                across = np.convolve((before - mean)[::-1], head - mean)
                total[1 : 1 + len(across)] += across[:edge]
            before = np.concatenate((before, tail))[-edge:] if edge else before
        lags = np.arange(min(edge + 1, n))
        acf = total[lags] / total[0] if total[0] > 0 else np.zeros(0)
        lags = lags[: len(acf)]
        band = np.where(lags == 0, 0.0, 1.96 * np.sqrt((1 + 2 * np.concatenate(([0.0, 0.0], np.cumsum(acf[1:-1] ** 2)))[: len(acf)]) / n))
        group = [pa.array([parts[0][k]] * len(lags), table.schema.field(k).type) for k in keys]
        return pa.table([*group, pa.array([n] * len(lags), pa.int64()), pa.array(lags.astype(np.int32)), pa.array(acf), pa.array(band)], names=[*keys, "n", "lag", "acf", "band"])

    key_fields = [df.schema[k] for k in keys]
    held = "_range bigint, _place bigint, _n bigint, _shift double, _sum double, _products array<double>, _head array<double>, _tail array<double>"
    parts = placed.mapInArrow(ranges, T.StructType([*key_fields, *T.StructType.fromDDL(held).fields]))
    result = T.StructType.fromDDL("n bigint, lag int, acf double, band double")
    return parts.groupBy(*keys).applyInArrow(joined, T.StructType([*key_fields, *result.fields]))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values with their number of rows, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is null."""
    return df.where(F.col(column).isNull())


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and its row count as a by-product of the job that uses it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
