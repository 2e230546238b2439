"""Parameter grids and the choice of the best rows, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_lists(best: DataFrame, stage: Mapping[str, Sequence]) -> DataFrame:
    """Best lists of the stage before, with the stage's own lists put over them.

    ``best``: symbol, params map<string, array<string>>.
    """
    if not stage:
        return best
    added = _as_map(stage, [F.array(*[F.lit(_text(v)) for v in values]) for values in stage.values()])
    kept = F.map_filter("params", lambda k, _: ~k.isin(list(stage)))
    return best.withColumn("params", F.map_concat(kept, added))


def _as_map(keys: Iterable[str], values: Sequence[Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*values))


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def parameter_grid(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of the lists: keys in sorted order, the last key fastest.

    ``lists``: symbol, params map<string, array<string>>. Each key is exploded in
    turn, so a symbol's row grows into its own grid without any join.
    """
    keys = sorted(keys)
    grid = lists.withColumn("grid_idx", F.lit(0))
    for key in keys:
        values = F.col("params")[key]
        grid = grid.select(
            "symbol",
            "params",
            "grid_idx",
            *[f"`p_{k}`" for k in keys[: keys.index(key)]],
            F.size(values).alias("_n"),
            F.posexplode(values).alias("_i", f"p_{key}"),
        )
        grid = grid.withColumn("grid_idx", F.col("grid_idx") * F.col("_n") + F.col("_i")).drop("_n", "_i")
    chosen = _as_map(keys, [F.col(f"p_{k}") for k in keys]) if keys else F.create_map().cast("map<string,string>")
    return grid.select("symbol", "grid_idx", chosen.alias("params"))


def ranked(results: DataFrame, by: str = "mape") -> DataFrame:
    """Rank of each grid row per symbol; equal errors go by grid position."""
    order = Window.partitionBy("symbol").orderBy(by, "grid_idx")
    return results.withColumn("rank", F.row_number().over(order))


def top_rows(results: DataFrame, n: int, by: str = "mape") -> DataFrame:
    return ranked(results, by).where(F.col("rank") <= n)


def candidate_lists(results: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Chosen columns of the best n rows as one list per column.

    The lists are taken column by column, so the next grid is their product.
    A symbol's rows are one grid (at most a few dozen rows).
    """
    if not columns:
        nothing = F.create_map().cast("map<string,array<string>>")
        return results.select("symbol").distinct().select("symbol", nothing.alias("params"))
    chosen = [F.col("params")[c].alias(c) for c in columns]
    rows = F.array_sort(F.collect_list(F.struct("rank", *chosen)))
    best = top_rows(results, n).groupBy("symbol").agg(rows.alias("_rows"))

    def values(column: str):
        return F.transform("_rows", lambda row: row[column])

    return best.select("symbol", _as_map(columns, [values(c) for c in columns]).alias("params"))
