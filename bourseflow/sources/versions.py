"""Tables whose rows are replaced by key, in versions that readers see as a whole.

A write puts the rows of the partitions it touches below ``data/held=n`` and
then one small file below ``manifests/version=n``, which lists, for every
partition of the table, the version that holds it. That file appears at once (one
task writes it, its commit is a rename), and it is written last: until then
readers use the manifest before it, and the rows of a write that was aborted are
never named by any. The same version written again is written over, and a
version that has its manifest is left as it is, so a batch that runs twice changes
nothing. One writer at a time; readers may be many.

A write costs the touched partitions, not the table. A reader joins the newest
manifest (a row per partition value, such as a day) with the data on the partition
columns, so only named folders are scanned.

Defined cases: a table that is not there yet is empty; a null partition value is
a partition of its own; keys given twice in one write keep all their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourseflow.session import cut_lineage


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def _manifest_schema(schema: T.StructType, part: str) -> T.StructType:
    # "part" is the value itself, "held" the version of its rows, "version" the folder of the manifest
    fields = [T.StructField("part", schema[part].dataType), T.StructField("held", T.LongType()), T.StructField("version", T.LongType())]
    return T.StructType(fields)


def newest_version(spark: SparkSession, path: str, schema: T.StructType, part: str) -> int:
    """Number of the version that readers see; 0 if nothing has been written."""
    manifests = _stored(spark, f"{path}/manifests", _manifest_schema(schema, part))
    return manifests.agg(F.max("version")).first()[0] or 0


def _manifest(spark: SparkSession, path: str, schema: T.StructType, part: str, version: int) -> DataFrame:
    """``part, held`` of one version."""
    every = _stored(spark, f"{path}/manifests", _manifest_schema(schema, part))
    # a version without any partition has a row without a number
    return every.where((F.col("version") == version) & F.col("held").isNotNull()).select("part", "held")


def read_version(spark: SparkSession, path: str, schema: T.StructType | str, part: str, version: int | None = None) -> DataFrame:
    """Rows of the newest version, or of the version named."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    version = newest_version(spark, path, schema, part) if version is None else version
    fields = [f for f in schema.fields if f.name != part]
    held = T.StructType([*fields, T.StructField("held", T.LongType()), schema[part]])
    # later folders belong to no manifest yet, and may be written over at any time
    data = _stored(spark, f"{path}/data", held).where(F.col("held") <= version)
    manifest = _manifest(spark, path, schema, part, version)
    # one row per partition value: bounded by the calendar, not by the rows
    named = data.join(F.broadcast(manifest), data["held"].eqNullSafe(manifest["held"]) & data[part].eqNullSafe(manifest["part"]), "left_semi")
    return named.select(*schema.fieldNames())


def replace_rows(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    part: str,
    version: int | None = None,
    touched: DataFrame | None = None,
    keep: Column | None = None,
) -> int:
    """Put ``new`` in place of all rows with its ``keys``; returns the version that readers see then.

    ``touched`` (the key columns) names the keys to replace where some of them get
    no new row. ``keys`` hold the partition column ``part``. ``keep``, a condition on
    a column named ``part``, drops whole partitions from the new version.
    """
    if part not in keys:
        raise ValueError(f"the keys must hold the partition column {part}")
    spark = new.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema.fields])
    before = newest_version(spark, path, schema, part)
    if version is not None and version <= before:
        return before
    version = before + 1 if version is None else version
    new = cut_lineage(new)
    gone = cut_lineage((new if touched is None else touched.select(*keys).unionByName(new.select(*keys))).select(*keys).distinct())
    parts = gone.select(F.col(part).alias("part")).distinct()
    manifest = _manifest(spark, path, schema, part, before)
    named = F.broadcast(parts)  # partition values of this write
    old = read_version(spark, path, schema, part, before)
    old = old.join(named, old[part].eqNullSafe(named["part"]), "left_semi")
    same = [old[k].eqNullSafe(gone[k]) for k in keys]
    rows = old.join(gone, _all(same), "left_anti").unionByName(new)
    rows.write.mode("overwrite").partitionBy(part).parquet(f"{path}/data/held={version}")
    untouched = manifest.join(named, manifest["part"].eqNullSafe(named["part"]), "left_anti")
    written = _stored(spark, f"{path}/data/held={version}", T.StructType([schema[part]])).select(F.col(part).alias("part")).distinct()
    listed = untouched.unionByName(written.withColumn("held", F.lit(version).cast("bigint")))
    if keep is not None:
        listed = listed.where(keep)
    nothing = spark.createDataFrame([(None, None)], T.StructType(_manifest_schema(schema, part).fields[:2]))
    listed.unionByName(nothing).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={version}")
    return version


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for more in conditions[1:]:
        found = found & more
    return found
