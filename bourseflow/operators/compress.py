"""Standardise columns, compress them to a few dimensions and rebuild them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconstruct(
    df: DataFrame, columns: Sequence[str], k: int = 3, test_share: float = 0.2, seed: int = 0, keys: Sequence[str] | None = None
) -> DataFrame:
    """Test rows with their code and squared reconstruction error.

    A row's side of the split depends on its ``keys`` (all columns, if not named) and
    the seed only, not on the partitions it is read in.
    Scaler and components are fitted on the training rows; both are sums over
    the rows, so their size depends on the number of columns only.
    """
    rows = df.na.drop("any", subset=list(columns))
    place = F.pmod(F.xxhash64(F.lit(seed), *(keys or df.columns)), F.lit(10_000))
    train, test = rows.where(place >= round(test_share * 10_000)), rows.where(place < round(test_share * 10_000))
    steps = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True),
            PCA(k=k, inputCol="_z", outputCol="_code"),
        ]
    )
    model = steps.fit(train)
    components = model.stages[-1].pc.toArray()  # columns x k
    scored = model.transform(test).withColumns({"z": vector_to_array("_z"), "code": vector_to_array("_code")})
    error = F.lit(0.0)
    for i in range(len(columns)):
        rebuilt = F.lit(0.0)
        for j in range(k):
            rebuilt = rebuilt + F.col("code")[j] * F.lit(float(components[i, j]))
        error = error + (F.col("z")[i] - rebuilt) * (F.col("z")[i] - rebuilt)
    return scored.select(*df.columns, "code", error.alias("squared_error"))
