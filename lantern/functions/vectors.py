"""Vector functions over array columns; sums run in double, left to right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """The cosine of unit vectors."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalised(v: str | Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(_c(v), lambda x: x / norm)).otherwise(F.transform(_c(v), lambda x: x.cast("double")))


def mean_vector(rows: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """[A13] (key, centroid): the mean of each key's vectors, normalised. One partial aggregate, no rows gathered."""
    mean = F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(dimension)))
    return rows.groupBy(key).agg(mean.alias("centroid")).withColumn("centroid", normalised("centroid"))
