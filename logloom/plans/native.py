"""Queries that are no SQL text: models per entity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..shipping import ship
from . import dialect, projection


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, entity, key, score, outlier): the days of every user, device and group against forests trained on all days."""
    ship(spark)
    logs = dialect.frame(projection.logs, spark, sf_dir, keep=True)
    models = dialect.written(api.train_models(logs))
    parts = [api.score_models(logs, models, kind).select(F.lit(kind).alias("kind"), "entity", "key", F.round("score", 9).alias("score"), "outlier") for kind in api.ENTITIES]
    return reduce(DataFrame.unionByName, parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"isolation_forest": isolation_forest}
