"""Loaders by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, loader: Callable[..., DataFrame]) -> None:
    if name in _LOADERS:
        raise ValueError(f"{name} is registered already")
    _LOADERS[name] = loader


def load(name: str, spark: SparkSession, *args, **options) -> DataFrame:
    if name not in _LOADERS:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](spark, *args, **options)


def names() -> list[str]:
    return sorted(_LOADERS)


def _defaults() -> None:
    from postmill.sources import feeds, records

    register("posts_json", lambda spark, paths, **o: records.normalise(records.read_raw(spark, paths), **o))
    register("feed_xml", lambda spark, paths, name, kind="media": feeds.read_xml(spark, paths, name, kind))
    register("feed_json", lambda spark, paths, name, kind="media": feeds.read_json(spark, paths, name, kind))
    register("parquet", lambda spark, path: spark.read.parquet(path))


_defaults()
