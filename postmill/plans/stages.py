"""Stages whose results are kept by content address, so that a run that broke goes on where it stopped.

A stage's key is the digest of its name, its version, its settings, and the keys of its inputs. A finished result of that key is read,
not made again; a changed setting changes the keys of its own stage and of what follows, and of nothing else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from postmill.sinks.packages import digest, exists, remove, rename


@dataclass(frozen=True)
class Result:
    name: str
    key: str
    rows: DataFrame


@dataclass
class Stages:
    spark: SparkSession
    root: str
    #: (stage, key, whether it was read)
    log: list[tuple[str, str, bool]] = field(default_factory=list)

    def source(self, name: str, rows: DataFrame) -> Result:
        """A table from outside; its key is its content's."""
        return Result(name, hashlib.sha256(f"{name}|{digest(rows)}".encode()).hexdigest()[:32], rows)

    def run(self, name: str, inputs: Sequence[Result], make: Callable[..., DataFrame], settings: Mapping | None = None, version: int = 1) -> Result:
        """make(*rows of inputs, **settings), or what an earlier run made of the same."""
        what = {"name": name, "version": version, "settings": dict(settings or {}), "inputs": [i.key for i in inputs]}
        key = hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:32]
        path = f"{self.root}/{name}-{key}"
        kept = exists(self.spark, path)
        if not kept:  # written beside, then named: a name means a whole result
            stage = f"{self.root}/.{name}-{key}"
            remove(self.spark, stage)
            make(*[i.rows for i in inputs], **what["settings"]).write.parquet(stage)
            rename(self.spark, stage, path)
        self.log.append((name, key, kept))
        return Result(name, key, self.spark.read.parquet(path))
