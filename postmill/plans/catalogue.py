"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB SQL."""

from postmill.plans import articles, commerce, editorial, evidence, folds, media, posts, selections, slots  # noqa: F401  they register their queries
from postmill.plans.registry import ORACLES, QUERIES  # noqa: F401
