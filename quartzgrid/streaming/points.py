"""The row-by-row part of the pipeline on a stream of points: code, bin and filter need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bins import with_bin
from ..operators.compact import compact
from ..operators.layout import with_morton


def hot_stream(points: DataFrame, threshold: float, k: int = 8) -> DataFrame:
    """Hot points of a streaming (or batch) table with ``morton`` and ``bin``."""
    return with_bin(compact(with_morton(points), threshold), k)
