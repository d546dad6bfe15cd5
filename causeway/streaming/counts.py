"""Running confusion counts over a stream of pixels.

The reference has no streams; this is an extension.  Counts are sums, so each
micro-batch adds its own, and late rows only change the totals of their event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from causeway.operators.evaluate import confusion, metrics


def running_confusion(pixels: DataFrame, predicted: Column, keys: list[str]) -> DataFrame:
    """Confusion counts and ratios per key of a streaming ``pixels``, for output mode complete or update."""
    return metrics(confusion(pixels, predicted, keys))
