"""The asset cache's rules as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cacheable(method: Column, status: Column, url: Column, denied: list[str]) -> Column:
    """A successful GET whose url holds none of the denied parts."""
    held = [F.contains(url, F.lit(part)) for part in denied]
    refused = held[0] if held else F.lit(False)
    for h in held[1:]:
        refused = refused | h
    return (method == "GET") & (status == 200) & ~refused


def stale(caches: DataFrame, keep: DataFrame) -> DataFrame:
    """Caches (name) that aren't to be kept."""
    return caches.join(keep.select("name"), "name", "left_anti")
