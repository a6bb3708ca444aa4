"""Spans of a text by kind, and how result tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def written(spans: Column, kinds: tuple[str, ...], base_only: bool = False) -> Column:
    """``kind:start:end`` by start, then kind in the order given, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else spans
    placed = F.transform(chosen, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("place"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
