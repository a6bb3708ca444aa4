"""Counts that come with a job's own pass: what each step keeps, and what it finds in its columns.

Counting rows before and after a step takes jobs of its own. An audit instead marks steps of a plan with observed sums; Spark fills them
while the result is written, and the report reads them afterwards. Watching keeps filters from moving below the step, so jobs
watch only if they are asked to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.cleaning import DIRTY_TOKENS, strip


class Audit:
    """The watched steps of one job, in order. An audit serves one run of one job."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Observation, list[str]]] = []

    def watch(self, df: DataFrame, step: str, *, nulls: Sequence[str] = (), dirty: Sequence[str] = (), **counts: Column) -> DataFrame:
        """The same rows; counts them, the nulls and dirty tokens of columns, and rows for which conditions hold."""
        conditions = {f"nulls of {c}": F.col(f"`{c}`").isNull() for c in nulls}
        conditions |= {f"dirty {c}": F.lower(strip(F.coalesce(F.col(f"`{c}`"), F.lit("nan")))).isin(*DIRTY_TOKENS) for c in dirty}
        conditions |= counts
        observation = Observation()
        self.steps.append((step, observation, ["rows", *conditions]))
        sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(conditions.values(), 1)]
        return df.observe(observation, F.count("*").alias("c0"), *sums)

    def counts(self) -> list[tuple[str, str, int]]:
        """``(step, measure, n)`` of the run; waits for the job to end. Steps after the first also tell how many rows went."""
        out, before = [], None
        for step, observation, names in self.steps:
            found = observation.get
            out += [(step, name, found[f"c{i}"]) for i, name in enumerate(names)]
            if before is not None:
                out.append((step, "removed", before - found["c0"]))
            before = found["c0"]
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """The counts as a table, one row per step and measure."""
        return spark.createDataFrame(self.counts(), "step string, measure string, n long")
