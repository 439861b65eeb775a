"""Pairings of points, folded inside the tile that forms them.

The complete graph has n(n-1)/2 edges, so no operator returns them as rows. What the
clustering needs of a pairing are the facts below and the trees in ``spanning``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import kernels
from arbora.operators.tiles import home_runs, map_pairs, ragged_parts, widened

SUMMARY = "pairs long, shortest double, longest double, total double"


def _kernel(subgraph, left, right):
    return kernels.pair_summary(left, right)


def pairs_within(blocked: DataFrame, s: int) -> DataFrame:
    """Facts on the pairs inside each block, keyed by its subgraph."""
    return _folded(blocked, s, lambda a, b, i, j: a == b, home_runs)


def pairs_between(blocked: DataFrame, s: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Facts on the pairs across blocks, of all block pairs or of ``low`` and ``high``."""
    if low is None:
        return _folded(blocked, s, lambda a, b, i, j: a != b)
    ends = {low, high}
    return _folded(blocked.where(F.col("block").isin(*ends)), s, lambda a, b, i, j: a != b and {a, b} == ends)


def complete_graph(blocked: DataFrame, s: int) -> DataFrame:
    """Facts on all pairs, per subgraph."""
    return _folded(blocked, s)


def _folded(blocked: DataFrame, s: int, wants=None, reach=None) -> DataFrame:
    parts = widened(ragged_parts(blocked))
    reach = reach and reach(parts)
    found = map_pairs(parts, s, _kernel, SUMMARY, wants, reach, together=kernels.pair_summaries).drop("whole")
    return per_subgraph(found) if parts.split else found


def per_subgraph(found: DataFrame) -> DataFrame:
    """Facts of parts of subgraphs as those of the subgraphs."""
    return _united(found.groupBy("subgraph"))


def united(summary: DataFrame) -> DataFrame:
    """The facts of several subgraphs as those of one graph."""
    return _united(summary.groupBy())


def _united(groups) -> DataFrame:
    return groups.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.sum("total").alias("total"),
    )
