"""The evidence tables as temporary views, so that operators' inputs are at hand in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import consensus, votes
from ..sources import encodings

TABLES = {
    "event_votes": encodings.event_votes,
    "order_votes": encodings.order_votes,
    "regions": encodings.regions,
    "points": encodings.points,
    "cameras": encodings.cameras,
}


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the views: the encodings, and winners and consensus of either kind of vote."""
    for name, make in TABLES.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    for kind in ("event", "order"):
        own = votes.with_unique_winner(votes.normalised(spark.table(f"{kind}_votes")), votes.OF_VIEW)
        own.createOrReplaceTempView(f"{kind}_winners")
        consensus.statistics(consensus.winner_counts(own), spark.table(f"{kind}_votes")).createOrReplaceTempView(f"{kind}_consensus")
    return [*TABLES, *(f"{k}_{t}" for k in ("event", "order") for t in ("winners", "consensus"))]
