"""From a pool of candidates to a feed: relevance, penalties, floors, selection by diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A selection chooses from so few rows of a group at most.
MOST_CHOICES = 1_000


def shortlist(pool: DataFrame, size: int) -> DataFrame:
    return pool.orderBy(F.desc("sim"), "candidate_id").limit(size)


def minmax_relevance(pool: DataFrame) -> DataFrame:
    """sim brought to 0.05..1, 0.5 where all are equal; the limits come from one aggregated row."""
    limits = pool.agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(0.05 + 0.95 * (F.col("sim") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return pool.crossJoin(F.broadcast(limits)).withColumn("relevance", scaled).drop("lo", "hi")


def overlay(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores of a verdict table in place of relevance; rows without keep theirs."""
    joined = rows.join(verdicts, "candidate_id", "left")
    return joined.withColumn("relevance", F.coalesce("score", "relevance")).withColumn("scored", F.col("score").isNotNull()).drop("score")


def penalise(rows: DataFrame, penalties: DataFrame) -> DataFrame:
    """relevance less the penalty of the row's site."""
    joined = rows.join(penalties.select("site", "penalty"), "site", "left")
    return joined.withColumn("relevance", F.col("relevance") - F.coalesce("penalty", F.lit(0.0))).drop("penalty")


def relevance_floor(rows: DataFrame, least: float = 0.3) -> DataFrame:
    return rows.filter((F.col("relevance") > 0) & (~F.col("scored") | (F.col("relevance") >= least)))


def fresh(rows: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Rows whose own date isn't older than so many days; an unknown date stays."""
    return rows.filter(~F.coalesce(F.col("published") < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False)))


def mmr(rows: DataFrame, size: int, weight: float = 0.6, group: str = "tenant") -> DataFrame:
    """group, candidate_id, place: maximal marginal relevance within each group.

    The choice is sequential, so a group goes to one function; it holds a shortlist,
    and more than MOST_CHOICES rows raise."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_CHOICES:
            raise ValueError("cut a shortlist before choosing")
        pdf = pdf.sort_values("candidate_id")
        v = np.array(pdf["vector"].tolist(), float)
        relevance, order = pdf["relevance"].to_numpy(float), []
        nearest = np.full(len(pdf), -np.inf)
        left = np.ones(len(pdf), bool)
        while left.any() and len(order) < size:
            value = relevance if not order else np.round(weight * relevance - (1 - weight) * nearest, 12)
            i = int(np.argmax(np.where(left, value, -np.inf)))
            order.append(i)
            left[i] = False
            nearest = np.maximum(nearest, v @ v[i])
        out = pdf.iloc[order][[group, "candidate_id"]]
        return out.assign(place=np.arange(len(order), dtype=np.int64))

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "candidate_id", "relevance", "vector").groupBy(group).applyInPandas(
        choose, f"{group} {kind}, candidate_id long, place long"
    )
