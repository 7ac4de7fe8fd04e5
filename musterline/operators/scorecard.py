"""Managers placed against the average of all managers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.functions.codes import MISSING
from musterline.functions.columns import fixed, percent, total

# Quadrant -> status label.
STATUS_LABELS = {
    "star_performers": "✅ Star Performer",
    "burnout_risk": "🔥 Burnout Risk",
    "stable_uninspired": "⚖️ Stable Cluster",
    "high_risk": "🚩 High Risk",
}


def manager_effort(employees: DataFrame) -> DataFrame:
    """Team size, absenteeism and extra effort per manager; unnamed managers are left out."""
    teams = (
        employees.where(F.col("reporting_manager") != MISSING)
        .groupBy(F.col("reporting_manager").alias("manager_name"))
        .agg(
            F.count(F.lit(1)).alias("team_size"),
            total("mandays").alias("mandays"),
            total("total_presence").alias("presence"),
            total("total_absenteeism").alias("absenteeism"),
            (total("worked_weekends") + total("worked_holidays")).alias("extra_days"),
        )
    )
    return teams.select(
        "manager_name",
        "team_size",
        percent("absenteeism", "mandays").alias("absenteeism_rate"),
        percent("extra_days", "presence").alias("extra_effort_rate"),
    )


def manager_quadrants(employees: DataFrame) -> DataFrame:
    """Each manager's quadrant by the unweighted averages over managers.

    The averages are one subquery: a window without a partition would pull every
    manager into one task.
    """
    managers = manager_effort(employees)
    facts = managers.agg(
        F.struct(
            F.count(F.lit(1)).alias("managers"),
            F.avg("absenteeism_rate").alias("absenteeism"),
            F.avg("extra_effort_rate").alias("effort"),
        ).alias("facts")
    ).scalar()
    calm = F.col("absenteeism_rate") <= F.col("avg_absenteeism")
    keen = F.col("extra_effort_rate") >= F.col("avg_effort")
    quadrant = (
        F.when(calm & keen, F.lit("star_performers"))
        .when(~calm & keen, F.lit("burnout_risk"))
        .when(calm & ~keen, F.lit("stable_uninspired"))
        .otherwise(F.lit("high_risk"))
    )
    return (
        managers.withColumn("managers", facts["managers"])
        .withColumn("avg_absenteeism", facts["absenteeism"])
        .withColumn("avg_effort", facts["effort"])
        .withColumn("quadrant", quadrant)
        .withColumn("absenteeism", F.concat(fixed("absenteeism_rate", 1), F.lit("%")))
        .withColumn("effort", F.concat(fixed("extra_effort_rate", 1), F.lit("%")))
    )


def leadership_scorecard(employees: DataFrame) -> DataFrame:
    """Status of every manager, highest absenteeism first; empty for a single manager."""
    quadrants = manager_quadrants(employees)
    status = F.col("quadrant")
    labels = F.create_map(*[F.lit(text) for pair in STATUS_LABELS.items() for text in pair])
    return (
        quadrants.where(F.col("managers") > 1)
        .select(
            labels[status].alias("status"),
            F.col("manager_name").alias("manager"),
            "team_size",
            F.col("absenteeism_rate").alias("absenteeism_pct"),
            F.col("extra_effort_rate").alias("extra_effort_pct"),
        )
        .orderBy(F.desc("absenteeism_pct"), "manager")
    )
