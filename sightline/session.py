"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sightline", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution on; partition sizes and counts stay the cluster's own unless given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
