"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings, with underscores for dots."""
    b = SparkSession.builder.master(master).appName("tierloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
