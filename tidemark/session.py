"""A session with the settings that the operators assume."""

from pyspark.sql import SparkSession


def build_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
