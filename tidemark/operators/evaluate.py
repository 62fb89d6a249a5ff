"""How much of a query pack the corpus answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def citation_rates(pack: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: the share of ``pack(query_id, must_cite)`` with a citation, and with all the path parts it must cite."""
    paths = cited.groupBy("query_id").agg(F.collect_set("path").alias("paths"))
    rows = pack.join(paths, "query_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    held = F.forall("must_cite", lambda part: F.exists("paths", lambda p: F.contains(p, part)))
    return rows.agg(F.count("*").alias("queries"), F.avg((F.size("paths") > 0).cast("int")).alias("influence_rate"), F.avg((held & (F.size("paths") > 0)).cast("int")).alias("required_path_rate"))
