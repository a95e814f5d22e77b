"""A value finds its own rank, also where it is another the next time it is computed."""

import uuid

from pyspark.sql import functions as F

from opportunity.operators import windows


def test_a_value_that_changes_finds_its_rank(spark):
    # Sums of shuffled rows differ in their last bits from one evaluation to the next; here every evaluation differs.
    value = F.udf(lambda: str(uuid.uuid4())).asNondeterministic()
    df = spark.range(40).select("id", F.lit("a").alias("key")).withColumn("value", value())
    reference = spark.range(3).select(F.lit("a").alias("key"), F.lit("5").alias("value"))
    for found in (windows.average_rank_percentile(df, ["key"], "value"), windows.cume_percentile(df, ["key"], "value"), windows.midrank_percentile(df, reference, ["key"], "value")):
        assert found.filter("percentile is null").count() == 0 and found.count() == 40
