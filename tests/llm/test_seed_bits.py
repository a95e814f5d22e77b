from pyspark.sql import functions as F

from opportunity.llm import decontaminate


def test_asked_seeds_keep_their_bit_and_few_others_have_one(spark):
    seeds = spark.range(3000).select(F.xxhash64("id").alias("seed"))
    own = spark.range(100_000).select("id", F.xxhash64("id").alias("seed"))
    found = {r.id for r in decontaminate._with_bit(own, seeds).select("id").collect()}
    assert set(range(3000)) <= found and len(found) < 3100
    edges = spark.createDataFrame([(k,) for k in (0, -1, 63, 64, 32767, 32768, -(1 << 63), (1 << 63) - 1, decontaminate.BITS)], "seed long")
    assert {r.seed for r in decontaminate._with_bit(edges, edges).collect()} == {r.seed for r in edges.collect()}
    others = spark.createDataFrame([(k,) for k in (1, 2, 62, 65, 32766, 32769, 40_000)], "seed long")
    assert decontaminate._with_bit(others, edges).count() == 0
