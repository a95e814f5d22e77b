import numpy as np
from pyspark.sql import functions as F

from opportunity.resampling import bootstrap_spearman


def scopes(spark):
    rows = spark.range(90).selectExpr("id % 3 as part", "id as unit", "cast(id * 37 % 11 as double) as x", "cast(id * id % 17 + id / 9 as double) as y")
    lone = spark.range(5).selectExpr("7L as part", "id as unit", "1D as x", "cast(id as double) as y")  # no sample can be ranked
    return rows.unionByName(lone).withColumn("y", F.when(F.col("unit") != 4, F.col("y")))


def test_both_ways_of_ranking_agree(spark):
    by_array = bootstrap_spearman(scopes(spark), ["part"], ["unit"], "x", "y", samples=60)
    by_shuffle = bootstrap_spearman(scopes(spark), ["part"], ["unit"], "x", "y", samples=60, array_rows=0)
    mixed = bootstrap_spearman(scopes(spark), ["part"], ["unit"], "x", "y", samples=60, array_rows=20)
    first, second, third = (sorted(map(tuple, f.collect())) for f in (by_array, by_shuffle, mixed))
    assert [r[0] for r in first] == [0, 1, 2, 7] and first[3][1:] == (None, None, 0)
    for other in (second, third):
        assert [(r[0], r[3]) for r in first] == [(r[0], r[3]) for r in other]
        assert np.allclose([r[1:3] for r in first[:3]], [r[1:3] for r in other[:3]], rtol=0, atol=1e-12)


def test_no_row_is_shuffled_for_a_draw(spark):
    plan = bootstrap_spearman(scopes(spark), ["part"], ["unit"], "x", "y", samples=60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "md5" not in plan
