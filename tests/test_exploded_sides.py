"""Exploded rows are more than Spark takes them for: they must not be broadcast unasked."""

from opportunity.operators import joins


def test_cited_sources_are_not_broadcast(spark, tmp_path):
    spark.range(300).selectExpr("id as team", "array(-1 - id, id * 2, id * 2 + 1) as source_ids").write.parquet(f"{tmp_path}/teams")
    spark.range(600).selectExpr("id as source_id", "date_add(to_date('2000-01-01'), cast(id as int)) as published").write.parquet(f"{tmp_path}/sources")
    found = joins.evidence_dates(spark.read.parquet(f"{tmp_path}/teams"), spark.read.parquet(f"{tmp_path}/sources"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.team: (r.primary_source, str(r.latest)) for r in found.collect()}
    assert len(rows) == 300 and rows[0] == (0, "2000-01-02") and rows[7] == (14, "2000-01-16")
