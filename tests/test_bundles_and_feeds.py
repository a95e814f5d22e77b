"""Bundles under a hash tree, feeds of many blocks, cutoffs, and recomputed decisions."""

import pytest
from pyspark.sql import functions as F

from opportunity import quality
from opportunity.quality import QualityError
from opportunity.sources import bundles, readers


def tables(spark):
    people = spark.range(500).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("name"), F.when(F.col("id") % 7 != 0, F.col("id") / 3).alias("x"))
    return {"people": people, "places": spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "", 2.0)], "k int, v string, w double")}


def test_bundle_names_the_changed_part(spark, tmp_path):
    held = tables(spark)
    digest = bundles.write_bundle(held, str(tmp_path), "one", {"people": ["id"]}, parts=8, parameters={"season": 1})
    assert bundles.write_bundle({k: v.repartition(5) for k, v in held.items()}, str(tmp_path), "two", {"people": ["id"]}, parts=8, parameters={"season": 1}) == digest
    back = bundles.read_bundle(spark, str(tmp_path), "one", {"people": ["name"]}, {"season": 1})
    assert quality.same_rows(back["people"], held["people"]) and quality.same_rows(back["places"], held["places"])
    with pytest.raises(QualityError, match="parameters"):
        bundles.read_bundle(spark, str(tmp_path), "one", parameters={"season": 2})
    with pytest.raises(Exception, match="(?i)exist"):
        bundles.write_bundle(held, str(tmp_path), "one")
    part = held["people"].filter("id = 44").select(bundles.part_of(["id"], 8)).first()[0]
    bad = held["people"].withColumn("x", F.when(F.col("id") == 44, 9.0).otherwise(F.col("x")))
    bad.filter(bundles.part_of(["id"], 8) == part).write.mode("overwrite").parquet(f"{tmp_path}/one/data/people/_part={part}")
    with pytest.raises(QualityError, match=f"part {part} of people is changed"):
        bundles.read_bundle(spark, str(tmp_path), "one", parameters={"season": 1})
    assert [tuple(r) for r in bundles.bundle_differences(spark, str(tmp_path), "one", {"people": [part]}).collect()] == [("people", part, "changed")]
    assert bundles.bundle_differences(spark, str(tmp_path), "one", {"people": [p for p in range(8) if p != part]}).collect() == []
    only = bundles.read_parts(spark, str(tmp_path), "one", "people", [part])
    assert "PartitionFilters: [_part" in only._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(_part" in only._jdf.queryExecution().toString()
    assert only.count() < 150 and only.filter("id = 44").count() == 1


def test_repeated_and_lost_rows_change_a_part(spark):
    held = tables(spark)["places"]
    whole = bundles.bundle_tree({"places": held}, {}, 4)
    once = bundles.bundle_tree({"places": held.distinct()}, {}, 4)
    assert [r.change for r in bundles.tree_differences(whole, once).collect()] == ["changed"]
    assert {r.change for r in bundles.tree_differences(whole, bundles.bundle_tree({"places": held.filter("k is null")}, {}, 4)).collect()} == {"missing"}
    assert bundles.tree_differences(whole, bundles.bundle_tree({"places": held.repartition(3)}, {}, 4)).collect() == []


def test_empty_bundle_table(spark, tmp_path):
    empty = tables(spark)["places"].limit(0)
    bundles.write_bundle({"places": empty, "people": tables(spark)["people"]}, str(tmp_path), "e")
    with pytest.raises(QualityError, match="empty"):
        bundles.read_bundle(spark, str(tmp_path), "e")


def test_a_feed_of_many_blocks_keeps_order_and_cap(spark, tmp_path):
    def item(n, guid=None, title=None):
        return f"<item>\n<title>{title or f'Title {n}'}</title><link>l{n}</link><guid>{guid or f'g{n}'}</guid><pubDate>d</pubDate><source url='u'>s</source></item>\n"

    body = "".join(item(n, guid=f"g{n - 1}" if n % 10 == 1 else None, title=" " if n % 7 == 0 else None) for n in range(4000))
    (tmp_path / "a.xml").write_text(f"<rss><channel><title>feed</title>\n{body}</channel></rss>")
    (tmp_path / "b.xml").write_text(f"<rss><channel>\n{item(1)}{item(2)}</channel></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = readers.read_news(spark, str(tmp_path), 1500)
        assert spark.read.option("lineSep", "</item>").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = [(r.feed.rsplit("/", 1)[1], r.title) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    seen, want = set(), []
    for n in range(4000):
        guid = f"g{n - 1}" if n % 10 == 1 else f"g{n}"
        if n % 7 and guid not in seen and len(want) < 1500:
            seen.add(guid)
            want.append(("a.xml", f"Title {n}"))
    assert sorted(rows) == sorted([*want, ("b.xml", "Title 1"), ("b.xml", "Title 2")])


def test_more_cutoffs_than_allowed_are_an_error(spark, tmp_path):
    (tmp_path / "dated.csv").write_text("dt,team,gsis_id,pos_abb,pos_rank\n2024-08-01,KC,x,QB,1\n")
    cutoffs = spark.range(501).select((F.col("id") + 1500).cast("int").alias("season"), F.expr("make_date(cast(id as int) + 1500, 9, 5)").alias("cutoff"))
    with pytest.raises(QualityError, match="cutoffs"):
        readers.read_opening_depth(spark, {"dated": str(tmp_path / "dated.csv")}, cutoffs)
    assert readers.read_opening_depth(spark, {"dated": str(tmp_path / "dated.csv")}, cutoffs.filter("season > 1900").unionByName(spark.createDataFrame([(2024, "2024-09-05")], "season int, cutoff string").withColumn("cutoff", F.to_date("cutoff")))).count() == 1


def test_a_changed_decision_raises(spark):
    rows = spark.createDataFrame([(k, float(e)) for k in "ab" for e in range(30)], "k string, error double")
    from opportunity.stats import conformal_radius

    radii = conformal_radius(rows, ["k"], "error")
    quality.assert_no_differences(quality.radius_differences(rows, radii, ["k"], "error"), "radius")
    changed = radii.withColumn("radius", F.when(F.col("k") == "a", 1.0).otherwise(F.col("radius")))
    with pytest.raises(QualityError, match="radius"):
        quality.assert_no_differences(quality.radius_differences(rows, changed, ["k"], "error"), "radius")


def csv(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_projections_have_neutral_defaults(spark, tmp_path):
    rows = {r.player_id: r for r in readers.read_projections(spark, csv(tmp_path, "p.csv", "player_id,name,position,team,bye_week,receptions,upside_rating,injury_risk", "a,Ann,def,kc,7,4.5,0.9,", "b,Bo,WR,lv,,,,0.2")).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.position, a.team, a.bye_week, a.receptions, a.upside_rating, a.injury_risk, a.role_security, a.adp) == ("DST", "KC", 7, 4.5, 0.9, 0.0, 0.5, None)
    assert (b.bye_week, b.receptions, b.upside_rating, b.injury_risk, b.passing_yards, b.projected_points) == (None, 0.0, 0.5, 0.2, 0.0, None)
    head = "player_id,name,position,team,bye_week,upside_rating,floor_points,ceiling_points"
    for bad in ("a,,QB,KC,,,,", "a,A,QB,KC,19,,,", "a,A,QB,KC,,1.5,,", "a,A,QB,KC,x,,,", "a,A,OL,KC,,,,", "a,A,QB,KC,,,9,8"):
        with pytest.raises(QualityError):
            readers.read_projections(spark, csv(tmp_path, f"bad{abs(hash(bad))}.csv", head, bad))
    for lines in (("player_id,name,team", "a,A,KC"), (head + ",shoe", "a,A,QB,KC,,,,,9"), (head,), (head, "a,A,QB,KC,,,,", "a,B,QB,KC,,,,")):
        with pytest.raises(QualityError):
            readers.read_projections(spark, csv(tmp_path, f"t{abs(hash(lines))}.csv", *lines))


def test_team_profiles_and_the_neutral_one(spark, tmp_path):
    profiles = readers.read_team_profiles(spark, csv(tmp_path, "t.csv", "team,pace_rating,continuity_rating", "kc,0.8,"))
    players = spark.createDataFrame([("a", "KC"), ("b", "LV")], "player_id string, team string")
    got = {r.player_id: (r.pace_rating, r.continuity_rating, r.pass_volume_rating) for r in readers.with_profiles(players, profiles).collect()}
    assert got == {"a": (0.8, 0.5, 0.5), "b": (0.5, 0.5, 0.5)}
    for lines in (("team,pace_rating", "kc,1.2"), ("team,pace_rating", ",0.2"), ("team,pace_rating", "kc,0.2", "KC,0.3"), ("pace_rating", "0.5")):
        with pytest.raises(QualityError):
            readers.read_team_profiles(spark, csv(tmp_path, f"p{abs(hash(lines))}.csv", *lines))
