"""Files, schemas, store, and streaming against batch."""

import pytest
from pyspark.sql import functions as F

from rekurve.operators import bleach as bl, ordered as od, tracks as tr
from rekurve.plans.session import shared_scratch
from rekurve.sources import readers as rs, schema as sc, store as st
from rekurve.streaming import live


def test_read_curve_files(spark, tmp_path):
    for name, tau in (("cell_1", 2.0), ("cell_2", 5.0)):
        sub = tmp_path / "group_a"
        sub.mkdir(exist_ok=True)
        (sub / f"{name}.csv").write_text("Time (s),Intensity of region 1,Region 2,Background\n" + "\n".join(f"{i},{100 + i * tau},200,5" for i in range(20)))
    (tmp_path / "group_a" / "~$cell_3.csv").write_text("Time (s),a,b,c\n1,2,3,4\n")
    d = rs.read_curves(spark, str(tmp_path))
    assert {r["curve_id"]: r["n"] for r in d.groupBy("curve_id").agg(F.count("roi1").alias("n")).collect()} == {"group_a/cell_1": 20, "group_a/cell_2": 20}
    assert d.select(rs.subfolder(F.col("path")).alias("g")).distinct().first()["g"] == "group_a"


def test_read_curves_of_many_layouts(spark, tmp_path):
    """The same name in two folders, swapped columns, motion columns in one file, no header, a value that is no number; one plan for all."""
    body = lambda f: "\n".join(f(i) for i in range(12))
    for folder, text in (
        ("a", "Time (s),Region 1,Region 2,Background\n" + body(lambda i: f"{i},{100 + i},200,5")),
        ("b", "Background,Region 2,Displacement,Region 1,Seconds\n" + body(lambda i: f"6,300,0.{i},{500 + i},{i * 2}") + "\n\n7,300,x,oops,99"),
        ("c/d", body(lambda i: f"{i},{700 + i},400,8") + "\n"),
        ("e", "one,two,three,four,five\n" + body(lambda i: f"{i},{900 + i},500,\"9\",0")),
    ):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "cell.csv").write_text(text)
    d = rs.read_curves(spark, str(tmp_path))
    assert d.columns == ["path", "time", "roi1", "roi2", "roi3", "displacement", "curve_id"]
    got = {}
    for r in d.collect():
        got.setdefault(r.curve_id, []).append((r.time, r.roi1, r.roi2, r.roi3, r.displacement))
    assert sorted(got["a/cell"]) == [(i, 100 + i, 200, 5, None) for i in range(12)]
    assert sorted(got["b/cell"], key=lambda r: r[0]) == [(2 * i, 500 + i, 300, 6, f"0.{i}") for i in range(12)] + [(99, None, 300, 7, "x")]
    assert sorted(got["c/d/cell"]) == [(i, 700 + i, 400, 8, None) for i in range(12)]  # its first line is a row
    assert sorted(got["e/cell"]) == [(i, 900 + i, 500, 9, None) for i in range(12)]  # by position
    (tmp_path / "e" / "bad.csv").write_text("time,what\n1,2\n")
    with pytest.raises(Exception, match="can't be told"):
        rs.read_curves(spark, str(tmp_path)).collect()


def test_alias_rules():
    assert sc.resolve_columns(["Elapsed sec", "Bleach", "Control", "background"]) == {"time": "Elapsed sec", "roi1": "Bleach", "roi2": "Control", "roi3": "background"}
    assert sc.resolve_columns(["a", "b", "c", "d", "e"])["roi3"] == "d"  # by position
    with pytest.raises(ValueError):
        sc.resolve_columns(["time", "roi1"], exact=True)


def test_store_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("e1", 1, 0.5, None), ("e2", 2, None, True)], "exp_id string, cell_id int, k double, ok boolean")
    st.save_table(d, str(tmp_path / "f"), "both")
    for fmt in ("parquet", "csv"):
        assert sorted(st.load_table(spark, str(tmp_path / "f"), fmt, d.schema).collect()) == sorted(d.collect())
    assert not sc.validate(d, sc.FEATURES)[0] and sc.validate(spark.createDataFrame([], sc.TRACES), sc.TRACES)[0]


def test_arrays_in_chunks(spark):
    d = spark.range(25).select(F.lit("c").alias("curve_id"), F.col("id").alias("frame"), (F.col("id") * 1.0).alias("t"), (F.col("id") * 2.0).alias("y"))
    got = st.collect_curves(d, ["curve_id"], chunk=10)
    assert sorted(len(r["t"]) for r in got.collect()) == [5, 10, 10]


def test_name_rules(spark):
    d = spark.createDataFrame([("Wild_type_FOV-12", "Laser IR"), ("mutant", "plain")], "name string, grp string")
    r = d.select(rs.field_of_view(F.col("name")).alias("fov"), rs.keyword_group(F.col("name"), {"wt": ["wild"], "mut": ["mut"]}).alias("g"), rs.bleach_radius(F.col("grp")).alias("w")).collect()
    assert [tuple(x) for x in r] == [(12, "wt", pytest.approx(1.44)), (None, "mut", pytest.approx(0.72))]


def frames(spark, path, batches, rows):
    for i in range(batches):
        spark.createDataFrame([r for r in rows if r[0] % batches == i or batches == 1], "part long, curve_id long, us long, event_id long, y double").coalesce(1).write.mode("append").parquet(path)


def test_live_bleach_over_several_batches(spark):
    path = shared_scratch(spark, "test")
    rows = [(us // 10, c, us, us, (100.0 if us < 14 + c else 20.0) + us * 0.1) for c in range(4) for us in range(30)]
    schema = "part long, curve_id long, us long, event_id long, y double"
    for p in range(3):
        spark.createDataFrame([r for r in rows if r[0] == p], schema).coalesce(1).write.mode("append").parquet(path)
    # one file per trigger in arrival order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_available(live.live_bleach(stream.select("curve_id", "us", "event_id", "y")), shared_scratch(spark, "test"))
    batch = bl.bleach_at_drop(od.frame_index(spark.createDataFrame(rows, schema), ["curve_id"], ["us"]))
    assert {(r["curve_id"], r["bleach"]) for r in got.collect()} == {(r["curve_id"], r["bleach"]) for r in batch.collect()} == {(c, 14 + c) for c in range(4)}


def test_live_positions_equal_batch(spark):
    path = shared_scratch(spark, "test")
    d = spark.range(60).select((F.col("id") % 3).alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 0.7 + F.col("id") % 5).alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    d.coalesce(1).write.parquet(path)
    got = live.run_available(live.live_positions(spark.readStream.schema(d.schema).parquet(path)), shared_scratch(spark, "test"))
    batch = tr.kalman(od.frame_index(d, ["track_id"], ["seq"]).drop("seq"))
    r = lambda t: sorted((x["track_id"], x["frame"], round(x["xs"], 9), round(x["ys"], 9), x["flag"]) for x in t.collect())
    assert r(got) == r(batch)


def test_live_positions_of_a_slow_filter(spark):
    """Gains that go on falling for thousands of frames: live and batch still agree."""
    path = shared_scratch(spark, "test")
    d = spark.range(6000).select(F.lit(1).cast("long").alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 0.01 + F.pmod(F.hash("id"), F.lit(100)) / 50).alias("x"), F.sin(F.col("id") / 500).alias("y"))
    d.coalesce(1).write.parquet(path)
    got = live.run_available(live.live_positions(spark.readStream.schema(d.schema).parquet(path), 1e-10, 1e-13), shared_scratch(spark, "test"))
    batch = tr.kalman(od.frame_index(d, ["track_id"], ["seq"]).drop("seq"), 1e-10, 1e-13)
    j = got.select("frame", "xs", "ys").join(batch.select("frame", F.col("xs").alias("xb"), F.col("ys").alias("yb")), "frame")
    r = j.agg(F.count(F.lit(1)), F.max(F.abs(F.col("xs") - F.col("xb"))), F.max(F.abs(F.col("ys") - F.col("yb")))).first()
    assert r[0] == 6000 and r[1] < 1e-8 and r[2] < 1e-8
