import pytest
from pyspark.sql import functions as F

from crosstie.geo.shapes import segments_from_vertices
from crosstie.sources import features, store, tables


def test_csv_schema_and_overrides(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, "2.5", "x"), (2, "n/a", "y")], "id bigint, v string, t string").coalesce(1).write.option("header", True).csv(path)
    fixed = tables.read_table_csv(spark, path, overrides={"v": "double"})
    assert {(r.id, r.v) for r in fixed.collect()} == {(1, 2.5), (2, None)}
    typed = tables.read_table_csv(spark, path, "id bigint, v string, t string")
    assert typed.dtypes == [("id", "bigint"), ("v", "string"), ("t", "string")]


def test_directory_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,007\n")
    (tmp_path / "b.csv").write_text("y,k\nz,2\n")
    (tmp_path / "c.csv").write_text("k,x\n3,\n")
    out = tables.read_dir_strings(spark, str(tmp_path))
    assert sorted(((r.k, r.x, r.y) for r in out.collect()), key=str) == [("1", "007", None), ("2", None, "z"), ("3", None, None)]


def test_pruned_scan_reads_only_kept_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).selectExpr("id", "id * 2 AS b", "'t' AS c").write.option("header", True).csv(path)
    df = tables.read_csv_pruned(spark, path, {"b": "double"}, ["id", "b", "c"])
    assert sorted(r.b for r in df.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:double>" in plan


def test_geojson_lines_polygons_and_collections(spark, tmp_path):
    df = spark.sql("""SELECT 5 AS id, array(struct(0D AS x, 0D AS y), struct(1D AS x, 2D AS y)) AS points,
        array(array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 1D AS y))) AS rings""")
    for kind, shape in ((features.LINE, "points"), (features.POLYGON, "rings")):
        path = str(tmp_path / kind)
        features.write_geojson(df, path, kind, ["id"])
        back = features.read_geojson(spark, path, kind, "id: int")
        assert back.first()[shape] == df.first()[shape] and back.first().id == 5
    one = tmp_path / "all.json"
    one.write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", '
                   '"coordinates": [1.5, 2.5]}, "properties": {"id": 1}}, {"type": "Feature", "geometry": '
                   '{"type": "Point", "coordinates": [3, 4]}, "properties": {"id": 2}}]}')
    pts = features.read_geojson(spark, str(one), features.POINT, "id: int", collection=True)
    assert sorted((r.id, r.x, r.y) for r in pts.collect()) == [(1, 1.5, 2.5), (2, 3.0, 4.0)]


def test_store(spark, tmp_path):
    store.checkpoint({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path))
    assert store.restore(spark, str(tmp_path), "b").agg(F.count("id")).first()[0] == 4


def test_long_lines_are_exported_in_parts(spark):
    vertices = spark.range(11).selectExpr("7 AS line_id", "id AS seq", "CAST(id AS DOUBLE) AS x", "0D AS y")
    parts = {r.part: [p.x for p in r.points] for r in features.lines_from_vertices(vertices, most_points=5).collect()}
    assert parts == {0: [0, 1, 2, 3, 4, 5], 1: [5, 6, 7, 8, 9, 10]}


@pytest.mark.parametrize("interchange", [False, True])
def test_long_lines_come_back_whole(spark, tmp_path, interchange):
    vertices = spark.range(25_000).selectExpr("7L AS line_id", "id AS seq", "CAST(id AS DOUBLE) AS x", "id * 0.5D AS y")
    short = spark.sql("SELECT 8L AS line_id, CAST(id AS BIGINT) AS seq, 1D AS x, id * 2D AS y FROM range(10001)")
    vertices, path = vertices.unionByName(short), str(tmp_path / "lines")
    lines = features.lines_from_vertices(vertices)
    if interchange:
        features.write_geojson(lines, path, features.LINE, ["line_id", "first_seq"])
        back = features.read_geojson(spark, path, features.LINE, "line_id: bigint, first_seq: bigint")
    else:
        features.write_features(lines, path)
        back = features.read_features(spark, path)
    assert back.select(F.max(F.size("points"))).first()[0] <= 10_001 and back.count() == 4
    whole = features.vertices_from_lines(back)
    assert whole.count() == vertices.count() and whole.exceptAll(vertices.select(whole.columns)).isEmpty()
    segments = features.segments_from_lines(back)
    expected = segments_from_vertices(vertices).select(segments.columns)
    assert segments.count() == 24_999 + 10_000 and segments.exceptAll(expected).isEmpty()


def test_headers_are_found_in_one_job(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f{i:03d}.csv").write_text(f"k,{'xy'[i % 2]}\n{i},v\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "late.csv").write_text("\nk,z\n900,w\n")
    (tmp_path / "only.csv").write_text("k,x\n")
    assert tables.first_lines(spark, str(tmp_path)).count() == 202
    out = tables.read_dir_strings(spark, str(tmp_path))
    assert sorted(out.columns) == ["k", "x", "y", "z"]
    rows = {r.k: (r.x, r.y, r.z) for r in out.collect()}
    assert len(rows) == 201 and rows["4"] == ("v", None, None) and rows["5"] == (None, "v", None) and rows["900"] == (None, None, "w")


def test_folder_without_tables(spark, tmp_path):
    assert tables.read_dir_strings(spark, str(tmp_path)).columns == []
    (tmp_path / "a.csv").write_text("")
    out = tables.read_dir_strings(spark, str(tmp_path))
    assert out.columns == [] and out.count() == 0


def test_first_lines_hold_and_sort_no_lines(spark, tmp_path):
    """The best value by a number is no plain aggregate of texts, which would sort every line of a task."""
    for i in range(40):
        lines = "".join(f"{i},{j}\n" for j in range(500))
        (tmp_path / f"f{i:02d}.csv").write_text("\n" * (i % 3) + f"k,{'xyz'[i % 3]}\n" + lines)
    (tmp_path / "long.csv").write_text("k,x\n" + "9,9\n" * 20000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = tables.first_lines(spark, str(tmp_path))
        got = {r.path.rsplit("/", 1)[1]: r.first_line for r in found.collect()}
        assert got == {f"f{i:02d}.csv": f"k,{'xyz'[i % 3]}" for i in range(40)} | {"long.csv": "k,x"}
        assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
        assert tables.read_dir_strings(spark, str(tmp_path)).count() == 40 * 500 + 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
