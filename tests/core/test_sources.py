"""Readers, writers, the routing server and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from zonewright.functions import geo
from zonewright.operators import assign, distances, graph, relational, spatial
from zonewright.plans import geography
from zonewright.sources import exports, geojson, routing, tables
from zonewright.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_locations(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Latitude,Longitude,Name,Type\n16.1,95.1,Ben B,Client\n16.5,95.5,Hub,Office\n16.2,95.2,12,Client\n")
    rows = tables.read_locations(spark, str(tmp_path / "l.csv")).orderBy("loc_idx").collect()
    assert [(r["loc_idx"], r["id"], r["client_idx"]) for r in rows] == [(0, "hub", -1), (1, "12", 0), (2, "ben_b", 1)]


def test_matrix_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("Client-1", "Client-1", 0.0), ("Client-1", "Main Office", 2.5), ("Main Office", "Client-1", float("inf")), ("Main Office", "Main Office", 0.0)], "i string, j string, km double")
    exports.write_matrix_csv(m.coalesce(1), ["Client-1", "Main Office"], str(tmp_path / "m"))
    rows = {(r["i"], r["j"]): r["km"] for r in tables.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert rows == {("1", "1"): 0.0, ("1", "0"): 2.5, ("0", "1"): None, ("0", "0"): 0.0}


def test_matrix_must_be_square(spark, tmp_path):
    (tmp_path / "m.csv").write_text("x,a,b\na,0,1\n")
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "m.csv"))


def test_wards_of_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    ell = [[[2, 0], [4, 0], [4, 1], [3, 1], [3, 2], [2, 2], [2, 0]]]
    def feature(kind, c, **p):
        return {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    doc = {"type": "FeatureCollection", "features": [feature("Polygon", square, VT_PCODE="A", VT="One"), feature("MultiPolygon", [ell, square], VT_PCODE="B"), feature("Point", [1, 2], VT_PCODE="C")]}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    good, bad = geojson.read_wards(spark, str(tmp_path / "w.json"))
    rows = {r["pcode"]: r for r in good.collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["township"] == "UNKNOWN" and len(rows["B"]["rings"]) == 2 and [r["pcode"] for r in bad.collect()] == ["C"]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 2.5), (3, 1.5, 3.5), (4, 9.0, 9.0)], "client_idx long, lat double, lon double")
    mapped = spatial.map_clients(points, good, 1.0)
    assert {r["client_idx"]: r["pcode"] for r in mapped.collect()} == {1: "A", 2: "B", 3: None, 4: None}
    fixed = {r["client_idx"]: r for r in spatial.fix_unmapped(mapped, good, 1.0).collect()}
    assert fixed[3]["pcode"] == "B" and fixed[3]["distance_to_ward"] == pytest.approx(0.5) and fixed[3]["was_unmapped"] and not fixed[1]["was_unmapped"]


def test_features(spark):
    df = spark.createDataFrame([(1, 16.0, 95.0)], "id int, lat double, lon double")
    out = json.loads(geojson.features(df).first()["value"])
    assert out["geometry"] == {"type": "Point", "coordinates": [95.0, 16.0]} and out["properties"] == {"id": 1}


def test_corners_that_touch_share_no_border(spark):
    def ward(o, p, x, y, s=1.0):
        ring = [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
        return (o, p, p, "T", "T", [ring])
    df = spark.createDataFrame([ward(0, "A", 0.0, 0.0), ward(1, "B", 1.0, 0.5), ward(2, "C", 1.0, 1.5), ward(3, "D", -1.0, -1.0)], spark.createDataFrame([], "ord int, pcode string, name string, township string, township_pcode string, rings array<array<struct<x:double,y:double>>>").schema)
    rows = {(r["src"], r["dst"]): r["border_length_km"] for r in spatial.borders(df).collect()}
    assert rows == {("A", "B"): pytest.approx(55.0), ("B", "C"): pytest.approx(110.0)}


def test_adjacency_is_kept_without_roads(spark, tmp_path):
    path = str(tmp_path / "adj")
    assert exports.load_adjacency(spark, path) is None
    exports.save_adjacency(spark.createDataFrame([("a", "b", 1.0, 9.0)], "src string, dst string, border_length_km double, score double"), path)
    assert exports.load_adjacency(spark, path).columns == ["src", "dst", "border_length_km"]


def test_json_export(spark, tmp_path):
    locations = spark.createDataFrame([(0, "hub", 1.0, 2.0, "Office")], "loc_idx int, name string, lat double, lon double, type string")
    matrix = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 2.0, 2.6), (1, 0, 2.0, 2.6), (1, 1, 0.0, float("inf"))], "i int, j int, km double, road_km double")
    locations = locations.unionByName(spark.createDataFrame([(1, "a", 1.0, 2.1, "Client")], locations.schema))
    exports.write_matrices_json(locations, matrix, str(tmp_path / "e"))
    row = spark.read.json(str(tmp_path / "e")).first()
    assert row["metadata"]["total_locations"] == 2 and row["road_distance_matrix"] == [[0.0, 2.6], [2.6, None]] and [x["name"] for x in row["locations"]] == ["hub", "a"]
    exports.write_matrices_json(locations, matrix, str(tmp_path / "l"), lines=True)
    rows = {r["loc_idx"]: r for r in spark.read.json(str(tmp_path / "l")).collect()}
    assert rows[1]["euclidean_distances"] == [2.0, 0.0] and len(rows) == 2


def test_workbooks(spark, tmp_path):
    import zipfile
    from datetime import datetime

    from zonewright.schema import VISIT
    from zonewright.sources import workbook

    head = ["client_id", "village_latitude", "due_date", "Branch", "assigned_loan_officer_id"]
    day = workbook.day_number(datetime(2024, 3, 5, 12))
    shared = "".join(f"<si><t>{x}</t></si>" for x in [*head, "North &amp; East"])
    cells = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDE"))
    rows = f'<row r="1">{cells}</row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>16.25</v></c><c r="C2"><v>{day}</v></c><c r="D2" t="s"><v>5</v></c></row>'
    rows += '<row r="3"><c r="A3"><v>8</v></c><c r="D3" t="inlineStr"><is><t>South</t></is></c><c r="E3"><v>3</v></c></row>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "v.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    got = tables.read_visits(spark, str(tmp_path / "v.xlsx")).orderBy("client_id").collect()
    assert [(r["client_id"], r["client_latitude"], r["branch"], r["officer_id"]) for r in got] == [(7, 16.25, "North & East", None), (8, None, "South", 3)]
    assert got[0]["due_date"] == datetime(2024, 3, 5, 12) and got[1]["due_date"] is None
    assert workbook.read_sheet(spark, str(tmp_path / "v.xlsx"), VISIT, "S").count() == 2
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_sheet(spark, str(tmp_path / "v.xlsx"), VISIT, "T").count()


def answers(url, timeout):
    if "/table/" in url:
        n = url.split("sources=")[1].split("&")[0].count(";") + 1
        m = url.split("destinations=")[1].split("&")[0].count(";") + 1
        if n == 1:
            raise TimeoutError
        return {"code": "Ok", "distances": [[1500.0] * m] * n}
    return {"code": "Ok", "routes": [{"distance": 2000.0, "geometry": {"coordinates": [[95.0, 16.0], [95.1, 16.1]]}}]}


def test_routing_in_blocks(spark):
    rows = spark.createDataFrame([(1, i, 16.0 + i / 10, 95.0) for i in range(5)], "branch long, loc_idx long, lat double, lon double")
    got = routing.road_matrix(rows, "http://none", block=2, get=answers, pause=0.0).collect()
    assert len(got) == 20 and {r["road_km"] for r in got} == {1.5} and {r["i"] for r in got} == {0, 1, 2, 3}
    half = distances.pairs(rows.withColumnRenamed("loc_idx", "client_idx"))
    known = distances.with_road(half, routing.road_matrix(rows, "http://none", block=2, get=answers, pause=0.0))
    filled = {(r["i"], r["j"]): r for r in known.collect()}
    assert filled[(0, 1)]["road_km"] == 1.5 and len(filled) == 10


def test_locations_are_dealt_in_parts(spark):
    """A location goes to the tasks 2 * PARTS times at most, not once for every request it is in."""
    rows = spark.createDataFrame([(b, i + 3, 16.0 + i / 100, 95.0) for b, n in ((1, 57), (2, 3)) for i in range(n)], "branch long, loc_idx long, lat double, lon double")
    sent = routing.dealt(rows, 2).collect()
    assert sum(len(r["sources"]) + len(r["targets"]) for r in sent if r["branch"] == 1) <= 57 * 2 * routing.PARTS
    assert sorted(len(r["sources"]) for r in sent if r["branch"] == 2) == [1, 1, 2, 2]

    def by_number(url, timeout):
        where, _, rest = url.rpartition("/")[2].partition("?")
        lat = [float(p.split(",")[1]) for p in where.split(";")]
        own, other = ([lat[int(k)] for k in part.split("=")[1].split(";")] for part in rest.split("&")[:2])
        assert len(own) <= 2 and len(other) <= 2
        return {"code": "Ok", "distances": [[None if a == b else 1000 * (100 * a + b) for b in other] for a in own]}

    got = {(r["branch"], r["i"], r["j"]): r["road_km"] for r in routing.road_matrix(rows, "http://none", block=2, get=by_number).collect()}
    lat = [16.0 + i / 100 for i in range(57)]
    assert got == {(b, i + 3, j + 3): None if i == j else pytest.approx(100 * lat[i] + lat[j]) for b, n in ((1, 57), (2, 3)) for i in range(n) for j in range(n)}


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(x.totalShuffleWrite() for x in _scala(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def _scala(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def test_parts_are_sent_once_for_both_ways(spark):
    """Many branches have few parts each, so what is shuffled is a few times the locations (20 times before)."""
    rows = spark.range(50_000).select((F.col("id") % 25).alias("branch"), F.floor(F.col("id") / 25).alias("loc_idx"), F.rand(1).alias("lat"), F.rand(2).alias("lon"))
    before = _shuffled(spark)
    pairs = routing.dealt(rows, 20).select(F.size("sources").cast("long").alias("a"), F.size("targets").alias("b")).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert pairs == 25 * 2_000**2
    assert _shuffled(spark) - before < 8 * 50_000 * 24


def test_a_large_branch_has_more_parts(spark):
    """One branch with nearly all pairs is dealt to as many tasks as if it were alone."""
    rows = spark.createDataFrame([(b, i) for b in range(200) for i in range(2_000 if b == 7 else 3)], "branch long, loc_idx long").withColumns({"lat": F.lit(16.0), "lon": F.lit(95.0)})
    sent = routing.dealt(rows, 1).select("branch", F.size("sources").alias("a"), F.size("targets").alias("b")).collect()
    assert sum(r["a"] * r["b"] for r in sent) == 2_000**2 + 199 * 9
    assert max(r["a"] * r["b"] for r in sent) <= 2_000**2 / routing.PARTS**2
    assert sum(r["branch"] != 7 for r in sent) == 199


def test_numbers_with_gaps(spark):
    """Any two locations of a branch meet once each way, in order, whatever parts are empty; none without a branch."""
    numbers = [-1_000, -7, 0, 1, 2, 500, 501, 9_999, None]
    rows = spark.createDataFrame([(b, i, 16.0, 95.0) for b in (1, None) for i in numbers] + [(2, None, 16.0, 95.0)], "branch long, loc_idx long, lat double, lon double")
    sent = [(r["branch"], [p["loc_idx"] for p in r["sources"]], [p["loc_idx"] for p in r["targets"]]) for r in routing.dealt(rows, 3).collect()]
    assert sorted(((b, i, j) for b, x, y in sent for i in x for j in y), key=str) == sorted([(1, i, j) for i in numbers for j in numbers] + [(2, None, None)], key=str)
    assert all(x == sorted(x, key=lambda i: -math.inf if i is None else i) for _, *both in sent for x in both)


def test_short_answers_and_missing_numbers(spark):
    rows = spark.createDataFrame([(1, i, 16.0, 95.0) for i in (-1, 0, 1, None)], "branch long, loc_idx long, lat double, lon double")

    def short(url, timeout):
        n = url.split("sources=")[1].split("&")[0].count(";") + 1
        return {"code": "Ok", "distances": [[1000.0]] * n}

    got = sorted([(r["i"], r["j"], r["road_km"]) for r in routing.road_matrix(rows, "http://none", block=2, get=short).collect()], key=str)
    whole = [(i, j, 1.0) for i in (-1, 0, 1, None) for j in (-1, 0, None)]
    assert got == sorted(whole, key=str)


def test_requests_are_tried_again():
    calls = []

    def failing(url, timeout):
        calls.append(url)
        raise ConnectionError

    assert routing.ask("x", failing, tries=3, pause=0.0) is None and len(calls) == 3
    assert routing.ask("x", lambda u, t: {"code": "NoRoute"}) is None


def test_routes_and_the_way_back(spark):
    pairs = spark.createDataFrame([(1, 2, 16.0, 95.0, 16.1, 95.1)], "i long, j long, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = {r["i"]: r for r in routing.with_mirror(routing.routes(pairs, "http://none", answers)).collect()}
    assert rows[1]["road_km"] == 2.0 and rows[2]["route"] == rows[1]["route"][::-1]


def test_no_fallback_raises(spark):
    half = spark.createDataFrame([(1, 1, 2, 3.0)], "branch long, i long, j long, km double")
    with pytest.raises(Exception, match="no road distance"):
        distances.with_road(half, fallback=False).collect()


def test_symmetrised(spark):
    m = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.0), (2, 1, 4.0), (2, 2, 0.0)], "i int, j int, road_km double")
    assert {(r["i"], r["j"]): r["road_km"] for r in distances.symmetrised(m, []).collect()} == {(1, 1): 0.0, (1, 2): 3.0, (2, 1): 3.0, (2, 2): 0.0}


def test_route_similarity(spark):
    def route(k):
        return [{"lat": 16.0 + (0 if i < k else 1), "lon": 95.0 + i} for i in range(10)]
    rows = [(k, route(10), route(k)) for k in (0, 4, 10)] + [(0, route(10), [])]
    df = spark.createDataFrame(rows, "k int, a array<struct<lat:double,lon:double>>, b array<struct<lat:double,lon:double>>")
    same = spark.createDataFrame([([(float(i), 1.0) for i in range(5)], [(float(i + (i > m)), 1.0) for i in range(5)], m + 1) for m in range(-1, 5)], "a array<struct<lat:double,lon:double>>, b array<struct<lat:double,lon:double>>, n int")
    assert all(r[0] == r[1] == min(5, r[2]) / 5 for r in same.select(geo.route_similarity(F.col("a"), F.col("b")), geo.fixed_route_similarity(F.col("a"), F.col("b"), 5), "n").collect())
    assert [(r[0], r[1]) for r in df.select("k", geo.route_similarity(F.col("a"), F.col("b"))).collect()] == [(0, 0.0), (4, 0.4), (10, 1.0), (0, 0.0)]


def test_client_graph_stops_at_the_allowance(spark):
    row = spark.createDataFrame([(a, b) for a, b in zip("ABCD", "BCDE")], "src string, dst string")
    held = spark.createDataFrame([("A",), ("C",), ("E",)], "pcode string")
    edges = graph.undirected(row)
    assert graph.client_graph(edges, held, 0).count() == 0
    assert {(r[0], r[1]) for r in graph.client_graph(edges, held, 1).collect()} == {("A", "C"), ("C", "A"), ("C", "E"), ("E", "C")}
    assert graph.client_graph(edges, held, 3).count() == 4


def test_best_solutions(spark):
    df = spark.createDataFrame([(1, 5.0, [0, 1]), (2, 5.00001, [0, 1]), (3, 4.0, [1, 1]), (4, 5.0, [1, 0])], "seq int, loss double, labels array<int>")
    assert [r["seq"] for r in relational.unique_solutions(df, 2).orderBy("rank").collect()] == [3, 1]


def test_daily_locations_keep_the_office(spark):
    rows = [(1, 16.0, 95.0), (2, 16.0, 95.0), (3, 16.5, 95.5)]
    visits = spark.createDataFrame([(i, a, o, "b", 16.5, 95.5) for i, a, o in rows], "client_id long, client_latitude double, client_longitude double, branch string, latitude_branch double, longitude_branch double").withColumn("due_date", F.lit("2024-02-01").cast("timestamp"))
    assert sorted(r["name"] for r in tables.daily_locations(visits).collect()) == ["1", "3", "Main Office"]


def test_furthest_first_agrees_with_the_kernel(spark):
    import pandas as pd

    from zonewright.operators import partition

    rows = geography.clients(spark, SF).filter("branch in (1, 2)")
    both = distances.mirrored(distances.with_road(distances.pairs(rows)))
    got = {(r["branch"], r["seed"]): r["client_idx"] for r in assign.furthest_first(rows, both, 3).collect()}
    for branch in (1, 2):
        t = partition.Territory(rows.filter(f"branch = {branch}").toPandas())
        assert [got[(branch, s)] for s in range(3)] == [t.idx[i] for i in partition.spread_seeds(t, 3)]


def test_kmedoids_of_frames_and_kernel_agree(spark):
    from zonewright.operators import partition

    rows = geography.clients(spark, SF).filter("branch = 1")
    both = distances.mirrored(distances.with_road(distances.pairs(rows)))
    labels = {r["client_idx"]: r["label"] for r in assign.kmedoids(rows, both, 2).collect()}
    t = partition.Territory(rows.toPandas())
    assert labels == dict(zip(t.idx.tolist(), partition.kmedoids(t, 2).tolist()))


def test_stream_agrees_with_batches(spark, tmp_path):
    labelled = geography.clients(spark, SF).withColumn("label", (F.col("client_idx") % 5).cast("int"))
    new = geography.new_clients(spark, SF).withColumn("office_km", F.lit(1.0))
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    rule = lambda batch, known: assign.assign_new_mean(batch, known, 5)
    arrivals.assign_stream(stream, labelled, rule, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["client_idx"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["client_idx"]: r["label"] for r in rule(new, labelled).collect()} and got


def test_nearest_ward_of_far_points_and_of_none(spark):
    points = spark.createDataFrame([(1, 16.05, 900.0), (2, None, 95.0), (3, -70.0, 95.01), (4, 16.04, 96.1)], "client_idx long, lat double, lon double")
    near = {r["client_idx"]: r for r in spatial.nearest_ward(points, geography.wards(spark), geography.CELL).collect()}
    assert set(near) == {1, 3, 4} and near[1]["pcode"] == "W009" and near[3]["pcode"] == "W000" and near[4]["pcode"] == "W009"
    assert near[1]["distance_to_ward"] == pytest.approx(900 - 95.95)
    none = spatial.nearest_ward(points, geography.wards(spark).limit(0), geography.CELL).collect()
    assert len(none) == 4 and all(r["pcode"] is None for r in none)


def test_ancestors_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(300)], "node string, parent string")
    rows = graph.ancestors(tree)
    assert rows.count() == 300 * 301 // 2 and rows.filter("node = '299' and ancestor = '0'").first()["distance"] == 299


@pytest.mark.parametrize("k", [1, 4, 40])
def test_nearest_clients_agree_with_all_pairs(spark, k):
    """Crowds, lone points and a branch of two clients; k above a branch's size gives all others."""
    points = [(0, i, 16 + (i * 7919 % 97) / 900, 95 + (i * 104729 % 89) / 900) for i in range(60)] + [(0, 100, 19.5, 98.0), (0, 101, 16.0, 60.0)]
    points += [(1, 200, 16.0, 95.0), (1, 201, 16.0, 95.0), (2, 300, 16.0, 95.0), (0, 400, None, None)]
    df = spark.createDataFrame(points, "branch int, client_idx long, lat double, lon double")
    got = {(r["branch"], r["i"], r["rank"]): (r["j"], r["road_km"]) for r in spatial.nearest_clients(df, k).collect()}
    both = distances.mirrored(distances.with_road(distances.pairs(df.filter("lat is not null"))))
    expected = {(r["branch"], r["i"], r["rank"]): (r["j"], r["road_km"]) for r in spatial.knn(both, k).collect()}
    assert got.keys() == expected.keys() and all(got[x][0] == expected[x][0] for x in got)
    among = spatial.nearest_clients(df, 1, among=df.filter("client_idx in (3, 100)")).collect()
    assert {r["j"] for r in among} == {3, 100} and len(among) == 62
    assert spatial.nearest_clients(df, 1, among=df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_in_blocks(spark, block):
    df = spark.createDataFrame([(b, 100 * b + i, 16.0 + i, 95.0) for b, n in ((0, 30), (1, 1), (2, 9)) for i in range(n)], "branch int, client_idx long, lat double, lon double")
    rows = [(r["branch"], r["i"], r["j"]) for r in distances.pairs(df, block=block).collect()]
    assert len(rows) == len(set(rows)) == 30 * 29 // 2 + 36 and all(i < j for _, i, j in rows)
