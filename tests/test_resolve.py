import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import forest, resolve, tracks


def test_ids_closure_and_merge(spark):
    rows = [("e1", "ship", "A", None, None, 0.5, True, {"flag": "NO"}, "111", None), ("e2", "ship", None, 1.0, 2.0, 0.9, True, {"flag": "SE", "imo": "7"}, "111", "abc"),
            ("e3", "ship", "C", 5.0, 6.0, 0.2, True, {}, None, "abc"), ("e4", "plane", "D", None, None, 0.1, True, None, "111", ""), ("e5", "ship", "E", None, None, 0.3, True, {}, "", "")]
    ents = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, lat double, lon double, confidence double, is_active boolean, properties map<string,string>, mmsi string, icao string")
    links = resolve.match_ids(ents, ("mmsi", "icao"))
    assert sorted((r.a, r.b, r.field, r.confidence) for r in links.collect()) == [("e2", "e1", "mmsi", 1.0), ("e3", "e2", "icao", 1.0)]
    canon = resolve.closure(links)
    assert sorted(map(tuple, canon.collect())) == [("e1", "e1"), ("e2", "e1"), ("e3", "e1")]
    out = {r.entity_id: r for r in resolve.merge(ents, canon).collect()}
    assert len(out) == 5 and (out["e1"].name, out["e1"].lat, out["e1"].confidence, out["e1"].properties) == ("A", 1.0, 0.9, {"flag": "NO", "imo": "7"})
    assert [out[k].is_active for k in ("e1", "e2", "e3", "e4", "e5")] == [True, False, False, True, True] and out["e2"].canonical_id == "e1" and out["e2"].confidence == 0.9
    said = spark.createDataFrame([("e2", "e1", True, 1), ("e1", "e2", False, 2), ("e5", "e4", True, 1)], "a string, b string, confirmed boolean, ts int")
    assert sorted(map(tuple, resolve.feedback(links, said).collect())) == [("e3", "e2"), ("e5", "e4")]


def test_closure_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(400):03}", f"n{rng.randrange(400):03}") for _ in range(260)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("q", "q")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for x in list(parent)}
    got = resolve.closure(spark.createDataFrame(pairs, "a string, b string"))
    rows = got.collect()
    assert len(rows) == len(want) and {r.entity_id: r.canonical_id for r in rows} == want
    assert resolve.closure(spark.createDataFrame([], "a string, b string")).collect() == []


def test_screen_in_three_stages(spark):
    names = spark.createDataFrame([("i", "Unknown", "123-456", None), ("x", "blue, star", None, None), ("f", "Golden Horizn", None, None), ("s", "LEE", None, None), ("n", None, None, " ")], "entity_id string, name string, mmsi string, imo string")
    listed = resolve.read_list(spark.createDataFrame([(1, "Red Sun", "Blue Star; Azure", "123456", None), (2, "Golden Horizon", None, None, None), (3, "Lees", "", None, None), (4, "Blue Stair", None, None, None)], "list_id int, list_name string, aliases string, mmsi string, imo string"))
    got = {(r.entity_id, r.list_id): (r.score, r.id_match, r.matched, r.risk) for r in resolve.screen(names, listed).collect()}
    assert got == {("i", 1): (100, True, "Red Sun", "confirmed"), ("x", 1): (100, False, "Blue Star", "confirmed"), ("f", 2): (93, False, "Golden Horizon", "probable"), ("s", 3): (75, False, "Lees", "possible")}


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    f = forest.fit(x, trees=50, rows=128)
    got = f.scores(x)

    def depth(tree, row, node=0):
        c = tree["column"][node]
        return tree["depth"][node] if c < 0 else depth(tree, row, tree["left"][node] + int(row[c] >= tree["threshold"][node]))

    for i in (0, 7, 500):
        mean = sum(depth(t, x[i]) for t in f.trees) / 50
        assert math.isclose(got[i], 100 * 2 ** (-mean / forest.usual_depth(128)))
    assert got.argmax() == 500 and got[500] > 60 > got[:500].mean()
    again = forest.Forest.loads(f.dumps(), 3)
    assert (again.scores(x) == got).all() and (f.scores(x[:, :2]) == 0).all()
    with pytest.raises(ValueError):
        forest.Forest.loads(f.dumps(), 4)
    with pytest.raises(ValueError):
        forest.fit(np.zeros((0, 3)))
    assert forest.fit(np.ones((5, 2))).scores(np.ones((1, 2)))[0] >= 0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "k int, a double, b double, c double")
    one = forest.fit_sample(df, ["a", "b", "c"], "k", sample=400, trees=50)
    two = forest.fit_sample(df.repartition(7), ["a", "b", "c"], "k", sample=400, trees=50)
    assert one.dumps() == two.dumps()
    rows = {r.k: r.score for r in forest.score(df, ["a", "b", "c"], one).collect()}
    assert max(rows, key=rows.get) == 500 and rows[999] == 0


def test_features(spark):
    pts = [("a", i, f"2024-01-01 06:{i:02}:00", 10.0, 20.0 + 0.001 * i, 5.0) for i in range(6)]
    rows = spark.createDataFrame(pts, "entity_id string, event_id int, ts string, lat double, lon double, speed double").withColumn("ts", F.to_timestamp("ts"))
    got = tracks.kinematic_features(rows).orderBy("event_id").collect()
    assert [r.event_id for r in got] == [4, 5] and got[0].heading_jerk < 0.01 and got[0].dwell_ratio == 0.25 and got[0].speed_z == 0.0 and got[0].hour_sin == 1.0
