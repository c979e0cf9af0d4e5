import math
import random
import re

import duckdb
import pytest

from tidewatch.functions import geo
from tidewatch.operators import ingest, names as fuzzy, rules, store, tracks
from tidewatch.plans import queries as Q
from tidewatch.plans.ql import Engine, QuerySyntaxError, parse

SF = "/root/testdata/sf0.001"


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_geodesy(spark):
    # a degree along the equator, a quarter of a meridian, half the way round, and no way at all
    degree = 6371.0 * 3.141592653589793 / 180
    for points, degrees in (((0.0, 10.0, 0.0, 11.0), 1), ((0.0, 25.0, 90.0, 25.0), 90), ((0.0, -90.0, 0.0, 90.0), 180), ((12.5, 7.0, 12.5, 7.0), 0)):
        assert abs(value(spark, geo.haversine_km(*points)) - degrees * degree) < 1e-6
    assert value(spark, geo.heading_diff(350.0, 10.0)) == 20
    assert geo.parse_wkt_polygon("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))") == [(0, 0), (0, 10), (10, 10), (10, 0)]


@pytest.mark.parametrize("text", ["", "MATCH (a) RETURN", "MATCH (a) RETURN a.x LIMIT 1.5", "MATCH (a RETURN a.x", "MATCH (a) RETURN a.x nonsense", "MATCH (a) WHERE a.x IN [1 RETURN a.x"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def buoys(spark):
    """Seven buoys along a meridian, a tenth of a degree apart."""
    rows = [(f"b{i}", "Buoy", None if i == 3 else f"n{i}", -10.0 + 0.1 * i, 60.0, 2.5 * i, "red" if i < 3 else "green", "7" if i == 1 else "none") for i in range(7)]
    return spark.createDataFrame(rows, "entity_id string, entity_type string, name string, lat double, lon double, drift double, colour string, code string")


def test_query_language(spark):
    e = Engine(buoys(spark))
    run = lambda q: [tuple(r) for r in e.run(q).collect()]
    assert run("MATCH (s:buoy) WHERE s.drift >= 5 RETURN COUNT(s)") == [(5,)]
    assert run("match (s:Buoy) where s.drift < 5 return count(*)") == [(2,)]
    assert run("MATCH (s:Buoy) RETURN MIN(s.drift) AS a, MAX(s.drift) AS b") == [(0.0, 15.0)]
    assert run("MATCH (s:Buoy) RETURN s.id ORDER BY s.drift DESC LIMIT 2") == [("b6",), ("b5",)]
    assert run('MATCH (s:Buoy {colour: "red"}) RETURN COUNT(*) AS n') == [(3,)]
    assert run("MATCH (s) WHERE s.name IS NULL RETURN s.id") == [("b3",)]
    assert run("MATCH (s) WHERE s.depth IS NULL RETURN COUNT(*) AS n") == [(7,)]
    assert run("MATCH (s:Buoy) WHERE NEAR(s, lat=-10.0, lon=60.0, radius_km=12) RETURN s.id ORDER BY s.id") == [("b0",), ("b1",)]


def test_tolerant_types(spark):
    """Text against a number compares as one; text in a sum is joined; a division by zero is null."""
    e = Engine(buoys(spark))
    run = lambda q: [tuple(r) for r in e.run(q).collect()]
    assert run("MATCH (s) WHERE s.code > 5 RETURN s.id") == [("b1",)]
    assert run("MATCH (s) WHERE 7 = s.code RETURN s.id") == [("b1",)]
    assert run('MATCH (s) WHERE s.drift = "none" RETURN s.id') == []
    assert run('MATCH (s) WHERE s.drift = "5" RETURN s.colour + "-" + s.code AS x, s.drift / 0 AS y, s.drift % 0 AS z, s.code * 2 AS w') == [("red-none", None, None, None)]


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "entity_id string, last_updated int, name string")
    new = spark.createDataFrame([("a", 3, "y"), ("c", 1, "z")], now.schema)
    once = store.upsert(now, new)
    want = [("a", 3, "y"), ("b", 2, None), ("c", 1, "z")]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in store.upsert(once, new).collect()) == want


def test_anchored_window_does_not_slide(spark):
    rows = spark.sql("select id as event_id, 1 as k, timestamp_seconds(id * 40) as ts from range(6)")
    assert [r[0] for r in rules.anchored_dedup(rows, ["k"], 100).orderBy("event_id").select("event_id").collect()] == [0, 3]


def test_audit_chain(spark):
    rows, before = [], ""
    import hashlib

    for i in range(20):
        h = hashlib.sha256(f"{before}|{i}|op".encode()).hexdigest()
        rows.append((i, "op", before, h))
        before = h
    log = spark.createDataFrame(rows, "seq long, op string, previous_hash string, content_hash string")
    assert rules.verify_chain(log, ["seq", "op"]).count() == 0
    rows[7] = (7, "forged", *rows[7][2:])
    bad = spark.createDataFrame(rows, log.schema)
    assert [r[0] for r in rules.verify_chain(bad, ["seq", "op"]).collect()] == [7]


def test_fuzzy_screen_of_short_names(spark):
    names = spark.createDataFrame([("a", "LEE"), ("b", "lee."), ("c", "Wu"), ("d", ""), ("e", None), ("f", "LEES")], "entity_id string, name string")
    listed = spark.createDataFrame([(1, "Lees"), (2, "LEE"), (3, "Somebody"), (4, "Wux")], "list_id long, list_name string")
    got = sorted((r[0], r[1], r[2]) for r in rules.fuzzy_screen(names, listed).select("entity_id", "list_id", "score").collect())
    assert got == [("a", 1, 75), ("a", 2, 100), ("b", 1, 75), ("b", 2, 100), ("f", 1, 100), ("f", 2, 75)]


def test_fuzzy_screen_by_brute_force(spark, monkeypatch):
    """Names of all lengths, repeated names and lists of several parts; no pair of names is made by a join."""
    monkeypatch.setattr(rules, "LISTED_ROWS", 40)
    monkeypatch.setattr(rules, "NAME_ROWS", 30)
    monkeypatch.setattr(fuzzy, "CELLS", 200)
    monkeypatch.setattr(fuzzy, "OUT", 7)
    rng = random.Random(5)
    pool = ["".join(rng.choice("AB C1") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["LONG NAME OF A SHIP " * 3, "LONG NAME OF A SHOP " * 3, "ABCABCABC", None]
    some = [(i, rng.choice(pool)) for i in range(90)]
    listed = [(i, rng.choice(pool)) for i in range(100)]
    clean = lambda x: re.sub("[^A-Z0-9]+", " ", (x or "").upper()).strip()
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    for least, share in ((75, 0.3), (40, 0.5), (0, 0.1)):
        want = []
        for (i, n), (k, m) in ((a, b) for a in some for b in listed):
            n, m = clean(n), clean(m)
            if n and len(m) >= 3:
                score = math.floor((1 - far(n, m) / max(len(n), len(m))) * 100 + 0.5)
                if score >= least and (len(n) < 4 or len(grams(n) & grams(m)) >= max(1, math.ceil(len(grams(n)) * share))):
                    want.append((i, k, score))
        df = rules.fuzzy_screen(spark.createDataFrame(some, "entity_id long, name string"), spark.createDataFrame(listed, "list_id long, list_name string"), least, share)
        assert sorted((r.entity_id, r.list_id, r.score) for r in df.collect()) == sorted(want) and len(want) > 20
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_closest_approach_of_fast_and_wrapping_tracks(spark):
    rows = [("a", 0.0, 0.0, 480.0, 90.0), ("b", 0.0, 6.0, 480.0, 270.0), ("c", 40.0, 179.9, 5.0, 90.0), ("d", 40.0, -179.9, 5.0, 270.0)]
    points = spark.createDataFrame(rows, "entity_id string, lat double, lon double, speed double, course double")
    got = {(r["a"], r["b"]): r for r in tracks.closest_approach(points, 30, 10.0).collect()}
    assert got["a", "b"]["at_risk"] and got["a", "b"]["tcpa_min"] == 22.5 and got["c", "d"]["at_risk"]


def test_closest_approach_shuffles_no_pairs(spark):
    """Each step of each pair by the formula, pole, antimeridian, standing, fast and unknown ways; pairs are not shuffled."""
    rows = [(i, -20.0 + i * 53 % 41, (i * 97 % 41 + 340.0) % 360 - 180, float(i * 7 % 900), float(i * 41 % 360)) for i in range(60)]
    rows += [(60, 89.9, 10.0, 300.0, 0.0), (61, 89.5, -170.0, 300.0, 0.0), (62, 0.0, 0.0, 0.0, 0.0), (63, 0.0, 0.0, 0.0, 0.0), (64, 0.0, 0.1, None, 0.0)]
    points = spark.createDataFrame(rows, "entity_id long, lat double, lon double, speed double, course double")
    steps = [k / 2 for k in range(61)]

    def place(lat, lon, speed, course, t):
        la, far, co = math.radians(lat), speed * 1.852 * t / 60 / 6371, math.radians(course)
        to = math.asin(math.sin(la) * math.cos(far) + math.cos(la) * math.sin(far) * math.cos(co))
        return to, math.radians(lon) + math.atan2(math.sin(co) * math.sin(far) * math.cos(la), math.cos(far) - math.sin(la) * math.sin(to))

    want = {}
    for a, b in ((a, b) for a in rows for b in rows if a[0] < b[0] and None not in a + b):
        for t in steps:
            (la, lo), (lb, mb) = place(*a[1:], t), place(*b[1:], t)
            h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mb - lo) / 2) ** 2
            key = (round(2 * 6371 * math.asin(min(1, math.sqrt(h))) / 1.852, 4), t)
            want[a[0], b[0]] = min(want.get((a[0], b[0]), key), key)
    every = tracks.closest_approach(points, 30, 300.0)
    got = {(r.a, r.b): r for r in every.collect()}
    known = {k: (r.dcpa_nm, r.tcpa_min) for k, r in got.items() if r.at_risk is not None}
    assert known == {k: want[k] for k in known} and got[62, 64].at_risk is None and got[62, 64].dcpa_nm is None and known[62, 63] == (0.0, 0.0)
    risk = {k for k, (nm, t) in want.items() if nm < 300 and t > 0}
    assert {k for k, r in got.items() if r.at_risk} == risk and len(risk) > 5
    only = tracks.closest_approach(points, 30, 300.0, risk_only=True)
    assert {(r.a, r.b): (r.dcpa_nm, r.tcpa_min) for r in only.collect()} == {k: want[k] for k in risk}
    for df in (every, only):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Join")]
        assert "Exchange" not in above and "Aggregate" not in above


def test_registered_audit_chain(spark):
    assert rules.verify_chain(Q._audit_log(spark, SF), ["seq", "op"]).count() == 0
    got = sorted(r[0] for r in Q.QUERIES["audit_verify"](spark, SF).collect())
    want = duckdb.connect().execute(Q.ORACLE_SQL["audit_verify"].replace("FROM orders", f"FROM '{SF}/orders.parquet'")).fetchall()
    assert got == sorted(r[0] for r in want) and got


def test_screening_of_the_whole_list(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert Q.QUERIES["watch_exact"](spark, SF).select("list_id").distinct().count() == customers


def test_ingest_dead_letters(spark):
    rows = spark.createDataFrame([('{"mmsi":"12 3","lat":"91"}',), ("not json",), (None,), ('{"callsign":"X","altitude":3}',)], "payload string")
    ok, bad = ingest.ingest(rows)
    got = {r["entity_id"]: (r["entity_type"], r["lat"]) for r in ok.collect()}
    assert got == {"ship-12_3": ("ship", None), "aircraft-X": ("aircraft", None)} and bad.count() == 2


@pytest.mark.parametrize("name", ["ql_near", "ql_having", "ql_hop2", "graph_neighbors", "track_zone_events", "threat_assess", "watch_fuzzy", "federated_merge"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([clean(r[c]) for c in cols]) for r in df.collect())
    out = con.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    want = sorted(repr([clean(dict(zip(names, r))[c]) for c in cols]) for r in out.fetchall())
    assert got == want
