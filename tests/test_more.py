from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rules, store
from tidewatch.plans.ql import Engine, QuerySyntaxError
from tidewatch.streaming import streams


@pytest.fixture
def engine(spark):
    rows = [("a", "2024-01-01 00:00:00", "ship", 1.0, 0.0, 0.0), ("a", "2024-01-02 00:00:00", "ship", 2.0, 0.0, 179.95), ("b", "2024-01-02 06:00:00", "ship", 3.0, 0.0, -179.95), ("p", "2024-01-02 06:00:00", "port", None, 50.0, 10.0)]
    history = spark.createDataFrame(rows, "entity_id string, ts string, entity_type string, speed double, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    edges = spark.createDataFrame([("a", "p", "calls")], "source_id string, target_id string, rel_type string")
    return Engine(store.as_of(history, "2025-01-01"), edges, history, datetime(2024, 1, 2, 12, 0, 0))


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_instants(engine):
    assert ids(engine.run("MATCH (s:ship) AT TIME now() - interval(1, days) WHERE s.speed < 5 RETURN s.id, s.speed")) == [("a", 1.0)]
    assert ids(engine.run('MATCH (s:ship {entity_id: "a"}) AT TIME timestamp("2024-01-02T00:00:00") RETURN s.speed')) == [(2.0,)]
    assert ids(engine.run("MATCH (s) RETURN s.id, s.event_time AS t SINCE today() + interval(6, hours) ORDER BY s.event_time DESC"))[0][0] == "b"
    assert ids(engine.run("MATCH (s:ship) RETURN COUNT(*) AS n SINCE now() - interval(36, hours)")) == [(3,)]
    with pytest.raises(QuerySyntaxError):
        engine.run("MATCH (s) RETURN s.id SINCE now() - interval(3, moons)")
    with pytest.raises(ValueError):
        Engine(engine.entities).run("MATCH (s) AT TIME now() RETURN s.id")


def test_exists_inside_expressions(engine):
    assert ids(engine.run("MATCH (s) WHERE s.speed > 2.5 OR EXISTS { (s)-[:calls]->(p:port) } RETURN s.id")) == [("a",), ("b",)]
    assert ids(engine.run("MATCH (s) WHERE NOT (s.speed > 2.5 OR EXISTS { (s)-[:calls]->(p:port) }) RETURN s.id")) == []
    assert ids(engine.run("MATCH (s) WHERE s.speed IS NULL OR NOT EXISTS { (s)-[:calls]->(p) } RETURN s.id")) == [("b",), ("p",)]


def test_near_between_patterns_is_an_equi_join(engine):
    df = engine.run("MATCH (a:ship), (b:ship) WHERE NEAR(a, b, radius_km=50) AND a.id < b.id RETURN a.id AS x, b.id AS y")
    assert ids(df) == [("a", "b")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "_p0" in plan


def test_exports_and_status(spark):
    rows = spark.createDataFrame([("a", 'say "hi", you', None), ("b", "x\ny", 2)], "entity_id string, name string, n int")
    assert [r.value for r in store.as_csv(rows).collect()] == ['a,"say ""hi"", you",', 'b,"x\ny",2']
    assert [r.value for r in store.as_json(rows).collect()][0] == '{"entity_id":"a","name":"say \\"hi\\", you"}'
    with pytest.raises(ValueError):
        store.find(rows, near=(91.0, 0.0, 5.0))
    src = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "source_id string, enabled boolean")
    beats = spark.createDataFrame([("s1", "2024-01-01 00:00:00", 3, 5)], "source_id string, ts string, events int, errors int").withColumn("ts", F.to_timestamp("ts"))
    assert {r.source_id: r.status for r in store.source_status(src, beats, F.lit("2024-01-01 00:00:10")).collect()} == {"s1": "error", "s2": "unknown", "s3": "disabled"}


def test_audit_grows_as_a_chain(spark):
    log = spark.createDataFrame([], "seq long, op string, previous_hash string, content_hash string")
    one = rules.append_audit(log, spark.createDataFrame([("b", 2), ("a", 1)], "op string, at int"), ["seq", "op"], ["at"])
    two = rules.append_audit(one, spark.createDataFrame([("c", 1)], "op string, at int"), ["seq", "op"], ["at"])
    assert [(r.seq, r.op) for r in two.orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c")] and rules.verify_chain(two, ["seq", "op"]).count() == 0
    assert [r.seq for r in rules.verify_chain(two.withColumn("op", F.when(F.col("seq") == 2, "x").otherwise(F.col("op"))), ["seq", "op"]).collect()] == [2]


def test_fence_merge_and_outbox(spark):
    pts = spark.createDataFrame([("a", i, i, la, 0.0) for i, la in enumerate([5.0, 0.0, 0.1, 5.0])], "entity_id string, event_id int, ts int, lat double, lon double")
    assert ids(rules.fence_transitions(pts, "f", 0.0, 0.0, 50.0)) == [("f", "a", 1, "enter"), ("f", "a", 3, "exit")]
    assert ids(rules.fence_transitions(pts, "f", 0.0, 0.0, 50.0, "exit")) == [("f", "a", 3, "exit")]
    log = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}), ("a", 2, {"x": "2"}), ("b", 1, {})], "entity_id string, ts int, properties map<string,string>")
    assert {r.entity_id: (r.ts, r.properties) for r in streams.merged(log).collect()} == {"a": (2, {"x": "2", "y": "1"}), "b": (1, None)}
    sent = streams.outbox(spark.range(3).withColumnRenamed("id", "seq"), spark.createDataFrame([("n", 1)], "peer string, seq long"), ["n", "s"])
    assert ids(sent.select("peer", "seq")) == [("n", 2), ("s", 0), ("s", 1), ("s", 2)]


def test_shortest_path_beyond_ten_hops(spark):
    from tidewatch.operators import graph

    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)] + [("n00", "n00"), ("n03", "n01"), ("n05", "x"), ("x", "n07"), ("n05", "w"), ("w", "n07")]
    edges = spark.createDataFrame(chain, "source_id string, target_id string")
    assert ids(graph.shortest_path(edges, "n00", "n14")) == [(14, ">".join(f"n{i:02}" for i in range(15)))]
    assert ids(graph.shortest_path(edges, "n05", "n07")) == [(2, "n05>n06>n07")]
    assert ids(graph.shortest_path(edges, "n00", "n14", 5)) == [] and ids(graph.shortest_path(edges, "n14", "n00")) == [] and ids(graph.shortest_path(edges, "n01", "n01")) == []
    named = edges.withColumn("rel_type", F.lit("r"))
    assert ids(graph.neighbors(named, "n12", 5)) == [("n13", 1, "r"), ("n14", 2, "r")]


def test_entry_is_imported_without_a_session():
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'source_ais' in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=here).returncode == 0
