import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ingest
from tidewatch.plans import feed_queries  # noqa: F401  (registers)
from tidewatch.plans.queries import ORACLE_SQL, QUERIES
from tidewatch.sources import feeds
from tidewatch.streaming import streams


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_sbs(spark):
    good = "MSG,3,1,1,4CA2D6,1,2024/01/01,00:00:00,2024/01/01,00:00:00,RYR1 ,37000,450,90,51.5,-0.1,64,7000,0,0,0,0"
    rows = feeds.sbs(lines(spark, good, good.replace("MSG,3", "MSG,8"), good.replace("4CA2D6", " "), "MSG,3,1", "", None)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.entity_id, r.lat, r.lon) == ("icao:4CA2D6", 51.5, -0.1)
    assert r.properties["callsign"] == "RYR1" and r.properties["on_ground"] == "false" and float(r.properties["altitude"]) == 37000


def test_cef(spark):
    r = feeds.cef(lines(spark, r"Jan 1 host CEF:0|Ven\|dor|Prod|1.0|100|Worm \\ stopped|High|src=10.0.0.1 msg=a\=b c src=10.0.0.2 spt=1232", "no event", None)).collect()
    assert len(r) == 1 and r[0].entity_id == "cef:Ven|dor:Prod:100"
    p = r[0].properties
    assert p["event_name"] == "Worm \\ stopped" and p["severity"] == "High" and p["source_address"] == "10.0.0.2" and p["message"] == "a=b c" and p["ext_spt"] == "1232"


def test_marine_sentences(spark):
    both = lines(spark, "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47", "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A", "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*48", "$GPGGA,1", None)
    rows = feeds.fixes(both).orderBy(F.col("properties")["source"]).collect()
    assert len(rows) == 2 and all(abs(r.lat - 48.1173) < 1e-4 and abs(r.lon - 11.516667) < 1e-4 for r in rows)
    assert rows[0].properties["altitude_m"] == "545.4" and rows[1].properties["speed_knots"] == "22.4"


def test_geojson(spark):
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [4.5, 51.9]}, "properties": {"entity_type": "port", "n": 1}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 4]]}, "properties": {}},
        {"type": "Feature", "geometry": None, "properties": None}]})
    rows = feeds.geojson(lines(spark, text, "[]", None)).collect()
    assert [(r.entity_id, r.entity_type, r.lat, r.lon) for r in rows] == [("a", "port", 51.9, 4.5), ("geojson:feature-1", "feature", 2.0, 1.0), ("geojson:feature-2", "feature", 0.0, 0.0)]
    assert rows[0].properties["geometry_type"] == "Point" and rows[0].properties["n"] == "1"


def test_envelope_and_delimited(spark):
    rows = feeds.envelope(lines(spark, '{"device_id": 7, "lat": "1.5", "lng": 2, "t": 3}', "{}", "junk", None), "sensor").collect()
    assert [(r.entity_id, r.entity_type, r.lat, r.lon, r.properties) for r in rows] == [("7", "sensor", 1.5, 2.0, {"t": "3"})]
    table = spark.createDataFrame([(" 1 ", "5", "x", "a"), ("", "1", "2", "b"), (None, None, None, None)], "id string, lat string, lon string, name string")
    assert [tuple(r) for r in feeds.delimited(table, "ship", "id", "lat", "lon").collect()] == [("ship:1", "ship", 5.0, None, {"name": "a"})]


def test_metar(spark):
    r = feeds.metar(lines(spark, "METAR KJFK 121251Z 24016G28KT 10SM FEW250 M02/M17 A3034", "EHAM 121225Z VRB02KT CAVOK 08/04 Q1019", "hello", None)).collect()
    assert [x.entity_id for x in r] == ["metar:KJFK", "metar:EHAM"]
    assert r[0].properties["wind_gust_kt"] == "28" and r[0].properties["temperature_c"] == "-2" and r[0].properties["altimeter_inhg"] == "30.34"
    assert "wind_direction" not in r[1].properties and r[1].properties["pressure_hpa"] == "1019.0"


@pytest.fixture
def events(spark, tmp_path):
    rows = [("a", "x", "s", "1", "2024-01-01 00:00:00"), ("a", "x", "s", "1", "2024-01-01 00:10:00"), ("a", "x", "s", "2", "2024-01-01 00:20:00"), ("b", "x", "s", "1", "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "entity_id string, event_type string, source_id string, data string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream_to_current_state(spark, events, tmp_path):
    out = str(tmp_path / "out")
    streams.change_log(streams.suppress_repeats(events), out, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(out + "/changes").count() == 3
    assert sorted((r.entity_id, r.data) for r in streams.current(spark, out).collect()) == [("a", "2"), ("b", "1")]


def test_windows_and_sessions(spark, events, tmp_path):
    batch = spark.read.parquet(str(tmp_path / "in"))
    got = streams.windowed(batch, ["entity_id"], "15 minutes", [F.count("*").alias("n")]).orderBy("entity_id", "window_start").collect()
    assert [(r.entity_id, r.n) for r in got] == [("a", 2), ("a", 1), ("b", 1)]
    assert sorted((r.entity_id, r.n_events) for r in streams.sessions(batch, ["entity_id"], "11 minutes").collect()) == [("a", 3), ("b", 1)]


def test_dead_letters(spark):
    dead = spark.createDataFrame([('{"mmsi": "1"}', "x", 0), ("junk", "x", 1), ("junk", "x", 5)], "payload string, error string, retry_count int")
    good, bad = streams.retry(dead, ingest.ingest)
    assert [r.entity_id for r in good.collect()] == ["ship-1"]
    assert sorted(r.retry_count for r in bad.collect()) == [2, 5]


@pytest.mark.parametrize("name", ["source_lorawan", "source_netflow5", "source_netflow9", "source_pcap"])
def test_ids_beyond_two_bytes(spark, tmp_path, name):
    """Packets carry whole ids: a writer that cuts them to its fields gives other rows than the SQL."""
    con = duckdb.connect()
    pairs = [(0, 0), (5, 255), (65535, 65535), (65540, 65536), (99999, 3), (600005, 65536), (600006, 90000), (5999999, 89999), (6000000, 89999)]
    con.execute(f"create table events as select e::bigint as event_id, u::bigint as user_id from (values {', '.join(map(str, pairs))}) v(e, u)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    out = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    want = sorted(repr(r) for r in out.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and len(want) > 2
