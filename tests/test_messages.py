import json

from pyspark.sql import functions as F

from tidewatch.sources import messages


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_syslog(spark):
    rows = messages.syslog(lines(
        spark,
        '<165>1 2024-05-01T10:00:00Z gate7 sshd 812 ID3 [meta@1 user="an\\"na" zone="b"] login refused\n',
        "<34>May  1 10:00:00 gate8 su: attack seen",
        "<999>1 x y z a b - plain",
        '<13>1 - - - - - - CEF:0|Acme|NetFW|1|77|conn|3|src=10.0.0.9 act=deny',
        "<13>1 - gate9 - - - - CEF:0|Acme|Box|1|77|conn|9|act=deny",
        "", None)).collect()
    a, b, c, d, e = rows
    assert (a.entity_id, a.entity_type) == ("host:gate7", "host")
    assert a.properties["sd_user"] == 'an"na' and a.properties["message"] == "login refused" and a.properties["severity"] == "notice" and a.properties["facility"] == "20" and a.properties["proc_id"] == "812"
    assert b.entity_type == "threat"
    assert c.entity_type == "host" and "facility" not in c.properties
    assert d.entity_id == "network_event:10.0.0.9" and d.properties["cef_act"] == "deny" and d.properties["cef_severity"] == "3"
    assert e.entity_id == "threat:gate9"


def test_zeek(spark):
    header = messages.zeek_header(["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tconn", "#fields\tts\tuid\tid.orig_h\tid.resp_h\tlocal\ttags", "#types\ttime\tstring\taddr\taddr\tbool\tset[string]"])
    rows = messages.zeek_tsv(lines(spark, "#close", "1.5\tCa1\t10.0.0.1\t10.0.0.2\tT\ta,b", "2\t-\t10.0.0.1\t10.0.0.2\t-\t(empty)", "", None), header).collect()
    assert [r.entity_id for r in rows] == ["zeek:Ca1", "zeek:10.0.0.1-10.0.0.2"]
    assert rows[0].properties == {"ts": "1.5", "uid": "Ca1", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "local": "true", "tags": '["a","b"]', "zeek_log_type": "conn"}
    assert rows[1].properties["tags"] == "[]" and "local" not in rows[1].properties
    rows = messages.zeek_json(lines(spark, '{"uid":"C2","n":3,"x":null}', '{"id_orig_h":"a"}', "junk", None), "dns").collect()
    assert [r.entity_id for r in rows] == ["zeek:C2", "zeek:a-unknown"] and rows[0].properties == {"uid": "C2", "n": "3", "zeek_log_type": "dns"}


def test_stix(spark):
    bundle = {"type": "bundle", "id": "bundle--1", "objects": [{"type": "malware", "id": "malware--1", "name": "Wurm", "malware_types": ["worm"]}, {"type": "x-own", "id": "x-own--2"}, {"type": "tool"}]}
    rows = messages.stix(lines(spark, json.dumps(bundle), json.dumps({"type": "indicator", "id": "indicator--3", "confidence": 80}), '{"type":"bundle"}', "junk", None)).collect()
    assert [(r.entity_id, r.entity_type) for r in rows] == [("stix:malware--1", "threat"), ("stix:x-own--2", "stix_object"), ("stix:indicator--3", "threat_indicator")]
    assert rows[0].properties["malware_types"] == '["worm"]' and rows[2].properties["confidence"] == "80"


def test_cot_both_ways(spark):
    text = '<?xml version="1.0"?><event version="2.0" uid="U-1" type="a-h-S-X" how="m-g" time="t" start="t" stale="s"><point lat="54.5" lon="-3.25" hae="2" ce="5" le="6"/><detail><contact callsign="Gr&amp;y" endpoint="e:1"/><track course="12.5" speed="3"/><remarks> two &lt; three </remarks></detail></event>'
    rows = messages.cot(lines(spark, text, text.replace('uid="U-1"', ""), "<event", "", None)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.entity_id, r.entity_type, r.lat, r.lon) == ("cot:U-1", "vessel", 54.5, -3.25)
    assert r.properties["classification"] == "hostile" and r.properties["domain"] == "surface" and r.properties["callsign"] == "Gr&y" and r.properties["contact_endpoint"] == "e:1" and r.properties["track_speed"] == "3" and r.properties["remarks"] == "two < three"
    ents = spark.createDataFrame([("a&1", 'Q "x"', 1.5, -2.5), ("b", None, None, 1.0)], "entity_id string, name string, lat double, lon double")
    back = messages.cot(messages.to_cot(ents, F.lit("b-r"), F.lit("t"), F.lit("s"))).collect()
    assert [(x.entity_id, x.entity_type, x.lat, x.lon, x.properties["callsign"], x.properties["domain"]) for x in back] == [("cot:a&1", "sensor_point", 1.5, -2.5, 'Q "x"', "reference")]


def test_cap(spark):
    info = "<info><category>Met</category><event>Gale</event><severity>Severe</severity><area><areaDesc>Bay</areaDesc>{}</area></info>"
    head = '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>A1</identifier><sender>s</sender><status>Actual</status>{}</alert>'
    rows = messages.cap(lines(spark, head.format(info.format("<circle>10.5,20.5 7</circle>") + info.replace("Met", "Other").format("<polygon>0,0 0,4 2,4 2,0</polygon>")), head.format(""), "<alert>", "x", None)).collect()
    assert [(r.entity_id, r.entity_type, r.lat, r.lon) for r in rows] == [("cap:A1:0", "weather_alert", 10.5, 20.5), ("cap:A1:1", "emergency_alert", 1.0, 2.0), ("cap:A1", "emergency_alert", None, None)]
    assert rows[0].properties["radius_km"] == "7.0" and rows[0].properties["area_desc"] == "Bay" and rows[0].properties["event"] == "Gale"


def test_gtfs(spark):
    feed = {"header": {}, "entity": [
        {"id": "1", "vehicle": {"trip": {"tripId": "T1", "route_id": "R"}, "vehicle": {"id": "V", "label": "bus"}, "position": {"latitude": 1.5, "longitude": 2.5, "speed": 9}}},
        {"id": "2", "trip_update": {"trip": {"trip_id": "T2"}, "stop_time_update": [{"stop_id": "x"}]}}, {"id": "3", "vehicle": {"position": {}}}, {"id": "4", "alert": {}}]}
    rows = messages.gtfs(lines(spark, json.dumps(feed), "{}", "junk", None)).collect()
    assert [(r.entity_id, r.lat, r.lon) for r in rows] == [("gtfs:vehicle:V", 1.5, 2.5), ("gtfs:trip:T2", None, None)]
    assert rows[0].properties["trip_id"] == "T1" and rows[0].properties["route_id"] == "R" and "stop_id" in rows[1].properties["stop_time_updates"]


def test_hl7(spark):
    text = "\r".join(["MSH|^~\\&|LAB|WEST|X|Y|20240501||ORU^R01|C9|P|2.5", "PID|1||P7^^^H~P8||Doe^Jo||19700101|F", "OBR|1|||GLU^Glucose|||20240501", "OBX|1|NM|GLU^Glucose||5.4|mmol/L||H|||F", "OBX|2|NM|||9"])
    rows = messages.hl7(lines(spark, text, text.split("\r")[0] + "\r" + text.split("\r")[2], "MSH|^~\\&|A", "PID|1", "", None)).collect()
    assert [(r.entity_id, r.entity_type) for r in rows][:2] == [("P7", "patient"), ("GLU", "observation")] and rows[2].entity_id.startswith("hl7-") and len(rows) == 3
    p = rows[0].properties
    assert p["pid.name"] == "Jo Doe" and p["msh.sending_app"] == "LAB" and p["msh.message_type"] == "ORU^R01" and json.loads(p["obx.GLU"]) == {"value": "5.4", "units": "mmol/L", "abnormal": "H", "status": "F"}


def test_plant_messages(spark):
    rows = messages.opcua(lines(spark, '{"NodeId":"ns=2;s=Boiler.T1","DisplayName":"Boiler Temp","Value":7.5,"StatusCode":0}', '{"nodeId":"ns=1;s=PLC1","value":true,"status":2147483648}', "{}", "junk", None)).collect()
    assert [(r.entity_id, r.entity_type) for r in rows] == [("opcua:ns=2;s=Boiler.T1", "temperature_sensor"), ("opcua:ns=1;s=PLC1", "plc")]
    assert rows[0].properties["numeric_value"] == "7.5" and rows[1].properties["status_good"] == "false" and rows[1].properties["value"] == "true"
    sent = spark.createDataFrame([("spBv1.0/g/DDATA/n/d", '{"seq":4,"metrics":[{"name":"t","intValue":3},{"value":1}]}'), ("spBv1.0/g/NDATA/n", '{"metrics":[{"name":"u","value":"x"}]}'), ("other/g/x/n", "{}"), (None, None)], "topic string, value string")
    rows = messages.sparkplug(sent).collect()
    assert [(r.entity_id, r.properties["metric_value"]) for r in rows] == [("sparkplug:g:n:d:t", "3"), ("sparkplug:g:n:u", "x")] and rows[0].properties["seq"] == "4"
