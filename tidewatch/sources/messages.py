"""Structured feeds as observations: security logs, alerts, tactical, health, transit and plant messages.

Every decoder takes rows with a `value` and gives (entity_id, entity_type, lat, lon, properties),
as those of `feeds` do, by JVM expressions alone.  Values that a format does not accept, nulls
among them, give no row; a message with many parts gives a row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .feeds import _filled, _last_wins, _observed, cef_columns

# fixed values: names of the eight levels of a log line, in the order of their numbers
LEVELS = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
# fixed values: words of a product or of a line that decide the type, in the order in which they are tried
PRODUCT_TYPES = [
    ("threat", ["ids", "ips", "snort", "suricata"]),
    ("vulnerability", ["vuln", "qualys", "nessus", "openvas"]),
    ("network_event", ["firewall", "fw", "pix", "asa", "fortinet", "checkpoint"]),
]
LINE_TYPES = [
    ("threat", ["attack", "intrusion", "exploit", "malware", "trojan"]),
    ("network_event", ["denied", "blocked", "drop", "firewall", "nat "]),
]
# fixed values: object types of threat intelligence
STIX_TYPES = {
    "indicator": "threat_indicator",
    "malware": "threat",
    "threat-actor": "threat_actor",
    "attack-pattern": "attack_pattern",
    "vulnerability": "vulnerability",
    "campaign": "campaign",
    "intrusion-set": "intrusion_set",
    "tool": "tool",
    "observed-data": "observation",
    "identity": "identity",
    "infrastructure": "infrastructure",
    "location": "location",
    "note": "note",
    "opinion": "opinion",
    "report": "report",
    "relationship": "relationship",
    "sighting": "sighting",
}
# fixed values: letters of a tactical type code
AFFILIATIONS = {"f": "friendly", "h": "hostile", "n": "neutral", "u": "unknown", "s": "suspect", "j": "joker", "k": "faker", "o": "none", "p": "pending"}
DIMENSIONS = {
    "A": ("aircraft", "air"),
    "G": ("ground_unit", "ground"),
    "S": ("vessel", "surface"),
    "U": ("submarine", "subsurface"),
    "P": ("space_object", "space"),
    "F": ("sof_unit", "special_operations"),
}
SENSING = {"m": "sensor", "r": "reference", "d": "detection", "a": "alarm"}
# fixed values: categories of public alerts
ALERT_TYPES = {
    "Met": "weather_alert",
    "Geo": "geological_alert",
    "Fire": "fire_alert",
    "Health": "health_alert",
    "Security": "security_alert",
    "Safety": "safety_alert",
    "Rescue": "rescue_alert",
    "Env": "environmental_alert",
    "Transport": "transport_alert",
    "Infra": "infrastructure_alert",
    "CBRNE": "cbrne_alert",
}
# fixed values: words of a plant signal's name that decide its type, in the order in which they are tried
SIGNAL_TYPES = [
    ("temperature_sensor", ["temperature", "temp"]),
    ("pressure_sensor", ["pressure"]),
    ("flow_sensor", ["flow"]),
    ("level_sensor", ["level"]),
    ("valve", ["valve"]),
    ("pump", ["pump"]),
    ("motor", ["motor"]),
    ("alarm", ["alarm", "alert"]),
    ("speed_sensor", ["speed", "rpm"]),
    ("humidity_sensor", ["humidity"]),
    ("power_meter", ["power", "watt"]),
    ("voltage_sensor", ["voltage", "volt"]),
    ("current_sensor", ["current", "ampere"]),
]


def _has(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text.contains(w), F.lit(False))
    return out


def _first_of(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The type of the first rule of which a word is in the text, or null."""
    return F.coalesce(*[F.when(_has(text, words), F.lit(kind)) for kind, words in rules])


def _mapped(key: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _text(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def syslog(lines: DataFrame) -> DataFrame:
    """Log lines of the structured (version digit) and the older header, with a CEF record inside if there is one.

    An empty line gives no row.  A dash or a missing host is null; the host or the record's
    source address names the entity, `unknown` where there is neither.
    """
    rows = lines.select(F.regexp_replace("value", r"[\r\n]+$", "").alias("raw")).where(F.length("raw") > 0)
    number = F.regexp_extract("raw", r"^<([0-9]{1,3})>", 1).try_cast("int")
    known = number <= 255
    rows = rows.withColumn("pri", F.when(known, number)).withColumn("rest", F.when(known, F.regexp_replace("raw", r"^<[0-9]+>", "")).otherwise(F.col("raw")))
    modern = F.col("rest").rlike("^[0-9] .")
    rows = rows.withColumn("modern", modern).withColumn("p", F.when(modern, F.split("rest", " ", 7)).otherwise(F.split("rest", " ", 4)))
    word = lambda i: F.when(F.col("modern"), F.nullif(F.get("p", F.lit(i)), F.lit("-")))
    body = F.coalesce(F.get("p", F.when(F.col("modern"), 6).otherwise(3)), F.lit(""))
    rows = rows.withColumn("body", body)
    data = r'^((?:\[(?:[^\]"\\]|\\.|"(?:[^"\\]|\\.)*")*\])+|-(?=\s|$))?\s*'
    old_host = _text(F.regexp_extract("body", r"^(\S*)", 1))
    rows = rows.select(
        "raw", "pri",
        F.when(F.col("modern"), word(2)).otherwise(old_host).alias("host"), word(3).alias("app"), word(4).alias("proc"), word(5).alias("msg_id"),
        F.when(F.col("modern"), F.regexp_extract("body", data, 1)).alias("sd"),
        F.when(F.col("modern"), F.regexp_replace("body", data, "")).otherwise(F.when(F.col("body").contains(" "), F.regexp_replace("body", r"^\S* ", "")).otherwise(F.col("body"))).alias("message"))
    found, part, ext, level = cef_columns(F.col("message"))
    extra = F.when(found, ext).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("found", found).withColumn("ext", extra).withColumn("level", F.when(found, F.coalesce(level, F.lit(0))))
    for name in ("vendor", "product", "signature", "name"):
        rows = rows.withColumn(name, F.when(F.col("found"), part[name]))
    by_product = F.when(F.col("found"), F.coalesce(F.when(F.col("level") >= 7, F.lit("threat")), _first_of(F.lower("product"), PRODUCT_TYPES)))
    kind = F.coalesce(by_product, _first_of(F.lower("raw"), LINE_TYPES), F.lit("host"))
    pair = r'([^\s=\]\["]+)="((?:[^"\\]|\\.)*)"'
    sd = F.coalesce(F.col("sd"), F.lit(""))
    fields = F.zip_with(F.regexp_extract_all(sd, F.lit(pair), 1), F.regexp_extract_all(sd, F.lit(pair), 2), lambda k, v: F.struct(F.concat(F.lit("sd_"), k).alias("key"), F.regexp_replace(v, r'\\(["\\\]])', "$1").alias("value")))
    head = _filled(
        hostname=F.col("host"), app_name=F.col("app"), proc_id=F.col("proc"), msg_id=F.col("msg_id"), message=F.col("message"),
        facility=F.floor(F.col("pri") / 8), severity=F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("pri") % 8),
        cef_vendor=F.col("vendor"), cef_product=F.col("product"), cef_signature_id=F.col("signature"), cef_name=F.col("name"), cef_severity=F.col("level"))
    more = F.map_entries(F.transform_keys("ext", lambda k, _: F.concat(F.lit("cef_"), k)))
    props = _last_wins(F.concat(F.map_entries(head), more, fields))
    entity = F.coalesce(F.element_at("ext", "src"), F.col("host"), F.lit("unknown"))
    return _observed(rows, F.concat(kind, F.lit(":"), entity), kind, F.lit(None), F.lit(None), props)


def _zeek(rows: DataFrame, path: str) -> DataFrame:
    get = lambda *ks: F.coalesce(*[F.element_at("m", k) for k in ks], F.lit("unknown"))
    entity = F.coalesce(F.element_at("m", "uid"), F.concat(get("id.orig_h", "id_orig_h"), F.lit("-"), get("id.resp_h", "id_resp_h")))
    props = _last_wins(F.concat(F.map_entries("m"), F.map_entries(_filled(zeek_log_type=F.lit(path)))))
    return _observed(rows, F.concat(F.lit("zeek:"), entity), F.lit("network_event"), F.lit(None), F.lit(None), props)


def zeek_json(lines: DataFrame, path: str) -> DataFrame:
    """Network monitor logs, a JSON object a line; `path` is the kind of log (conn, dns, http, ...)."""
    return _zeek(lines.select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null").select(F.map_filter("m", lambda k, v: v.isNotNull()).alias("m")), path)


def zeek_tsv(lines: DataFrame, header: dict) -> DataFrame:
    """Network monitor logs with columns, read by the header that `zeek_header` gives.

    Unset fields are left out, empty ones are empty, booleans are true and false, and sets and
    vectors JSON lists.  A row with more or fewer fields keeps those that are there.
    """
    cells = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#")).select(F.split("value", header["separator"], -1).alias("c"))
    named = {}
    for i, (name, kind) in enumerate(zip(header["fields"], header["types"] + ["string"] * len(header["fields"]))):
        raw = F.nullif(F.get("c", F.lit(i)), F.lit(header["unset_field"]))
        empty = raw == header["empty_field"]
        if kind.startswith(("set[", "vector[")):
            named[name] = F.when(empty, "[]").otherwise(F.when(raw.isNotNull(), F.to_json(F.split(raw, "\\Q" + header["set_separator"] + "\\E", -1))))
        elif kind == "bool":
            named[name] = F.when(raw == "T", "true").when(raw == "F", "false").otherwise(raw)
        else:
            named[name] = F.when(empty, "").otherwise(raw)
    return _zeek(cells.select(_filled(**named).alias("m")), header["path"])


def zeek_header(lines: list[str]) -> dict:
    """The header of a log with columns: its first lines, each with a # in front."""
    out = {"separator": "\t", "set_separator": ",", "empty_field": "(empty)", "unset_field": "-", "path": "", "fields": [], "types": []}
    for line in lines:
        if not line.startswith("#"):
            continue
        if line.startswith("#separator "):
            out["separator"] = line[11:].strip().encode().decode("unicode_escape")
            continue
        key, *values = line[1:].rstrip("\n").split(out["separator"])
        if key in ("fields", "types"):
            out[key] = values
        elif key in out and values:
            out[key] = values[0]
    if not out["fields"]:
        raise ValueError("no #fields line in the header")
    return out


def stix(texts: DataFrame) -> DataFrame:
    """Threat intelligence: each object of a bundle, of a collection's page, or alone; lists and objects stay JSON text."""
    parsed = texts.select("value", F.from_json("value", "type string, id string, objects array<string>").alias("j")).where("j is not null")
    alone = F.col("j.objects").isNull() & (F.col("j.type") != "bundle")
    each = parsed.select(F.explode(F.when(alone, F.array("value")).otherwise(F.col("j.objects"))).alias("one"))
    rows = each.select(F.from_json("one", "map<string,string>").alias("m")).where("m is not null").where(F.element_at("m", "id").isNotNull() & F.element_at("m", "type").isNotNull())
    at = lambda k: F.element_at("m", k)
    kept = ["spec_version", "name", "description", "pattern", "pattern_type", "valid_from", "valid_until", "is_family", "malware_types", "threat_actor_types", "aliases", "sophistication", "kill_chain_phases", "relationship_type", "source_ref", "target_ref", "confidence", "labels", "external_references", "first_seen", "last_seen", "created"]
    props = _filled(stix_type=at("type"), stix_id=at("id"), **{k: at(k) for k in kept})
    return _observed(rows, F.concat(F.lit("stix:"), at("id")), _mapped(at("type"), STIX_TYPES, "stix_object"), F.lit(None), F.lit(None), props)


COT = "_uid string, _type string, _how string, _time string, _start string, _stale string, point struct<_lat: double, _lon: double, _hae: double, _ce: double, _le: double>"


def _xml(schema: str) -> Column:
    return F.from_xml("value", schema, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "attributePrefix": "_"})


def _unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cot(texts: DataFrame) -> DataFrame:
    """Tactical events: position, affiliation and domain by the type code, and the attributes of all elements of `detail`."""
    rows = texts.select("value", _xml(COT).alias("e")).where(F.length("e._uid") > 0)
    t = F.split(F.coalesce("e._type", F.lit("")), "-")
    at = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit(""))
    unit, sense, drawn = at(0) == "a", at(0) == "b", at(0) == "t"
    kind = F.when(unit, _mapped(at(2), {k: v[0] for k, v in DIMENSIONS.items()}, "unit")).when(sense, "sensor_point").when(drawn, "tactical_graphic").otherwise("unknown")
    domain = F.when(unit, _mapped(at(2), {k: v[1] for k, v in DIMENSIONS.items()}, "unknown")).when(sense, _mapped(at(1), SENSING, "sensor")).when(drawn, "tactical").otherwise("unknown")
    side = F.when(unit, _mapped(at(1), AFFILIATIONS, "unknown")).when(sense | drawn, "none").otherwise("unknown")
    detail = F.regexp_extract("value", r"(?s)<detail\b[^>]*>(.*)</detail>", 1)
    tag = r"""<([A-Za-z_][\w.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))+)\s*/?>"""
    attr = r"""([\w:.-]+)\s*=\s*["']([^"']*)["']"""
    elements = F.zip_with(F.regexp_extract_all("detail", F.lit(tag), 1), F.regexp_extract_all("detail", F.lit(tag), 2), lambda name, body: F.zip_with(F.regexp_extract_all(body, F.lit(attr), 1), F.regexp_extract_all(body, F.lit(attr), 2), lambda k, v: F.struct(F.when((name == "contact") & (k == "callsign"), F.lit("callsign")).otherwise(F.concat(name, F.lit("_"), k)).alias("key"), _unescaped(v).alias("value"))))
    rows = rows.withColumn("detail", detail)
    remarks = _text(F.trim(_unescaped(F.regexp_extract("detail", r"(?s)<remarks\b[^>]*[^/>]?>(.*?)</remarks>", 1))))
    far = F.lit(9999999.0)
    head = _filled(
        cot_type=F.col("e._type"), cot_how=F.col("e._how"), classification=side, domain=domain, stale=F.col("e._stale"), time=F.col("e._time"),
        hae=F.coalesce("e.point._hae", F.lit(0.0)), ce=F.coalesce("e.point._ce", far), le=F.coalesce("e.point._le", far), remarks=remarks)
    return _observed(rows, F.concat(F.lit("cot:"), "e._uid"), kind, F.col("e.point._lat"), F.col("e.point._lon"), _last_wins(F.concat(F.map_entries(head), F.flatten(elements))))


def to_cot(entities: DataFrame, type_code: Column, time: Column, stale: Column) -> DataFrame:
    """(entity_id, value): each entity that has a position as a tactical event, its name the callsign."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            c = F.replace(c.cast("string"), F.lit(a), F.lit(b))
        return F.coalesce(c, F.lit(""))

    value = F.concat(
        F.lit('<event version="2.0" uid="'), safe(F.col("entity_id")), F.lit('" type="'), safe(type_code), F.lit('" how="m-g" time="'), safe(time), F.lit('" start="'), safe(time), F.lit('" stale="'), safe(stale), F.lit('"><point lat="'),
        F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('" hae="0.0" ce="9999999.0" le="9999999.0"/>'),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('<detail><contact callsign="'), safe(F.col("name")), F.lit('"/></detail>'))).otherwise(F.lit("")), F.lit("</event>"))
    return entities.where("lat is not null and lon is not null").select("entity_id", value.alias("value"))


CAP = """identifier string, sender string, sent string, status string, msgType string, scope string, source string, note string,
info array<struct<category: array<string>, event: string, urgency: string, severity: string, certainty: string, headline: string, description: string,
instruction: string, expires: string, area: array<struct<areaDesc: string, circle: array<string>, polygon: array<string>>>>>"""


def cap(texts: DataFrame) -> DataFrame:
    """Public alerts: a row for each `info`, placed at the first area's circle or else the mean of its polygon's corners."""
    rows = texts.select(_xml(CAP).alias("a")).where(F.length("a.identifier") > 0).select("a", F.posexplode_outer("a.info").alias("i", "x"))
    area = F.get("x.area", F.lit(0))
    circle = F.get(area["circle"], F.lit(0))
    shape = r"^\s*([^,\s]+),([^,\s]+)\s+(\S+)\s*$"
    part = lambda g: F.regexp_extract(circle, shape, g).try_cast("double")
    round_one = circle.isNotNull() & part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull()
    corners = F.transform(F.filter(F.split(F.trim(F.get(area["polygon"], F.lit(0))), r"\s+"), lambda p: F.size(F.split(p, ",", -1)) == 2), lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("a"), F.split(p, ",")[1].try_cast("double").alias("o")))
    corners = F.filter(corners, lambda c: c["a"].isNotNull() & c["o"].isNotNull())
    mean = lambda k: F.try_divide(F.aggregate(corners, F.lit(0.0), lambda s, c: s + c[k]), F.size(corners))
    place = lambda g, k: F.when(circle.isNotNull(), F.when(round_one, part(g))).otherwise(mean(k))
    category = F.get("x.category", F.lit(0))
    props = _filled(
        cap_id=F.col("a.identifier"), sender=F.col("a.sender"), sent=F.col("a.sent"), status=F.col("a.status"), msg_type=F.col("a.msgType"), scope=F.col("a.scope"), source=F.col("a.source"), note=F.col("a.note"),
        category=category, event=F.col("x.event"), urgency=F.col("x.urgency"), severity=F.col("x.severity"), certainty=F.col("x.certainty"), headline=F.col("x.headline"), description=F.col("x.description"),
        instruction=F.col("x.instruction"), expires=F.col("x.expires"), area_desc=area["areaDesc"], radius_km=F.when(round_one, part(3)))
    entity = F.concat(F.lit("cap:"), "a.identifier", F.coalesce(F.concat(F.lit(":"), F.col("i").cast("string")), F.lit("")))
    return _observed(rows, entity, _mapped(category, ALERT_TYPES, "emergency_alert"), place(1, "a"), place(2, "o"), props)


def _either(path: str, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object("one", f"$.{path}{n}") for n in names])


def gtfs(texts: DataFrame) -> DataFrame:
    """Transit feeds in JSON: vehicle positions and trip updates, with the names of either spelling."""
    parsed = texts.select(F.from_json("value", "entity array<string>").alias("j")).where("j.entity is not null")
    each = parsed.select(F.explode("j.entity").alias("e"))
    get = lambda *ps: F.coalesce(*[F.get_json_object("e", f"$.{p}") for p in ps])
    parts = F.array(F.struct(F.lit("vehicle").alias("kind"), get("vehicle", "vehiclePosition").alias("one")), F.struct(F.lit("trip").alias("kind"), get("tripUpdate", "trip_update").alias("one")))
    rows = each.select(F.explode(F.filter(parts, lambda p: p["one"].isNotNull())).alias("p")).select("p.kind", "p.one")
    moving = F.col("kind") == "vehicle"
    lat, lon = _either("position.", "latitude").try_cast("double"), _either("position.", "longitude").try_cast("double")
    trip, vehicle = _either("trip.", "tripId", "trip_id"), _either("vehicle.", "id")
    only = lambda c: F.when(moving, c)
    props = _filled(
        trip_id=trip, route_id=_either("trip.", "routeId", "route_id"), vehicle_id=vehicle, vehicle_label=only(_either("vehicle.", "label")), latitude=only(lat), longitude=only(lon),
        bearing=only(_either("position.", "bearing").try_cast("double")), speed=only(_either("position.", "speed").try_cast("double")), occupancy_status=only(_either("", "occupancyStatus", "occupancy_status")),
        current_stop_sequence=only(_either("", "currentStopSequence", "current_stop_sequence")), stop_id=only(_either("", "stopId", "stop_id")), current_status=only(_either("", "currentStatus", "current_status")),
        timestamp=_either("", "timestamp"), stop_time_updates=F.when(~moving, _either("", "stopTimeUpdate", "stop_time_update")))
    rows = rows.where(F.when(moving, lat.isNotNull() & lon.isNotNull()).otherwise(trip.isNotNull()))
    entity = F.when(moving, F.concat(F.lit("gtfs:vehicle:"), F.coalesce(vehicle, trip, F.lit("unknown")))).otherwise(F.concat(F.lit("gtfs:trip:"), trip))
    return _observed(rows, entity, F.lit("vehicle"), only(lat), only(lon), props)


def hl7(texts: DataFrame) -> DataFrame:
    """Health messages (version 2, separators as the header names them): the patient, or else the test, with all results.

    A message of neither is named by a digest of its text.
    """
    rows = texts.select(F.regexp_replace("value", r"^[\x0b\s]+|[\x1c\s]+$", "").alias("t")).where(F.col("t").startswith("MSH") & (F.length("t") > 8))
    quoted = lambda i: F.concat(F.lit("\\Q"), F.substring("t", i, 1), F.lit("\\E"))
    rows = rows.select("t", quoted(4).alias("bar"), quoted(5).alias("hat"), quoted(6).alias("rep"))
    rows = rows.withColumn("s", F.transform(F.split("t", r"[\r\n]+"), lambda x: F.split(x, F.col("bar"), -1)))
    first = lambda name: F.get(F.filter("s", lambda x: x[0] == name), F.lit(0))
    rows = rows.select("*", *[first(n).alias(n) for n in ("MSH", "EVN", "PID", "PV1", "OBR")])
    at = lambda name, i: _text(F.trim(F.get(name, F.lit(i - 1 if name == "MSH" else i))))
    head = lambda c: F.get(F.split(c, F.col("hat"), -1), F.lit(0))
    patient = _text(head(F.get(F.split(at("PID", 3), F.col("rep"), -1), F.lit(0))))
    names = F.split(at("PID", 5), F.col("hat"), -1)
    name = _text(F.trim(F.concat_ws(" ", _text(F.trim(F.get(names, F.lit(1)))), _text(F.trim(F.get(names, F.lit(0)))))))
    named = {
        "msh.sending_app": at("MSH", 3), "msh.sending_facility": at("MSH", 4), "msh.timestamp": at("MSH", 7), "msh.message_type": at("MSH", 9), "msh.control_id": at("MSH", 10),
        "evn.trigger": at("EVN", 1), "evn.recorded": at("EVN", 2), "pid.patient_id": patient, "pid.name": name, "pid.dob": at("PID", 7), "pid.sex": at("PID", 8),
        "pv1.location": at("PV1", 3), "pv1.attending_doctor": at("PV1", 7), "obr.test_id": at("OBR", 4), "obr.observation_datetime": at("OBR", 7)}
    cell = lambda x, i: F.when(F.length(F.get(x, F.lit(i))) > 0, F.get(x, F.lit(i)))
    results = F.transform(F.filter("s", lambda x: (x[0] == "OBX") & (F.length(F.coalesce(head(F.get(x, F.lit(3))), F.lit(""))) > 0)), lambda x: F.struct(F.concat(F.lit("obx."), head(F.get(x, F.lit(3)))).alias("key"), F.to_json(F.struct(cell(x, 5).alias("value"), cell(x, 6).alias("units"), cell(x, 8).alias("abnormal"), cell(x, 11).alias("status"))).alias("value")))
    entity = F.coalesce(patient, _text(head(at("OBR", 4))), F.concat(F.lit("hl7-"), F.substring(F.sha2(F.col("t").cast("binary"), 256), 1, 16)))
    return _observed(rows, entity, F.when(F.col("PID").isNotNull(), "patient").otherwise("observation"), F.lit(None), F.lit(None), _last_wins(F.concat(F.map_entries(_filled(**named)), results)))


def opcua(lines: DataFrame) -> DataFrame:
    """Data changes of plant nodes in JSON; the display name tells what kind of signal it is."""
    rows = lines.select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    get = lambda *ks: F.coalesce(*[F.element_at("m", k) for k in ks])
    node, name = get("NodeId", "nodeId", "node_id"), get("DisplayName", "displayName", "display_name")
    status = F.coalesce(get("StatusCode", "statusCode", "status").try_cast("long"), F.lit(0))
    value = get("Value", "value")
    low = F.lower(F.coalesce(name, F.lit("")))
    kind = F.coalesce(_first_of(low, SIGNAL_TYPES), F.when(_has(F.lower(node), ["plc", "controller"]), F.lit("plc")), F.lit("sensor"))
    # the two highest bits of a status tell good, uncertain and bad
    grade = F.when(status < 2**30, "Good").when(status < 2**31, "Uncertain").otherwise("Bad")
    props = _filled(node_id=node, display_name=name, value=value, numeric_value=value.try_cast("double"), status=grade, status_good=status < 2**30, source_timestamp=get("SourceTimestamp", "sourceTimestamp", "source_timestamp"))
    return _observed(rows.where(node.isNotNull()), F.concat(F.lit("opcua:"), node), kind, F.lit(None), F.lit(None), props)


def sparkplug(messages: DataFrame) -> DataFrame:
    """(topic, value) messages of edge nodes with a JSON payload: a row for each metric that has a name."""
    rows = messages.select(F.split("topic", "/").alias("t"), F.from_json("value", "seq string, timestamp string, metrics array<map<string,string>>").alias("j"))
    rows = rows.where((F.get("t", F.lit(0)) == "spBv1.0") & (F.size("t") >= 4)).select("t", "j.seq", F.explode("j.metrics").alias("m"))
    get = lambda *ks: F.coalesce(*[F.element_at("m", k) for k in ks])
    at = lambda i: F.get("t", F.lit(i))
    value = get("intValue", "longValue", "floatValue", "doubleValue", "booleanValue", "stringValue", "value")
    props = _filled(metric_name=get("name"), metric_value=value, datatype=get("datatype"), group_id=at(1), message_type=at(2), edge_node_id=at(3), device_id=at(4), alias=get("alias"), seq=F.col("seq"), timestamp=get("timestamp"))
    return _observed(rows.where(get("name").isNotNull()), F.concat_ws(":", F.lit("sparkplug"), at(1), at(3), at(4), get("name")), F.lit("sensor"), F.lit(None), F.lit(None), props)
