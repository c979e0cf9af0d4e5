"""Universal JSON ingest: flatten, type detection, identifiers, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The ordered detection rules, (type, alternatives of keys that must all be there)
RULES = [("ship", [["mmsi"], ["imo"]]), ("aircraft", [["icao"], ["callsign", "altitude"]]), ("host", [["ip"], ["hostname"]]), ("threat", [["cve"], ["vulnerability"]]), ("sensor", [["temperature"], ["humidity"]]), ("vehicle", [["plate"], ["vin"]]), ("point", [["lat", "lon"]])]
ID_KEYS = {"ship": ["mmsi", "imo"], "aircraft": ["icao", "callsign"], "host": ["hostname", "ip"], "threat": ["cve", "vulnerability"], "sensor": ["sensor_id", "id"], "vehicle": ["plate", "vin"], "point": ["lat"]}


def flatten(payload: Column, depth: int = 4) -> Column:
    """JSON object text -> map of dotted keys to scalar text; arrays stay whole.  JVM expressions, `depth` levels."""
    out = F.from_json(payload, "map<string,string>")
    for _ in range(depth - 1):
        parts = F.transform(F.map_entries(out), lambda e: F.when(e["value"].startswith("{"), F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))))
        out = F.map_from_entries(F.flatten(parts))
    return out


def detect_type(fields: Column) -> Column:
    keys = F.transform(F.map_keys(fields), lambda k: F.lower(k))
    has = lambda k: F.array_contains(keys, k)
    out = None
    for name, ways in RULES:
        cond = F.lit(False)
        for way in ways:
            one = F.lit(True)
            for k in way:
                one = one & has(k)
            cond = cond | one
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("generic")


def entity_id(kind: Column, fields: Column) -> Column:
    """First non-empty key field of the type; otherwise a hash of the sorted fields."""
    out = None
    for name, keys in ID_KEYS.items():
        v = F.coalesce(*[F.when(F.length(F.element_at(fields, k)) > 0, F.element_at(fields, k)) for k in keys])
        c = (kind == name) & v.isNotNull()
        text = F.concat(F.lit(name + "-"), F.regexp_replace(v, r"\s+", "_"))
        out = F.when(c, text) if out is None else out.when(c, text)
    sorted_fields = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")
    return out.otherwise(F.concat(kind, F.lit("-"), F.substring(F.md5(sorted_fields.cast("binary")), 1, 16)))


def in_range(value: Column, low: float, high: float) -> Column:
    v = value.try_cast("double")
    return F.when(v.between(low, high), v)


def ingest(rows: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(entities, dead letters): payloads that are not JSON objects are dead letters."""
    fields = flatten(F.col(payload))
    parsed = rows.withColumn("fields", F.when(F.trim(payload).startswith("{") & F.col(payload).isNotNull(), fields))
    ok = parsed.where("fields is not null and size(fields) > 0").withColumn("entity_type", detect_type(F.col("fields")))
    pick = lambda *ks: F.coalesce(*[F.element_at("fields", k) for k in ks])
    ok = ok.withColumn("entity_id", entity_id(F.col("entity_type"), F.col("fields"))).withColumn("lat", in_range(pick("lat", "latitude"), -90, 90)).withColumn("lon", in_range(pick("lon", "lng", "longitude"), -180, 180)).withColumn("confidence", F.coalesce(F.least(F.greatest(pick("confidence").try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))).withColumn("name", pick("name", "vessel_name", "aircraft_name"))
    return ok, parsed.where("fields is null or size(fields) = 0").drop("fields").withColumn("error", F.lit("not a JSON object"))
