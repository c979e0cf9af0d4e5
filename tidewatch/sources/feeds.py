"""Text feeds as observations: every decoder takes rows with a `value` line, batch or stream.

All give (entity_id, entity_type, lat, lon, properties MAP<STRING, STRING>) and use JVM
expressions alone, so a decoder runs inside the scan of `spark.read.text` or
`spark.readStream.text`.  Lines that a format does not accept, nulls among them, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def _filled(**named: Column) -> Column:
    """A map of the values that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _last_wins(entries: Column) -> Column:
    """Entries -> map; of a key that repeats, the last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _observed(rows: DataFrame, entity_id: Column, entity_type: Column, lat: Column, lon: Column, properties: Column) -> DataFrame:
    return rows.select(entity_id.alias("entity_id"), entity_type.alias("entity_type"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), properties.alias("properties"))


def sbs(lines: DataFrame) -> DataFrame:
    """Base-station lines of aircraft: surface and airborne positions (types 2 and 3) of 15 fields or more."""
    cut = lines.select(F.transform(F.split("value", ",", -1), lambda x: F.trim(x)).alias("f"))
    at = lambda i: F.when(F.length(F.get("f", F.lit(i))) > 0, F.get("f", F.lit(i)))
    num = lambda i: at(i).try_cast("double")
    kept = cut.where((F.size("f") >= 15) & (F.get("f", F.lit(0)) == "MSG") & at(1).isin("2", "3") & at(4).isNotNull())
    ground = F.when(at(21).isin("-1", "1"), F.lit(True)).when(at(21) == "0", F.lit(False))
    props = _filled(icao=at(4), callsign=at(10), altitude=num(11), speed=num(12), heading=num(13), vertical_rate=num(16), squawk=at(17), on_ground=ground)
    return _observed(kept, F.concat(F.lit("icao:"), at(4)), F.lit("aircraft"), num(14), num(15), props)


def cef_columns(text: Column) -> tuple[Column, dict[str, Column], Column, Column]:
    """Whether a text holds a common event, its seven header fields, its extensions as a map, and its severity as a number."""
    field = r"((?:[^|\\]|\\.)*+)\|"
    pattern = r"CEF:\s*([0-9]+)\|" + field * 6 + r"(.*)$"
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"\\([=|\\])", "$1")
    part = {n: plain(F.regexp_extract(text, pattern, i)) for i, n in enumerate(["version", "vendor", "product", "device_version", "signature", "name", "raw"], 1)}
    pair = r"(\w+)=((?:\\.|[^=\\])*?)(?=\s+\w+=|\s*$)"
    rest = F.regexp_extract(text, pattern, 8)
    keys, values = F.regexp_extract_all(rest, F.lit(pair), 1), F.regexp_extract_all(rest, F.lit(pair), 2)
    ext = _last_wins(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), plain(v).alias("value"))))
    word = F.lower(part["raw"])
    level = F.coalesce(part["raw"].try_cast("int"), F.when(word == "low", 2).when(word == "medium", 5).when(word == "high", 8).when(word == "very-high", 10))
    return text.rlike(pattern), part, ext, level


def cef(lines: DataFrame) -> DataFrame:
    """Common event format: seven header fields, then key=value extensions; backslash escapes pipe, equals and itself."""
    found, part, ext, level = cef_columns(F.col("value"))
    rows = lines.where(found).select(*[c.alias(n) for n, c in part.items()], ext.alias("ext"), level.alias("level"))
    level = F.col("level")
    named = F.when(level <= 3, "Low").when(level <= 6, "Medium").when(level <= 8, "High").when(level <= 10, "Very-High").otherwise("Unknown")
    known = {"source_address": "src", "destination_address": "dst", "source_port": "spt", "destination_port": "dpt", "action": "act", "message": "msg", "category": "cat"}
    head = _filled(cef_version=F.col("version"), device_vendor=F.col("vendor"), device_product=F.col("product"), device_version=F.col("device_version"), signature_id=F.col("signature"), event_name=F.col("name"), severity=named, severity_raw=F.col("raw"), **{k: F.element_at("ext", v) for k, v in known.items()})
    props = F.map_concat(head, F.transform_keys("ext", lambda k, _: F.concat(F.lit("ext_"), k)))
    return _observed(rows, F.concat_ws(":", F.lit("cef"), "vendor", "product", "signature"), F.lit("security_event"), F.lit(None), F.lit(None), props)


def _degrees(text: Column, side: Column) -> Column:
    """DDMM.MMMM and a hemisphere -> signed degrees."""
    v = text.try_cast("double")
    whole = F.floor(v / 100)
    d = whole + (v - whole * 100) / 60
    return F.when(side.isin("N", "E"), d).when(side.isin("S", "W"), -d)


def checked(lines: DataFrame) -> DataFrame:
    """(body) of the marine sentences whose XOR checksum is there and right."""
    rows = lines.select(F.regexp_extract("value", r"^\s*[$!]([^*]+)\*([0-9A-Fa-f]{2})\s*$", 1).alias("body"), F.regexp_extract("value", r"\*([0-9A-Fa-f]{2})\s*$", 1).alias("sum"))
    xor = F.aggregate(F.split("body", ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))
    return rows.where((F.length("body") > 0) & (F.conv("sum", 16, 10).try_cast("int") == xor)).select("body")


def fixes(lines: DataFrame, vessel: str = "own_vessel") -> DataFrame:
    """Positions of the own vessel from GGA and valid RMC sentences of any talker."""
    rows = checked(lines).select(F.split("body", ",", -1).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    num = lambda i: at(i).try_cast("double")
    kind = F.substring(at(0), 3, 3)
    gga, rmc = kind == "GGA", (kind == "RMC") & (at(2) == "A")
    lat = F.when(gga, _degrees(at(2), at(3))).otherwise(_degrees(at(3), at(4)))
    lon = F.when(gga, _degrees(at(4), at(5))).otherwise(_degrees(at(5), at(6)))
    props = _filled(source=F.lower(at(0)), altitude_m=F.when(gga, num(9)), satellites=F.when(gga, at(7).try_cast("int")), hdop=F.when(gga, num(8)), fix_quality=F.when(gga, at(6).try_cast("int")), speed_knots=F.when(rmc, num(7)), course=F.when(rmc, num(8)))
    return _observed(rows.where(gga | rmc), F.lit(vessel), F.lit("own_vessel"), lat, lon, props).where("lat is not null and lon is not null")


def geojson(texts: DataFrame) -> DataFrame:
    """One row per feature of collections or single features; the position is the mean of all vertices, of any geometry."""
    parsed = F.from_json("value", "type string, features array<string>")
    many = texts.select("value", parsed.alias("j")).where("j.type in ('Feature', 'FeatureCollection')")
    each = many.select(F.posexplode(F.when(F.col("j.type") == "Feature", F.array("value")).otherwise(F.col("j.features"))).alias("i", "one"))
    cols = each.select("i", F.from_json("one", "id string, geometry string, properties map<string,string>").alias("x")).select("i", "x.*")
    vertex = r"\[\s*(" + NUMBER + r")\s*,\s*(" + NUMBER + ")"
    mean = lambda g: F.aggregate(F.regexp_extract_all("geometry", F.lit(vertex), g), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, v: F.struct((acc["s"] + v.try_cast("double")).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.try_divide(acc["s"], acc["n"]))
    own = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    entries = F.concat(F.map_entries(own), F.map_entries(_filled(geometry_type=F.get_json_object("geometry", "$.type"), geometry=F.col("geometry"))))
    return _observed(cols, F.coalesce("id", F.concat(F.lit("geojson:feature-"), F.col("i").cast("string"))), F.coalesce(F.element_at(own, "entity_type"), F.lit("feature")), F.coalesce(mean(2), F.lit(0.0)), F.coalesce(mean(1), F.lit(0.0)), _last_wins(entries))


def envelope(lines: DataFrame, default_type: str, topic: Column | None = None) -> DataFrame:
    """JSON messages of a broker: id, entity_id, device_id or the topic names the entity; lat, lon and lng place it."""
    rows = lines.select(F.from_json("value", "map<string,string>").alias("m"), (F.lit(None).cast("string") if topic is None else topic).alias("topic")).where("m is not null")
    get = lambda *ks: F.coalesce(*[F.element_at("m", k) for k in ks])
    entity = F.coalesce(get("id", "entity_id", "device_id"), F.col("topic"))
    taken = ["id", "entity_id", "device_id", "entity_type", "lat", "latitude", "lon", "lng", "longitude"]
    props = F.map_filter("m", lambda k, v: ~k.isin(*taken) & v.isNotNull())
    return _observed(rows, entity, F.coalesce(get("entity_type"), F.lit(default_type)), get("lat", "latitude").try_cast("double"), get("lon", "lng", "longitude").try_cast("double"), props).where("entity_id is not null")


def delimited(rows: DataFrame, entity_type: str, id_column: str, lat_column: str, lon_column: str) -> DataFrame:
    """Rows of `read.csv(header=True)`: all other columns are properties; rows without an id go."""
    key = F.trim(id_column)
    rest = {c: F.trim(c) for c in rows.columns if c not in (id_column, lat_column, lon_column)}
    props = _filled(**rest) if rest else F.create_map().cast("map<string,string>")
    return _observed(rows.where(F.length(key) > 0), F.concat(F.lit(entity_type + ":"), key), F.lit(entity_type), F.trim(lat_column).try_cast("double"), F.trim(lon_column).try_cast("double"), props)


def metar(lines: DataFrame) -> DataFrame:
    """Aviation weather reports: wind, temperature, dew point and pressure of a station."""
    got = lambda pattern, i: F.when(F.col("value").rlike(pattern), F.nullif(F.regexp_extract("value", pattern, i), F.lit("")))
    station = got(r"^\s*(?:METAR |SPECI )?(?:COR )?([A-Z][A-Z0-9]{3}) [0-9]{6}Z", 1)
    wind, heat = r" ([0-9]{3}|VRB)([0-9]{2,3})(?:G([0-9]{2,3}))?KT\b", r" (M?[0-9]{2})/(M?[0-9]{2})?(?: |$|=)"
    celsius = lambda i: F.regexp_replace(got(heat, i), "^M", "-").try_cast("int")
    inches, hecto = got(r" A([0-9]{4})\b", 1).try_cast("double") / 100, got(r" Q([0-9]{4})\b", 1).try_cast("double")
    props = _filled(station=station, wind_direction=got(wind, 1).try_cast("int"), wind_speed_kt=got(wind, 2).try_cast("int"), wind_gust_kt=got(wind, 3).try_cast("int"), temperature_c=celsius(1), dewpoint_c=celsius(2), altimeter_inhg=inches, pressure_hpa=hecto)
    return _observed(lines.where(station.isNotNull()), F.concat(F.lit("metar:"), station), F.lit("weather_station"), F.lit(None), F.lit(None), props)
