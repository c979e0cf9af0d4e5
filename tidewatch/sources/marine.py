"""Marine instruments and vessel reports of all kinds, from sentences with a right checksum.

`feeds.fixes` gives the own vessel's positions; here are its other instruments and what
other vessels, aids and stations send, in one sentence or several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .feeds import _filled, _observed, checked

MOST_PARTS = 9
SIGNS = "".join(chr(v + 48 if v < 40 else v + 56) for v in range(64))
BASE64 = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(48, 58), 43, 47))


def instruments(lines: DataFrame) -> DataFrame:
    """Course and speed, heading, depth, wind, engines and transducers; a sentence whose main number is missing gives no row."""
    rows = checked(lines).select(F.split("body", ",", -1).alias("f")).withColumn("k", F.upper(F.get("f", F.lit(0))))
    at = lambda i: F.get("f", F.lit(i))
    num = lambda i: at(i).try_cast("double")
    k, size = F.col("k"), F.size("f")
    vtg, depth = k.endswith("VTG") & (size >= 8), k.isin("SDDBT", "SDDBS") & (size >= 4)
    mwd, mwv = (k == "WIMWD") & (size >= 8), (k == "WIMWV") & (size >= 5)
    hdg, xdr, rpm = (k == "HCHDG") & (size >= 5), (k == "YXXDR") & (size >= 5), (k == "ERRPM") & (size >= 4)
    main = F.when(vtg, F.coalesce(num(1), num(5), num(7))).when(depth, num(3)).when(mwd, F.when(num(5).isNotNull(), num(1))).when(mwv, F.when(num(3).isNotNull(), num(1))).when(hdg, num(1)).when(xdr, num(2)).when(rpm, num(3))
    side = lambda v, i: F.when(F.coalesce(at(i), F.lit("")) == "W", -num(v)).otherwise(num(v))
    engine = F.coalesce(at(2).try_cast("int"), F.lit(0))
    of = lambda kind, c: F.when(kind, c)
    knots = F.when(at(4) == "K", num(3) / 1.852).when(at(4).isin("M", "S"), num(3) / 0.514444).otherwise(num(3))
    measured = lambda what: of(xdr & (at(1) == what), num(2))
    props = _filled(
        source=F.lower("k"), course_true=of(vtg, F.coalesce(num(1), F.lit(0.0))), course_magnetic=of(vtg, num(3)), speed_kmh=of(vtg, F.coalesce(num(7), F.lit(0.0))),
        depth_m=of(depth, num(3)), below_surface=of(depth, k == "SDDBS"), direction_true=of(mwd, num(1)), speed_ms=of(mwd, F.coalesce(num(7), num(5) * 0.514444)), wind_angle=of(mwv, num(1)),
        speed_knots=F.when(vtg, F.coalesce(num(5), F.lit(0.0))).when(mwd, num(5)).when(mwv, knots), reference=F.when(mwd, "T").when(mwv, at(2)),
        heading_magnetic=of(hdg, num(1)), deviation=of(hdg, side(2, 3)), variation=of(hdg, side(4, 5)),
        transducer_type=of(xdr, at(1)), value=of(xdr, num(2)), units=of(xdr, at(3)), temperature_c=measured("C"), pressure_pa=measured("P"), humidity_pct=measured("H"), rpm=of(rpm, num(3)), engine_number=of(rpm, engine))
    entity = F.when(depth, "depth").when(mwd | mwv, "wind").when(xdr, F.concat(F.lit("sensor:"), at(4))).when(rpm, F.concat(F.lit("engine:"), engine.cast("string"))).otherwise("own_vessel")
    kind = F.when(depth, "depth_reading").when(mwd | mwv, "wind_reading").when(xdr, "sensor").when(rpm, "engine").otherwise("own_vessel")
    return _observed(rows.where(main.isNotNull()), entity, kind, F.lit(None), F.lit(None), props)


def payloads(lines: DataFrame) -> DataFrame:
    """(payload, own): of reports in one sentence, and, where the lines have `feed` and `n`, of those in several.

    Parts of a message follow one another in their feed (by `n`) under one message number and
    channel, in order; others may stand between.  A message with a part missing gives no row.
    Only sentences that are parts are shuffled.
    """
    along = [c for c in ("feed", "n") if c in lines.columns]
    rows = lines.select(F.struct("value", *along).alias("line"), "value")
    right = F.aggregate(F.split(F.regexp_extract("value", r"^\s*[$!]([^*]+)\*", 1), ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))
    said = F.conv(F.regexp_extract("value", r"\*([0-9A-Fa-f]{2})\s*$", 1), 16, 10).try_cast("int")
    rows = rows.where(F.col("value").rlike(r"^\s*[$!]AIVD[MO],[^*]+\*[0-9A-Fa-f]{2}\s*$") & (right == said))
    f = F.split(F.regexp_extract("value", r"^\s*[$!]([^*]+)\*", 1), ",", -1)
    at = lambda i: F.get("f", F.lit(i))
    cut = rows.select(f.alias("f"), "line").select((at(0) == "AIVDO").alias("own"), at(1).try_cast("int").alias("total"), at(2).try_cast("int").alias("part"), at(3).alias("number"), at(4).alias("channel"), at(5).alias("payload"), "line")
    whole = cut.where((F.col("total") == 1) & (F.col("part") == 1)).select("payload", "own")
    if len(along) < 2:
        return whole
    parts = cut.where(F.col("total").between(2, MOST_PARTS) & F.col("part").between(1, F.col("total")))
    w = Window.partitionBy("line.feed", "number", "channel", "own", "total").orderBy("line.n").rowsBetween(-(MOST_PARTS - 1), 0)
    held = parts.withColumn("near", F.collect_list(F.struct("part", "payload")).over(w)).where((F.col("part") == F.col("total")) & (F.size("near") >= F.col("total")))
    held = held.withColumn("near", F.slice("near", F.greatest(F.size("near") - F.col("total") + 1, F.lit(1)), F.col("total"))).where(F.transform("near", lambda x: x["part"]) == F.sequence(F.lit(1), F.col("total")))
    return whole.unionByName(held.select(F.array_join(F.transform("near", lambda x: x["payload"]), "").alias("payload"), "own"))


def ais(lines: DataFrame) -> DataFrame:
    """Reports of vessels (types 1-3, 5, 18, 19, 27), stations (4), rescue aircraft (9) and aids (21).

    Values marked as not available are null.  A report that is too short for its type gives no row.
    """
    # the 64 signs of a payload are those of base 64 in another order, so a payload is bytes at once
    kept = payloads(lines).where(F.col("payload").rlike("^[0-W`-w]+$"))
    filled = F.rpad(F.translate("payload", SIGNS, BASE64), (F.ceil(F.length("payload") / 4) * 4).cast("int"), "A")
    rows = kept.select("payload", "own", F.concat(F.hex(F.unbase64(filled)), F.lit("0000")).alias("h"))
    # cheap for filters: the type is the first sign, and the bits are counted, not built
    t = F.ascii("payload") - F.when(F.ascii("payload") >= 96, 56).otherwise(48)
    size = F.length("payload") * 6

    def take(start: int, n: int) -> Column:
        end = -(-(start + n) // 4)
        word = F.conv(F.substring("h", start // 4 + 1, end - start // 4), 16, 10).try_cast("long")
        return F.shiftright(word, end * 4 - start - n).bitwiseAND(2**n - 1)

    # type -> fewest bits, places of longitude, latitude, speed, course, heading
    layout = {(1, 2, 3): (149, 61, 89, 50, 116, 128), (18, 19): (133, 57, 85, 46, 112, 124), (4,): (149, 79, 107, None, None, None), (9,): (134, 61, 89, 50, 116, None), (21,): (219, 164, 192, None, None, None), (27,): (96, 44, 62, 79, 85, None), (5,): (302, None, None, None, None, None)}
    need = lon = lat = sog = cog = heading = F.lit(None).cast("double")
    signed = lambda v, n: F.when(v >= 2 ** (n - 1), v - 2**n).otherwise(v)
    for types, (bits, x, y, s, c, h) in layout.items():
        mine, far = t.isin(*types), types == (27,)
        need = F.when(mine, F.lit(bits)).otherwise(need)
        if x is not None:
            lon = F.when(mine, signed(take(x, 18), 18) / 600.0 if far else signed(take(x, 28), 28) / 600000.0).otherwise(lon)
            lat = F.when(mine, signed(take(y, 17), 17) / 600.0 if far else signed(take(y, 27), 27) / 600000.0).otherwise(lat)
        if s is not None:
            v = take(s, 6) if far else take(s, 10)
            sog = F.when(mine, F.when(v < (63 if far else 1023), v.cast("double") if far or types == (9,) else v / 10.0)).otherwise(sog)
            v = take(c, 9) if far else take(c, 12)
            cog = F.when(mine, F.when(v < (360 if far else 3600), v.cast("double") if far else v / 10.0)).otherwise(cog)
        if h is not None:
            heading = F.when(mine, F.when(take(h, 9) < 360, take(h, 9))).otherwise(heading)
    rows = rows.where(size >= need)

    def text(start: int, n: int) -> Column:
        def letter(i: Column) -> Column:
            at = i * 6 + start
            word = F.conv(F.substr("h", F.floor(at / 4).cast("int") + 1, F.lit(3)), 16, 10).cast("int")
            # three hex digits hold the six bits from the place's rest on
            return F.floor(word / F.pow(F.lit(2.0), 6 - at % 4)).cast("int") % 64

        plain = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.char(F.when(letter(i) < 32, letter(i) + 64).otherwise(letter(i)))), "")
        return F.nullif(F.trim(F.regexp_replace(plain, "@.*$", "")), F.lit(""))

    mmsi = F.lpad(take(8, 30).cast("string"), 9, "0")
    fixed, station, aid, rescue = t == 5, t == 4, t == 21, t == 9
    of = lambda when, c: F.when(when, c)
    sent = F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", take(38, 14), take(52, 4), take(56, 5), take(61, 5), take(66, 6), take(72, 6))
    imo = take(40, 30)
    props = _filled(
        mmsi=mmsi, message_type=t, sog=sog, cog=cog, heading=heading.cast("int"), nav_status=F.when(t.between(1, 3), take(38, 4)).when(t == 27, take(40, 4)),
        imo=of(fixed & (imo > 0), imo), call_sign=of(fixed, text(70, 7)), vessel_name=F.when(fixed, text(112, 20)).when((t == 19) & (size >= 263), text(143, 20)), ship_type=F.when(fixed, take(232, 8)).when((t == 19) & (size >= 271), take(263, 8)),
        draught_m=of(fixed, take(294, 8) / 10.0), destination=of(fixed & (size >= 422), text(302, 20)), altitude_m=of(rescue & (take(38, 12) < 4095), take(38, 12)),
        aid_type=of(aid, take(38, 5)), name=of(aid, text(43, 20)), reported_at=of(station & (take(38, 14) > 0), sent), fix_type=of(station, take(134, 4)))
    entity = F.when(station, F.concat(F.lit("ais_base:"), mmsi)).when(aid, F.concat(F.lit("aton:"), mmsi)).when(F.col("own"), "own_vessel").otherwise(F.concat(F.lit("mmsi:"), mmsi))
    kind = F.when(station, "ais_base_station").when(aid, "aton").when(rescue, "sar_aircraft").otherwise("ship")
    there = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return _observed(rows, entity, kind, F.when(there, lat), F.when(there, lon), props)
