from tidewatch.sources import marine


def sentence(body, start="!"):
    total = 0
    for c in body:
        total ^= ord(c)
    return f"{start}{body}*{total:02X}"


def armour(fields, size):
    """A payload of (start, bits, value) fields."""
    bits = ["0"] * ((size + 5) // 6 * 6)
    for start, n, v in fields:
        if isinstance(v, str):
            codes = [(ord(c) - 64 if ord(c) >= 64 else ord(c)) for c in v.ljust(n, "@")]
            word = "".join(f"{c:06b}" for c in codes)
        else:
            word = f"{v % 2**n:0{n}b}"
        bits[start : start + len(word)] = word
    sixes = [int("".join(bits[i : i + 6]), 2) for i in range(0, len(bits), 6)]
    return "".join(chr(v + 48 if v < 40 else v + 56) for v in sixes)


def one(payload, kind="AIVDM"):
    return sentence(f"{kind},1,1,,A,{payload},0")


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_position(spark):
    r = marine.ais(lines(spark, "!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C", "!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5D", None)).collect()
    assert len(r) == 1 and r[0].entity_id == "mmsi:477553000"
    assert abs(r[0].lat - 47.5828333) < 1e-6 and abs(r[0].lon + 122.3458333) < 1e-6
    assert r[0].properties["nav_status"] == "5" and r[0].properties["heading"] == "181" and float(r[0].properties["cog"]) == 51.0


def test_other_reports(spark):
    place = lambda x, y: [(x, 28, -3_000_000), (y, 27, 30_000_000)]
    station = armour([(0, 6, 4), (8, 30, 2320000), (38, 14, 2024), (52, 4, 5), (56, 5, 6), (61, 5, 7), (66, 6, 8), (72, 6, 9), *place(79, 107), (134, 4, 7)], 168)
    rescue = armour([(0, 6, 9), (8, 30, 111232511), (38, 12, 303), (50, 10, 42), *place(61, 89), (116, 12, 1545)], 168)
    aid = armour([(0, 6, 21), (8, 30, 992351000), (38, 5, 1), (43, 20, "WEST BUOY"), *place(164, 192)], 272)
    far = armour([(0, 6, 27), (8, 30, 206914217), (40, 4, 2), (44, 18, -3000), (62, 17, 30000), (79, 6, 63), (85, 9, 167)], 96)
    class_b = armour([(0, 6, 19), (8, 30, 367059850), (46, 10, 87), *place(57, 85), (112, 12, 3600), (124, 9, 511), (143, 20, "CAPT. J"), (263, 8, 36)], 312)
    rows = marine.ais(lines(spark, *[one(p) for p in (station, rescue, aid, far, class_b)], one(class_b, "AIVDO"), one(rescue[:10]), one(""), None)).collect()
    assert [(r.entity_id, r.entity_type) for r in rows] == [("ais_base:002320000", "ais_base_station"), ("mmsi:111232511", "sar_aircraft"), ("aton:992351000", "aton"), ("mmsi:206914217", "ship"), ("mmsi:367059850", "ship"), ("own_vessel", "ship")]
    assert all((r.lat, r.lon) == (50.0, -5.0) for r in rows)
    a, b, c, d, e, _ = (r.properties for r in rows)
    assert a["reported_at"] == "2024-05-06T07:08:09Z" and a["fix_type"] == "7" and (b["altitude_m"], b["sog"], b["cog"]) == ("303", "42.0", "154.5") and c["name"] == "WEST BUOY"
    assert "sog" not in d and d["cog"] == "167.0" and e["vessel_name"] == "CAPT. J" and e["ship_type"] == "36" and "cog" not in e and "heading" not in e


def test_reports_in_parts(spark):
    static = armour([(0, 6, 5), (8, 30, 351759000), (40, 30, 9134270), (70, 7, "3FOF8"), (112, 20, "EVER DIADEM"), (232, 8, 70), (294, 8, 122), (302, 20, "NEW YORK")], 424)
    p = lambda total, k, number, payload: sentence(f"AIVDM,{total},{k},{number},A,{payload},0")
    a, b = static[:40], static[40:]
    rows = [("x", 1, p(2, 1, 3, a)), ("x", 2, p(2, 1, 4, a)), ("x", 3, p(2, 2, 3, b)), ("y", 4, p(2, 2, 4, b)), ("x", 5, p(2, 2, 4, b)), ("x", 6, p(2, 2, 4, b)), ("z", 1, p(3, 1, 1, a)), ("z", 2, p(3, 3, 1, b)), ("z", 3, None)]
    df = spark.createDataFrame(rows, "feed string, n long, value string")
    got = marine.ais(df).collect()
    assert len(got) == 2
    for r in got:
        q = r.properties
        assert r.entity_id == "mmsi:351759000" and r.lat is None and (q["imo"], q["call_sign"], q["vessel_name"], q["ship_type"], q["draught_m"], q["destination"]) == ("9134270", "3FOF8", "EVER DIADEM", "70", "12.2", "NEW YORK")
    assert marine.ais(df.select("value")).count() == 0


def test_instruments(spark):
    bodies = ["GNVTG,54.7,T,34.4,M,5.5,N,10.2,K", "SDDBT,17.0,f,5.1,M,2.8,F", "WIMWD,270,T,,M,10,N,,M", "WIMWV,45,R,18.52,K,A", "HCHDG,101.1,1.5,W,7.1,E", "YXXDR,C,19.5,C,TempAir", "ERRPM,E,2,1500,10,A", "SDDBT,x,f,,M", "ERRPM"]
    rows = marine.instruments(lines(spark, *[sentence(b, "$") for b in bodies], "$SDDBT,17.0,f,5.1,M,2.8,F*00", None)).collect()
    assert [r.entity_id for r in rows] == ["own_vessel", "depth", "wind", "wind", "own_vessel", "sensor:TempAir", "engine:2"]
    q = [r.properties for r in rows]
    assert q[0]["course_magnetic"] == "34.4" and q[1]["depth_m"] == "5.1" and q[1]["below_surface"] == "false" and abs(float(q[2]["speed_ms"]) - 5.14444) < 1e-9 and abs(float(q[3]["speed_knots"]) - 10) < 1e-9
    assert q[4]["deviation"] == "-1.5" and q[4]["variation"] == "7.1" and q[5]["temperature_c"] == "19.5" and q[6]["rpm"] == "1500.0"
