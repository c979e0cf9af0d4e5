import struct

from pyspark.sql import functions as F

from tidewatch.sources import packets


def values(spark, *given):
    return spark.createDataFrame([(bytearray(v) if v is not None else None,) for v in given], "value binary")


def lines(spark, *given):
    return spark.createDataFrame([(v,) for v in given], "value string")


def test_flows_of_version_5(spark):
    record = bytes([10, 0, 0, 1, 10, 0, 0, 2, 0, 0, 0, 0]) + struct.pack(">HHIIIIHHBBBBHHBBH", 1, 2, 7, 900, 1000, 4000, 443, 5000, 0, 0x12, 6, 8, 64, 65, 24, 24, 0)
    packet = struct.pack(">HHIIIIBBH", 5, 2, 0, 1700000000, 0, 0, 0, 0, 0) + record * 2
    rows = packets.netflow5(values(spark, packet, packet[:-1], packet[:30], b"", None)).collect()
    assert [r.entity_id for r in rows] == ["netflow:10.0.0.1:443-10.0.0.2:5000"] * 3
    p = rows[0].properties
    assert p["protocol"] == "TCP" and p["tcp_flags"] == "SYN ACK" and p["bytes"] == "900" and p["duration_ms"] == "3000" and p["tos"] == "8" and p["dst_as"] == "65"


def test_flows_with_templates(spark):
    fields = [(8, 4), (12, 4), (7, 2), (11, 2), (1, 4), (56, 6)]
    template = struct.pack(">HH", 300, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
    flow = lambda last: bytes([1, 2, 3, 4, 5, 6, 7, last]) + struct.pack(">HHI", 80, 81, 99) + bytes(range(6))
    part = lambda k, body: struct.pack(">HH", k, len(body) + 4) + body
    head = struct.pack(">HHIIII", 9, 1, 0, 1700000000, 0, 7)
    ten = struct.pack(">HHIII", 10, 0, 1700000000, 0, 7)
    rows = [("a", 1, head + part(300, flow(1))), ("a", 2, head + part(0, template) + part(300, flow(2) + flow(3) + b"\0\0")), ("a", 3, head + part(300, flow(4))), ("b", 9, head + part(300, flow(5))), ("c", 1, ten + part(2, template) + part(300, flow(6))), ("c", 2, b"\0"), ("c", 3, None)]
    df = spark.createDataFrame([(e, s, bytearray(v) if v is not None else None) for e, s, v in rows], "exporter string, seq long, value binary")
    got = sorted((r.entity_id, r.properties["in_bytes"], r.properties["in_src_mac"], r.properties["netflow_version"]) for r in packets.netflow_templated(df).collect())
    assert got == [(f"netflow:1.2.3.4:80-5.6.7.{i}:81", "99", "000102030405", "10" if i == 6 else "9") for i in (2, 3, 4, 6)]


def test_captures(spark):
    def frame(kind, rest):
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(rest), 0, 0, 63, kind, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
        return bytes(12) + b"\x08\x00" + ip + rest

    frames = [frame(6, struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x18, 0, 0, 0) + b"hello"), frame(17, struct.pack(">HHHH", 53, 99, 0, 0) + b"x"), frame(1, b"ping"), bytes(12) + b"\x86\xdd" + bytes(40)]
    for order, mark in (("<", 0xA1B2C3D4), (">", 0xA1B2C3D4)):
        file = struct.pack(order + "IHHiIII", mark, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "IIII", 5, 0, len(f), len(f)) + f for f in frames)
        rows = packets.pcap(values(spark, file, file[:-1], b"", None)).collect()
        assert [r.entity_id for r in rows[:3]] == ["pcap:10.0.0.1:1234-10.0.0.2:80", "pcap:10.0.0.1:53-10.0.0.2:99", "pcap:10.0.0.1-10.0.0.2"] and len(rows) == 6
        assert rows[0].properties["tcp_flags"] == "PSH ACK" and rows[0].properties["payload_size"] == "5" and rows[1].properties["payload_size"] == "1" and rows[2].properties["protocol"] == "ICMP"


def klv_set(*tags, wrong=0):
    body = b"".join(bytes([t, len(v)]) + v for t, v in tags)
    whole = packets.KLV_KEY + bytes([len(body) + 4]) + body + b"\x01\x02"
    total = sum(b << 8 * ((i + 1) % 2) for i, b in enumerate(whole)) + wrong
    return whole + struct.pack(">H", total % 65536)


def test_video_metadata(spark):
    one = klv_set((3, b"M1"), (4, b"T9"), (5, b"\xff\xff"), (13, struct.pack(">i", 2**30)), (14, struct.pack(">i", -(2**31))))
    two = klv_set((5, b"\x00\x00"))
    bad = klv_set((4, b"no"), wrong=1)
    df = spark.createDataFrame([(bytearray(v), "s") for v in (one + b"\0\0" + two, two + bad + two, one[:-1], b"")], "value binary, sender string")
    rows = packets.klv(df).collect()
    assert [r.entity_id for r in rows] == ["M1-T9", "klv-s", "klv-s"]
    assert abs(rows[0].lat - 45) < 1e-6 and rows[0].lon is None and rows[0].properties["platform_heading_deg"] == "360.0"


def test_radio_frames(spark):
    data = "40 04030201 A1 0500 FF 0A BEEF 11223344"
    join = "00" + "0807060504030201" + "1817161514131211" + "3412" + "AABBCCDD"
    rows = packets.lorawan(lines(spark, data, join, "20DEAD01020304", "zz", "4001", "", None)).collect()
    assert [r.entity_id for r in rows] == ["lorawan:01020304", "lorawan:join:1112131415161718", "lorawan:join_accept"]
    p = rows[0].properties
    assert p["fcnt"] == "5" and p["adr"] == "true" and p["ack"] == "true" and p["fopts_len"] == "1" and p["fport"] == "10" and p["frm_payload_hex"] == "BEEF" and p["mic"] == "44332211" and p["mtype"] == "UnconfirmedDataUp"
    assert rows[1].properties["dev_nonce"] == str(0x1234)


def test_vehicle_bus(spark):
    rows = packets.canbus(lines(spark, "(1700000000.5) can0 0CF00400#FF7D7D0032FFFFFF", "(1.0) can0 123#AABB", "(1.0) can0 18FEF100#00008000", "# note", "x", None)).collect()
    assert [(r.entity_id, r.entity_type) for r in rows] == [("canbus:j1939:sa-0", "engine"), ("canbus:123", "vehicle"), ("canbus:j1939:sa-0", "vehicle")]
    p = rows[0].properties
    assert p["pgn"] == "61444" and float(p["engine_speed_rpm"]) == 1600.0 and p["priority"] == "3" and p["pgn_name"] == "Engine Speed" and float(rows[2].properties["vehicle_speed_kmh"]) == 128.0 and "pgn" not in rows[1].properties


def test_aircraft_messages(spark):
    rows = packets.acars(lines(spark, "MODE: 2\nREG: .N123\nLABEL: H1\nFLIGHT: AB12\nMSG: one\nREG: not this", "REG: x\nLABEL: y", "", None)).collect()
    assert [r.entity_id for r in rows] == ["acars:N123"] and rows[0].properties["message_text"] == "one\nREG: not this" and rows[0].properties["mode_description"] == "VHF ACARS" and rows[0].properties["flight_id"] == "AB12"
