"""Binary feeds as observations: flow exports, packet captures, video metadata, radio frames, vehicle buses.

Formats of fixed places are read by JVM expressions over the hex text of a value; those whose
parts must be walked one after the other are read in Arrow batches, a value at a time.  Values that
a format does not accept, nulls among them, give no row; a damaged value keeps the parts before the damage.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .feeds import _filled, _observed

OBSERVED = "entity_id string, entity_type string, lat double, lon double, properties map<string,string>"
# fixed values: numbers of protocols above IP and of fields of a flow template
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 89: "OSPF", 132: "SCTP"}
FLOW_FIELDS = {
    1: "in_bytes",
    2: "in_pkts",
    3: "flows",
    4: "protocol",
    5: "src_tos",
    6: "tcp_flags",
    7: "l4_src_port",
    8: "ipv4_src_addr",
    10: "input_snmp",
    11: "l4_dst_port",
    12: "ipv4_dst_addr",
    14: "output_snmp",
    15: "ipv4_next_hop",
    16: "src_as",
    17: "dst_as",
    21: "last_switched",
    22: "first_switched",
    23: "out_bytes",
    24: "out_pkts",
    32: "icmp_type",
    56: "in_src_mac",
    80: "in_dst_mac",
    136: "flow_end_reason",
    152: "flow_start_milliseconds",
    153: "flow_end_milliseconds",
}
ADDRESSES = (8, 12, 15)
TCP_FLAGS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG"]
# fixed values: key of a set of video metadata
KLV_KEY = bytes.fromhex("060E2B34020B01010E01030101000000")
# fixed values: message types of a radio frame, by number
LORA_TYPES = ["JoinRequest", "JoinAccept", "UnconfirmedDataUp", "UnconfirmedDataDown", "ConfirmedDataUp", "ConfirmedDataDown", "RejoinRequest", "Proprietary"]
# fixed values: groups of parameters on a vehicle bus
GROUPS = {
    61444: "Engine Speed",
    65265: "Vehicle Speed",
    65262: "Engine Temperature",
    65266: "Fuel Consumption",
    65272: "Transmission Oil Temperature",
    65267: "Brake System Pressure",
    65269: "Ambient Conditions",
    65271: "Vehicle Electrical Power",
    65276: "Dash Display",
    65253: "Engine Hours",
}
ENGINE_GROUPS = (61444, 65262, 65253, 65266)


def _walked(rows: DataFrame, read: Callable[..., Iterator[tuple]], schema: str, *columns: str) -> DataFrame:
    """Rows that a reader gives for each value; of a value that it cannot go on with, those before."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for args in pdf[list(columns)].itertuples(index=False, name=None):
                try:
                    for row in read(*args):
                        out.append(row)
                except (struct.error, IndexError, ValueError):
                    pass
            yield pd.DataFrame(out, columns=names)

    return rows.select(*columns).where(F.col(columns[0]).isNotNull()).mapInPandas(run, schema)


def _row(entity: str, kind: str, lat, lon, props: dict) -> tuple:
    return entity, kind, lat, lon, {k: v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in props.items() if v is not None}


def _address(b: bytes) -> str:
    return ".".join(map(str, b))


def _flags(bits: int) -> str:
    return " ".join(n for i, n in enumerate(TCP_FLAGS) if bits >> i & 1)


def _number(hexed: Column, start: Column | int, size: int) -> Column:
    """The unsigned number of `size` bytes from a place on, most significant first."""
    at = (start if isinstance(start, Column) else F.lit(start)) * 2 + 1
    return F.conv(F.substr(hexed, at.cast("int"), F.lit(size * 2)), 16, 10).try_cast("long")


def _little(hexed: Column, start: int, size: int) -> Column:
    """The same, least significant first; null where the bytes end before."""
    out = F.lit(0).cast("long")
    for i in range(size):
        out = out + _number(hexed, start + i, 1) * 256**i
    return F.when(F.length(hexed) >= (start + size) * 2, out)


def netflow5(packets: DataFrame) -> DataFrame:
    """Flow exports of version 5: a row for each of the records that a packet holds whole."""
    h = F.hex("value")
    whole = F.least(_number(F.col("h"), 2, 2), F.floor((F.length("h") / 2 - 24) / 48))
    rows = packets.select(h.alias("h")).where(F.col("h").startswith("0005") & (F.length("h") >= 144)).where(whole > 0)
    rows = rows.select("h", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("i"))
    n = lambda place, size: _number(F.col("h"), F.col("i") * 48 + 24 + place, size)
    ip = lambda place: F.concat_ws(".", *[n(place + k, 1).cast("string") for k in range(4)])
    name = F.lit("OTHER")
    for number, text in PROTOCOLS.items():
        name = F.when(n(38, 1) == number, text).otherwise(name)
    flags = F.concat_ws(" ", *[F.when(n(37, 1).bitwiseAND(2**i) != 0, F.lit(t)) for i, t in enumerate(TCP_FLAGS)])
    props = _filled(
        src_ip=ip(0), dst_ip=ip(4), src_port=n(32, 2), dst_port=n(34, 2), protocol=name, protocol_num=n(38, 1), packets=n(16, 4), bytes=n(20, 4),
        duration_ms=F.greatest(n(28, 4) - n(24, 4), F.lit(0)), tcp_flags=flags, tos=n(39, 1), src_as=n(40, 2), dst_as=n(42, 2), next_hop=ip(8), netflow_version=F.lit(5), unix_secs=_number(F.col("h"), 8, 4))
    entity = F.concat(F.lit("netflow:"), ip(0), F.lit(":"), n(32, 2).cast("string"), F.lit("-"), ip(4), F.lit(":"), n(34, 2).cast("string"))
    return _observed(rows, entity, F.lit("network_flow"), F.lit(None), F.lit(None), props)


def _flow_sets(value: bytes, exporter, seq) -> Iterator[tuple]:
    """The templates and the data sets of a packet of version 9 or 10, in their order."""
    version = struct.unpack_from(">H", value)[0]
    if version == 9:
        seconds, source, at, templates = struct.unpack_from(">I", value, 8)[0], struct.unpack_from(">I", value, 16)[0], 20, 0
    elif version == 10:
        seconds, source, at, templates = struct.unpack_from(">I", value, 4)[0], struct.unpack_from(">I", value, 12)[0], 16, 2
    else:
        return
    part = 0
    while at + 4 <= len(value):
        set_id, length = struct.unpack_from(">HH", value, at)
        if length < 4:
            return
        body, at = bytes(value[at + 4 : at + length]), at + length
        if set_id == templates:
            place = 0
            while place + 4 <= len(body):
                template, count = struct.unpack_from(">HH", body, place)
                place += 4
                fields = []
                for _ in range(count):
                    kind, size = struct.unpack_from(">HH", body, place)
                    place += 4
                    if version == 10 and kind & 0x8000:
                        kind, place = 0, place + 4
                    fields += [kind, size]
                if template < 256:
                    break
                yield exporter, source, seq, part, version, seconds, template, fields, None
                part += 1
        elif set_id >= 256:
            yield exporter, source, seq, part, version, seconds, set_id, None, body
            part += 1


def _flow_records(body: bytes, fields, version: int, seconds: int) -> Iterator[tuple]:
    pairs = list(zip(fields[::2], fields[1::2]))
    size = sum(n for _, n in pairs)
    if size == 0 or any(n == 65535 for _, n in pairs):  # fields of varying length are not read
        return
    for start in range(0, len(body) - size + 1, size):
        at, got = start, {}
        for kind, n in pairs:
            raw, at = body[at : at + n], at + n
            name = FLOW_FIELDS.get(int(kind), "unknown")
            got[name] = _address(raw) if kind in ADDRESSES and n == 4 else str(int.from_bytes(raw, "big")) if n in (1, 2, 4, 8) else raw.hex()
        a, b = got.get("ipv4_src_addr", "0.0.0.0"), got.get("ipv4_dst_addr", "0.0.0.0")
        yield _row(f"netflow:{a}:{got.get('l4_src_port', 0)}-{b}:{got.get('l4_dst_port', 0)}", "network_flow", None, None, got | {"netflow_version": version, "unix_secs": seconds})


def netflow_templated(packets: DataFrame) -> DataFrame:
    """Flow exports of versions 9 and 10, (exporter, seq, value): each data set is read by the last template before it.

    A template holds for its exporter and source from its packet on (`seq` orders packets).  Data
    before their template, and templates with fields of varying length, give no row.  Only changes
    of a template are gathered, so repeated announcements cost nothing and data sets, a hot
    exporter's too, meet a short list by an equi-join that may be split; packets are walked twice.
    """
    schema = "exporter string, source long, seq long, part int, version int, seconds long, template int, fields array<int>, body binary"
    sets = _walked(packets.select("value", F.col("exporter").cast("string").alias("exporter"), F.col("seq").cast("long").alias("seq")), _flow_sets, schema, "value", "exporter", "seq")
    key = ["exporter", "source", "template"]
    w = Window.partitionBy(*key).orderBy("seq", "part")
    said = sets.where("fields is not null").select(*key, "seq", "part", "fields").withColumn("before", F.lag("fields").over(w)).where("before is null or before <> fields")
    held = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "part", "fields"))).alias("all"))
    place = F.struct("seq", "part")
    data = sets.where("body is not null").drop("fields").withColumn("place", place).join(held, key)
    last = F.get(F.reverse(F.filter("all", lambda t: F.struct(t["seq"], t["part"]) <= F.col("place"))), F.lit(0))["fields"]
    return _walked(data.withColumn("fields", last).where("fields is not null"), _flow_records, OBSERVED, "body", "fields", "version", "seconds")


def _captured(value: bytes) -> Iterator[tuple]:
    mark = bytes(value[:4])
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(mark)
    if order is None or struct.unpack_from(order + "I", value, 20)[0] != 1:
        return
    at = 24
    while at + 16 <= len(value):
        seconds, _, kept, whole = struct.unpack_from(order + "IIII", value, at)
        frame, at = value[at + 16 : at + 16 + kept], at + 16 + kept
        if at > len(value):
            return
        if len(frame) < 34 or frame[12:14] != b"\x08\x00" or frame[14] >> 4 != 4:
            continue
        head, total = (frame[14] & 15) * 4, struct.unpack_from(">H", frame, 16)[0]
        kind, src, dst = frame[23], _address(frame[26:30]), _address(frame[30:34])
        props = {"src_ip": src, "dst_ip": dst, "protocol": PROTOCOLS.get(kind, "OTHER"), "payload_size": max(0, total - head), "orig_len": whole, "ttl": frame[22], "ts_sec": seconds}
        rest, entity = frame[14 + head :], f"pcap:{src}-{dst}"
        if kind in (6, 17) and len(rest) >= (20 if kind == 6 else 8):
            a, b = struct.unpack_from(">HH", rest)
            own = (rest[12] >> 4) * 4 if kind == 6 else 8
            props |= {"src_port": a, "dst_port": b, "payload_size": max(0, total - head - own), "tcp_flags": _flags(rest[13]) if kind == 6 else None}
            entity = f"pcap:{src}:{a}-{dst}:{b}"
        elif kind in (6, 17):
            continue
        yield _row(entity, "network_event", None, None, props)


def pcap(files: DataFrame) -> DataFrame:
    """Captures, whole files of either byte order: a row for each packet of IPv4 over Ethernet; other packets give none.

    A file is one value, so it must stay below 2 GB; capture tools rotate files far earlier.
    """
    return _walked(files.select("value"), _captured, OBSERVED, "value")


def _length(b: bytes, at: int) -> tuple[int, int]:
    if b[at] < 128:
        return b[at], at + 1
    n = b[at] & 127
    if not 1 <= n <= 4 or at + 1 + n > len(b):
        raise ValueError("length")
    return int.from_bytes(b[at + 1 : at + 1 + n], "big"), at + 1 + n


def _signed(raw: bytes, size: int, scale: float):
    if len(raw) != size or raw == b"\x80" + bytes(size - 1):
        return None
    return int.from_bytes(raw, "big", signed=True) * scale / (2 ** (8 * size - 1) - 1)


def _share(raw: bytes, span: float, low: float = 0.0):
    return int.from_bytes(raw, "big") * span / 65535 + low if len(raw) == 2 else None


def _plain(raw: bytes):
    return raw.decode("ascii") if raw and all(32 <= c < 127 for c in raw) else None


VIDEO_TAGS: dict[int, tuple[str, Callable]] = {
    2: ("precision_timestamp_us", lambda r: int.from_bytes(r, "big") if len(r) == 8 else None),
    3: ("mission_id", _plain),
    4: ("platform_tail_number", _plain),
    5: ("platform_heading_deg", lambda r: _share(r, 360.0)),
    6: ("platform_pitch_deg", lambda r: _signed(r, 2, 20.0)),
    7: ("platform_roll_deg", lambda r: _signed(r, 2, 20.0)),
    10: ("platform_designation", _plain),
    13: ("lat", lambda r: _signed(r, 4, 90.0)),
    14: ("lon", lambda r: _signed(r, 4, 180.0)),
    15: ("sensor_true_altitude_m", lambda r: _share(r, 19900.0, -900.0)),
    16: ("sensor_hfov_deg", lambda r: _share(r, 180.0)),
    17: ("sensor_vfov_deg", lambda r: _share(r, 180.0)),
    23: ("frame_centre_latitude_deg", lambda r: _signed(r, 4, 90.0)),
    24: ("frame_centre_longitude_deg", lambda r: _signed(r, 4, 180.0)),
    25: ("frame_centre_elevation_m", lambda r: _share(r, 19900.0, -900.0)),
}


def _video_sets(value: bytes, sender) -> Iterator[tuple]:
    value, at = bytes(value), 0
    while at < len(value):
        if value[at] == 0:
            at += 1
            continue
        if value[at : at + 16] != KLV_KEY:
            return
        size, place = _length(value, at + 16)
        end, got = place + size, {}
        if end > len(value):
            return
        while place < end:
            tag = value[place]
            n, place = _length(value, place + 1)
            raw = value[place : place + n]
            if place + n > end:
                return
            if tag == 1 and (n != 2 or int.from_bytes(raw, "big") != (sum(value[at:place:2]) * 256 + sum(value[at + 1 : place : 2])) % 65536):
                return
            if tag in VIDEO_TAGS:
                got[VIDEO_TAGS[tag][0]] = VIDEO_TAGS[tag][1](raw)
            place += n
        mission, tail = got.get("mission_id"), got.get("platform_tail_number")
        entity = f"{mission}-{tail}" if mission and tail else f"klv-{tail or sender}"
        yield _row(entity, "uav", got.pop("lat", None), got.pop("lon", None), got)
        at = end


def klv(packets: DataFrame) -> DataFrame:
    """Metadata of drone video, (value, sender): all sets of a value up to the first damaged one or wrong checksum."""
    return _walked(packets, _video_sets, OBSERVED, "value", "sender")


def lorawan(frames: DataFrame) -> DataFrame:
    """Radio frames as hex text: data frames by device address, join requests by device, others by their type."""
    rows = frames.select(F.upper(F.regexp_replace("value", r"\s", "")).alias("h")).where(F.col("h").rlike("^(?:[0-9A-F]{2}){5,}$"))
    rows = rows.withColumn("type", (_number(F.col("h"), 0, 1) / 32).cast("int")).withColumn("b", F.expr("substring(h, 3, length(h) - 10)"))
    b = F.col("b")
    turned = lambda start, n: F.concat(*[F.substring(b, (start + n - 1 - i) * 2 + 1, 2) for i in range(n)])
    data, join, accept = F.col("type").between(2, 5), F.col("type") == 0, F.col("type") == 1
    control = _number(b, 4, 1)
    extra = control.bitwiseAND(15)
    rows = rows.where(F.when(data, (F.length(b) >= 14) & (F.length(b) >= 14 + 2 * extra)).when(join, F.length(b) >= 36).otherwise(True))
    rest = F.expr("substring(b, 15 + 2 * (cast(conv(substring(b, 9, 2), 16, 10) as int) & 15))")
    port = F.when(data & (F.length(rest) > 0), _number(rest, 0, 1))
    load = F.when(data, F.substring(rest, 3, 1 << 20))
    mic = F.concat(*[F.expr(f"substring(h, length(h) - {1 + 2 * i}, 2)") for i in range(4)])
    only = lambda when, c: F.when(when, c)
    props = _filled(
        mtype=F.get(F.array(*[F.lit(t) for t in LORA_TYPES]), F.col("type")), major=_number(F.col("h"), 0, 1).bitwiseAND(3), mic=mic,
        dev_addr=only(data, turned(0, 4)), fcnt=only(data, _little(b, 5, 2)), adr=only(data, control.bitwiseAND(128) != 0), ack=only(data, control.bitwiseAND(32) != 0), fopts_len=only(data, extra),
        fport=port, fport_type=F.when(port == 0, "MAC commands").when(port <= 223, "Application").when(port.isNotNull(), "Reserved"),
        frm_payload_hex=F.when(F.length(load) > 0, load), frm_payload_length=F.when(F.length(load) > 0, (F.length(load) / 2).cast("int")),
        app_eui=only(join, turned(0, 8)), dev_eui=only(join, turned(8, 8)), dev_nonce=only(join, _little(b, 16, 2)), join_accept_data=only(accept, b), raw_payload=only(F.col("type") > 5, b))
    entity = F.when(data, F.concat(F.lit("lorawan:"), turned(0, 4))).when(join, F.concat(F.lit("lorawan:join:"), turned(8, 8))).when(accept, "lorawan:join_accept").otherwise("lorawan:raw")
    return _observed(rows, entity, F.lit("sensor"), F.lit(None), F.lit(None), props)


def canbus(lines: DataFrame) -> DataFrame:
    """Frames of a vehicle bus as dump lines, (time) interface ID#DATA; of extended ids the parameter group and its values."""
    shape = r"^\s*(?!#)\(?([0-9.]+)?\S*\s+\S+\s+([0-9A-Fa-f]{1,8})#([0-9A-Fa-f]*)"
    rows = lines.where(F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).try_cast("double").alias("ts"), F.conv(F.regexp_extract("value", shape, 2), 16, 10).cast("long").alias("id"), F.upper(F.regexp_extract("value", shape, 3)).alias("h"))
    rows = rows.withColumn("h", F.expr("substring(h, 1, length(h) - length(h) % 2)"))
    rows = rows.withColumn("long", F.col("id") > 0x7FF)
    bits = lambda shift, mask: F.shiftright("id", shift).bitwiseAND(mask)
    # groups below 240 are sent to one address, which is no part of their number
    pgn = bits(24, 1) * 65536 + bits(16, 255) * 256 + F.when(bits(16, 255) >= 240, bits(8, 255)).otherwise(0)
    rows = rows.withColumn("pgn", F.when(F.col("long"), pgn))
    name = F.lit("Unknown PGN")
    for number, text in GROUPS.items():
        name = F.when(F.col("pgn") == number, text).otherwise(name)
    h = F.col("h")
    value = lambda group, c: F.when(F.col("pgn") == group, c)
    props = _filled(
        can_id=F.lpad(F.hex("id"), 8, "0"), dlc=(F.length(h) / 2).cast("int"), raw_data=h, timestamp=F.col("ts"), pgn=F.col("pgn"), pgn_name=F.when(F.col("long"), name),
        source_address=F.when(F.col("long"), bits(0, 255)), priority=F.when(F.col("long"), bits(26, 7)),
        engine_speed_rpm=value(61444, _little(h, 3, 2) * 0.125), torque_mode=value(61444, _little(h, 0, 1).bitwiseAND(15)), vehicle_speed_kmh=value(65265, _little(h, 1, 2) / 256.0),
        coolant_temp_c=value(65262, _little(h, 0, 1) - 40), oil_temp_c=value(65262, _little(h, 2, 2) * 0.03125 - 273.0), fuel_rate_lph=value(65266, _little(h, 0, 2) * 0.05),
        ambient_temp_c=value(65269, _little(h, 3, 2) * 0.03125 - 273.0), engine_total_hours=value(65253, _little(h, 0, 4) * 0.05))
    entity = F.when(F.col("long"), F.concat(F.lit("canbus:j1939:sa-"), bits(0, 255).cast("string"))).otherwise(F.concat(F.lit("canbus:"), F.lpad(F.hex("id"), 3, "0")))
    return _observed(rows, entity, F.when(F.col("pgn").isin(*ENGINE_GROUPS), "engine").otherwise("vehicle"), F.lit(None), F.lit(None), props)


def acars(messages: DataFrame) -> DataFrame:
    """Messages of aircraft as labelled lines (MODE:, REG:, LABEL: and others; MSG: takes all lines after it)."""
    got = lambda key: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^\s*{key}:[ \t]*(.*?)\s*$", 1)), F.lit(""))
    head = F.regexp_replace("value", r"(?s)(?:^|\n)\s*MSG:.*", "")
    text = F.trim(F.regexp_extract("value", r"(?s)(?:^|\n)\s*MSG:(.*)$", 1))
    rows = messages.select(F.col("value").alias("whole"), text.alias("text"), head.alias("value"))
    mode, label = F.substring(got("MODE"), 1, 1), got("LABEL")
    register = F.nullif(F.regexp_replace(got("REG"), r"^\.+", ""), F.lit(""))
    way = F.when(mode == "2", "VHF ACARS").when(mode.isin("H", "C", "P", "Y"), "HF Data Link (HFDL)").when(mode == "I", "Inmarsat").when(mode == "V", "VDL Mode 2").otherwise("Unknown Mode")
    props = _filled(
        mode=mode, mode_description=way, registration=register, label=label, message_text=F.col("text"), block_id=F.substring(got("BLOCK_ID"), 1, 1), acknowledgement=F.substring(got("ACK"), 1, 1),
        flight_id=got("FLIGHT"), message_number=got("MSGNO"), sublabel=got("SUBLABEL"))
    return _observed(rows.where(mode.isNotNull() & register.isNotNull() & label.isNotNull()), F.concat(F.lit("acars:"), register), F.lit("aircraft"), F.lit(None), F.lit(None), props)
