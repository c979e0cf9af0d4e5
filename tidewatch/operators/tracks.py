"""Track analytics over (entity_id, ts, lat, lon, speed, course): window functions and partial aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import geo

_BY_TIME = ("ts", "event_id")


def _w(desc: bool = False):
    cols = [F.col(c).desc() if desc else F.col(c) for c in _BY_TIME]
    return Window.partitionBy("entity_id").orderBy(*cols)


def latest(tracks: DataFrame, n: int) -> DataFrame:
    return tracks.withColumn("rank", F.row_number().over(_w(True))).where(F.col("rank") <= n)


def manoeuvres(tracks: DataFrame, window_min: int = 60 * 24 * 3, speed_pct: float = 50.0, course_deg: float = 30.0) -> DataFrame:
    """First against last point of each entity's final window: speed change in percent and course change."""
    end = tracks.groupBy("entity_id").agg(F.max("ts").alias("end"))
    held = tracks.join(end, "entity_id").where(F.col("ts") >= F.col("end") - F.expr(f"INTERVAL {window_min} MINUTES"))
    first = F.min(F.struct("ts", "event_id", "speed", "course")).alias("f")
    last = F.max(F.struct("ts", "event_id", "speed", "course")).alias("l")
    g = held.groupBy("entity_id").agg(first, last, F.count("*").alias("n")).where("n >= 2")
    change = F.when(F.col("f.speed") > 0.1, F.abs(F.col("l.speed") - F.col("f.speed")) / F.col("f.speed") * 100).otherwise(0.0)
    turn = geo.heading_diff(F.col("f.course"), F.col("l.course"))
    return g.select("entity_id", F.round(change, 4).alias("speed_change"), F.round(turn, 4).alias("course_change"), ((change > speed_pct) | (turn > course_deg)).alias("manoeuvre"))


def zone_events(tracks: DataFrame, zone: list[tuple[float, float]]) -> DataFrame:
    """Enter and exit events of one zone."""
    inside = geo.point_in_polygon(F.col("lat"), F.col("lon"), zone)
    rows = tracks.withColumn("inside", inside).withColumn("before", F.coalesce(F.lag("inside").over(_w()), F.lit(False)))
    return rows.where("inside <> before").select("entity_id", "event_id", F.when(F.col("inside"), "enter").otherwise("exit").alias("transition"))


def dwell(tracks: DataFrame, radius_km: float, min_seconds: int) -> DataFrame:
    """Time the unbroken tail of points within radius of the latest one has lasted."""
    last = tracks.groupBy("entity_id").agg(F.max(F.struct("ts", "event_id", "lat", "lon")).alias("l"))
    rows = tracks.join(last, "entity_id").withColumn("out", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("l.lat"), F.col("l.lon")) > radius_km)
    left = rows.groupBy("entity_id").agg(F.max(F.when(F.col("out"), F.col("ts"))).alias("last_out"))
    tail = rows.join(left, "entity_id").where(F.col("last_out").isNull() | (F.col("ts") > F.col("last_out")))
    g = tail.groupBy("entity_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return g.where(F.col("seconds") >= min_seconds)


def pattern_of_life(tracks: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    hourly = tracks.groupBy("entity_id", hour.alias("hour")).agg(F.count("*").alias("n"))
    peak = hourly.groupBy("entity_id").agg(F.max("n").alias("peak"))
    active = hourly.join(peak, "entity_id").where("n > 0.5 * peak").groupBy("entity_id").agg(F.array_sort(F.collect_list("hour")).alias("hours"))
    g = tracks.groupBy("entity_id").agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.stddev_pop("speed").alias("std_speed"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return g.join(active, "entity_id")


def anomaly_scores(tracks: DataFrame) -> DataFrame:
    """Latest point against its entity's pattern: speed .40, area .30, hour .20, course .10, each clamped to 100."""
    life = pattern_of_life(tracks)
    last = latest(tracks, 2).groupBy("entity_id").agg(F.max(F.struct("ts", "event_id", "lat", "lon", "speed", "course")).alias("l"), F.min(F.struct("ts", "event_id", "course")).alias("p"))
    r = last.join(life, "entity_id")
    z = F.abs(F.col("l.speed") - F.col("mean_speed")) / F.col("std_speed")
    speed = F.when(F.col("std_speed") > 0.01, F.least(z / 3 * 100, F.lit(100.0))).when(F.col("mean_speed") > 0.1, F.least(F.abs(F.col("l.speed") - F.col("mean_speed")) / F.col("mean_speed") * 100, F.lit(100.0))).otherwise(0.0)
    area = F.when(F.col("l.lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("l.lon").between(F.col("min_lon"), F.col("max_lon")), 0.0).otherwise(50.0)
    hour = F.when(F.array_contains("hours", F.hour("l.ts")), 0.0).otherwise(30.0)
    course = F.when(geo.heading_diff(F.col("l.course"), F.col("p.course")) > 45, 20.0).otherwise(0.0)
    return r.select("entity_id", F.round(0.4 * speed + 0.3 * area + 0.2 * hour + 0.1 * course, 4).alias("score"))


def dark_targets(tracks: DataFrame, as_of: Column, min_minutes: int = 30) -> DataFrame:
    g = tracks.groupBy("entity_id").agg(F.max("ts").alias("last_seen"))
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")) / 60)
    level = F.when(minutes < 60, "low").when(minutes < 360, "medium").otherwise("high")
    return g.select("entity_id", minutes.alias("minutes"), level.alias("severity")).where(F.col("minutes") >= min_minutes)


def _approach(a: np.ndarray, b: np.ndarray, steps: int, limit_nm: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, nm, half minutes) of pairs of (lat, lon, speed, course) rows; with a limit only pairs nearer than it and not at the start.

    The cosine of the angle between two great-circle ways is a sum of two sinusoids of the time, which a recurrence
    follows without trigonometry; the distance itself is taken only at the steps that may be the least when rounded.
    """
    half = np.array([])

    def frame(m):
        la, lo, co = np.radians(m[:, 0]), np.radians(m[:, 1]), np.radians(m[:, 3])
        up = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
        north = np.stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)])
        east = np.stack([-np.sin(lo), np.cos(lo), np.zeros_like(lo)])
        return up, np.cos(co) * north + np.sin(co) * east, m[:, 2] * geo.KM_PER_NM / 120.0 / geo.EARTH_KM

    (ua, da, wa), (ub, db, wb) = frame(a), frame(b)
    dot = lambda x, y: (x * y).sum(axis=0)
    p, q, r, s = dot(ua, ub), dot(ua, db), dot(da, ub), dot(da, db)
    apart = np.empty((steps, len(a)))  # one minus the cosine
    waves = []
    for c, d, w in (((p + s) / 2, (r - q) / 2, wa - wb), ((p - s) / 2, (r + q) / 2, wa + wb)):
        waves.append([2 * np.cos(w), c * np.cos(w) - d * np.sin(w), c])  # factor, value a step before, value
    for k in range(steps):
        apart[k] = 1 - waves[0][2] - waves[1][2]
        for x in waves:
            x[1], x[2] = x[2], x[0] * x[2] - x[1]
    least = np.maximum(apart.min(axis=0), 0)
    slack = 4e-8 * np.sqrt(2 * least) + 1e-11 + 1e-15 * steps**2  # over a step of the rounding to 4 digits, and the error of the recurrence
    may = apart <= least + slack
    if limit_nm is not None:
        may &= may[1:].any(axis=0) & (least - slack <= 1 - math.cos(min(math.pi, limit_nm * geo.KM_PER_NM / geo.EARTH_KM)))
    row, k = np.nonzero(may.T)
    if not len(row):
        return row, half, half

    def place(m):
        la, lo, co, far = np.radians(m[row, 0]), np.radians(m[row, 1]), np.radians(m[row, 3]), m[row, 2] * geo.KM_PER_NM * (k / 2) / 60.0 / geo.EARTH_KM
        lat = np.arcsin(np.clip(np.sin(la) * np.cos(far) + np.cos(la) * np.sin(far) * np.cos(co), -1, 1))
        return lat, lo + np.arctan2(np.sin(co) * np.sin(far) * np.cos(la), np.cos(far) - np.sin(la) * np.sin(lat))

    (la, lo), (lb, mb) = place(a), place(b)
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((mb - lo) / 2) ** 2
    nm = np.round(2 * geo.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h))) / geo.KM_PER_NM, 4)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    low = np.minimum.reduceat(nm, first)
    at = np.minimum.reduceat(np.where(nm == np.repeat(low, np.diff(np.r_[first, len(row)])), k, steps), first)
    keep = (low < limit_nm) & (at > 0) if limit_nm is not None else slice(None)
    return row[first][keep], low[keep], at[keep]


def closest_approach(points: DataFrame, horizon_min: int, threshold_nm: float, cell_deg: float = 2.0, risk_only: bool = False) -> DataFrame:
    """Closest approach of nearby pairs, both projected every half minute; points: one row per entity.

    Pairs come from a grid over the unit sphere, so neither poles nor 180 degrees are an edge:
    each point is sent to its own and the neighbouring cells, and an equi-join on the cell
    replaces the comparison of all pairs.  A cell is as wide as the threshold and twice the
    way of the fastest point within the horizon (at least cell_deg), so no pair at risk is lost.
    A pair meets in one cell alone, so its steps are compared where it is found and nothing of
    it is shuffled.  With risk_only, pairs that start beyond the threshold and both their ways
    are left out before, and all that are not at risk after.
    """
    fastest = points.agg(F.max(F.abs("speed")).alias("v")).first()["v"] or 0.0
    reach_km = (threshold_nm + 2 * fastest * horizon_min / 60) * geo.KM_PER_NM
    width = max(math.radians(cell_deg), 1.001 * reach_km / geo.EARTH_KM)
    la, lo = F.radians("lat"), F.radians("lon")
    place = {"cx": F.cos(la) * F.cos(lo), "cy": F.cos(la) * F.sin(lo), "cz": F.sin(la)}
    state = ["lat", "lon", "speed", "course"]
    p = points.select("entity_id", *[F.col(c).cast("double").alias(c) for c in state]).withColumns({f"u{k}": c for k, c in place.items()}).withColumns({k: F.floor(F.col(f"u{k}") / width) for k in place})
    near = p
    for k in place:
        near = near.withColumn(k, F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)])))
    near = near.select(*place, *[F.col(c).alias(f"b_{c}") for c in ("entity_id", *state, *[f"u{k}" for k in place])])
    meet = F.col("entity_id") < F.col("b_entity_id")
    if risk_only:
        reach = (threshold_nm + (F.abs("speed") + F.abs("b_speed")) * (horizon_min / 60)) * (1.001 * geo.KM_PER_NM / geo.EARTH_KM)
        meet = meet & (sum(F.pow(F.col(f"u{k}") - F.col(f"b_u{k}"), F.lit(2.0)) for k in place) <= reach * reach)
    pairs = p.join(near, list(place)).where(meet).select(F.col("entity_id").alias("a"), F.col("b_entity_id").alias("b"), *state, *[f"b_{c}" for c in state])

    steps = 2 * horizon_min + 1
    most = max(1, (1 << 20) // steps)  # pairs at a time, for the memory of their steps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[*state, *[f"b_{c}" for c in state]]].to_numpy(float)
            known = np.flatnonzero(np.isfinite(x).all(axis=1))
            for i in range(0, len(known), most):
                own = known[i : i + most]
                row, nm, at = _approach(x[own, :4], x[own, 4:], steps, threshold_nm if risk_only else None)
                yield pdf[["a", "b"]].iloc[own[row]].assign(dcpa_nm=nm, tcpa_min=at / 2, at_risk=(at > 0) & (nm < threshold_nm))
            if not risk_only and len(known) < len(pdf):  # nothing is known of where these go
                yield pdf[["a", "b"]].drop(pdf.index[known]).assign(dcpa_nm=None, tcpa_min=0.0, at_risk=None)

    kind = points.schema["entity_id"].dataType.simpleString()
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, dcpa_nm double, tcpa_min double, at_risk boolean")


def kinematic_features(tracks: DataFrame, history: int = 32) -> DataFrame:
    """Per point over the last `history` points (five at least): speed z-score, mean turn between bearings, share of the
    four points before within 200 m, hour as a circle, distance to the centroid."""
    w = _w().rowsBetween(-(history - 1), 0)
    lat, lon = F.col("lat"), F.col("lon")
    r = tracks.withColumn("way", geo.bearing(F.lag("lat").over(_w()), F.lag("lon").over(_w()), lat, lon))
    r = r.withColumn("turn", F.abs(geo.heading_diff(F.lag("way").over(_w()), F.col("way"))))
    near = F.lit(0)
    for k in range(1, 5):
        near = near + F.when(geo.haversine_km(lat, lon, F.lag("lat", k).over(_w()), F.lag("lon", k).over(_w())) < 0.2, 1).otherwise(0)
    over = {"n": F.count("*"), "mean": F.avg("speed"), "std": F.stddev_pop("speed"), "clat": F.avg("lat"), "clon": F.avg("lon")}
    # the first two points of a window have no turn that lies within it
    turned = F.avg("turn").over(_w().rowsBetween(-(history - 1) + 2, 0))
    r = r.withColumns({**{k: c.over(w) for k, c in over.items()}, "jerk": turned, "dwell_ratio": near / 4}).where("n >= 5")
    angle = F.hour("ts") * (2 * 3.141592653589793 / 24)
    z = F.when(F.col("std") > 1e-6, (F.col("speed") - F.col("mean")) / F.col("std")).otherwise(0.0)
    fine = lambda c: F.round(c, 4) + 0.0
    return r.select(
        "entity_id", "event_id", fine(z).alias("speed_z"), fine(F.col("jerk")).alias("heading_jerk"), "dwell_ratio",
        fine(F.sin(angle)).alias("hour_sin"), fine(F.cos(angle)).alias("hour_cos"), fine(geo.haversine_km(lat, lon, F.col("clat"), F.col("clon"))).alias("centroid_km"))
