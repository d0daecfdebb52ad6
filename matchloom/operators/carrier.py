"""Who carries the ball: candidates, the velocity test, hysteresis."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import H, distance, foot, point_to_box, project
from matchloom.operators.detections import BOX, FRAME


@dataclass(frozen=True)
class CarrierConfig:
    touch_px: float = 15.0
    near_m: float = 2.5
    switch_frames: int = 10
    grace_frames: int = 8
    margin: float = 0.7
    window: int = 4
    speed_change: float = 2.0
    angle_change: float = 20.0
    fps: float = 25.0


def _people(tracks: DataFrame, roles: DataFrame) -> DataFrame:
    return tracks.join(roles.filter(F.col("role").isin("player", "goalkeeper")).select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")


def touches(ball: DataFrame, tracks: DataFrame, roles: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Players and keepers whose box the ball touches."""
    people = _people(tracks, roles).select(*FRAME, "track_id", *BOX)
    joined = people.join(ball.filter("x_px is not null").select(*FRAME, "x_px", "y_px").hint("merge"), FRAME)
    return joined.select(*FRAME, "track_id", point_to_box(F.col("x_px"), F.col("y_px")).alias("dist")).filter(F.col("dist") <= cfg.touch_px)


def proximities(ball: DataFrame, tracks: DataFrame, roles: DataFrame, homography: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Players and keepers whose feet are near the ball on the pitch."""
    people = _people(tracks, roles).join(homography.filter("h0 is not null").select(*FRAME, *H).hint("merge"), FRAME)
    x, y = project(*foot())
    feet = people.select(*FRAME, "track_id", x.alias("fx"), y.alias("fy"))
    joined = feet.join(ball.filter("pitch_x is not null").select(*FRAME, "pitch_x", "pitch_y").hint("merge"), FRAME)
    return joined.select(*FRAME, "track_id", distance(F.col("pitch_x"), F.col("pitch_y"), F.col("fx"), F.col("fy")).alias("dist")).filter(F.col("dist") <= cfg.near_m)


def best_with_margin(near: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Nearest candidate of each frame and whether the second is too close to tell."""
    two = F.slice(F.array_sort(F.collect_list(F.struct("dist", "track_id"))), 1, 2)
    out = near.groupBy(*FRAME).agg(two.alias("two"))
    second = F.get("two", F.lit(1))["dist"]
    unclear = F.coalesce((second <= 0) | (F.get("two", F.lit(0))["dist"] >= cfg.margin * second), F.lit(False))
    return out.select(*FRAME, F.get("two", F.lit(0))["track_id"].alias("track_id"), F.get("two", F.lit(0))["dist"].alias("dist"), unclear.alias("ambiguous"))


def velocity_change(ball: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Speeds before and after each frame and the turn in degrees; null where a point is missing. One row
    a frame is needed; at the ends the window is cut."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    all_ = Window.partitionBy("match_id")
    first, last = F.min("frame_idx").over(all_), F.max("frame_idx").over(all_)
    here = F.struct("frame_idx", "pitch_x", "pitch_y")
    k = cfg.window
    before = F.coalesce(F.lag(here, k).over(w), F.first(here).over(w))
    after = F.coalesce(F.lead(here, k).over(w), F.last(here).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = ball.withColumns({"_b": before, "_a": after, "_first": first, "_last": last})
    dt0, dt1 = (F.col("frame_idx") - F.col("_b.frame_idx")) / cfg.fps, (F.col("_a.frame_idx") - F.col("frame_idx")) / cfg.fps
    some = (dt0 > 0) & (dt1 > 0)
    v = {f"_{n}{c}": F.when(some, d) for n, c, d in (("0", "x", (F.col("pitch_x") - F.col("_b.pitch_x")) / dt0), ("0", "y", (F.col("pitch_y") - F.col("_b.pitch_y")) / dt0), ("1", "x", (F.col("_a.pitch_x") - F.col("pitch_x")) / dt1), ("1", "y", (F.col("_a.pitch_y") - F.col("pitch_y")) / dt1))}
    rows = rows.withColumns(v)
    length = lambda n: F.sqrt(F.col(f"_{n}x") * F.col(f"_{n}x") + F.col(f"_{n}y") * F.col(f"_{n}y"))
    turn = F.abs(F.degrees(F.atan2("_1y", "_1x") - F.atan2("_0y", "_0x")))
    some = F.col("_0x").isNotNull() & F.col("_1x").isNotNull()
    return rows.select(*FRAME, F.when(some, length("0")).alias("speed_before"), F.when(some, length("1")).alias("speed_after"), F.when(some, F.least(turn, 360 - turn)).alias("turn_deg"))


def touch_like(change: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Whether the ball's speed or direction changes enough; true where that is unknown."""
    moved = (F.abs(F.col("speed_after") - F.col("speed_before")) >= cfg.speed_change) | (F.col("turn_deg") >= cfg.angle_change)
    return change.select(*FRAME, F.coalesce(moved, F.lit(True)).alias("touch_like"))


def decisions(frames: DataFrame, ball: DataFrame, tracks: DataFrame, roles: DataFrame, homography: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """One row a frame with the candidate and its method: overlap, else proximity; contested if unclear."""
    one = best_with_margin(touches(ball, tracks, roles, cfg), cfg).select(*FRAME, F.col("track_id").alias("id1"), F.col("ambiguous").alias("am1"))
    two = best_with_margin(proximities(ball, tracks, roles, homography, cfg), cfg).select(*FRAME, F.col("track_id").alias("id2"), F.col("ambiguous").alias("am2"))
    present = _people(tracks, roles).select(*FRAME).distinct().withColumn("present", F.lit(True))
    rows = frames.select(*FRAME)
    for each in (ball.select(*FRAME, "x_px", "source"), present, one, two, touch_like(velocity_change(ball, cfg), cfg)):
        rows = rows.join(each.hint("merge"), FRAME, "left")
    method = F.when(F.col("id1").isNotNull(), F.when(F.col("am1"), "contested").otherwise("overlap")).when(F.col("id2").isNotNull(), F.when(F.col("am2"), "contested").otherwise("proximity"))
    playable = F.col("x_px").isNotNull() & F.coalesce("present", F.lit(False))
    rows = rows.select(*FRAME, F.col("source").alias("ball_source"), playable.alias("playable"), F.when(playable, method).alias("method"), F.coalesce("id1", "id2").alias("_id"), F.coalesce("touch_like", F.lit(True)).alias("touch_like"))
    return rows.withColumn("candidate", F.when(F.col("method").isin("overlap", "proximity"), F.col("_id"))).drop("_id")


def islands(rows: DataFrame, cfg: CarrierConfig = CarrierConfig()) -> DataFrame:
    """Add ``island``: it begins at a candidate after so many frames without one that all is forgotten."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    last = F.last(F.when(F.col("candidate").isNotNull(), F.col("frame_idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("candidate").isNotNull() & (F.col("frame_idx") - last > cfg.grace_frames + 1)
    return rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w)).drop("_new")


def hold(rows: pd.DataFrame, cfg: CarrierConfig) -> pd.DataFrame:
    """Carrier of each frame of one island: a rival needs enough touch-like frames to take over, and
    after too many frames without a candidate all is forgotten."""
    rows = rows.sort_values("frame_idx")
    now, streak, idle, out = None, defaultdict(int), 0, []
    for candidate, touch in zip(rows["candidate"], rows["touch_like"]):
        if pd.isna(candidate):
            idle += 1
            if idle > cfg.grace_frames:
                now = None
                streak.clear()
        else:
            idle = 0
            if candidate == now:
                streak[candidate] = 0
            elif touch:
                streak[candidate] += 1
                if streak[candidate] >= cfg.switch_frames:
                    now = candidate
                    streak.clear()
        out.append(now)
    res = rows[[*FRAME, "method", "ball_source"]].copy()
    res.insert(2, "track_id", pd.Series(out, index=rows.index, dtype=object))
    return res


def assign_carrier(decided: DataFrame, cfg: CarrierConfig = CarrierConfig(), split: bool = True) -> DataFrame:
    """(match_id, frame_idx, track_id, method, ball_source) for every frame of ``decided``."""
    rows = islands(decided, cfg) if split else decided.withColumn("island", F.lit(0).cast("long"))
    schema = "match_id long, frame_idx long, track_id long, method string, ball_source string"
    narrow = rows.select(*FRAME, "candidate", "touch_like", "method", "ball_source", "island")
    return narrow.groupBy("match_id", "island").applyInPandas(lambda g: hold(g, cfg), schema)


def carrier_stats(carrier: DataFrame) -> DataFrame:
    out = carrier.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.count("track_id").alias("n_assigned"), F.count_if(F.col("method") == "contested").alias("n_contested"))
    return out.withColumns({"assigned_pct": 100 * F.col("n_assigned") / F.col("n_frames"), "contested_pct": 100 * F.col("n_contested") / F.col("n_frames")})
