"""The ball: candidates, Kalman filter with smoothing, statistics of gaps and sources."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import H, PX_PER_METER, centre, project
from matchloom.operators.detections import FRAME


#: The defaults are fixed values.
@dataclass(frozen=True)
class BallConfig:
    noise_pos: float = 15.0
    noise_vel: float = 40.0
    noise_measured: float = 25.0
    gap_inflation: float = 1.15
    most_inflation: float = 25.0
    gate: float = 9.21
    min_conf: float = 0.15
    max_gap: int = 38
    fps: float = 25.0
    max_speed: float = 35.0
    crowd_conf: float = 0.5
    crowd_radius: float = 60.0
    crowd_players: int = 2


def candidates(det: DataFrame, cfg: BallConfig = BallConfig()) -> DataFrame:
    """Strongest ball of each frame, the first on a tie, at the centre of its box."""
    cx, cy = centre()
    first = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("conf"), "det_id"))
    ball = det.filter((F.col("class") == "ball") & (F.col("conf") >= cfg.min_conf))
    return ball.withColumn("_n", first).filter("_n = 1").select(*FRAME, cx.alias("x_px"), cy.alias("y_px"), "conf")


def islands(frames: DataFrame, cfg: BallConfig = BallConfig()) -> DataFrame:
    """Add ``island``: it begins at a candidate so long after the last one that no track can be alive."""
    seen = Window.partitionBy("match_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("x_px").isNotNull(), F.col("frame_idx")), ignorenulls=True).over(seen)
    new = F.col("x_px").isNotNull() & (F.col("frame_idx") - last >= cfg.max_gap + 2)
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    return frames.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w)).drop("_new")


_MOVE = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]], dtype=float)


def _pitch(xy, h) -> np.ndarray | None:
    if np.isnan(h).any():
        return None
    u, v, w = h.reshape(3, 3) @ (xy[0], xy[1], 1.0)
    return None if abs(w) < 1e-8 else np.array([u, v]) / w / PX_PER_METER


def track(rows: pd.DataFrame, cfg: BallConfig) -> pd.DataFrame:
    """Filter and smooth the frames of one island, in order.

    A frame's candidate is used if it is near the prediction, not too fast after a miss, and not weak
    in a crowd. A track ends with the miss that exceeds the longest gap; its frames are then smoothed
    backwards. Detections keep their measured place, earlier misses get the smoothed one, misses after
    the last detection are lost.
    """
    rows = rows.sort_values("frame_idx")
    z, conf = rows[["x_px", "y_px"]].to_numpy(float), rows["conf"].to_numpy(float)
    hs, crowds = rows[H].to_numpy(float), rows["people"].to_numpy()
    n = len(rows)
    place, source, fast = np.full((n, 2), np.nan), np.array(["lost"] * n, dtype=object), np.zeros(n, dtype=bool)
    noise, seen_noise = np.diag([cfg.noise_pos, cfg.noise_pos, cfg.noise_vel, cfg.noise_vel]), cfg.noise_measured * np.eye(2)
    x = p = None
    gap, steps = 0, []

    def finish():
        if not steps:
            return
        smooth = [s[1] for s in steps]
        for k in range(len(steps) - 2, -1, -1):
            _, xf, pf, *_ = steps[k]
            gain = pf @ _MOVE.T @ np.linalg.pinv(steps[k + 1][4])
            smooth[k] = xf + gain @ (smooth[k + 1] - steps[k + 1][3])
        last = max(k for k, s in enumerate(steps) if s[5])
        for k, (at, *_, hit) in enumerate(steps):
            if hit:
                place[at], source[at] = z[at], "detected"
            elif k < last:
                place[at], source[at] = smooth[k][:2], "smoothed"
        steps.clear()

    for at in range(n):
        have = not np.isnan(z[at, 0])
        if x is None:
            if have:
                x, p, gap = np.array([*z[at], 0, 0]), np.diag([cfg.noise_measured, cfg.noise_measured, 100.0, 100.0]), 0
                steps.append((at, x, p, None, None, True))
            continue
        x = _MOVE @ x
        p = _MOVE @ p @ _MOVE.T + noise * min(cfg.gap_inflation**gap, cfg.most_inflation)
        before = (x, p)
        if have and conf[at] < cfg.crowd_conf and crowds[at] is not None and len(crowds[at]):
            people = np.array([[c["x"], c["y"]] for c in crowds[at]])
            have = (np.hypot(*(people - x[:2]).T) <= cfg.crowd_radius).sum() < cfg.crowd_players
        hit = False
        if have:
            spread, off = p[:2, :2] + seen_noise, z[at] - x[:2]
            if off @ np.linalg.solve(spread, off) <= cfg.gate:
                a, b = (_pitch(z[at], hs[at]), _pitch(x[:2], hs[at])) if gap else (None, None)
                hit = a is None or b is None or np.hypot(*(a - b)) / ((gap + 1) / cfg.fps) <= cfg.max_speed
                fast[at] = not hit
            if hit:
                gain = p[:, :2] @ np.linalg.inv(spread)
                x, p, gap = x + gain @ off, p - gain @ p[:2], 0
        steps.append((at, x, p, *before, hit))
        if not hit:
            gap += 1
            if gap > cfg.max_gap:
                finish()
                x = None
    finish()
    out = rows[FRAME].copy()
    empty = lambda v: pd.Series(v, index=rows.index).astype(object).where(~np.isnan(v), None)
    out["x_px"], out["y_px"], out["source"] = empty(place[:, 0]), empty(place[:, 1]), source
    out["conf"] = empty(np.where(source == "detected", conf, np.nan))
    out["rejected_speed"] = fast
    return out


def track_ball(frames: DataFrame, found: DataFrame, people: DataFrame, homography: DataFrame, cfg: BallConfig = BallConfig(), split: bool = True) -> DataFrame:
    """One row a frame: place, source and confidence of the ball, and its place on the pitch.

    ``people`` holds box centres (x, y) of players and keepers. The filter is a recurrence, so its
    groups are islands: stretches that no track can cross whatever happened before.
    """
    crowd = people.groupBy(*FRAME).agg(F.collect_list(F.struct("x", "y")).alias("people"))
    rows = frames.select(*FRAME).join(found, FRAME, "left").join(crowd, FRAME, "left").join(homography.select(*FRAME, *H), FRAME, "left")
    rows = islands(rows, cfg) if split else rows.withColumn("island", F.lit(0).cast("long"))
    schema = "match_id long, frame_idx long, x_px double, y_px double, source string, conf double, rejected_speed boolean"
    tracked = rows.groupBy("match_id", "island").applyInPandas(lambda g: track(g, cfg), schema)
    x, y = project(F.col("x_px"), F.col("y_px"))
    return tracked.join(homography.select(*FRAME, *H), FRAME, "left").withColumns({"pitch_x": x, "pitch_y": y}).drop(*H)


def source_stats(tracked: DataFrame) -> DataFrame:
    """Frames of each source with their share, and how many candidates the match and the source rejected for speed."""
    w = Window.partitionBy("match_id")
    by_source = tracked.groupBy("match_id", "source").agg(F.count("*").alias("n"), F.count_if("rejected_speed").alias("n_rejected_speed"))
    return by_source.withColumns({"pct": 100 * F.col("n") / F.sum("n").over(w), "match_rejected_speed": F.sum("n_rejected_speed").over(w)})


def gap_summary(tracked: DataFrame, longest: int = 38) -> DataFrame:
    """Number, mean, median and largest of the runs without a detected ball, and how many are too long."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    miss = F.col("source") != "detected"
    new = miss & ~F.coalesce(F.lag(miss).over(w), F.lit(False))
    runs = tracked.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w)).filter(miss).groupBy("match_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("match_id").agg(F.count("*").alias("n_gaps"), F.avg("n").alias("mean_gap"), F.median("n").alias("median_gap"), F.max("n").alias("max_gap"), F.count_if(F.col("n") > longest).alias("n_long"))
