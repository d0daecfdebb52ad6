"""Homography tables: orientation, smoothing, coverage. A matrix is nine columns h0..h8."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import H, project

MIRROR_PX = 1050.0
LEFT, RIGHT, MIDDLE = 200.0, 1700.0, 540.0


@dataclass(frozen=True)
class HomographyConfig:
    every: int = 50
    most_samples: int = 60
    least_votes: int = 5
    full_inliers: float = 15
    base_alpha: float = 0.3
    jump_px: float = 25.0
    jump_conf: float = 0.5
    jump_alpha: float = 0.8
    least_alpha: float = 0.05
    most_alpha: float = 0.9


def orientation(h: DataFrame) -> DataFrame:
    """Add ``sign``: which way image x runs along the pitch; null without a matrix."""
    a, b = project(F.lit(RIGHT), F.lit(MIDDLE), 1.0)[0], project(F.lit(LEFT), F.lit(MIDDLE), 1.0)[0]
    return h.withColumn("sign", F.signum(a - b).cast("int"))


def calibrate(raw: DataFrame, cfg: HomographyConfig = HomographyConfig()) -> DataFrame:
    """One vote a match on sampled frames, weighted by inliers: reference sign, agreement, status."""
    seen = orientation(raw.filter(F.col("frame_idx") % cfg.every == 0))
    nth = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_idx"))
    seen = seen.withColumn("nth", nth).filter(F.col("nth") <= cfg.most_samples).withColumn("w", F.coalesce("n_inliers", F.lit(1)))
    side = lambda s: F.sum(F.when(F.col("sign") == s, F.col("w")).otherwise(0))
    votes = seen.groupBy("match_id").agg(F.count_if(F.col("sign") != 0).alias("n_votes"), side(1).alias("plus"), side(-1).alias("minus"))
    enough = F.col("n_votes") >= cfg.least_votes
    agree = 100.0 * F.greatest("plus", "minus") / F.nullif(F.col("plus") + F.col("minus"), F.lit(0))
    return votes.select(
        "match_id", "n_votes", F.when(enough, F.when(F.col("plus") >= F.col("minus"), 1).otherwise(-1)).alias("reference_sign"), F.when(enough, agree).alias("agreement_pct"),
        F.when(~enough, "too few votes").when(agree < 70, "weak").otherwise("ok").alias("status"),
    )


def enforce(h: DataFrame, reference: DataFrame) -> DataFrame:
    """Mirror the matrices that run against the match's reference sign."""
    joined = orientation(h).join(reference.select("match_id", "reference_sign"), "match_id", "left")
    wrong = F.coalesce((F.col("sign") != 0) & (F.col("sign") != F.col("reference_sign")), F.lit(False))
    turned = {f"h{i}": F.when(wrong, -F.col(f"h{i}") + MIRROR_PX * F.col(f"h{i + 6}")).otherwise(F.col(f"h{i}")) for i in range(3)}
    return joined.withColumns(turned).withColumn("mirrored", wrong).drop("sign", "reference_sign")


#: Key points of a 105 m by 68 m pitch in metres: corners, halfway line, boxes, circle.
KEY_POINTS = np.array([
    (0, 0), (105, 0), (52.5, 0), (52.5, 68), (52.5, 34),
    (0, 13.85), (16.5, 13.85), (0, 54.15), (16.5, 54.15), (105, 13.85), (88.5, 13.85), (105, 54.15), (88.5, 54.15), (94, 34),
    (0, 24.85), (5.5, 24.85), (0, 43.15), (5.5, 43.15), (105, 24.85), (99.5, 24.85), (105, 43.15), (99.5, 43.15),
    (16.5, 24.85), (16.5, 43.15), (88.5, 24.85), (88.5, 43.15), (52.5, 24.85), (52.5, 43.15), (43.35, 34), (61.65, 34),
])


_POINTS = np.c_[KEY_POINTS * 10, np.ones(len(KEY_POINTS))].T


def _adjugates(m: np.ndarray) -> np.ndarray:
    """Adjugates of (n, 3, 3) matrices: their inverses but for a factor, which moves no projected point."""
    rows = m[:, [[1], [2], [0]], [1, 2, 0]] * m[:, [[2], [0], [1]], [2, 0, 1]] - m[:, [[1], [2], [0]], [2, 0, 1]] * m[:, [[2], [0], [1]], [1, 2, 0]]
    return rows.transpose(0, 2, 1)


def image_points(m: np.ndarray) -> np.ndarray:
    """Image places (n, 2, points) of the key points under (n, 3, 3) matrices; NaN under singular ones."""
    turned = _adjugates(m)
    p = turned @ _POINTS
    ok = np.einsum("ni,ni->n", m[:, 0], turned[:, :, 0]) != 0
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok[:, None, None], p[:, :2] / p[:, 2:], np.nan)


def _apart(pa: np.ndarray, pb: np.ndarray) -> float:
    if np.isnan(pa[0, 0]) or np.isnan(pb[0, 0]):
        return float("inf")
    off = np.sort(np.hypot(pa[0] - pb[0], pa[1] - pb[1]))
    return float(off[len(off) // 2 - 1] + off[len(off) // 2]) / 2


def disagreement(a: np.ndarray, b: np.ndarray) -> float:
    """Median image distance of the key points under two matrices; infinite if one is singular."""
    return _apart(*image_points(np.stack([a, b]).astype(float)))


def _smooth(cfg: HomographyConfig, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("frame_idx")
    mats, inliers, tags = rows[H].to_numpy(float).reshape(-1, 3, 3), rows["n_inliers"].to_numpy(float), rows["tag"].to_numpy()
    known = ~np.isnan(mats).any(axis=(1, 2))
    conf = np.where(np.isnan(inliers), 1.0, np.minimum(1.0, inliers / cfg.full_inliers))
    asked = known & (conf >= cfg.jump_conf)
    # All raw matrices are turned round at once; the state's is, when a jump is asked for.
    points = np.full((len(rows), 2, len(KEY_POINTS)), np.nan)
    points[asked] = image_points(mats[asked])
    now, out, jumps = None, np.full((len(rows), 9), np.nan), np.zeros(len(rows), dtype=bool)
    slow = np.clip(cfg.base_alpha * conf, cfg.least_alpha, cfg.most_alpha)
    fast = np.clip(np.maximum(cfg.base_alpha * conf, cfg.jump_alpha), cfg.least_alpha, cfg.most_alpha)
    for k in range(len(mats)):
        if known[k]:
            if now is None:
                now = mats[k] if tags[k] == "anchor" else None
            else:
                jumps[k] = bool(asked[k]) and _apart(points[k], image_points(now[None])[0]) > cfg.jump_px
                alpha = fast[k] if jumps[k] else slow[k]
                now = alpha * mats[k] + (1 - alpha) * now
        if now is not None:
            out[k] = now.ravel()
    res = rows[["match_id", "frame_idx"]].copy()
    for i, c in enumerate(H):
        res[c] = pd.Series(out[:, i], index=rows.index).astype(object).where(~np.isnan(out[:, i]), None)
    res["jump"] = jumps
    return res


def smooth(raw: DataFrame, cfg: HomographyConfig = HomographyConfig()) -> DataFrame:
    """Running mean of the matrices of each match, faster where they are sure or jump.

    It starts at the first anchor and is carried over frames without a matrix. The weight depends on
    the state, so one match is one group; a match has some 100,000 narrow rows at most.
    """
    schema = "match_id long, frame_idx long, " + ", ".join(f"{c} double" for c in H) + ", jump boolean"
    return raw.select("match_id", "frame_idx", *H, "n_inliers", "tag").groupBy("match_id").applyInPandas(lambda rows: _smooth(cfg, rows), schema)


def coverage(raw: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Valid raw matrices, frames covered after smoothing and jumps of each match."""
    valid = raw.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.count("h0").alias("n_valid"))
    after = smoothed.groupBy("match_id").agg(F.count("h0").alias("n_covered"), F.count_if("jump").alias("n_jumps"))
    return valid.join(after, "match_id")
