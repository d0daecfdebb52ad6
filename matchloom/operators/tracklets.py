"""From raw tracks to identities: tracklets, contact splits, linking, roles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import centre, distance, dot, iou
from matchloom.operators import assignment
from matchloom.operators.detections import BOX, FRAME
from matchloom.sources.io import materialize


@dataclass(frozen=True)
class TrackingConfig:
    contact_iou: float = 0.3
    merge_gap: int = 1
    min_frames: int = 20
    window: int = 8
    max_gap: int = 500
    motion_weight: float = 0.3
    motion_norm_px: float = 300.0
    min_link_score: float = 0.3
    min_track_rows: int = 300
    lock_votes: int = 10
    lock_ratio: float = 0.02
    expected: tuple = (("goalkeeper", 2), ("referee", 3))


def initial_tracklets(raw: DataFrame) -> DataFrame:
    """Add ``part``: a new tracklet of a raw track begins where a frame is missing."""
    w = Window.partitionBy("match_id", "raw_track_id").orderBy("frame_idx")
    new = F.coalesce((F.col("frame_idx") != F.lag("frame_idx").over(w) + 1).cast("int"), F.lit(0))
    return raw.withColumn("_new", new).withColumn("part", F.sum("_new").over(w)).drop("_new")


def majority_class(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent class of each tracklet, the first by name on a tie."""
    votes = rows.groupBy(*keys, "class").agg(F.count("*").alias("n"))
    return votes.groupBy(*keys).agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("class"))


def contacts(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(match_id, a, b, frame_idx, class): pairs of tracklets of one class whose boxes overlap."""
    side = lambda x: rows.select(*FRAME, "class", F.col("tracklet_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in BOX))
    boxes = [[F.col(f"{x}_{c}") for c in BOX] for x in "ab"]
    touch = (F.col("a") < F.col("b")) & (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (iou(*boxes) >= threshold)
    return side("a").join(side("b"), [*FRAME, "class"]).filter(touch).select("match_id", "a", "b", "frame_idx", "class")


def contact_runs(pairs: DataFrame, merge_gap: int = 1) -> DataFrame:
    """First and last frame of every run of contacts of a pair."""
    w = Window.partitionBy("match_id", "a", "b").orderBy("frame_idx")
    new = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) > merge_gap).cast("int"), F.lit(0))
    run = pairs.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return run.groupBy("match_id", "a", "b", "run").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def split_points(runs: DataFrame) -> DataFrame:
    """Frames after which both members of a run are cut."""
    cut = F.inline(F.array(*(F.struct(F.col(m).alias("tracklet_id"), f.alias("cut_frame")) for m in "ab" for f in (F.col("first_frame") - 1, F.col("last_frame")))))
    return runs.select("match_id", cut).distinct()


def apply_splits(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``chunk``: number of cut frames of the tracklet before the row."""
    joined = rows.join(cuts.withColumnRenamed("cut_frame", "frame_idx").withColumn("_cut", F.lit(1)), ["match_id", "tracklet_id", "frame_idx"], "left")
    w = Window.partitionBy("match_id", "tracklet_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("chunk", F.coalesce(F.sum("_cut").over(w), F.lit(0))).drop("_cut")


def drop_short(rows: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def ends(rows: DataFrame, keys: list[str], window: int = 8) -> DataFrame:
    """Rows of the first and last ``window`` frames with ``head`` and ``tail`` flags, and the centre."""
    nth, n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx")), F.count("*").over(Window.partitionBy(*keys))
    cx, cy = centre()
    ranked = rows.withColumns({"_nth": nth, "_n": n}).withColumns({"head": F.col("_nth") <= window, "tail": F.col("_nth") > F.col("_n") - window})
    return ranked.filter("head or tail").drop("_nth", "_n").withColumns({"cx": cx, "cy": cy})


def motion_features(rows: DataFrame, keys: list[str], window: int = 8) -> DataFrame:
    """Span, first and last centre, and least-squares velocities at both ends (null for one row)."""
    e = ends(rows, keys, window)
    part = lambda c, side: F.when(F.col(side), F.col(c))
    slope = lambda c, side: F.regr_slope(part(c, side), part("frame_idx", side).cast("double"))
    return e.groupBy(*keys).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"),
        *(F.min_by(c, "frame_idx").alias(f"head_{c[1]}") for c in ("cx", "cy")), *(F.max_by(c, "frame_idx").alias(f"tail_{c[1]}") for c in ("cx", "cy")),
        *(slope(c, s).alias(f"{s}_v{c[1]}") for s in ("head", "tail") for c in ("cx", "cy")),
    )


def mean_vectors(rows: DataFrame, keys: list[str], vectors: DataFrame, window: int = 8) -> DataFrame:
    """Mean embedding of the first and last rows; ``vectors`` is (vec_id, embedding). Only these rows
    meet the embeddings; rows without one are left out."""
    e = ends(rows, keys, window).select(*keys, "head", "tail", "vec_id").join(vectors, "vec_id")
    found = e.groupBy(*keys).agg(*(F.collect_list(F.when(F.col(side), F.col("embedding"))).alias(side) for side in ("head", "tail")))

    def mean(side: str) -> Column:
        """Of the few vectors of one end; they are added up place by place."""
        first = F.transform(F.get(side, 0), lambda x: x.cast("double"))
        total = F.aggregate(F.slice(side, 2, F.greatest(F.size(side), F.lit(1))), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        return F.when(F.size(side) > 0, F.transform(total, lambda x: x / F.size(side)))

    return found.select(*keys, mean("head").alias("head_emb"), mean("tail").alias("tail_emb"))


def link_candidates(tracklets: DataFrame, cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """(match_id, class, i, j, score): j may continue i. Starts and ends meet in frame buckets as wide as
    the largest gap, so a tracklet sees two buckets only."""
    old = tracklets.select("match_id", "class", F.col("tracklet_id").alias("i"), "end_frame", "tail_emb", "tail_x", "tail_y", "tail_vx", "tail_vy")
    old = old.withColumn("bucket", F.explode(F.array(F.floor(F.col("end_frame") / cfg.max_gap), F.floor(F.col("end_frame") / cfg.max_gap) + 1)))
    new = tracklets.select("match_id", "class", F.col("tracklet_id").alias("j"), "start_frame", "head_emb", "head_x", "head_y", F.floor(F.col("start_frame") / cfg.max_gap).alias("bucket"))
    gap = F.col("start_frame") - F.col("end_frame")
    pairs = old.join(new, ["match_id", "class", "bucket"]).filter((F.col("i") != F.col("j")) & (gap > 0) & (gap <= cfg.max_gap))
    alike = F.coalesce(dot(F.col("tail_emb"), F.col("head_emb")), F.lit(0.0))
    ahead = [F.col(f"tail_{c}") + F.coalesce(F.col(f"tail_v{c}"), F.lit(0.0)) * gap for c in "xy"]
    off = F.least(distance(*ahead, F.col("head_x"), F.col("head_y")) / cfg.motion_norm_px, F.lit(1.0))
    score = alike - cfg.motion_weight * off
    return pairs.select("match_id", "class", "i", "j", score.alias("score")).filter(F.col("score") >= cfg.min_link_score)


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Most pairs first, then the largest total weight, of a matrix; -inf forbids a pair."""
    rows, cols = np.nonzero(np.isfinite(weight))
    return [(i, j) for i, j, _ in assignment.assign(list(zip(rows.tolist(), cols.tolist(), weight[rows, cols].tolist())))[0]]


def _parts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the smallest node of each connected part of (keys, u, v).

    Each round takes the smallest label of the neighbours and then the label of that label, so that what
    a label skips doubles; it ends when no label moves.
    """
    both = materialize(edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))), "link-ends")
    now = both.groupBy(*keys, F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label"))
    while True:
        now = materialize(now, "link-parts")
        near = both.join(now.select(*keys, F.col("node").alias("v"), F.col("label").alias("near")), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("near").alias("near"))
        step = now.join(near, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "near").alias("low"))
        up = step.select(*keys, F.col("node").alias("low"), F.col("low").alias("up"))
        later = materialize(step.join(up, [*keys, "low"]).select(*keys, "node", "label", F.least("low", "up").alias("next")), "link-steps")
        if later.filter("next < label").isEmpty():
            return now
        now = later.select(*keys, "node", F.col("next").alias("label"))


def priced_links(candidates: DataFrame) -> DataFrame:
    """Every candidate with whether it is one of the best links and the prices that prove it.

    Connected parts of the candidate graph don't touch each other, so each is solved by itself. A
    tracklet as predecessor and as successor are two nodes.
    """
    keys = ["match_id", "class"]
    parts = _parts(candidates.select(*keys, (2 * F.col("i")).alias("u"), (2 * F.col("j") + 1).alias("v")), keys)
    return assignment.priced_links(candidates, parts.filter("node % 2 = 0").select(*keys, F.expr("node div 2").alias("i"), "label"))


def best_links(candidates: DataFrame) -> DataFrame:
    """One successor and predecessor at most for each tracklet: most links, then the best total score."""
    return priced_links(candidates).filter("chosen").select("match_id", "i", "j", "score")


def mutual_links(candidates: DataFrame) -> DataFrame:
    """A cheaper, local choice: j is the best successor of i and i the best predecessor of j; scores that are equal to
    nine digits are ties and go by the smaller id."""
    best = lambda mine, other: F.row_number().over(Window.partitionBy("match_id", "class", mine).orderBy(F.desc(F.round("score", 9)), other))
    ranked = candidates.withColumns({"_i": best("i", "j"), "_j": best("j", "i")})
    return ranked.filter("_i = 1 and _j = 1").select("match_id", "i", "j", "score")


def identities(tracklets: DataFrame, links: DataFrame) -> DataFrame:
    """(match_id, tracklet_id, head, track_id, class): chains of links, numbered by their first start.

    Links form disjoint paths; each round doubles the length that a pointer skips.
    """
    known = tracklets.select("match_id", "tracklet_id", "class", "start_frame")
    back = known.join(links.select("match_id", F.col("j").alias("tracklet_id"), F.col("i").alias("head")), ["match_id", "tracklet_id"], "left")
    now = materialize(back.withColumn("head", F.coalesce("head", "tracklet_id")), "chains")
    while True:
        up = now.select("match_id", F.col("tracklet_id").alias("head"), F.col("head").alias("next"))
        later = now.join(up, ["match_id", "head"]).select("match_id", "tracklet_id", "class", "start_frame", F.col("next").alias("head"), (F.col("next") != F.col("head")).alias("moved"))
        later = materialize(later, "chains")
        now = later.drop("moved")
        if not later.filter("moved").limit(1).count():
            break
    first = known.select("match_id", F.col("tracklet_id").alias("head"), F.col("class").alias("_class"), F.col("start_frame").alias("_start"))
    named = now.join(first, ["match_id", "head"])
    number = F.dense_rank().over(Window.partitionBy("match_id").orderBy("_start", "head"))
    return named.select("match_id", "tracklet_id", "head", number.cast("long").alias("track_id"), F.col("_class").alias("class"))


def identity_report(ids: DataFrame, cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """Chains of 1, 2 and 3 or more tracklets, identities by class and whether too many exist."""
    chains = ids.groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.first("class").alias("class"))
    by_class = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("player", "goalkeeper", "referee")]
    out = chains.groupBy("match_id").agg(F.count_if(F.col("n") == 1).alias("chains_1"), F.count_if(F.col("n") == 2).alias("chains_2"), F.count_if(F.col("n") >= 3).alias("chains_3"), *by_class)
    return out.withColumns({f"over_{c}": F.col(f"n_{c}") > m for c, m in cfg.expected})


def attach_ball(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracks with the first ball detection of their frame, null where there is none."""
    ball = detections.filter("class = 'ball'").groupBy(*FRAME).agg(F.min_by(F.struct(*BOX, "conf"), "det_id").alias("ball"))
    return tracks.join(ball, FRAME, "left").select(*tracks.columns, *(F.col(f"ball.{c}").alias(f"ball_{c}") for c in (*BOX, "conf")))


def drop_ghosts(tracks: DataFrame, least: int = 300) -> DataFrame:
    keep = tracks.groupBy("match_id", "track_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return tracks.join(keep, ["match_id", "track_id"], "left_semi")


def lock_classes(tracks: DataFrame, cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """One role a track: referee or keeper if they have enough votes, else the majority (first seen on
    a tie)."""
    votes = tracks.groupBy("match_id", "track_id", "class").agg(F.count("*").alias("n"), F.min("frame_idx").alias("seen"))
    of = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0))
    locked = lambda n: (F.col(n) >= cfg.lock_votes) & (F.col(n) / F.col("total") >= cfg.lock_ratio)
    out = votes.groupBy("match_id", "track_id").agg(F.sum("n").alias("total"), of("referee").alias("ref"), of("goalkeeper").alias("gk"), F.min_by("class", F.struct(-F.col("n"), F.col("seen"))).alias("major"))
    return out.select("match_id", "track_id", F.when(locked("ref"), "referee").when(locked("gk"), "goalkeeper").otherwise(F.col("major")).alias("role"))


def renest(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a frame with its tracks in an array by id; frames without tracks have an empty one."""
    row = F.struct("track_id", *BOX, "conf", "class")
    nested = tracks.groupBy(*FRAME).agg(F.sort_array(F.collect_list(row)).alias("tracks"))
    return frames.join(nested, FRAME, "left").select(*FRAME, F.coalesce("tracks", F.array()).alias("tracks"))


def unnest(nested: DataFrame) -> DataFrame:
    return nested.select(*FRAME, F.inline("tracks"))
