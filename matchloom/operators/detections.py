"""Detection tables: filters, suppression, the ball, summaries, crowding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import iou

FRAME = ["match_id", "frame_idx"]
BOX = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class DetectionConfig:
    min_conf: float = 0.25
    low_conf: float = 0.15
    nms_iou: float = 0.5
    cross_class_iou: float = 0.5


def filter_sources(det: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The ball comes from the ball model alone, all else from the other; weak boxes go."""
    return det.filter(((F.col("class") == "ball") == (F.col("source") == "ball_model")) & (F.col("conf") >= cfg.min_conf))


def suppress(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression in every frame and class: a box stays unless a stronger kept one overlaps."""
    rest = [c for c in det.columns if c not in (*FRAME, "class")]
    row = F.struct((-F.col("conf")).alias("order"), "det_id", *(c for c in rest if c != "det_id"))
    boxes = F.array_sort(F.collect_list(row))
    cut = det.schema
    kind = "array<struct<order:double,det_id:%s,%s>>" % (cut["det_id"].dataType.simpleString(), ",".join(f"`{c}`:{cut[c].dataType.simpleString()}" for c in rest if c != "det_id"))
    corners = lambda b: [b[c] for c in BOX]
    kept = F.aggregate("boxes", F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: iou(corners(k), corners(b)) >= threshold), acc).otherwise(F.concat(acc, F.array(b))))
    grouped = det.groupBy(*FRAME, "class").agg(boxes.alias("boxes"))
    return grouped.select(*FRAME, "class", F.inline(kept)).select(*det.columns)


def suppress_across(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Player boxes that overlap a goalkeeper or referee of the same frame go."""
    strong = det.filter(F.col("class").isin("goalkeeper", "referee")).select(*FRAME, *(F.col(c).alias(f"s_{c}") for c in BOX))
    overlap = iou([F.col(c) for c in BOX], [F.col(f"s_{c}") for c in BOX]) >= threshold
    players = det.filter("class = 'player'").alias("p")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in FRAME]
    clear = players.join(strong.alias("s"), [*same, overlap], "left_anti")
    return clear.unionByName(det.filter("class <> 'player'"))


def best_ball(det: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The strongest ball of each frame, the first on a tie, with its low-confidence flag."""
    first = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("conf"), "det_id"))
    ball = det.filter("class = 'ball'").withColumn("_n", first).filter("_n = 1").drop("_n")
    return ball.withColumn("low_confidence", F.col("conf") < cfg.low_conf)


def fuse(ball: DataFrame, others: DataFrame) -> DataFrame:
    return ball.unionByName(others, allowMissingColumns=True)


def clean(det: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Filter, suppress within and across classes, pick the ball, fuse."""
    used = filter_sources(det, cfg)
    others = suppress_across(suppress(used.filter("class <> 'ball'"), cfg.nms_iou), cfg.cross_class_iou)
    return fuse(best_ball(used, cfg), others)


def spine(frames: DataFrame) -> DataFrame:
    """Every frame from 0 to the last of each match."""
    last = frames.groupBy("match_id").agg(F.max("frame_idx").alias("last"))
    return last.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("frame_idx"))


def summary(fused: DataFrame, frames: DataFrame) -> DataFrame:
    """Ball coverage and boxes per frame and class of each match; frames without boxes count as 0."""
    count = lambda c: F.count_if(F.col("class") == c)
    per_frame = fused.groupBy(*FRAME).agg(
        count("ball").alias("ball"), F.count_if((F.col("class") == "ball") & F.col("low_confidence")).alias("low"),
        count("goalkeeper").alias("goalkeeper"), count("referee").alias("referee"), count("player").alias("player"),
    )
    every = spine(frames).join(per_frame, FRAME, "left").fillna(0)
    out = [F.count("*").alias("n_frames"), F.count_if(F.col("ball") > 0).alias("n_ball"), F.count_if(F.col("low") > 0).alias("n_low_conf"), F.count_if(F.col("ball") == 0).alias("n_missing")]
    for c in ("goalkeeper", "referee", "player"):
        out += [F.avg(c).alias(f"{c}_avg"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return every.groupBy("match_id").agg(*out).withColumn("ball_pct", 100 * F.col("n_ball") / F.col("n_frames"))


def crowding(tracks: DataFrame, roles: DataFrame, radius: float = 45, compact: int = 3) -> DataFrame:
    """Number of other players and keepers with a whole-pixel foot within ``radius`` of each."""
    people = tracks.join(roles, ["match_id", "track_id"]).filter(F.col("role").isin("player", "goalkeeper"))
    feet = people.select(*FRAME, "track_id", ((F.col("x1") + F.col("x2")) / 2).cast("int").alias("fx"), F.col("y2").cast("int").alias("fy"))
    other = feet.select(*FRAME, F.col("track_id").alias("o"), F.col("fx").alias("ox"), F.col("fy").alias("oy"))
    close = (F.col("track_id") != F.col("o")) & ((F.col("fx") - F.col("ox")) * (F.col("fx") - F.col("ox")) + (F.col("fy") - F.col("oy")) * (F.col("fy") - F.col("oy")) <= radius * radius)
    near = feet.join(other, FRAME).groupBy(*FRAME, "track_id").agg(F.count_if(close).alias("n_near"))
    return near.withColumn("compact", F.col("n_near") >= compact)
