"""Frame tables: one row a player and frame, one row a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import H, PITCH_LENGTH, PITCH_WIDTH, foot, project
from matchloom.operators.detections import BOX, FRAME, spine

MARGIN = 5.0
POSSESSION_GAP = 8


def player_frames(tracks: DataFrame, roles: DataFrame, teams: DataFrame, homography: DataFrame, carrier: DataFrame) -> DataFrame:
    """Role, team, foot in the image and on the pitch, and whether the track carries the ball.

    The dimensions have some 25 rows a match; Spark broadcasts them while they are small and joins by
    key beyond.
    """
    fx, fy = foot()
    rows = tracks.select(*FRAME, "track_id", "class", *BOX)
    rows = rows.join(roles.select("match_id", "track_id", "role"), ["match_id", "track_id"], "left").join(teams.select("match_id", "track_id", "team"), ["match_id", "track_id"], "left")
    rows = rows.join(homography.select(*FRAME, *H), FRAME, "left").join(carrier.select(*FRAME, F.col("track_id").alias("_carrier")), FRAME, "left")
    x, y = project(fx, fy)
    return rows.select(
        *FRAME, "track_id", F.coalesce("role", "class").alias("role"), "team", fx.alias("x_px"), fy.alias("y_px"), x.alias("pitch_x"), y.alias("pitch_y"),
        F.coalesce(F.col("track_id") == F.col("_carrier"), F.lit(False)).alias("is_carrier"),
    )


def _on_pitch(margin: float = MARGIN):
    return F.col("pitch_x").between(-margin, PITCH_LENGTH + margin) & F.col("pitch_y").between(-margin, PITCH_WIDTH + margin)


def drop_implausible(players: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Both coordinates become null where one is out of the pitch and its margin."""
    return players.withColumns({c: F.when(_on_pitch(margin), F.col(c)) for c in ("pitch_x", "pitch_y")})


def plausibility(players: DataFrame, margin: float = MARGIN) -> DataFrame:
    known = F.col("pitch_x").isNotNull()
    out = players.groupBy("match_id").agg(F.count_if(known & ~_on_pitch(margin)).alias("n_bad"), F.count_if(known).alias("n_total"))
    return out.withColumn("bad_pct", 100 * F.col("n_bad") / F.nullif(F.col("n_total"), F.lit(0)))


def ball_frames(frames: DataFrame, tracked: DataFrame, carrier: DataFrame, teams: DataFrame) -> DataFrame:
    """Every frame of each match with the ball, its carrier and the carrier's team. Tables of a row a frame are never broadcast."""
    ball = tracked.select(*FRAME, F.col("x_px").alias("ball_x_px"), F.col("y_px").alias("ball_y_px"), F.col("pitch_x").alias("ball_pitch_x"), F.col("pitch_y").alias("ball_pitch_y"), F.col("source").alias("ball_source"), F.col("conf").alias("ball_conf"))
    rows = spine(frames).join(ball.hint("merge"), FRAME, "left").join(carrier.select(*FRAME, F.col("track_id").alias("carrier_track_id")).hint("merge"), FRAME, "left")
    named = teams.select("match_id", F.col("track_id").alias("carrier_track_id"), F.col("team").alias("carrier_team"))
    return rows.join(named, ["match_id", "carrier_track_id"], "left")


def fill_possession(ball: DataFrame, limit: int | None = POSSESSION_GAP) -> DataFrame:
    """Add ``possession_team``: the last carrier's team, over ``limit`` frames at most or without end."""
    w = Window.partitionBy("match_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return ball.withColumn("possession_team", F.last("carrier_team", ignorenulls=True).over(w))


def attack_directions(players: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Direction of each team and half, away from its keeper's median place, with the number of rows.
    ``boundaries`` has half_boundary_frame by match; without it a match is one half."""
    half = F.lit(0)
    if boundaries is not None:
        players = players.join(boundaries, "match_id", "left")
        half = F.coalesce((F.col("frame_idx") >= F.col("half_boundary_frame")).cast("int"), F.lit(0))
    keepers = players.filter("role = 'goalkeeper' and pitch_x is not null and team is not null").withColumn("half", half)
    out = keepers.groupBy("match_id", "team", "half").agg(F.median("pitch_x").alias("median_x"), F.count("*").alias("n_rows"))
    return out.withColumn("attack_direction", F.when(F.col("median_x") < PITCH_LENGTH / 2, 1).otherwise(-1))


def attach_direction(players: DataFrame, directions: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    half = F.lit(0)
    players = players.drop("attack_direction")
    if boundaries is not None:
        players = players.join(boundaries, "match_id", "left")
        half = F.coalesce((F.col("frame_idx") >= F.col("half_boundary_frame")).cast("int"), F.lit(0))
    out = players.withColumn("half", half).join(directions.select("match_id", "team", "half", "attack_direction"), ["match_id", "team", "half"], "left")
    return out.drop("half", "half_boundary_frame")


def quality(players: DataFrame, ball: DataFrame) -> DataFrame:
    """Players a frame, coverages, ranges, carrier changes and directions of each match."""
    per_frame = players.groupBy(*FRAME).agg(F.count("*").alias("n"))
    n = per_frame.groupBy("match_id").agg(F.avg("n").alias("players_avg"), F.min("n").alias("players_min"), F.max("n").alias("players_max"))
    p = players.groupBy("match_id").agg(
        (100 * F.count("pitch_x") / F.count("*")).alias("pitch_pct"), F.min("pitch_x").alias("x_min"), F.max("pitch_x").alias("x_max"), F.min("pitch_y").alias("y_min"), F.max("pitch_y").alias("y_max"),
        (100 * F.count("attack_direction") / F.count("*")).alias("direction_pct"), F.count_distinct("attack_direction").alias("n_directions"),
    )
    now = F.coalesce("carrier_track_id", F.lit(-1))
    before = F.lag(now).over(Window.partitionBy("match_id").orderBy("frame_idx"))
    b = ball.withColumn("_change", (now != before).cast("int")).groupBy("match_id").agg(
        (100 * F.count("ball_pitch_x") / F.count("*")).alias("ball_pct"), (100 * F.count("carrier_track_id") / F.count("*")).alias("carrier_pct"),
        F.count_if(F.col("possession_team").isNull()).alias("n_no_possession"), F.coalesce(F.sum("_change"), F.lit(0)).alias("n_carrier_changes"),
    )
    return n.join(p, "match_id").join(b, "match_id")
