"""Team pressing: possession phases, line height, converging defenders, the trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import PITCH_LENGTH, distance
from matchloom.operators.detections import FRAME, spine
from matchloom.operators.intervals import interval_join

RADIUS_M, HIGH_LINE_M, CONVERGING = 15.0, 35.0, 3


def phases(ball: DataFrame) -> DataFrame:
    """Spells of possession by one team; frames without possession inside a spell belong to it."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    held = ball.filter("possession_team is not null")
    new = (F.col("possession_team") != F.lag("possession_team").over(w)).cast("int")
    runs = held.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("phase", F.sum("_new").over(w))
    out = runs.groupBy("match_id", "phase").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.first("possession_team").alias("possession_team"))
    return out.withColumns({"duration_frames": F.col("end_frame") - F.col("start_frame") + 1, "defending_team": 1 - F.col("possession_team")})


def phase_summary(spells: DataFrame) -> DataFrame:
    d = "duration_frames"
    return spells.groupBy("match_id").agg(F.count("*").alias("n_phases"), F.avg(d).alias("mean_frames"), F.min(d).alias("min_frames"), F.max(d).alias("max_frames"))


def line_heights(players: DataFrame) -> DataFrame:
    """Distance of the last outfield player from the own goal line, by frame and team; null without a
    direction."""
    used = players.filter("role = 'player' and pitch_x is not null and team is not null")
    out = used.groupBy(*FRAME, "team").agg(F.min("pitch_x").alias("lo"), F.max("pitch_x").alias("hi"), F.min_by("attack_direction", F.when(F.col("attack_direction").isNotNull(), F.col("track_id"))).alias("d"))
    return out.select(*FRAME, "team", F.when(F.col("d") == 1, F.col("lo")).when(F.col("d") == -1, PITCH_LENGTH - F.col("hi")).alias("line_height_m"))


def convergence(players: DataFrame, ball: DataFrame, radius: float = RADIUS_M) -> DataFrame:
    """Team members near the ball and those of them that have come nearer since the frame before.

    Both are null unless both frames have players and a ball. The step back is by track, so the work
    spreads over tracks, not matches.
    """
    here = players.join(ball.select(*FRAME, F.col("ball_pitch_x").alias("bx"), F.col("ball_pitch_y").alias("by")), FRAME, "left")
    here = here.select(*FRAME, "track_id", "team", F.col("pitch_x").isNotNull().alias("known"), distance(F.col("pitch_x"), F.col("pitch_y"), F.col("bx"), F.col("by")).alias("dist"))
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_idx")
    before = F.when(F.lag("frame_idx").over(w) == F.col("frame_idx") - 1, F.lag("dist").over(w))
    near = F.col("dist") <= radius
    counts = here.withColumn("before", before).filter("team is not null").groupBy(*FRAME, "team").agg(F.count_if(near).alias("n_in_radius"), F.count_if(near & (F.col("dist") < F.col("before"))).alias("n_converging"))
    present = players.select(*FRAME).distinct().withColumn("has", F.lit(True))
    o = Window.partitionBy("match_id").orderBy("frame_idx")
    frames = ball.select(*FRAME, "ball_pitch_x").join(present, FRAME, "left").withColumn("ok", F.coalesce("has", F.lit(False)) & F.col("ball_pitch_x").isNotNull())
    frames = frames.withColumn("ok", F.col("ok") & F.coalesce(F.lag("ok").over(o) & (F.lag("frame_idx").over(o) == F.col("frame_idx") - 1), F.lit(False)))
    teams = frames.select(*FRAME, "ok", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("team"))
    out = teams.join(counts.withColumn("team", F.col("team").cast("long")), [*FRAME, "team"], "left")
    return out.select(*FRAME, "team", *(F.when(F.col("ok"), F.coalesce(c, F.lit(0))).alias(c) for c in ("n_in_radius", "n_converging")))


def frame_phases(ball: DataFrame, spells: DataFrame) -> DataFrame:
    """Phase of each frame, null outside all: inside, the last start looking back and the next end looking
    on are of one phase, so no range join is needed."""
    none = F.lit(None).cast("long")
    at = lambda f, s, e: F.struct(F.col(f).alias("frame_idx"), s.alias("s"), e.alias("e"))
    marks = spells.select("match_id", F.inline(F.array(at("start_frame", F.col("phase"), none), at("end_frame", none, F.col("phase")))))
    marks = marks.groupBy(*FRAME).agg(F.max("s").alias("s"), F.max("e").alias("e"))
    # Looking on is looking back in the opposite order, which runs in one pass.
    seen = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy("match_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = spine(ball).join(marks, FRAME, "left")
    rows = rows.withColumn("back", seen("s", F.col("frame_idx"))).withColumn("on", seen("e", F.col("frame_idx").desc()))
    return rows.select(*FRAME, F.when(F.col("back") == F.col("on"), F.col("back")).alias("phase"))


def frames_in_spells(frames: DataFrame, spells: DataFrame) -> DataFrame:
    """(match_id, frame_idx, phase, frames_in) for each spell around each frame; spells may overlap."""
    inside = interval_join(frames.select(*FRAME), spells.select("match_id", "phase", "start_frame", "end_frame"), ["match_id"], "frame_idx", "start_frame", "end_frame")
    return inside.select(*FRAME, "phase", (F.col("frame_idx") - F.col("start_frame")).alias("frames_in"))


def press_frames(players: DataFrame, ball: DataFrame) -> DataFrame:
    """Every frame with the defending team's line, its converging players and whether it presses; the
    reason is given where that can't be told."""
    spells = phases(ball)
    rows = frame_phases(ball, spells).join(spells.select("match_id", "phase", "defending_team"), ["match_id", "phase"], "left").withColumn("team", F.col("defending_team").cast("long"))
    lines = line_heights(players).withColumn("team", F.col("team").cast("long"))
    rows = rows.join(lines, [*FRAME, "team"], "left").join(convergence(players, ball), [*FRAME, "team"], "left")
    pushed, many = F.col("line_height_m") >= HIGH_LINE_M, F.col("n_converging") >= CONVERGING
    undecided = F.col("line_height_m").isNull() | F.col("n_converging").isNull()
    reason = F.when(F.col("defending_team").isNull(), "no_phase").when(undecided, "no_frame_data")
    decided = reason.isNull()
    return rows.select(
        *FRAME, F.col("defending_team"), "line_height_m", "n_converging", "n_in_radius", F.when(decided, pushed).alias("line_pushed_up"), F.when(decided, many).alias("numbers_converging"),
        F.coalesce(decided & pushed & many, F.lit(False)).alias("team_press_trigger_raw"), reason.alias("reason"),
    )


#: The spread of a column: what a description of it holds beside the count.
DESCRIBE = (("mean", F.avg), ("std", F.stddev), ("min", F.min), *((f"p{q}", lambda c, q=q: F.percentile(c, F.lit(q / 100))) for q in (25, 50, 75)), ("max", F.max))


def press_report(frames: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int"))
    return frames.groupBy("match_id").agg(
        F.count("*").alias("n_frames"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("no_phase", "no_frame_data")), F.count_if(F.col("reason").isNull()).alias("n_decided"),
        F.count_if("team_press_trigger_raw").alias("n_triggers"), share("team_press_trigger_raw").alias("trigger_rate"), share("line_pushed_up").alias("pushed_rate"), share("numbers_converging").alias("converging_rate"),
        *(f(c).alias(f"{c}_{n}") for c in ("line_height_m", "n_converging") for n, f in DESCRIBE),
    )
