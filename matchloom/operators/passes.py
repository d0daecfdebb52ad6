"""Possession segments, passes and the statistics over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from matchloom.operators.detections import FRAME
from matchloom.operators.intervals import nearest


@dataclass(frozen=True)
class PassConfig:
    max_gap_frames: int
    min_frames: int = 5
    pitch_margin: float = 5.0
    lost_share: float = 0.5


def _order():
    return Window.partitionBy("match_id").orderBy("frame_idx")


def first_teams(players: DataFrame) -> DataFrame:
    """First known team of each track."""
    return players.filter("team is not null").groupBy("match_id", "track_id").agg(F.min_by("team", "frame_idx").alias("team"))


def majority_teams(players: DataFrame) -> DataFrame:
    """Most frequent team of each track, the smaller on a tie."""
    n = players.filter("team is not null").groupBy("match_id", "track_id", "team").agg(F.count("*").alias("n"))
    return n.groupBy("match_id", "track_id").agg(F.min_by("team", F.struct(-F.col("n"), F.col("team"))).alias("team"))


def attack_by_majority(players: DataFrame) -> DataFrame:
    n = players.filter("team is not null and attack_direction is not null").groupBy("match_id", "team", "attack_direction").agg(F.count("*").alias("n"))
    return n.groupBy("match_id", "team").agg(F.min_by("attack_direction", F.struct(-F.col("n"), F.col("attack_direction"))).alias("attack_direction"))


def _counted(ball: DataFrame, margin: float) -> DataFrame:
    """Running numbers of frames, lost frames and frames with the ball out, before carriers are filtered."""
    out = ~(F.col("ball_pitch_x").between(-margin, PITCH_LENGTH + margin) & F.col("ball_pitch_y").between(-margin, PITCH_WIDTH + margin))
    flags = {"rows": F.lit(1), "lost": (F.col("ball_source") == "lost").cast("int"), "out": F.coalesce(out, F.lit(False)).cast("int")}
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    return ball.withColumns({f"own_{k}": v for k, v in flags.items()}).withColumns({f"cum_{k}": F.sum(f"own_{k}").over(upto) for k in flags})


def _runs(ball: DataFrame, bridge: int) -> DataFrame:
    held = ball.filter("carrier_track_id is not null")
    new = (F.col("carrier_track_id") != F.lag("carrier_track_id").over(_order())) | (F.col("frame_idx") - F.lag("frame_idx").over(_order()) > bridge)
    return held.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("seg", F.sum("_new").over(_order()))


def segments(ball: DataFrame, cfg: PassConfig) -> DataFrame:
    """Spells of one carrier, bridging gaps of ``max_gap_frames`` frames; short ones are dropped. The
    counts up to the end and before the start travel along, so that gaps need no join."""
    runs = _runs(_counted(ball, cfg.pitch_margin), cfg.max_gap_frames)
    carried = [F.max_by(f"cum_{k}", "frame_idx").alias(f"end_{k}") for k in ("rows", "lost", "out")] + [F.min_by(F.col(f"cum_{k}") - F.col(f"own_{k}"), "frame_idx").alias(f"before_{k}") for k in ("rows", "lost", "out")]
    out = runs.groupBy("match_id", "seg").agg(F.first("carrier_track_id").alias("track_id"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), *carried)
    out = out.withColumn("n_frames", F.col("end_frame") - F.col("start_frame") + 1)
    return out.filter(F.col("n_frames") >= cfg.min_frames)


def possession_segments(ball: DataFrame, teams: DataFrame, cfg: PassConfig) -> DataFrame:
    return segments(ball, cfg).join(teams, ["match_id", "track_id"], "left").select("match_id", "track_id", "team", "start_frame", "end_frame", "n_frames")


def strict_segments(ball: DataFrame, teams: DataFrame, least: int = 10) -> DataFrame:
    """Spells without any missing frame, by number of rows."""
    out = _runs(ball, 1).groupBy("match_id", "seg").agg(F.first("carrier_track_id").alias("track_id"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_frames"))
    return out.filter(F.col("n_frames") >= least).join(teams, ["match_id", "track_id"], "left").select("match_id", "track_id", "team", "start_frame", "end_frame", "n_frames")


def pass_events(ball: DataFrame, teams: DataFrame, cfg: PassConfig) -> DataFrame:
    """Every change of carrier: completed, failed or a turnover, with what happened in the gap. The
    outcome is null where a team is unknown."""
    seg = segments(ball, cfg).join(teams, ["match_id", "track_id"], "left")
    w = Window.partitionBy("match_id").orderBy("start_frame")
    after = F.lead(F.struct("track_id", "team", "start_frame", *(f"before_{k}" for k in ("rows", "lost", "out")))).over(w)
    pairs = seg.withColumn("nxt", after).filter(F.col("nxt.track_id") != F.col("track_id"))
    gap = {k: F.greatest(F.col(f"nxt.before_{k}") - F.col(f"end_{k}"), F.lit(0)) for k in ("rows", "lost", "out")}
    pairs = pairs.withColumns({f"gap_{k}": v for k, v in gap.items()})
    share = F.when(F.col("gap_rows") > 0, F.col("gap_lost") / F.col("gap_rows")).otherwise(0.0)
    pairs = pairs.withColumns({"_share": share, "ball_out_of_bounds": F.col("gap_out") > 0})
    pairs = pairs.withColumn("is_turnover", (F.col("_share") > cfg.lost_share) | F.col("ball_out_of_bounds"))
    same = F.col("team") == F.col("nxt.team")
    outcome = F.when(~F.col("is_turnover"), F.when(same, "completed").when(~same, "failed"))
    return pairs.select(
        "match_id", F.col("track_id").alias("passer_id"), F.col("team").alias("passer_team"), F.col("end_frame").alias("passer_end_frame"),
        F.col("nxt.track_id").alias("receiver_id"), F.col("nxt.team").alias("receiver_team"), F.col("nxt.start_frame").alias("receiver_start_frame"),
        (F.col("end_frame") + 1).alias("gap_start"), (F.col("nxt.start_frame") - 1).alias("gap_end"), F.col("gap_rows").alias("gap_frames"),
        F.bround("_share", 2).alias("ball_lost_frac"), "ball_out_of_bounds", "is_turnover", outcome.alias("outcome"),
    )


def simple_passes(segs: DataFrame, max_frames: int = 75) -> DataFrame:
    """Consecutive spells of different players of known teams within ``max_frames``."""
    w = Window.partitionBy("match_id").orderBy("start_frame")
    rows = segs.withColumn("nxt", F.lead(F.struct("track_id", "team", "start_frame")).over(w))
    gap = F.col("nxt.start_frame") - F.col("end_frame")
    keep = (F.col("nxt.track_id") != F.col("track_id")) & (gap <= max_frames) & F.col("team").isNotNull() & F.col("nxt.team").isNotNull()
    return rows.filter(keep).select(
        "match_id", F.col("end_frame").alias("pass_frame"), F.col("nxt.start_frame").alias("receive_frame"), gap.alias("gap_frames"), F.col("track_id").alias("passer_id"),
        F.col("nxt.track_id").alias("receiver_id"), F.col("team").alias("passer_team"), F.col("nxt.team").alias("receiver_team"), (F.col("team") == F.col("nxt.team")).alias("completed"),
    )


def turnover_rate(events: DataFrame) -> DataFrame:
    out = events.groupBy("match_id").agg(F.count_if(~F.col("is_turnover")).alias("n_scored"), F.count_if("is_turnover").alias("n_turnovers"))
    return out.withColumn("turnover_rate", F.col("n_turnovers") / (F.col("n_scored") + F.col("n_turnovers")))


def scored(events: DataFrame) -> DataFrame:
    """Events that are no turnover, with ``completed``."""
    return events.filter(~F.col("is_turnover")).withColumn("completed", F.col("outcome") == "completed")


def _tally(events: DataFrame, keys: list[str]) -> DataFrame:
    done, missed = F.count_if(F.col("outcome") == "completed"), F.count_if(F.col("outcome") == "failed")
    out = events.filter(~F.col("is_turnover") & F.col("outcome").isNotNull()).groupBy(*keys).agg(done.alias("completed"), missed.alias("failed"))
    out = out.withColumn("attempted", F.col("completed") + F.col("failed"))
    return out.withColumn("completion_pct", F.bround(100 * F.col("completed") / F.col("attempted"), 1))


def team_stats(events: DataFrame) -> DataFrame:
    return _tally(events.filter("passer_team is not null"), ["match_id", "passer_team"])


def top_passers(events: DataFrame, top: int = 5, by: str = "completed") -> DataFrame:
    """The ``top`` passers of each team; the smaller id goes first on a tie."""
    stats = _tally(events.filter("passer_team is not null"), ["match_id", "passer_team", "passer_id"])
    place = F.row_number().over(Window.partitionBy("match_id", "passer_team").orderBy(F.desc(by), "passer_id"))
    return stats.withColumn("place", place).filter(F.col("place") <= top)


def dashboard(passes: DataFrame) -> DataFrame:
    """Attempts, completions and rate by team, and over both teams (null team)."""
    out = passes.rollup("match_id", "passer_team").agg(F.count("*").alias("attempted"), F.count_if("completed").alias("n_completed"), F.grouping_id().alias("level"))
    return out.filter("level < 2").select("match_id", "passer_team", (F.col("level") == 1).alias("is_total"), "attempted", "n_completed", F.bround(100 * F.col("n_completed") / F.col("attempted"), 1).alias("completion_pct"))


def label_shots_saved(passes: DataFrame, keepers: DataFrame, directions: DataFrame, ball: DataFrame, share: float = 0.2) -> DataFrame:
    """Label passes: to the other keeper from near the goal attacked is a saved shot, to another opponent a
    turnover, else a pass. Missing data means turnover for keepers' balls."""
    rows = passes.join(keepers.select("match_id", F.col("track_id").alias("receiver_id"), F.col("team").alias("keeper_team")), ["match_id", "receiver_id"], "left")
    rows = rows.join(directions.select("match_id", F.col("team").alias("passer_team"), "attack_direction"), ["match_id", "passer_team"], "left")
    rows = rows.join(ball.select("match_id", F.col("frame_idx").alias("pass_frame"), "ball_pitch_x"), ["match_id", "pass_frame"], "left")
    zone = share * PITCH_LENGTH
    near = F.when(F.col("attack_direction") == 1, F.col("ball_pitch_x") >= PITCH_LENGTH - zone).when(F.col("attack_direction") == -1, F.col("ball_pitch_x") <= zone)
    theirs = F.col("keeper_team") != F.col("passer_team")
    label = F.when(F.coalesce(theirs, F.lit(False)), F.when(F.coalesce(near, F.lit(False)), "shot_saved").otherwise("turnover")).when(F.col("completed"), "pass").otherwise("turnover")
    return rows.select(*passes.columns, label.alias("label"))


def trailing_velocity(ball: DataFrame, frames: int = 5, fps: float = 25.0) -> DataFrame:
    """Velocity between the first and last known place within ``frames`` frames back; null if one."""
    w = _order().rangeBetween(-frames, 0)
    point = F.when(F.col("ball_pitch_x").isNotNull(), F.struct("frame_idx", "ball_pitch_x", "ball_pitch_y"))
    rows = ball.withColumns({"_a": F.first(point, ignorenulls=True).over(w), "_b": F.last(point, ignorenulls=True).over(w)})
    dt = (F.col("_b.frame_idx") - F.col("_a.frame_idx")) / fps
    return rows.select(*FRAME, *(F.when(dt > 0, (F.col(f"_b.ball_pitch_{c}") - F.col(f"_a.ball_pitch_{c}")) / dt).alias(f"v{c}") for c in "xy"))


def nearest_position(wanted: DataFrame, players: DataFrame, reach: int = 5) -> DataFrame:
    """Place of (match_id, track_id, frame_idx) or of the nearest frame within ``reach``, the earlier on a
    tie."""
    asked = wanted.select(*FRAME, "track_id").distinct()
    known = players.filter("pitch_x is not null").select(*FRAME, "track_id", F.col("pitch_x").alias("near_x"), F.col("pitch_y").alias("near_y"))
    return nearest(asked, known, ["match_id", "track_id"], "frame_idx", ["near_x", "near_y"], reach).select(*FRAME, "track_id", "near_x", "near_y")


def shot_angle(rows: DataFrame) -> DataFrame:
    """Add ``shot_angle``: degrees between the ball's velocity (vx, vy) and the way to the goal's centre."""
    gx = F.when(F.col("attack_direction") == 1, PITCH_LENGTH).when(F.col("attack_direction") == -1, 0.0) - F.col("ball_pitch_x")
    gy = PITCH_WIDTH / 2 - F.col("ball_pitch_y")
    norms = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) * F.sqrt(gx * gx + gy * gy)
    cos = (F.col("vx") * gx + F.col("vy") * gy) / norms
    return rows.withColumn("shot_angle", F.when(norms > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))))


@dataclass(frozen=True)
class EventConfig:
    contest_m: float = 2.5
    shot_angle: float = 30.0
    shot_speed: float = 8.0
    edge_m: float = 2.0


def event_types(passes: DataFrame, players: DataFrame, ball: DataFrame, directions: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """pass, dispossessed, shot_on_target or turnover for every pass, with what decided it."""
    both = [nearest_position(passes.select("match_id", F.col(f).alias("frame_idx"), F.col(i).alias("track_id")), players).select("match_id", F.col("frame_idx").alias(f), F.col("track_id").alias(i), F.col("near_x").alias(f"{i}_x"), F.col("near_y").alias(f"{i}_y")) for f, i in (("pass_frame", "passer_id"), ("receive_frame", "receiver_id"))]
    rows = passes.join(both[0], ["match_id", "pass_frame", "passer_id"], "left").join(both[1], ["match_id", "receive_frame", "receiver_id"], "left")
    move = trailing_velocity(ball).join(ball.select(*FRAME, "ball_pitch_x", "ball_pitch_y"), FRAME).withColumnRenamed("frame_idx", "pass_frame")
    rows = rows.join(move, ["match_id", "pass_frame"], "left").join(directions.select("match_id", F.col("team").alias("passer_team"), "attack_direction"), ["match_id", "passer_team"], "left")
    rows = shot_angle(rows)
    dx, dy = F.col("passer_id_x") - F.col("receiver_id_x"), F.col("passer_id_y") - F.col("receiver_id_y")
    contest, speed = F.sqrt(dx * dx + dy * dy), F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    kind = F.when(F.col("completed"), "pass").when(contest <= cfg.contest_m, "dispossessed").when((F.col("shot_angle") <= cfg.shot_angle) & (speed >= cfg.shot_speed), "shot_on_target").otherwise("turnover")
    return rows.select(*passes.columns, contest.alias("contest_m"), speed.alias("ball_speed"), "shot_angle", kind.alias("event_type"))


def unreceived(segs: DataFrame, passes: DataFrame, ball: DataFrame, directions: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Spells of a known team that start no pass: shot_off_target, out_of_play or unresolved."""
    alone = segs.filter("team is not null").join(passes.select("match_id", F.col("passer_id").alias("track_id"), F.col("pass_frame").alias("end_frame")), ["match_id", "track_id", "end_frame"], "left_anti")
    move = trailing_velocity(ball).join(ball.select(*FRAME, "ball_pitch_x", "ball_pitch_y"), FRAME).withColumnRenamed("frame_idx", "end_frame")
    rows = shot_angle(alone.join(move, ["match_id", "end_frame"], "left").join(directions, ["match_id", "team"], "left"))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    x, y = F.col("ball_pitch_x"), F.col("ball_pitch_y")
    edge = (x <= cfg.edge_m) | (x >= PITCH_LENGTH - cfg.edge_m) | (y <= cfg.edge_m) | (y >= PITCH_WIDTH - cfg.edge_m)
    kind = F.when((F.col("shot_angle") <= cfg.shot_angle) & (speed >= cfg.shot_speed), "shot_off_target").when(edge, "out_of_play").otherwise("unresolved")
    return rows.select("match_id", "track_id", "team", "end_frame", kind.alias("event_type"))


def pass_report(events: DataFrame, segs: DataFrame, fps: float = 25.0) -> DataFrame:
    """Turnover rate, events with an unknown team, length of spells, warnings and the spread of gaps."""
    e = events.groupBy("match_id").agg(
        F.count("*").alias("n_events"), F.avg(F.col("is_turnover").cast("int")).alias("turnover_rate"), F.count_if(F.col("passer_team").isNull() | F.col("receiver_team").isNull()).alias("n_unknown_team"),
        F.count_if(F.col("outcome").isNotNull()).alias("n_attempts"), F.avg("gap_frames").alias("gap_mean"), F.stddev("gap_frames").alias("gap_std"), F.min("gap_frames").alias("gap_min"),
        *(F.percentile("gap_frames", F.lit(q)).alias(f"gap_p{int(100 * q)}") for q in (0.25, 0.5, 0.75)), F.max("gap_frames").alias("gap_max"),
    )
    s = segs.groupBy("match_id").agg(F.count("*").alias("n_segments"), F.avg("n_frames").alias("segment_frames"))
    return s.join(e, "match_id", "left").withColumns({"segment_seconds": F.col("segment_frames") / fps, "many_turnovers": F.col("turnover_rate") > 0.5, "few_attempts": F.col("n_attempts") < 5})
