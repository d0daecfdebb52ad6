"""Frame tables, possession, passes, pressing."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import detections, frames, passes, pressing
from matchloom.plans.registry import project_sql, register
from matchloom.sources.io import materialize

FRAME = detections.FRAME
CFG = passes.PassConfig(max_gap_frames=8)
FX, FY = project_sql("((x1 + x2) / 2)", "y2")
PLAYERS = f""", pf AS (SELECT t.match_id, t.frame_idx, t.track_id, coalesce(r.role, t.class) AS role, m.team, (x1 + x2) / 2 AS x_px, y2 AS y_px, {FX} AS pitch_x, {FY} AS pitch_y, coalesce(t.track_id = c.carrier_track_id, false) AS is_carrier
  FROM tracks t LEFT JOIN track_role r USING (match_id, track_id) LEFT JOIN track_team m USING (match_id, track_id) LEFT JOIN homography h USING (match_id, frame_idx) LEFT JOIN ball_frame c ON c.match_id = t.match_id AND c.frame_idx = t.frame_idx),
pv AS (SELECT * REPLACE (CASE WHEN pitch_x BETWEEN -5 AND 110 AND pitch_y BETWEEN -5 AND 73 THEN pitch_x END AS pitch_x, CASE WHEN pitch_x BETWEEN -5 AND 110 AND pitch_y BETWEEN -5 AND 73 THEN pitch_y END AS pitch_y) FROM pf)"""
NEEDS = "tracks track_role track_team homography ball_frame"


def player_frames(t):
    return frames.player_frames(t.tracks, t.track_role, t.track_team, t.homography, t.ball_frame.select(*FRAME, F.col("carrier_track_id").alias("track_id")))


@register("f01_player_frames", NEEDS, PLAYERS + " --- SELECT match_id, track_id, role, team, count(*) AS n, avg(x_px) AS x_px, avg(y_px) AS y_px, avg(pitch_x) AS pitch_x, avg(pitch_y) AS pitch_y, count(*) FILTER (is_carrier) AS n_carrier FROM pf GROUP BY ALL", "x_px y_px pitch_x pitch_y")
def _(t):
    p = player_frames(t)
    return p.groupBy("match_id", "track_id", "role", "team").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("x_px", "y_px", "pitch_x", "pitch_y")), F.count_if("is_carrier").alias("n_carrier"))


@register("f02_drop_implausible", NEEDS, PLAYERS + " --- SELECT match_id, track_id, count(pitch_x) AS n, min(pitch_x) AS lo, max(pitch_x) AS hi, avg(pitch_y) AS y FROM pv GROUP BY ALL", "lo hi y")
def _(t):
    p = frames.drop_implausible(player_frames(t))
    return p.groupBy("match_id", "track_id").agg(F.count("pitch_x").alias("n"), F.min("pitch_x").alias("lo"), F.max("pitch_x").alias("hi"), F.avg("pitch_y").alias("y"))


@register("f02_plausibility", NEEDS, PLAYERS + " --- SELECT match_id, count(pf.pitch_x) - count(pv.pitch_x) AS n_bad, count(pf.pitch_x) AS n_total, 100.0 * (count(pf.pitch_x) - count(pv.pitch_x)) / count(pf.pitch_x) AS bad_pct FROM pf JOIN pv USING (match_id, frame_idx, track_id) GROUP BY match_id", "bad_pct")
def _(t):
    return frames.plausibility(player_frames(t))


BX, BY = project_sql("x_px", "y_px")


@register("f03_ball_frames", "ball_px ball_frame track_team homography", f"SELECT e.match_id, e.frame_idx, p.x_px AS ball_x_px, {BX} AS ball_pitch_x, p.source AS ball_source, p.conf AS ball_conf, b.carrier_track_id, m.team AS carrier_team FROM ev e LEFT JOIN ball_px p USING (match_id, frame_idx) LEFT JOIN homography h USING (match_id, frame_idx) LEFT JOIN ball_frame b USING (match_id, frame_idx) LEFT JOIN track_team m ON m.match_id = e.match_id AND m.track_id = b.carrier_track_id", "ball_x_px ball_pitch_x ball_conf")
def _(t):
    from matchloom.functions.geometry import project

    x, y = project(F.col("x_px"), F.col("y_px"))
    tracked = t.ball_px.join(t.homography.hint("merge"), FRAME).withColumns({"pitch_x": x, "pitch_y": y})
    out = frames.ball_frames(t.ev, tracked, t.ball_frame.select(*FRAME, F.col("carrier_track_id").alias("track_id")), t.track_team)
    return out.select(*FRAME, "ball_x_px", "ball_pitch_x", "ball_source", "ball_conf", "carrier_track_id", "carrier_team")


FILL = "SELECT match_id, frame_idx, last_value(carrier_team IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW) AS possession_team FROM ball_frame"


@register("f04_possession_fill", "ball_frame", FILL.format(8))
def _(t):
    return frames.fill_possession(t.ball_frame.drop("possession_team")).select(*FRAME, "possession_team")


@register("f04_possession_fill_unbounded", "ball_frame", FILL.format("UNBOUNDED"))
def _(t):
    return frames.fill_possession(t.ball_frame.drop("possession_team"), None).select(*FRAME, "possession_team")


DIRECTIONS = """, d AS (SELECT match_id, team, (frame_idx >= 240)::INT AS half, median(pitch_x) AS median_x, count(*) AS n_rows FROM player_frame WHERE role = 'goalkeeper' AND pitch_x IS NOT NULL AND team IS NOT NULL GROUP BY ALL),
dd AS (SELECT *, CASE WHEN median_x < 52.5 THEN 1 ELSE -1 END AS direction FROM d)"""


def halves(t):
    return t.ev.select("match_id").distinct().withColumn("half_boundary_frame", F.lit(240))


@register("f05_attack_directions", "player_frame", DIRECTIONS + " --- SELECT match_id, team, half, median_x, n_rows, direction AS attack_direction FROM dd", "median_x")
def _(t):
    return frames.attack_directions(t.player_frame, halves(t))


@register("f06_attach_directions", "player_frame", DIRECTIONS + " --- SELECT p.match_id, p.track_id, direction AS attack_direction, count(*) AS n FROM player_frame p LEFT JOIN dd ON dd.match_id = p.match_id AND dd.team = p.team AND dd.half = (p.frame_idx >= 240)::INT GROUP BY ALL")
def _(t):
    p = frames.attach_direction(t.player_frame, frames.attack_directions(t.player_frame, halves(t)), halves(t))
    return p.groupBy("match_id", "track_id", "attack_direction").agg(F.count("*").alias("n"))


@register("f07_frame_quality", "player_frame", """, n AS (SELECT match_id, avg(n) AS players_avg, min(n) AS players_min, max(n) AS players_max FROM (SELECT match_id, frame_idx, count(*) AS n FROM player_frame GROUP BY ALL) q GROUP BY match_id),
  p AS (SELECT match_id, 100.0 * count(pitch_x) / count(*) AS pitch_pct, min(pitch_x) AS x_min, max(pitch_x) AS x_max, min(pitch_y) AS y_min, max(pitch_y) AS y_max, 100.0 * count(attack_direction) / count(*) AS direction_pct, count(DISTINCT attack_direction) AS n_directions FROM player_frame GROUP BY match_id),
  c AS (SELECT *, coalesce(carrier_track_id, -1) <> lag(coalesce(carrier_track_id, -1)) OVER (PARTITION BY match_id ORDER BY frame_idx) AS change FROM ball_frame),
  b AS (SELECT match_id, 100.0 * count(ball_pitch_x) / count(*) AS ball_pct, 100.0 * count(carrier_track_id) / count(*) AS carrier_pct, count(*) FILTER (possession_team IS NULL) AS n_no_possession, count(*) FILTER (change) AS n_carrier_changes FROM c GROUP BY match_id)
  --- SELECT * FROM n JOIN p USING (match_id) JOIN b USING (match_id)""", "players_avg pitch_pct x_min x_max y_min y_max direction_pct ball_pct carrier_pct")
def _(t):
    return frames.quality(t.player_frame, t.ball_frame)


@register("p01_first_teams", "player_frame", "SELECT match_id, track_id, first(team ORDER BY frame_idx) AS team FROM player_frame WHERE team IS NOT NULL GROUP BY ALL")
def _(t):
    return passes.first_teams(t.player_frame)


@register("p02_majority_teams", "player_frame", "SELECT match_id, track_id, mode(team) AS team FROM player_frame WHERE team IS NOT NULL GROUP BY ALL")
def _(t):
    return passes.majority_teams(t.player_frame)


SEGMENTS = """, held AS (SELECT *, CASE WHEN carrier_track_id <> lag(carrier_track_id) OVER w OR frame_idx - lag(frame_idx) OVER w > 8 THEN 1 ELSE 0 END AS new FROM ball_frame WHERE carrier_track_id IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY frame_idx) AS seg FROM held),
seg AS (SELECT match_id, any_value(carrier_track_id) AS track_id, any_value(CASE WHEN carrier_track_id <> 7 THEN carrier_track_id % 2 END) AS team, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, max(frame_idx) - min(frame_idx) + 1 AS n_frames FROM runs GROUP BY match_id, seg HAVING max(frame_idx) - min(frame_idx) + 1 >= 5),
nxt AS (SELECT *, lead(track_id) OVER w AS to_id, lead(team) OVER w AS to_team, lead(start_frame) OVER w AS to_start FROM seg WINDOW w AS (PARTITION BY match_id ORDER BY start_frame)),
gap AS (SELECT n.match_id, n.track_id, n.team, n.end_frame, n.to_id, n.to_team, n.to_start, count(b.frame_idx) AS gap_frames, count(*) FILTER (b.ball_source = 'lost') AS lost, count(*) FILTER (b.ball_pitch_x NOT BETWEEN -5 AND 110 OR b.ball_pitch_y NOT BETWEEN -5 AND 73) AS outs
  FROM nxt n LEFT JOIN ball_frame b ON b.match_id = n.match_id AND b.frame_idx > n.end_frame AND b.frame_idx < n.to_start WHERE n.to_id <> n.track_id GROUP BY ALL),
ev0 AS (SELECT *, CASE WHEN gap_frames > 0 THEN lost / gap_frames ELSE 0.0 END AS share, outs > 0 AS oob FROM gap),
pass AS (SELECT match_id, track_id AS passer_id, team AS passer_team, end_frame AS passer_end_frame, to_id AS receiver_id, to_team AS receiver_team, to_start AS receiver_start_frame, end_frame + 1 AS gap_start, to_start - 1 AS gap_end, gap_frames, round_even(share, 2) AS ball_lost_frac, oob AS ball_out_of_bounds, share > 0.5 OR oob AS is_turnover,
  CASE WHEN share > 0.5 OR oob THEN NULL WHEN team = to_team THEN 'completed' WHEN team <> to_team THEN 'failed' END AS outcome FROM ev0)"""


def team_dim(t):
    return passes.first_teams(t.player_frame)


@register("p03_possession_segments", "ball_frame", SEGMENTS + " --- SELECT * FROM seg")
def _(t):
    return passes.possession_segments(t.ball_frame, team_dim(t), CFG)


STRICT = """, sheld AS (SELECT *, CASE WHEN carrier_track_id <> lag(carrier_track_id) OVER w OR frame_idx - lag(frame_idx) OVER w > 1 THEN 1 ELSE 0 END AS new FROM ball_frame WHERE carrier_track_id IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
sruns AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY frame_idx) AS seg FROM sheld),
strict AS (SELECT match_id, any_value(carrier_track_id) AS track_id, any_value(CASE WHEN carrier_track_id <> 7 THEN carrier_track_id % 2 END) AS team, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_frames FROM sruns GROUP BY match_id, seg HAVING count(*) >= 4),
simple AS (SELECT match_id, end_frame AS pass_frame, to_start AS receive_frame, to_start - end_frame AS gap_frames, track_id AS passer_id, to_id AS receiver_id, team AS passer_team, to_team AS receiver_team, team = to_team AS completed
  FROM (SELECT *, lead(track_id) OVER w AS to_id, lead(team) OVER w AS to_team, lead(start_frame) OVER w AS to_start FROM strict WINDOW w AS (PARTITION BY match_id ORDER BY start_frame)) q WHERE to_id <> track_id AND to_start - end_frame <= 75 AND team IS NOT NULL AND to_team IS NOT NULL)"""


def strict(t):
    return passes.strict_segments(t.ball_frame, team_dim(t), 4)


def simple(t):
    return passes.simple_passes(strict(t))


@register("p04_strict_segments", "ball_frame", STRICT + " --- SELECT * FROM strict")
def _(t):
    return strict(t)


def events(t):
    return passes.pass_events(t.ball_frame, team_dim(t), CFG)


@register("p05_classify_transitions", "ball_frame", SEGMENTS + " --- SELECT * FROM pass", "ball_lost_frac")
def _(t):
    return events(t)


@register("p06_simple_passes", "ball_frame", STRICT + " --- SELECT * FROM simple")
def _(t):
    return simple(t)


@register("p07_turnover_rate", "ball_frame", SEGMENTS + " --- SELECT match_id, count(*) FILTER (NOT is_turnover) AS n_scored, count(*) FILTER (is_turnover) AS n_turnovers, count(*) FILTER (is_turnover) / count(*) AS turnover_rate FROM pass GROUP BY match_id", "turnover_rate")
def _(t):
    return passes.turnover_rate(events(t))


TALLY = "count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed, count(*) AS attempted, round_even(100 * count(*) FILTER (outcome = 'completed') / count(*), 1) AS completion_pct"


@register("p08_team_pass_stats", "ball_frame", SEGMENTS + f" --- SELECT match_id, passer_team, {TALLY} FROM pass WHERE outcome IS NOT NULL AND passer_team IS NOT NULL GROUP BY ALL", "completion_pct")
def _(t):
    return passes.team_stats(events(t))


TOP = SEGMENTS + f", stats AS (SELECT match_id, passer_team, passer_id, {TALLY} FROM pass WHERE outcome IS NOT NULL AND passer_team IS NOT NULL GROUP BY ALL)"


@register("p09_top_passers", "ball_frame", TOP + " --- SELECT *, row_number() OVER (PARTITION BY match_id, passer_team ORDER BY completed DESC, passer_id) AS place FROM stats QUALIFY place <= 5", "completion_pct")
def _(t):
    return passes.top_passers(events(t))


@register("p10_top_passers_by_attempts", "ball_frame", TOP + " --- SELECT *, row_number() OVER (PARTITION BY match_id, passer_team ORDER BY attempted DESC, passer_id) AS place FROM stats QUALIFY place <= 5", "completion_pct")
def _(t):
    return passes.top_passers(events(t), by="attempted")


@register("p11_dashboard_summary", "ball_frame", STRICT + " --- SELECT match_id, passer_team, grouping(passer_team) = 1 AS is_total, count(*) AS attempted, count(*) FILTER (completed) AS n_completed, round_even(100 * count(*) FILTER (completed) / count(*), 1) AS completion_pct FROM simple GROUP BY GROUPING SETS ((match_id, passer_team), (match_id))", "completion_pct")
def _(t):
    return passes.dashboard(simple(t))


def keepers(t):
    return t.track_team.filter("track_id in (11, 22)")


@register("p12_shots_saved", "ball_frame direction", STRICT + """, l AS (SELECT s.*, CASE WHEN s.receiver_id IN (11, 22) THEN s.receiver_id % 2 END AS keeper_team, d.attack_direction, b.ball_pitch_x FROM simple s LEFT JOIN direction d ON d.match_id = s.match_id AND d.team = s.passer_team LEFT JOIN ball_frame b ON b.match_id = s.match_id AND b.frame_idx = s.pass_frame)
  --- SELECT match_id, pass_frame, passer_id, receiver_id, CASE WHEN coalesce(keeper_team <> passer_team, false) THEN CASE WHEN coalesce(CASE WHEN attack_direction = 1 THEN ball_pitch_x >= 84 ELSE ball_pitch_x <= 21 END, false) THEN 'shot_saved' ELSE 'turnover' END WHEN completed THEN 'pass' ELSE 'turnover' END AS label FROM l""")
def _(t):
    return passes.label_shots_saved(simple(t), keepers(t), t.direction, t.ball_frame).select("match_id", "pass_frame", "passer_id", "receiver_id", "label")


VELOCITY = """, vel AS (SELECT a.match_id, a.frame_idx, CASE WHEN max(b.frame_idx) > min(b.frame_idx) THEN (max_by(b.ball_pitch_x, b.frame_idx) - min_by(b.ball_pitch_x, b.frame_idx)) / ((max(b.frame_idx) - min(b.frame_idx)) / 25) END AS vx, CASE WHEN max(b.frame_idx) > min(b.frame_idx) THEN (max_by(b.ball_pitch_y, b.frame_idx) - min_by(b.ball_pitch_y, b.frame_idx)) / ((max(b.frame_idx) - min(b.frame_idx)) / 25) END AS vy
  FROM ball_frame a LEFT JOIN ball_frame b ON b.match_id = a.match_id AND b.frame_idx BETWEEN a.frame_idx - 5 AND a.frame_idx AND b.ball_pitch_x IS NOT NULL GROUP BY a.match_id, a.frame_idx)"""


@register("p13_trailing_velocity", "ball_frame", VELOCITY + " --- SELECT * FROM vel", "vx vy")
def _(t):
    return passes.trailing_velocity(t.ball_frame)


NEAREST = """, asked AS (SELECT DISTINCT match_id, frame_idx, track_id FROM (SELECT match_id, pass_frame AS frame_idx, passer_id AS track_id FROM simple UNION ALL SELECT match_id, receive_frame, receiver_id FROM simple) q),
place AS (SELECT a.match_id, a.frame_idx, a.track_id, first(p.pitch_x ORDER BY abs(p.frame_idx - a.frame_idx), p.frame_idx) AS near_x, first(p.pitch_y ORDER BY abs(p.frame_idx - a.frame_idx), p.frame_idx) AS near_y FROM asked a LEFT JOIN player_frame p ON p.match_id = a.match_id AND p.track_id = a.track_id AND p.frame_idx BETWEEN a.frame_idx - 5 AND a.frame_idx + 5 AND p.pitch_x IS NOT NULL GROUP BY a.match_id, a.frame_idx, a.track_id)"""


def asked_places(t):
    s = materialize(simple(t), "passes")
    return s.select("match_id", F.col("pass_frame").alias("frame_idx"), F.col("passer_id").alias("track_id")).unionByName(s.select("match_id", F.col("receive_frame").alias("frame_idx"), F.col("receiver_id").alias("track_id")))


@register("p14_nearest_position", "ball_frame player_frame", STRICT + NEAREST + " --- SELECT * FROM place", "near_x near_y")
def _(t):
    return passes.nearest_position(asked_places(t), t.player_frame)


ANGLE = "CASE WHEN sqrt(vx * vx + vy * vy) * sqrt(gx * gx + gy * gy) > 0 THEN degrees(acos(greatest(-1.0, least(1.0, (vx * gx + vy * gy) / (sqrt(vx * vx + vy * vy) * sqrt(gx * gx + gy * gy)))))) END"


@register("p15_shot_angle", "ball_frame", VELOCITY + f", g AS (SELECT b.match_id, b.frame_idx, 105.0 - ball_pitch_x AS gx, 34.0 - ball_pitch_y AS gy, vx, vy FROM ball_frame b JOIN vel USING (match_id, frame_idx)) --- SELECT match_id, frame_idx, {ANGLE} AS shot_angle FROM g", "shot_angle", 4)
def _(t):
    rows = passes.trailing_velocity(t.ball_frame).join(t.ball_frame, FRAME).withColumn("attack_direction", F.lit(1))
    return passes.shot_angle(rows).select(*FRAME, "shot_angle")


EVENTS = STRICT + NEAREST + VELOCITY + f""", g AS (SELECT s.*, v.vx, v.vy, CASE d.attack_direction WHEN 1 THEN 105.0 WHEN -1 THEN 0.0 END - b.ball_pitch_x AS gx, 34.0 - b.ball_pitch_y AS gy, sqrt(pow(p.near_x - r.near_x, 2) + pow(p.near_y - r.near_y, 2)) AS contest_m
  FROM simple s LEFT JOIN vel v ON v.match_id = s.match_id AND v.frame_idx = s.pass_frame LEFT JOIN ball_frame b ON b.match_id = s.match_id AND b.frame_idx = s.pass_frame LEFT JOIN direction d ON d.match_id = s.match_id AND d.team = s.passer_team
  LEFT JOIN place p ON p.match_id = s.match_id AND p.frame_idx = s.pass_frame AND p.track_id = s.passer_id LEFT JOIN place r ON r.match_id = s.match_id AND r.frame_idx = s.receive_frame AND r.track_id = s.receiver_id),
k AS (SELECT *, {ANGLE} AS shot_angle, sqrt(vx * vx + vy * vy) AS ball_speed FROM g)"""


@register("p16_event_types", "ball_frame player_frame", EVENTS + " --- SELECT match_id, pass_frame, passer_id, receiver_id, contest_m, ball_speed, shot_angle, CASE WHEN completed THEN 'pass' WHEN contest_m <= 2.5 THEN 'dispossessed' WHEN shot_angle <= 30 AND ball_speed >= 8 THEN 'shot_on_target' ELSE 'turnover' END AS event_type FROM k", "contest_m ball_speed shot_angle", 4)
def _(t):
    out = passes.event_types(materialize(simple(t), "passes"), t.player_frame, t.ball_frame, t.direction)
    return out.select("match_id", "pass_frame", "passer_id", "receiver_id", "contest_m", "ball_speed", "shot_angle", "event_type")


@register("p17_unreceived_events", "ball_frame direction", STRICT + VELOCITY + f""", g AS (SELECT s.match_id, s.track_id, s.team, s.end_frame, v.vx, v.vy, b.ball_pitch_x AS x, b.ball_pitch_y AS y, CASE d.attack_direction WHEN 1 THEN 105.0 WHEN -1 THEN 0.0 END - b.ball_pitch_x AS gx, 34.0 - b.ball_pitch_y AS gy FROM strict s
  LEFT JOIN vel v ON v.match_id = s.match_id AND v.frame_idx = s.end_frame LEFT JOIN ball_frame b ON b.match_id = s.match_id AND b.frame_idx = s.end_frame LEFT JOIN direction d ON d.match_id = s.match_id AND d.team = s.team
  WHERE s.team IS NOT NULL AND NOT EXISTS (SELECT 1 FROM simple p WHERE p.match_id = s.match_id AND p.passer_id = s.track_id AND p.pass_frame = s.end_frame)), k AS (SELECT *, {ANGLE} AS angle FROM g)
  --- SELECT match_id, track_id, team, end_frame, CASE WHEN angle <= 30 AND sqrt(vx * vx + vy * vy) >= 8 THEN 'shot_off_target' WHEN x <= 2 OR x >= 103 OR y <= 2 OR y >= 66 THEN 'out_of_play' ELSE 'unresolved' END AS event_type FROM k""")
def _(t):
    segs = materialize(strict(t), "strict")
    return passes.unreceived(segs, passes.simple_passes(segs), t.ball_frame, t.direction)


@register("p18_attack_by_majority", "player_frame", "SELECT match_id, team, mode(attack_direction) AS attack_direction FROM player_frame WHERE team IS NOT NULL AND attack_direction IS NOT NULL GROUP BY ALL")
def _(t):
    return passes.attack_by_majority(t.player_frame)


@register("p19_pass_report", "ball_frame", SEGMENTS + """, e AS (SELECT match_id, count(*) AS n_events, avg(is_turnover::INT) AS turnover_rate, count(*) FILTER (passer_team IS NULL OR receiver_team IS NULL) AS n_unknown_team, count(outcome) AS n_attempts, avg(gap_frames) AS gap_mean, stddev(gap_frames) AS gap_std, min(gap_frames) AS gap_min, quantile_cont(gap_frames, 0.25) AS gap_p25, quantile_cont(gap_frames, 0.5) AS gap_p50, quantile_cont(gap_frames, 0.75) AS gap_p75, max(gap_frames) AS gap_max FROM pass GROUP BY match_id),
  s AS (SELECT match_id, count(*) AS n_segments, avg(n_frames) AS segment_frames FROM seg GROUP BY match_id)
  --- SELECT *, segment_frames / 25 AS segment_seconds, turnover_rate > 0.5 AS many_turnovers, n_attempts < 5 AS few_attempts FROM s LEFT JOIN e USING (match_id)""", "segment_frames turnover_rate gap_mean gap_std gap_p25 gap_p50 gap_p75 segment_seconds")
def _(t):
    return passes.pass_report(events(t), passes.possession_segments(t.ball_frame, team_dim(t), CFG))


PHASES = """, ph0 AS (SELECT *, CASE WHEN possession_team <> lag(possession_team) OVER (PARTITION BY match_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS new FROM ball_frame WHERE possession_team IS NOT NULL),
ph1 AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY frame_idx)::BIGINT AS phase FROM ph0),
phases AS (SELECT match_id, phase, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, any_value(possession_team) AS possession_team, max(frame_idx) - min(frame_idx) + 1 AS duration_frames, 1 - any_value(possession_team) AS defending_team FROM ph1 GROUP BY ALL)"""


@register("r01_possession_phases", "ball_frame", PHASES + " --- SELECT * FROM phases")
def _(t):
    return pressing.phases(t.ball_frame)


@register("r01_phase_summary", "ball_frame", PHASES + " --- SELECT match_id, count(*) AS n_phases, avg(duration_frames) AS mean_frames, min(duration_frames) AS min_frames, max(duration_frames) AS max_frames FROM phases GROUP BY match_id", "mean_frames")
def _(t):
    return pressing.phase_summary(pressing.phases(t.ball_frame))


LINES = ", lines AS (SELECT match_id, frame_idx, team, CASE WHEN any_value(attack_direction) = 1 THEN min(pitch_x) WHEN any_value(attack_direction) = -1 THEN 105 - max(pitch_x) END AS line_height_m FROM player_frame WHERE role = 'player' AND pitch_x IS NOT NULL AND team IS NOT NULL GROUP BY ALL)"


@register("r02_line_heights", "player_frame", LINES + " --- SELECT * FROM lines", "line_height_m")
def _(t):
    return pressing.line_heights(t.player_frame)


CONVERGE = """, dist AS (SELECT p.match_id, p.frame_idx, p.track_id, p.team, sqrt(pow(p.pitch_x - b.ball_pitch_x, 2) + pow(p.pitch_y - b.ball_pitch_y, 2)) AS dist FROM player_frame p JOIN ball_frame b ON b.match_id = p.match_id AND b.frame_idx = p.frame_idx),
near AS (SELECT a.match_id, a.frame_idx, a.team, count(*) FILTER (a.dist <= 15) AS n_in_radius, count(*) FILTER (a.dist <= 15 AND a.dist < q.dist) AS n_converging FROM dist a LEFT JOIN dist q ON q.match_id = a.match_id AND q.track_id = a.track_id AND q.frame_idx = a.frame_idx - 1 WHERE a.team IS NOT NULL GROUP BY ALL),
okay AS (SELECT match_id, frame_idx, ball_pitch_x IS NOT NULL AND coalesce(lag(ball_pitch_x IS NOT NULL) OVER (PARTITION BY match_id ORDER BY frame_idx), false) AS ok FROM ball_frame),
conv AS (SELECT o.match_id, o.frame_idx, team, CASE WHEN ok THEN coalesce(n_in_radius, 0) END AS n_in_radius, CASE WHEN ok THEN coalesce(n_converging, 0) END AS n_converging FROM (SELECT *, unnest([0, 1]) AS team FROM okay) o LEFT JOIN near USING (match_id, frame_idx, team))"""


@register("r03_convergence", "player_frame", CONVERGE + " --- SELECT * FROM conv")
def _(t):
    return pressing.convergence(t.player_frame, t.ball_frame)


LOOKUP = PHASES + ", fp AS (SELECT e.match_id, e.frame_idx, p.phase, p.defending_team FROM ev e LEFT JOIN phases p ON p.match_id = e.match_id AND e.frame_idx BETWEEN p.start_frame AND p.end_frame)"


@register("r04_frame_phases", "ball_frame", LOOKUP + " --- SELECT match_id, frame_idx, phase FROM fp")
def _(t):
    return pressing.frame_phases(t.ball_frame, pressing.phases(t.ball_frame))


#: Every spell as seen from 40 frames before it starts to 40 after it ends, so that neighbours overlap.
@register("r04_frames_in_overlapping_spells", "ball_frame", LOOKUP + " --- SELECT b.match_id, b.frame_idx, p.phase, b.frame_idx - (p.start_frame - 40) AS frames_in FROM ball_frame b JOIN phases p ON p.match_id = b.match_id AND b.frame_idx BETWEEN p.start_frame - 40 AND p.end_frame + 40")
def _(t):
    wide = pressing.phases(t.ball_frame).withColumns({"start_frame": F.col("start_frame") - 40, "end_frame": F.col("end_frame") + 40})
    return pressing.frames_in_spells(t.ball_frame, wide)


@register("p14_nearest_position_far", "ball_frame player_frame", STRICT + NEAREST.replace("- 5", "- 500").replace("+ 5", "+ 500") + " --- SELECT * FROM place", "near_x near_y")
def _(t):
    return passes.nearest_position(asked_places(t), t.player_frame, reach=500)


PRESS = LOOKUP + LINES + CONVERGE + """, pr AS (SELECT f.match_id, f.frame_idx, f.defending_team, line_height_m, n_converging, n_in_radius, CASE WHEN defending_team IS NULL THEN 'no_phase' WHEN line_height_m IS NULL OR n_converging IS NULL THEN 'no_frame_data' END AS reason
  FROM fp f LEFT JOIN lines l ON l.match_id = f.match_id AND l.frame_idx = f.frame_idx AND l.team = f.defending_team LEFT JOIN conv c ON c.match_id = f.match_id AND c.frame_idx = f.frame_idx AND c.team = f.defending_team),
press AS (SELECT *, CASE WHEN reason IS NULL THEN line_height_m >= 35 END AS line_pushed_up, CASE WHEN reason IS NULL THEN n_converging >= 3 END AS numbers_converging, coalesce(reason IS NULL AND line_height_m >= 35 AND n_converging >= 3, false) AS team_press_trigger_raw FROM pr)"""


@register("r05_press_trigger", "ball_frame player_frame", PRESS + " --- SELECT match_id, frame_idx, defending_team, line_height_m, n_converging, n_in_radius, line_pushed_up, numbers_converging, team_press_trigger_raw, reason FROM press", "line_height_m")
def _(t):
    return pressing.press_frames(t.player_frame, t.ball_frame)


@register("r06_press_report", "ball_frame player_frame", PRESS + """ --- SELECT match_id, count(*) AS n_frames, count(*) FILTER (reason = 'no_phase') AS n_no_phase, count(*) FILTER (reason = 'no_frame_data') AS n_no_frame_data, count(*) FILTER (reason IS NULL) AS n_decided, count(*) FILTER (team_press_trigger_raw) AS n_triggers,
  avg(team_press_trigger_raw::INT) AS trigger_rate, avg(line_pushed_up::INT) AS pushed_rate, avg(numbers_converging::INT) AS converging_rate, avg(line_height_m) AS line_height_m_mean, stddev(line_height_m) AS line_height_m_std, min(line_height_m) AS line_height_m_min, quantile_cont(line_height_m, 0.25) AS line_height_m_p25, quantile_cont(line_height_m, 0.5) AS line_height_m_p50, quantile_cont(line_height_m, 0.75) AS line_height_m_p75, max(line_height_m) AS line_height_m_max, avg(n_converging) AS n_converging_mean, stddev(n_converging) AS n_converging_std, min(n_converging) AS n_converging_min, quantile_cont(n_converging, 0.25) AS n_converging_p25, quantile_cont(n_converging, 0.5) AS n_converging_p50, quantile_cont(n_converging, 0.75) AS n_converging_p75, max(n_converging) AS n_converging_max FROM press GROUP BY match_id""", "trigger_rate pushed_rate converging_rate line_height_m_mean line_height_m_std line_height_m_min line_height_m_p25 line_height_m_p50 line_height_m_p75 line_height_m_max n_converging_mean n_converging_std n_converging_p25 n_converging_p50 n_converging_p75")
def _(t):
    return pressing.press_report(pressing.press_frames(t.player_frame, t.ball_frame))
