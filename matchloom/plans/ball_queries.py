"""The ball and its carrier."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import geometry as g
from matchloom.operators import ball, carrier, detections
from matchloom.plans.registry import project_sql, register
from matchloom.sources.io import materialize

FRAME = detections.FRAME
CANDIDATES = """, cand AS (SELECT match_id, frame_idx, (x1 + x2) / 2 AS x_px, (y1 + y2) / 2 AS y_px, conf FROM detections WHERE class = 'ball' AND conf >= 0.15 QUALIFY row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY conf DESC, det_id) = 1)"""


@register("b01_ball_candidates", "detections", CANDIDATES + " --- SELECT * FROM cand", "x_px y_px conf")
def _(t):
    return ball.candidates(t.detections)


def people(t):
    rows = t.tracks.join(t.track_role.filter("role <> 'referee'"), ["match_id", "track_id"])
    cx, cy = g.centre()
    return rows.select(*FRAME, cx.alias("x"), cy.alias("y"))


@register("b02_crowd_gate", "detections tracks track_role", CANDIDATES + """, near AS (SELECT c.match_id, c.frame_idx, any_value(c.conf) AS conf, count(*) FILTER (role <> 'referee' AND sqrt(pow((x1 + x2) / 2 - c.x_px, 2) + pow((y1 + y2) / 2 - c.y_px, 2)) <= 60) AS n FROM cand c JOIN tracks USING (match_id, frame_idx) JOIN track_role USING (match_id, track_id) GROUP BY ALL)
  --- SELECT match_id, frame_idx, n, n >= 2 AND conf < 0.5 AS rejected FROM near""")
def _(t):
    c, cfg = ball.candidates(t.detections), ball.BallConfig()
    rows = c.join(t.tracks.join(t.track_role, ["match_id", "track_id"]).select(*FRAME, "role", *(x.alias(n) for x, n in zip(g.centre(), "xy"))), FRAME)
    near = (F.col("role") != "referee") & (g.distance(F.col("x"), F.col("y"), F.col("x_px"), F.col("y_px")) <= cfg.crowd_radius)
    n = rows.groupBy(*FRAME).agg(F.first("conf").alias("conf"), F.count_if(near).alias("n"))
    return n.select(*FRAME, "n", ((F.col("n") >= cfg.crowd_players) & (F.col("conf") < cfg.crowd_conf)).alias("rejected"))


def tracked(t):
    return ball.track_ball(t.ev.select(*FRAME), ball.candidates(t.detections), people(t), t.homography)


#: Both axes have the same variances and don't mix, so one place-and-speed filter of scalars a, b, c (variance of
#: the place, covariance, variance of the speed) serves them; then the smoothing steps back through each track.
TRACKED = CANDIDATES + f""", crowd AS (SELECT match_id, frame_idx, list({{'x': (x1 + x2) / 2, 'y': (y1 + y2) / 2}}) AS people FROM tracks JOIN track_role USING (match_id, track_id) WHERE role <> 'referee' GROUP BY match_id, frame_idx),
z AS (SELECT e.match_id, e.frame_idx, row_number() OVER (PARTITION BY e.match_id ORDER BY e.frame_idx) AS n, x_px AS zx, y_px AS zy, conf, coalesce(people, []) AS people, h.* EXCLUDE (match_id, frame_idx)
  FROM ev e LEFT JOIN cand USING (match_id, frame_idx) LEFT JOIN crowd USING (match_id, frame_idx) LEFT JOIN homography h USING (match_id, frame_idx)),
f(match_id, frame_idx, n, seg, alive, inside, hit, fast, gap, x, y, vx, vy, a, b, c, px, py, pvx, pvy, pa, pb, pc) AS (
  SELECT match_id, frame_idx, n, (zx IS NOT NULL)::INT, zx IS NOT NULL, zx IS NOT NULL, zx IS NOT NULL, false, 0, zx, zy, 0.0::DOUBLE, 0.0::DOUBLE, 25.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE,
    NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM z WHERE n = 1
  UNION ALL SELECT r.match_id, r.frame_idx, r.n, seg + (new)::INT, new OR was AND (hit OR gap < 38), new OR was, new OR hit, fast, CASE WHEN new OR hit THEN 0 ELSE gap + 1 END,
    CASE WHEN new THEN zx WHEN hit THEN px + pa / s * (zx - px) ELSE px END, CASE WHEN new THEN zy WHEN hit THEN py + pa / s * (zy - py) ELSE py END,
    CASE WHEN new THEN 0 WHEN hit THEN pvx + pb / s * (zx - px) ELSE pvx END, CASE WHEN new THEN 0 WHEN hit THEN pvy + pb / s * (zy - py) ELSE pvy END,
    CASE WHEN new THEN 25 WHEN hit THEN pa - pa / s * pa ELSE pa END, CASE WHEN new THEN 0 WHEN hit THEN pb - pa / s * pb ELSE pb END, CASE WHEN new THEN 100 WHEN hit THEN pc - pb / s * pb ELSE pc END,
    px, py, pvx, pvy, pa, pb, pc
  FROM (SELECT *, near AND NOT quick AS hit, near AND quick AS fast FROM (
    SELECT *, coalesce(gap > 0 AND sqrt(pow({project_sql("zx", "zy")[0]} - {project_sql("px", "py")[0]}, 2) + pow({project_sql("zx", "zy")[1]} - {project_sql("px", "py")[1]}, 2)) / ((gap + 1) / 25.0) > 35, false) AS quick,
      was AND zx IS NOT NULL AND NOT (conf < 0.5 AND len(list_filter(people, lambda p: sqrt(pow(p.x - px, 2) + pow(p.y - py, 2)) <= 60)) >= 2) AND (pow(zx - px, 2) + pow(zy - py, 2)) / s <= 9.21 AS near
    FROM (SELECT *, pa + 25 AS s FROM (
      SELECT z.*, f.seg, f.gap, f.alive AS was, NOT f.alive AND z.zx IS NOT NULL AS new, f.x + f.vx AS px, f.y + f.vy AS py, f.vx AS pvx, f.vy AS pvy,
        f.a + 2 * f.b + f.c + 15 * least(pow(1.15, f.gap), 25) AS pa, f.b + f.c AS pb, f.c + 40 * least(pow(1.15, f.gap), 25) AS pc
      FROM f JOIN z ON z.match_id = f.match_id AND z.n = f.n + 1) k) p) q) r),
steps AS (SELECT *, max(n) OVER t AS last_n, max(CASE WHEN hit THEN n END) OVER t AS last_hit FROM f WHERE inside WINDOW t AS (PARTITION BY match_id, seg)),
back(match_id, n, seg, sx, sy, svx, svy, nx, ny, nvx, nvy, na, nb, nc) AS (
  SELECT match_id, n, seg, x, y, vx, vy, px, py, pvx, pvy, pa, pb, pc FROM steps WHERE n = last_n
  UNION ALL SELECT r.match_id, r.n, r.seg, x + g1 * (sx - nx) + g2 * (svx - nvx), y + g1 * (sy - ny) + g2 * (svy - nvy), vx + g3 * (sx - nx) + g4 * (svx - nvx), vy + g3 * (sy - ny) + g4 * (svy - nvy), px, py, pvx, pvy, pa, pb, pc
  FROM (SELECT k.*, t.sx, t.sy, t.svx, t.svy, t.nx, t.ny, t.nvx, t.nvy, ((a + b) * nc - b * nb) / (na * nc - nb * nb) AS g1, (b * na - (a + b) * nb) / (na * nc - nb * nb) AS g2, ((b + c) * nc - c * nb) / (na * nc - nb * nb) AS g3, (c * na - (b + c) * nb) / (na * nc - nb * nb) AS g4
    FROM back t JOIN steps k ON k.match_id = t.match_id AND k.seg = t.seg AND k.n = t.n - 1) r),
placed AS (SELECT z.*, CASE WHEN s.hit THEN zx WHEN s.n < last_hit THEN sx END AS x_px, CASE WHEN s.hit THEN zy WHEN s.n < last_hit THEN sy END AS y_px, CASE WHEN s.hit THEN 'detected' WHEN s.n < last_hit THEN 'smoothed' ELSE 'lost' END AS source, CASE WHEN s.hit THEN z.conf END AS at_conf, coalesce(s.fast, false) AS rejected_speed
  FROM z LEFT JOIN steps s ON s.match_id = z.match_id AND s.n = z.n LEFT JOIN back b ON b.match_id = z.match_id AND b.n = z.n AND b.seg = s.seg)"""
PITCH = "{} AS pitch_x, {} AS pitch_y".format(*project_sql("x_px", "y_px"))


@register("b03_track_ball", "ev detections tracks track_role homography", TRACKED + " --- SELECT match_id, frame_idx, source, rejected_speed FROM placed")
def _(t):
    return tracked(t).select(*FRAME, "source", "rejected_speed")


@register("b04_smooth_ball", "ev detections tracks track_role homography", TRACKED + " --- SELECT match_id, frame_idx, x_px, y_px FROM placed", "x_px y_px", digits=4)
def _(t):
    return tracked(t).select(*FRAME, "x_px", "y_px")


@register("b05_ball_positions", "ev detections tracks track_role homography", TRACKED + f" --- SELECT match_id, frame_idx, x_px, y_px, source, at_conf AS conf, rejected_speed, {PITCH} FROM placed", "x_px y_px conf pitch_x pitch_y", digits=4)
def _(t):
    return tracked(t)


@register("b06_source_stats", "ev detections tracks track_role homography", TRACKED + """, n AS (SELECT match_id, source, count(*) AS n, count(*) FILTER (rejected_speed) AS n_rejected_speed FROM placed GROUP BY ALL)
  --- SELECT match_id, source, n, n_rejected_speed, 100.0 * n / sum(n) OVER w AS pct, (sum(n_rejected_speed) OVER w)::BIGINT AS match_rejected_speed FROM n WINDOW w AS (PARTITION BY match_id)""", "pct")
def _(t):
    return ball.source_stats(tracked(t))


@register("b07_gap_summary", "ball_px", """, m AS (SELECT *, source <> 'detected' AS miss, coalesce(lag(source <> 'detected') OVER (PARTITION BY match_id ORDER BY frame_idx), false) AS prev FROM ball_px),
  r AS (SELECT *, sum((miss AND NOT prev)::INT) OVER (PARTITION BY match_id ORDER BY frame_idx) AS run FROM m), g AS (SELECT match_id, run, count(*) AS n FROM r WHERE miss GROUP BY ALL)
  --- SELECT match_id, count(*) AS n_gaps, avg(n) AS mean_gap, median(n) AS median_gap, max(n) AS max_gap, count(*) FILTER (n > 38) AS n_long FROM g GROUP BY match_id""", "mean_gap median_gap")
def _(t):
    return ball.gap_summary(t.ball_px)


DIST = "sqrt(pow(greatest(x1 - x_px, 0.0, x_px - x2), 2) + pow(greatest(y1 - y_px, 0.0, y_px - y2), 2))"
BX, BY = project_sql("x_px", "y_px")
FX, FY = project_sql("((x1 + x2) / 2)", "y2")
NEAR = f""", ball AS (SELECT p.*, {BX} AS pitch_x, {BY} AS pitch_y FROM ball_px p JOIN homography USING (match_id, frame_idx)),
who AS (SELECT match_id, track_id FROM track_role WHERE role <> 'referee'),
touch AS (SELECT * FROM (SELECT match_id, frame_idx, track_id, {DIST} AS dist FROM tracks JOIN who USING (match_id, track_id) JOIN ball_px USING (match_id, frame_idx) WHERE x_px IS NOT NULL) q WHERE dist <= 15),
feet AS (SELECT match_id, frame_idx, track_id, {FX} AS fx, {FY} AS fy FROM tracks JOIN who USING (match_id, track_id) JOIN homography USING (match_id, frame_idx)),
prox AS (SELECT * FROM (SELECT match_id, frame_idx, track_id, sqrt((pitch_x - fx) * (pitch_x - fx) + (pitch_y - fy) * (pitch_y - fy)) AS dist FROM feet JOIN ball USING (match_id, frame_idx)) q WHERE dist <= 2.5),
rank1 AS (SELECT *, row_number() OVER w AS k, lead(dist) OVER w AS second FROM touch WINDOW w AS (PARTITION BY match_id, frame_idx ORDER BY dist, track_id)),
best1 AS (SELECT match_id, frame_idx, track_id, dist, coalesce(second <= 0 OR dist >= 0.7 * second, false) AS ambiguous FROM rank1 WHERE k = 1),
rank2 AS (SELECT *, row_number() OVER w AS k, lead(dist) OVER w AS second FROM prox WINDOW w AS (PARTITION BY match_id, frame_idx ORDER BY dist, track_id)),
best2 AS (SELECT match_id, frame_idx, track_id, dist, coalesce(second <= 0 OR dist >= 0.7 * second, false) AS ambiguous FROM rank2 WHERE k = 1)"""
NEEDS = "ball_px homography tracks track_role"


def ball_on_pitch(t):
    x, y = g.project(F.col("x_px"), F.col("y_px"))
    return t.ball_px.join(t.homography.hint("merge"), FRAME).select(*FRAME, "x_px", "y_px", "source", "conf", x.alias("pitch_x"), y.alias("pitch_y"))


@register("c01_touch_candidates", NEEDS, NEAR + " --- SELECT * FROM touch", "dist")
def _(t):
    return carrier.touches(t.ball_px, t.tracks, t.track_role)


@register("c02_proximity_candidates", NEEDS, NEAR + " --- SELECT * FROM prox", "dist")
def _(t):
    return carrier.proximities(ball_on_pitch(t), t.tracks, t.track_role, t.homography)


@register("c03_best_with_margin", NEEDS, NEAR + " --- SELECT * FROM best1", "dist")
def _(t):
    return carrier.best_with_margin(carrier.touches(t.ball_px, t.tracks, t.track_role))


CHANGE = NEAR + """, ends AS (SELECT match_id, max(frame_idx) AS last FROM ball GROUP BY ALL),
v AS (SELECT b.match_id, b.frame_idx, (b.pitch_x - p.pitch_x) / ((b.frame_idx - p.frame_idx) / 25) AS x0, (b.pitch_y - p.pitch_y) / ((b.frame_idx - p.frame_idx) / 25) AS y0, (n.pitch_x - b.pitch_x) / ((n.frame_idx - b.frame_idx) / 25) AS x1, (n.pitch_y - b.pitch_y) / ((n.frame_idx - b.frame_idx) / 25) AS y1, p.frame_idx < b.frame_idx AND n.frame_idx > b.frame_idx AS ok
  FROM ball b JOIN ends e USING (match_id) JOIN ball p ON p.match_id = b.match_id AND p.frame_idx = greatest(b.frame_idx - 4, 0) JOIN ball n ON n.match_id = b.match_id AND n.frame_idx = least(b.frame_idx + 4, e.last)),
change AS (SELECT match_id, frame_idx, CASE WHEN ok AND x0 IS NOT NULL AND x1 IS NOT NULL THEN sqrt(x0 * x0 + y0 * y0) END AS speed_before, CASE WHEN ok AND x0 IS NOT NULL AND x1 IS NOT NULL THEN sqrt(x1 * x1 + y1 * y1) END AS speed_after,
  CASE WHEN ok AND x0 IS NOT NULL AND x1 IS NOT NULL THEN least(abs(degrees(atan2(y1, x1) - atan2(y0, x0))), 360 - abs(degrees(atan2(y1, x1) - atan2(y0, x0)))) END AS turn_deg FROM v),
touchy AS (SELECT match_id, frame_idx, coalesce(abs(speed_after - speed_before) >= 2.0 OR turn_deg >= 20.0, true) AS touch_like FROM change)"""


@register("c04_velocity_change", NEEDS, CHANGE + " --- SELECT * FROM change", "speed_before speed_after turn_deg", 4)
def _(t):
    return carrier.velocity_change(ball_on_pitch(t))


@register("c05_touch_like", NEEDS, CHANGE + " --- SELECT * FROM touchy")
def _(t):
    return carrier.touch_like(carrier.velocity_change(ball_on_pitch(t)))


def decided(t):
    return materialize(carrier.decisions(t.ev, ball_on_pitch(t), t.tracks, t.track_role, t.homography), "decisions")


CHOICE = CHANGE + """, choice AS (SELECT e.match_id, e.frame_idx, CASE WHEN x_px IS NOT NULL THEN CASE WHEN b1.track_id IS NOT NULL THEN CASE WHEN b1.ambiguous THEN 'contested' ELSE 'overlap' END WHEN b2.track_id IS NOT NULL THEN CASE WHEN b2.ambiguous THEN 'contested' ELSE 'proximity' END END END AS method, coalesce(b1.track_id, b2.track_id) AS id
  FROM ev e LEFT JOIN ball USING (match_id, frame_idx) LEFT JOIN best1 b1 ON b1.match_id = e.match_id AND b1.frame_idx = e.frame_idx LEFT JOIN best2 b2 ON b2.match_id = e.match_id AND b2.frame_idx = e.frame_idx)"""


@register("c06_carrier_candidates", NEEDS, CHOICE + " --- SELECT match_id, frame_idx, method, CASE WHEN method IN ('overlap', 'proximity') THEN id END AS candidate FROM choice")
def _(t):
    return decided(t).select(*FRAME, "method", "candidate")


CFG = carrier.CarrierConfig(switch_frames=4)


#: Track numbers of the derived tables go to 24; the recurrence goes frame by frame.
_PUT = "list_transform(range(1, 25), lambda i: CASE WHEN i = candidate THEN {} ELSE streak[i] END)"
_NONE = "list_transform(range(1, 25), lambda i: 0)"
HELD = CHOICE + f""", w AS (SELECT c.match_id, c.frame_idx, method, CASE WHEN method IN ('overlap', 'proximity') THEN id END AS candidate, coalesce(touch_like, true) AS touch, source AS ball_source, row_number() OVER (PARTITION BY c.match_id ORDER BY c.frame_idx) AS n
  FROM choice c LEFT JOIN touchy USING (match_id, frame_idx) LEFT JOIN ball USING (match_id, frame_idx)),
k(match_id, frame_idx, n, now, idle, streak) AS (
  SELECT match_id, -1::BIGINT, 0::BIGINT, NULL::BIGINT, 0, {_NONE} FROM w WHERE n = 1
  UNION ALL SELECT r.match_id, r.frame_idx, r.n, CASE WHEN candidate IS NULL THEN CASE WHEN idle < 8 THEN now END WHEN candidate = now THEN now WHEN touch AND streak[candidate] + 1 >= {CFG.switch_frames} THEN candidate ELSE now END,
    CASE WHEN candidate IS NULL THEN idle + 1 ELSE 0 END,
    CASE WHEN candidate IS NULL THEN CASE WHEN idle < 8 THEN streak ELSE {_NONE} END WHEN candidate = now THEN {_PUT.format(0)} WHEN NOT touch THEN streak WHEN streak[candidate] + 1 >= {CFG.switch_frames} THEN {_NONE} ELSE {_PUT.format("streak[i] + 1")} END
  FROM (SELECT w.*, k.now, k.idle, k.streak FROM k JOIN w ON w.match_id = k.match_id AND w.n = k.n + 1) r),
held AS (SELECT match_id, frame_idx, now AS track_id, method, ball_source FROM k JOIN w USING (match_id, frame_idx))"""


@register("c06_hold_carrier", NEEDS, HELD + " --- SELECT * FROM held")
def _(t):
    return carrier.assign_carrier(decided(t), CFG)


@register("c07_carrier_stats", NEEDS, HELD + " --- SELECT match_id, count(*) AS n_frames, count(track_id) AS n_assigned, count(*) FILTER (method = 'contested') AS n_contested, 100.0 * count(track_id) / count(*) AS assigned_pct, 100.0 * count(*) FILTER (method = 'contested') / count(*) AS contested_pct FROM held GROUP BY match_id", "assigned_pct contested_pct")
def _(t):
    return carrier.carrier_stats(carrier.assign_carrier(decided(t), CFG))
