"""Sources, geometry, detections and homographies."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from matchloom.functions import geometry as g
from matchloom.operators import detections, homographies, tracklets
from matchloom.plans.registry import iou_sql, profile, profile_doubles, profile_sql, project_sql, register
from matchloom.sources import io, schemas

FRAME, BOX = detections.FRAME, detections.BOX
BALL_FRAME = "SELECT match_id, frame_idx, ball_source, ball_pitch_x, ball_pitch_y, carrier_track_id, carrier_team, possession_team FROM ball_frame"


@register("s01_read_table", sql="SELECT event_id, user_id, event_type, value FROM events", doubles="value")
def _(t):
    return schemas.conform(io.read(t.spark, f"{t.sf_dir}/events.parquet", schemas.EVENTS), schemas.EVENTS)


@register("s02_write_and_read", "ball_frame", BALL_FRAME, "ball_pitch_x ball_pitch_y")
def _(t):
    return io.materialize(t.ball_frame, "ball-frames")


def match_tables(t, buckets: int = 8):
    """Player and ball frames in buckets by match and frame, so that a long match spreads over all of them, each sorted."""
    base = f"{io.shared_folder(t.spark)}/matchloom/frames-{uuid.uuid4().hex}"
    both = [("players", schemas.conform(t.player_frame, schemas.PLAYER_FRAMES)), ("balls", schemas.conform(t.ball_frame, schemas.BALL_FRAMES))]
    return [io.write_bucketed(df, f"matchloom_{name}_{uuid.uuid4().hex}", f"{base}-{name}", FRAME, buckets, FRAME) for name, df in both]


@register("s02_join_bucketed", "player_frame ball_frame", "SELECT p.match_id, p.frame_idx, count(p.pitch_x) AS n_known, count(*) FILTER (p.is_carrier) AS n_carriers, any_value(b.ball_source) AS ball_source, any_value(b.possession_team) AS possession_team FROM player_frame p JOIN ball_frame b USING (match_id, frame_idx) GROUP BY p.match_id, p.frame_idx")
def _(t):
    players, balls = match_tables(t)
    joined = players.join(balls.select(*FRAME, "ball_source", "possession_team").hint("merge"), FRAME)
    return joined.groupBy(*FRAME).agg(F.count("pitch_x").alias("n_known"), F.count_if("is_carrier").alias("n_carriers"), F.first("ball_source").alias("ball_source"), F.first("possession_team").alias("possession_team"))


@register("s02_write_partitioned", "player_frame", "SELECT match_id, track_id, count(*) AS n, count(pitch_x) AS n_known, min(frame_idx) AS first_frame FROM player_frame GROUP BY ALL")
def _(t):
    path = f"{io.shared_folder(t.spark)}/matchloom/by-match-{uuid.uuid4().hex}"
    io.write(schemas.conform(t.player_frame, schemas.PLAYER_FRAMES).repartition("match_id").sortWithinPartitions(*FRAME), path, partition_by=["match_id"])
    return io.read(t.spark, path, schemas.PLAYER_FRAMES).groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.count("pitch_x").alias("n_known"), F.min("frame_idx").alias("first_frame"))


@register("s03_load_or_build", "ball_frame", BALL_FRAME, "ball_pitch_x ball_pitch_y")
def _(t):
    path = f"{io.shared_folder(t.spark)}/matchloom/stage-{zlib.crc32(t.sf_dir.encode())}"
    io.load_or_build(t.spark, [path], lambda: [t.ball_frame], force=True)
    return io.load_or_build(t.spark, [path], lambda: [t.ball_frame.limit(0)])[0]


@register("s04_unnest_frames", "tracks", "SELECT match_id, frame_idx, track_id, conf, class FROM tracks", "conf")
def _(t):
    return tracklets.unnest(tracklets.renest(t.tracks, t.ev.select(*FRAME))).select(*FRAME, "track_id", "conf", "class")


@register("s05_renest_frames", "tracks", "SELECT match_id, frame_idx, count(track_id) AS n_tracks, min(track_id) AS first_track, max(track_id) AS last_track FROM ev LEFT JOIN tracks USING (match_id, frame_idx) GROUP BY ALL")
def _(t):
    nested = tracklets.renest(t.tracks, t.ev.select(*FRAME))
    return nested.select(*FRAME, F.size("tracks").cast("long").alias("n_tracks"), F.get("tracks", F.lit(0))["track_id"].alias("first_track"), F.get("tracks", F.size("tracks") - 1)["track_id"].alias("last_track"))


@register("s06_frame_spine", "ev", "SELECT match_id, unnest(generate_series(0, max(frame_idx))) AS frame_idx FROM ev GROUP BY match_id")
def _(t):
    return detections.spine(t.ev)


@register("g01_iou", "tracks", ", p AS (SELECT a.match_id, a.track_id, " + iou_sql() + " AS iou FROM tracks a JOIN tracks b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND b.track_id = a.track_id + 1) --- " + profile_sql("p", "match_id, track_id", "iou"), profile_doubles("iou"))
def _(t):
    other = t.tracks.select(*FRAME, (F.col("track_id") - 1).alias("track_id"), *(F.col(c).alias(f"b_{c}") for c in BOX))
    pairs = t.tracks.join(other, [*FRAME, "track_id"])
    return profile(pairs.withColumn("iou", g.iou([F.col(c) for c in BOX], [F.col(f"b_{c}") for c in BOX])), ["match_id", "track_id"], "iou")


@register("g02_box_points", "tracks", ", p AS (SELECT match_id, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 AS fy FROM tracks) --- " + profile_sql("p", "match_id, track_id", "cx", "cy", "fy"), profile_doubles("cx", "cy", "fy"))
def _(t):
    cx, cy = g.centre()
    return profile(t.tracks.withColumns({"cx": cx, "cy": cy, "fy": g.foot()[1]}), ["match_id", "track_id"], "cx", "cy", "fy")


PX, PY = project_sql("x_px", "y_px")


@register("g03_pixel_to_pitch", "ball_px homography", f"SELECT match_id, frame_idx, {PX} AS x, {PY} AS y FROM ball_px JOIN homography USING (match_id, frame_idx)", "x y")
def _(t):
    x, y = g.project(F.col("x_px"), F.col("y_px"))
    return t.ball_px.join(t.homography.hint("merge"), FRAME).select(*FRAME, x.alias("x"), y.alias("y"))


FX, FY = project_sql("((x1 + x2) / 2)", "y2")


@register("g04_project_all_feet", "tracks homography", f", p AS (SELECT match_id, track_id, {FX} AS x, {FY} AS y FROM tracks JOIN homography USING (match_id, frame_idx)) --- " + profile_sql("p", "match_id, track_id", "x", "y"), profile_doubles("x", "y"))
def _(t):
    x, y = g.project(*g.foot())
    return profile(t.tracks.join(t.homography.hint("merge"), FRAME).withColumns({"x": x, "y": y}), ["match_id", "track_id"], "x", "y")


BOX_DIST = "sqrt(pow(greatest(x1 - x_px, 0.0, x_px - x2), 2) + pow(greatest(y1 - y_px, 0.0, y_px - y2), 2))"


@register("g05_point_to_box", "ball_px tracks", f", p AS (SELECT match_id, track_id, {BOX_DIST} AS dist, ({BOX_DIST} <= 15)::INT AS touch FROM tracks JOIN ball_px USING (match_id, frame_idx) WHERE x_px IS NOT NULL) --- SELECT match_id, track_id, count(*) AS n, min(dist) AS lo, avg(dist) AS mean, sum(touch)::BIGINT AS n_touch FROM p GROUP BY match_id, track_id", "lo mean")
def _(t):
    rows = t.tracks.join(t.ball_px.filter("x_px is not null").select(*FRAME, "x_px", "y_px").hint("merge"), FRAME).withColumn("dist", g.point_to_box(F.col("x_px"), F.col("y_px")))
    return rows.groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.avg("dist").alias("mean"), F.count_if(F.col("dist") <= 15).alias("n_touch"))


@register("g06_player_feet", "tracks homography track_role", f", p AS (SELECT match_id, role, {FX} AS x, {FY} AS y FROM tracks JOIN homography USING (match_id, frame_idx) JOIN track_role USING (match_id, track_id)) --- " + profile_sql("p", "match_id, role", "x", "y"), profile_doubles("x", "y"))
def _(t):
    x, y = g.project(*g.foot())
    return profile(t.tracks.join(t.homography.hint("merge"), FRAME).join(t.track_role, ["match_id", "track_id"]).withColumns({"x": x, "y": y}), ["match_id", "role"], "x", "y")


@register("g07_unit_vectors", sql="SELECT vec_id, sum(x * x) AS length2, max(x) AS top FROM (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY vec_id", doubles="length2 top")
def _(t):
    e = t.file("embeddings").withColumn("u", g.unit(F.col("embedding")))
    return e.select("vec_id", g.dot(F.col("u"), F.col("u")).alias("length2"), F.array_max("u").alias("top"))


@register("g08_torso_crop", "tracks", """, p AS (SELECT match_id, track_id, x2 - x1 AS w, y2 - y1 AS h, greatest(round_even(x1 + 0.2 * (x2 - x1), 0)::INT, 0) AS cx1, greatest(round_even(y1 + 0.15 * (y2 - y1), 0)::INT, 0) AS cy1,
  least(round_even(x2 - 0.2 * (x2 - x1), 0)::INT, 1280) AS cx2, least(round_even(y1 + 0.5 * (y2 - y1), 0)::INT, 720) AS cy2 FROM tracks)
  --- SELECT match_id, track_id, count(*) AS n, min(cx1) AS cx1, min(cy1) AS cy1, max(cx2) AS cx2, max(cy2) AS cy2 FROM p WHERE w * h >= 900 AND cx2 > cx1 AND cy2 > cy1 GROUP BY match_id, track_id""")
def _(t):
    rows = t.tracks.select("match_id", "track_id", g.torso(F.lit(1280), F.lit(720)).alias("c")).filter("c is not null")
    return rows.groupBy("match_id", "track_id").agg(F.count("*").alias("n"), *(f(f"c.{c}").alias(c) for f, c in ((F.min, "cx1"), (F.min, "cy1"), (F.max, "cx2"), (F.max, "cy2"))))


@register("g09_class_ids", "detections", "SELECT match_id, CASE class WHEN 'player' THEN 0 WHEN 'goalkeeper' THEN 1 ELSE 2 END AS class_id, count(*) AS n FROM detections WHERE class <> 'ball' GROUP BY ALL")
def _(t):
    return t.detections.select("match_id", g.class_id(F.col("class")).alias("class_id")).filter("class_id is not null").groupBy("match_id", "class_id").agg(F.count("*").alias("n"))


@register("g10_resolution_tag", "homography_raw", "SELECT match_id, coalesce(tag, 'none') AS tag, count(*) AS n FROM homography_raw GROUP BY ALL")
def _(t):
    labels = F.when(F.col("tag").isNull(), F.array(F.lit("line"))).when(F.col("tag") == "unresolved", F.array(F.lit("a_anchor"), F.lit("b_unresolved"))).otherwise(F.array(F.lit("x"), F.concat(F.lit("side_"), "tag")))
    rows = t.homography_raw.withColumn("labels", labels).withColumn("tag", F.coalesce(g.resolution_tag(F.col("labels")), F.lit("none")))
    return rows.groupBy("match_id", "tag").agg(F.count("*").alias("n"))


@register("d01_source_filter", "detections", "SELECT match_id, class, source, count(*) AS n, min(conf) AS lo FROM detections WHERE (class = 'ball') = (source = 'ball_model') AND conf >= 0.25 GROUP BY ALL", "lo")
def _(t):
    return detections.filter_sources(t.detections).groupBy("match_id", "class", "source").agg(F.count("*").alias("n"), F.min("conf").alias("lo"))


def _nms_sql() -> str:
    """Greedy suppression as recursion over the rank in each frame and class."""
    return f""", used AS (SELECT * FROM detections WHERE class <> 'ball' AND conf >= 0.25),
ranked AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx, class ORDER BY conf DESC, det_id) AS k FROM used),
hits AS (SELECT b.match_id, b.frame_idx, b.class, b.k, list(a.k) AS over FROM ranked a JOIN ranked b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.class = b.class AND a.k < b.k WHERE {iou_sql()} >= 0.5 GROUP BY ALL),
boxes AS (SELECT r.match_id, r.frame_idx, r.class, list(struct_pack(k := r.k, over := coalesce(h.over, [])) ORDER BY r.k) AS all_boxes FROM ranked r LEFT JOIN hits h USING (match_id, frame_idx, class, k) GROUP BY ALL),
kept AS (SELECT match_id, frame_idx, class, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(all_boxes, lambda b: [b.k])), lambda acc, b: CASE WHEN list_has_any(acc, all_boxes[b[1]].over) THEN acc ELSE list_concat(acc, b) END)) AS k FROM boxes),
nms AS (SELECT ranked.* FROM ranked JOIN kept USING (match_id, frame_idx, class, k))"""


@register("d02_suppress_same_class", "detections", _nms_sql() + " --- SELECT match_id, frame_idx, class, count(*) AS n, sum(det_id)::BIGINT AS ids FROM nms GROUP BY ALL")
def _(t):
    used = t.detections.filter("class <> 'ball' and conf >= 0.25")
    return detections.suppress(used).groupBy(*FRAME, "class").agg(F.count("*").alias("n"), F.sum("det_id").alias("ids"))


CROSS = f""", crossed AS (SELECT * FROM detections a WHERE class <> 'ball' AND (class <> 'player' OR NOT EXISTS (SELECT 1 FROM detections b WHERE b.class IN ('goalkeeper', 'referee') AND a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND {iou_sql()} >= 0.5)))"""


@register("d03_suppress_across_classes", "whole_detections", CROSS.replace("FROM detections", "FROM whole_detections") + " --- SELECT match_id, frame_idx, class, count(*) AS n, sum(det_id)::BIGINT AS ids FROM crossed GROUP BY ALL")
def _(t):
    return detections.suppress_across(t.whole_detections.filter("class <> 'ball'")).groupBy(*FRAME, "class").agg(F.count("*").alias("n"), F.sum("det_id").alias("ids"))


BEST = ", best AS (SELECT *, conf < 0.5 AS low_confidence FROM detections WHERE class = 'ball' QUALIFY row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY conf DESC, det_id) = 1)"


@register("d04_best_ball", "detections", BEST + " --- SELECT match_id, frame_idx, det_id, conf, low_confidence FROM best", "conf")
def _(t):
    return detections.best_ball(t.detections, detections.DetectionConfig(low_conf=0.5)).select(*FRAME, "det_id", "conf", "low_confidence")


@register("d05_fuse", "detections", CROSS + BEST + " --- SELECT match_id, class, count(*) AS n, count(low_confidence) AS n_flagged FROM (SELECT match_id, class, low_confidence FROM best UNION ALL SELECT match_id, class, NULL FROM crossed) f GROUP BY ALL")
def _(t):
    fused = detections.fuse(detections.best_ball(t.detections, detections.DetectionConfig(low_conf=0.5)), detections.suppress_across(t.detections.filter("class <> 'ball'")))
    return fused.groupBy("match_id", "class").agg(F.count("*").alias("n"), F.count("low_confidence").alias("n_flagged"))


@register("d06_detection_summary", "detections", BEST + """, per AS (SELECT e.match_id, e.frame_idx, count(b.conf) AS ball, count(b.conf) FILTER (b.low_confidence) AS low, any_value(c.gk) AS gk, any_value(c.ref) AS ref, any_value(c.pl) AS pl
  FROM ev e LEFT JOIN best b USING (match_id, frame_idx) LEFT JOIN (SELECT match_id, frame_idx, count(*) FILTER (class = 'goalkeeper') AS gk, count(*) FILTER (class = 'referee') AS ref, count(*) FILTER (class = 'player') AS pl FROM detections GROUP BY ALL) c USING (match_id, frame_idx) GROUP BY e.match_id, e.frame_idx)
  --- SELECT match_id, count(*) AS n_frames, count(*) FILTER (ball > 0) AS n_ball, count(*) FILTER (low > 0) AS n_low_conf, count(*) FILTER (ball = 0) AS n_missing, 100.0 * count(*) FILTER (ball > 0) / count(*) AS ball_pct,
  avg(coalesce(gk, 0)) AS goalkeeper_avg, min(coalesce(gk, 0)) AS goalkeeper_min, max(coalesce(gk, 0)) AS goalkeeper_max, avg(coalesce(ref, 0)) AS referee_avg, min(coalesce(ref, 0)) AS referee_min, max(coalesce(ref, 0)) AS referee_max,
  avg(coalesce(pl, 0)) AS player_avg, min(coalesce(pl, 0)) AS player_min, max(coalesce(pl, 0)) AS player_max FROM per GROUP BY match_id""", "ball_pct goalkeeper_avg referee_avg player_avg")  # fmt: skip
def _(t):
    others = t.detections.filter("class <> 'ball'")
    return detections.summary(detections.fuse(detections.best_ball(t.detections, detections.DetectionConfig(low_conf=0.5)), others), t.ev)


SIGN = f"sign({project_sql('1700.0', '540.0', 1.0)[0]} - {project_sql('200.0', '540.0', 1.0)[0]})"


@register("h01_orientation_sign", "homography_raw", f"SELECT match_id, frame_idx, ({SIGN})::INT AS sign FROM homography_raw")
def _(t):
    return homographies.orientation(t.homography_raw).select(*FRAME, "sign")


VOTE = f""", v AS (SELECT match_id, {SIGN} AS sign, coalesce(n_inliers, 1) AS w FROM homography_raw WHERE frame_idx % 50 = 0 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) <= 60),
ref AS (SELECT match_id, count(*) FILTER (sign <> 0) AS n_votes, coalesce(sum(w) FILTER (sign = 1), 0)::BIGINT AS plus, coalesce(sum(w) FILTER (sign = -1), 0)::BIGINT AS minus FROM v GROUP BY match_id)"""


@register("h02_orientation_vote", "homography_raw", VOTE + " --- SELECT match_id, n_votes, CASE WHEN n_votes >= 5 THEN CASE WHEN plus >= minus THEN 1 ELSE -1 END END AS reference_sign, CASE WHEN n_votes >= 5 THEN 100.0 * greatest(plus, minus) / nullif(plus + minus, 0) END AS agreement_pct, CASE WHEN n_votes < 5 THEN 'too few votes' WHEN 100.0 * greatest(plus, minus) / nullif(plus + minus, 0) < 70 THEN 'weak' ELSE 'ok' END AS status FROM ref", "agreement_pct")
def _(t):
    return homographies.calibrate(t.homography_raw)


@register("h03_enforce_orientation", "homography_raw", VOTE + f""", j AS (SELECT h.*, coalesce({SIGN} <> 0 AND {SIGN} <> CASE WHEN plus >= minus THEN 1 ELSE -1 END, false) AS mirrored FROM homography_raw h JOIN ref USING (match_id))
  --- SELECT match_id, frame_idx, CASE WHEN mirrored THEN -h0 + 1050 * h6 ELSE h0 END AS h0, CASE WHEN mirrored THEN -h2 + 1050 * h8 ELSE h2 END AS h2, h4, mirrored FROM j""", "h0 h2 h4")  # fmt: skip
def _(t):
    return homographies.enforce(t.homography_raw, homographies.calibrate(t.homography_raw)).select(*FRAME, "h0", "h2", "h4", "mirrored")


def _smooth_sql() -> str:
    """The recurrence frame by frame, with the inverse by cofactors (its scale doesn't move a projected point)."""
    h = "[" + ", ".join(f"h{i}" for i in range(9)) + "]"
    turned = lambda m: "[" + ", ".join(f"{m}[{a}] * {m}[{b}] - {m}[{c}] * {m}[{d}]" for a, b, c, d in ((5, 9, 6, 8), (3, 8, 2, 9), (2, 6, 3, 5), (6, 7, 4, 9), (1, 9, 3, 7), (3, 4, 1, 6), (4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4))) + "]"
    singular = lambda m, t: f"{m}[1] * {t}[1] + {m}[2] * {t}[4] + {m}[3] * {t}[7] = 0"
    at = lambda t, i: f"({t}[{i}] * k.x + {t}[{i + 1}] * k.y + {t}[{i + 2}]) / ({t}[7] * k.x + {t}[8] * k.y + {t}[9])"
    off = "list_median(list_transform(points, lambda k: sqrt(power({} - {}, 2) + power({} - {}, 2))))".format(at("a", 1), at("b", 1), at("a", 4), at("b", 4))
    points = ", ".join(f"{{'x': {x * 10:.2f}::DOUBLE, 'y': {y * 10:.2f}::DOUBLE}}" for x, y in homographies.KEY_POINTS)
    return f""", z AS (SELECT match_id, frame_idx, tag, CASE WHEN h0 IS NOT NULL THEN {h} END AS h, coalesce(least(1.0, n_inliers / 15.0), 1.0)::DOUBLE AS conf, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS n, [{points}] AS points FROM homography_raw),
s(match_id, frame_idx, n, m, jump) AS (
  SELECT match_id, frame_idx, n, CASE WHEN tag = 'anchor' THEN h END, false FROM z WHERE n = 1
  UNION ALL SELECT r.match_id, r.frame_idx, r.n,
    CASE WHEN h IS NULL THEN m WHEN m IS NULL THEN CASE WHEN tag = 'anchor' THEN h END
      ELSE list_transform(range(1, 10), lambda i: least(greatest(alpha, 0.05), 0.9) * h[i] + (1 - least(greatest(alpha, 0.05), 0.9)) * m[i]) END, r.jump
  FROM (SELECT *, CASE WHEN jump THEN greatest(0.3 * conf, 0.8) ELSE 0.3 * conf END::DOUBLE AS alpha FROM (
    SELECT *, h IS NOT NULL AND m IS NOT NULL AND conf >= 0.5 AND (CASE WHEN {singular("h", "a")} OR {singular("m", "b")} THEN 'inf'::DOUBLE ELSE {off} END) > 25 AS jump FROM (
      SELECT z.*, s.m, {turned("z.h")} AS a, {turned("s.m")} AS b FROM s JOIN z ON z.match_id = s.match_id AND z.n = s.n + 1) p) q) r)"""


SMOOTH = _smooth_sql()
SMOOTHED = ", ".join(f"m[{i + 1}] AS h{i}" for i in range(9))


@register("h04_smooth", "homography_raw", SMOOTH + f" --- SELECT match_id, frame_idx, {SMOOTHED}, jump FROM s", " ".join(f"h{i}" for i in range(9)))
def _(t):
    return homographies.smooth(t.homography_raw)


@register("h05_jumps", "homography_raw", SMOOTH + " --- SELECT match_id, frame_idx FROM s WHERE jump")
def _(t):
    return homographies.smooth(t.homography_raw).filter("jump").select(*FRAME)


@register("h06_coverage", "homography_raw", SMOOTH + """, raw AS (SELECT match_id, count(*) AS n_frames, count(h0) AS n_valid FROM homography_raw GROUP BY match_id)
  --- SELECT match_id, any_value(n_frames) AS n_frames, any_value(n_valid) AS n_valid, count(m) AS n_covered, count(*) FILTER (jump) AS n_jumps FROM s JOIN raw USING (match_id) GROUP BY match_id""")
def _(t):
    return homographies.coverage(t.homography_raw, homographies.smooth(t.homography_raw))



@register("l01_crowding", "tracks track_role", """, p AS (SELECT match_id, frame_idx, track_id, trunc((x1 + x2) / 2)::INT AS fx, trunc(y2)::INT AS fy FROM tracks JOIN track_role USING (match_id, track_id) WHERE role IN ('player', 'goalkeeper')),
  c AS (SELECT a.match_id, a.frame_idx, a.track_id, count(*) FILTER (a.track_id <> b.track_id AND pow(a.fx - b.fx, 2) + pow(a.fy - b.fy, 2) <= 2025) AS n FROM p a JOIN p b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx GROUP BY ALL)
  --- SELECT match_id, track_id, sum(n)::BIGINT AS n_near, max(n) AS n_max, count(*) FILTER (n >= 3) AS n_compact FROM c GROUP BY ALL""")
def _(t):
    c = detections.crowding(t.tracks, t.track_role)
    return c.groupBy("match_id", "track_id").agg(F.sum("n_near").alias("n_near"), F.max("n_near").alias("n_max"), F.count_if("compact").alias("n_compact"))
