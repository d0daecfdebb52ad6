"""Tracklets, identities, teams."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from matchloom.operators import assignment, detections, teams, tracklets
from matchloom.plans.registry import iou_sql, project_sql, register
from matchloom.sources import io

FRAME = detections.FRAME
ISLANDS = """, r AS (SELECT *, CASE WHEN frame_idx <> lag(frame_idx) OVER w + 1 THEN 1 ELSE 0 END AS new FROM raw_tracks WINDOW w AS (PARTITION BY match_id, raw_track_id ORDER BY frame_idx)),
parts AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY match_id, raw_track_id ORDER BY frame_idx)::BIGINT AS part FROM r),
lets AS (SELECT *, raw_track_id * 1000 + part AS tracklet_id FROM parts),
votes AS (SELECT match_id, tracklet_id, class, count(*) AS n FROM lets GROUP BY ALL),
major AS (SELECT match_id, tracklet_id, class FROM votes QUALIFY row_number() OVER (PARTITION BY match_id, tracklet_id ORDER BY n DESC, class) = 1),
rows AS (SELECT l.* EXCLUDE (class), m.class FROM lets l JOIN major m USING (match_id, tracklet_id))"""


def lets(t):
    rows = tracklets.initial_tracklets(t.raw_tracks)
    return rows.withColumn("tracklet_id", F.col("raw_track_id") * 1000 + F.col("part"))


def rows(t):
    """Tracklet rows with the class of the tracklet."""
    r = lets(t)
    return r.drop("class").join(tracklets.majority_class(r, ["match_id", "tracklet_id"]), ["match_id", "tracklet_id"])


@register("k01_initial_tracklets", "raw_tracks", ISLANDS + " --- SELECT match_id, tracklet_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n FROM lets GROUP BY ALL")
def _(t):
    return lets(t).groupBy("match_id", "tracklet_id").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n"))


@register("k02_majority_class", "raw_tracks", ISLANDS + " --- SELECT match_id, tracklet_id, class FROM major")
def _(t):
    return tracklets.majority_class(lets(t), ["match_id", "tracklet_id"])


CONTACTS = ISLANDS + f""", touch AS (SELECT a.match_id, a.tracklet_id AS a, b.tracklet_id AS b, a.frame_idx, a.class FROM rows a JOIN rows b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.class = b.class AND a.tracklet_id < b.tracklet_id WHERE {iou_sql()} >= 0.3),
run0 AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY match_id, a, b ORDER BY frame_idx) > 1 THEN 1 ELSE 0 END AS new FROM touch),
run1 AS (SELECT *, sum(new) OVER (PARTITION BY match_id, a, b ORDER BY frame_idx) AS run FROM run0),
runs AS (SELECT match_id, a, b, run::BIGINT AS run, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM run1 GROUP BY ALL),
cuts AS (SELECT DISTINCT match_id, tracklet_id, cut_frame FROM (SELECT match_id, unnest([a, a, b, b]) AS tracklet_id, unnest([first_frame - 1, last_frame, first_frame - 1, last_frame]) AS cut_frame FROM runs)),
chunks AS (SELECT r.*, coalesce(sum((c.cut_frame IS NOT NULL)::INT) OVER (PARTITION BY r.match_id, r.tracklet_id ORDER BY r.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM rows r LEFT JOIN cuts c ON c.match_id = r.match_id AND c.tracklet_id = r.tracklet_id AND c.cut_frame = r.frame_idx)"""


@register("k03_contacts", "raw_tracks", CONTACTS + " --- SELECT * FROM touch")
def _(t):
    return tracklets.contacts(rows(t))


@register("k04_contact_runs", "raw_tracks", CONTACTS + " --- SELECT * FROM runs")
def _(t):
    return tracklets.contact_runs(tracklets.contacts(rows(t)))


@register("k05_split_points", "raw_tracks", CONTACTS + " --- SELECT * FROM cuts")
def _(t):
    return tracklets.split_points(tracklets.contact_runs(tracklets.contacts(rows(t))))


def chunks(t):
    r = rows(t)
    return tracklets.apply_splits(r, tracklets.split_points(tracklets.contact_runs(tracklets.contacts(r))))


@register("k06_apply_splits", "raw_tracks", CONTACTS + " --- SELECT match_id, tracklet_id, chunk, count(*) AS n, min(frame_idx) AS start_frame FROM chunks GROUP BY ALL")
def _(t):
    return chunks(t).groupBy("match_id", "tracklet_id", "chunk").agg(F.count("*").alias("n"), F.min("frame_idx").alias("start_frame"))


KEPT = CONTACTS + """, kept AS (SELECT * EXCLUDE (tracklet_id), tracklet_id * 100 + chunk AS tracklet_id FROM (SELECT *, count(*) OVER (PARTITION BY match_id, tracklet_id, chunk) AS n FROM chunks) WHERE n >= 20)"""


def kept(t):
    return tracklets.drop_short(chunks(t), ["match_id", "tracklet_id", "chunk"]).withColumn("tracklet_id", F.col("tracklet_id") * 100 + F.col("chunk"))


@register("k07_drop_short", "raw_tracks", KEPT + " --- SELECT match_id, tracklet_id, count(*) AS n FROM kept GROUP BY ALL")
def _(t):
    return kept(t).groupBy("match_id", "tracklet_id").agg(F.count("*").alias("n"))


FEATURES = KEPT + """, e AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY match_id, tracklet_id ORDER BY frame_idx) <= 8 AS head, row_number() OVER (PARTITION BY match_id, tracklet_id ORDER BY frame_idx DESC) <= 8 AS tail FROM kept),
motion AS (SELECT match_id, tracklet_id, any_value(class) AS class, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, min_by(cx, frame_idx) AS head_x, min_by(cy, frame_idx) AS head_y, max_by(cx, frame_idx) AS tail_x, max_by(cy, frame_idx) AS tail_y,
  regr_slope(cx, frame_idx::DOUBLE) FILTER (head) AS head_vx, regr_slope(cy, frame_idx::DOUBLE) FILTER (head) AS head_vy, regr_slope(cx, frame_idx::DOUBLE) FILTER (tail) AS tail_vx, regr_slope(cy, frame_idx::DOUBLE) FILTER (tail) AS tail_vy FROM e GROUP BY match_id, tracklet_id),
vec AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
mean AS (SELECT match_id, tracklet_id, pos, avg(v) FILTER (head) AS h, avg(v) FILTER (tail) AS t FROM e JOIN vec USING (vec_id) GROUP BY ALL)"""


def features(t):
    keys = ["match_id", "tracklet_id"]
    r = io.materialize(kept(t), "tracklet-rows")
    motion = tracklets.motion_features(r, keys)
    vectors = tracklets.mean_vectors(r, keys, t.file("embeddings").select("vec_id", "embedding"))
    return motion.join(vectors, keys, "left").join(r.select(*keys, "class").distinct(), keys)


@register("k08_motion_features", "raw_tracks", FEATURES + " --- SELECT * EXCLUDE (class) FROM motion", "head_x head_y tail_x tail_y head_vx head_vy tail_vx tail_vy")
def _(t):
    return tracklets.motion_features(kept(t), ["match_id", "tracklet_id"])


@register("k08_mean_vectors", "raw_tracks", FEATURES + " --- SELECT match_id, tracklet_id, sum(h * h) AS head2, sum(t * t) AS tail2, sum(h * t) AS dot FROM mean GROUP BY ALL", "head2 tail2 dot")
def _(t):
    from matchloom.functions.geometry import dot

    v = tracklets.mean_vectors(kept(t), ["match_id", "tracklet_id"], t.file("embeddings").select("vec_id", "embedding"))
    h, u = F.col("head_emb"), F.col("tail_emb")
    return v.select("match_id", "tracklet_id", dot(h, h).alias("head2"), dot(u, u).alias("tail2"), dot(h, u).alias("dot"))


LINKS = FEATURES + """, pairs AS (SELECT a.match_id, a.class, a.tracklet_id AS i, b.tracklet_id AS j, b.start_frame - a.end_frame AS gap, a.tail_x + coalesce(a.tail_vx, 0) * (b.start_frame - a.end_frame) - b.head_x AS dx, a.tail_y + coalesce(a.tail_vy, 0) * (b.start_frame - a.end_frame) - b.head_y AS dy
  FROM motion a JOIN motion b ON a.match_id = b.match_id AND a.class = b.class AND a.tracklet_id <> b.tracklet_id AND b.start_frame - a.end_frame BETWEEN 1 AND 500),
alike AS (SELECT p.match_id, i, j, sum(x.t * y.h) AS s FROM pairs p JOIN mean x ON x.match_id = p.match_id AND x.tracklet_id = p.i JOIN mean y ON y.match_id = p.match_id AND y.tracklet_id = p.j AND x.pos = y.pos GROUP BY ALL),
links AS (SELECT p.match_id, p.class, p.i, p.j, coalesce(s, 0) - 0.3 * least(sqrt(dx * dx + dy * dy) / 300, 1) AS score FROM pairs p LEFT JOIN alike a ON a.match_id = p.match_id AND a.i = p.i AND a.j = p.j)"""


@register("k09_link_candidates", "raw_tracks", LINKS + " --- SELECT * FROM links WHERE score >= 0.3", "score")
def _(t):
    return tracklets.link_candidates(features(t))


def linked(t):
    """Tracklets and their priced candidates, written once for an application and directory; later queries read them."""
    base = f"{io.shared_folder(t.spark)}/matchloom/links-{t.spark.sparkContext.applicationId}-{zlib.crc32(t.sf_dir.encode())}"
    lets = io.load_or_build(t.spark, [f"{base}-tracklets"], lambda: [features(t)])[0]
    priced = io.load_or_build(t.spark, [f"{base}-priced"], lambda: [tracklets.priced_links(io.materialize(tracklets.link_candidates(lets), "links"))])[0]
    return lets, priced


def chains(t):
    lets, priced = linked(t)
    return tracklets.identities(lets, priced.filter("chosen").select("match_id", "i", "j", "score"))


@register("k10_best_links")
def _(t):
    return linked(t)[1].filter("chosen").select("match_id", "i", "j", "score")


#: What DuckDB knows of the candidates, and zeros: no price too low, none negative, no end with two links, no gap between both sums.
@register("k10_certificate", "raw_tracks", LINKS + """, c AS (SELECT * FROM links WHERE score >= 0.3),
tally AS (SELECT match_id, class, count(*) AS n_candidates, sum(score) AS all_scores, count(DISTINCT i) + count(DISTINCT j) AS n_ends FROM c GROUP BY ALL)
  --- SELECT match_id, class, n_candidates, n_ends, all_scores, 0::BIGINT AS n_cheap, 0::BIGINT AS n_negative, 0::BIGINT AS n_shared, 0.0::DOUBLE AS gap FROM tally""", "all_scores gap", 5)
def _(t):
    return assignment.certificate(linked(t)[1]).drop("n_links")


@register("k11_identity_chains")
def _(t):
    return chains(t).groupBy("match_id", "track_id").agg(F.count("*").alias("n"))


@register("k12_track_numbers")
def _(t):
    return chains(t).select("match_id", "tracklet_id", "track_id", "class")


@register("k13_identity_report")
def _(t):
    return tracklets.identity_report(chains(t))


#: Chains over links that SQL can choose too; a recursive walk from each tracklet without a predecessor.
CHAINS = LINKS + """, c AS (SELECT * FROM links WHERE score >= 0.3),
m AS (SELECT match_id, i, j FROM c QUALIFY row_number() OVER (PARTITION BY match_id, class, i ORDER BY round(score, 9) DESC, j) = 1 AND row_number() OVER (PARTITION BY match_id, class, j ORDER BY round(score, 9) DESC, i) = 1),
k(match_id, head, tracklet_id) AS (SELECT match_id, tracklet_id, tracklet_id FROM motion f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.match_id = f.match_id AND m.j = f.tracklet_id)
  UNION ALL SELECT r.match_id, r.head, m.j FROM k r JOIN m ON m.match_id = r.match_id AND m.i = r.tracklet_id),
ids AS (SELECT k.match_id, k.tracklet_id, k.head, dense_rank() OVER (PARTITION BY k.match_id ORDER BY f.start_frame, k.head) AS track_id, f.class FROM k JOIN motion f ON f.match_id = k.match_id AND f.tracklet_id = k.head),
n AS (SELECT match_id, track_id, count(*) AS n, any_value(class) AS class FROM ids GROUP BY ALL)"""


def mutual_chains(t):
    lets = linked(t)[0]
    return tracklets.identities(lets, tracklets.mutual_links(tracklets.link_candidates(lets)))


@register("k11_chains_of_mutual_links", "raw_tracks", CHAINS + " --- SELECT match_id, tracklet_id, head FROM ids")
def _(t):
    return mutual_chains(t).select("match_id", "tracklet_id", "head")


@register("k12_numbers_of_mutual_links", "raw_tracks", CHAINS + " --- SELECT match_id, tracklet_id, track_id, class FROM ids")
def _(t):
    return mutual_chains(t).select("match_id", "tracklet_id", "track_id", "class")


@register("k13_report_of_mutual_links", "raw_tracks", CHAINS + """ --- SELECT match_id, count(*) FILTER (n = 1) AS chains_1, count(*) FILTER (n = 2) AS chains_2, count(*) FILTER (n >= 3) AS chains_3,
  count(*) FILTER (class = 'player') AS n_player, count(*) FILTER (class = 'goalkeeper') AS n_goalkeeper, count(*) FILTER (class = 'referee') AS n_referee, count(*) FILTER (class = 'goalkeeper') > 2 AS over_goalkeeper, count(*) FILTER (class = 'referee') > 3 AS over_referee FROM n GROUP BY match_id""")
def _(t):
    return tracklets.identity_report(mutual_chains(t))


@register("k14_attach_ball", "detections", """, b AS (SELECT match_id, frame_idx, min_by(x1, det_id) AS bx, min_by(conf, det_id) AS bc FROM detections WHERE class = 'ball' GROUP BY ALL)
  --- SELECT match_id, track_id, count(*) AS n, count(bx) AS n_ball, min(bx) AS lo, sum(bc) AS conf FROM tracks LEFT JOIN b USING (match_id, frame_idx) GROUP BY match_id, track_id""", "lo conf")
def _(t):
    a = tracklets.attach_ball(t.tracks, t.detections)
    return a.groupBy("match_id", "track_id").agg(F.count("*").alias("n"), F.count("ball_x1").alias("n_ball"), F.min("ball_x1").alias("lo"), F.sum("ball_conf").alias("conf"))


@register("k15_drop_ghosts", "tracks", "SELECT match_id, track_id, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) >= 300")
def _(t):
    return tracklets.drop_ghosts(t.tracks).groupBy("match_id", "track_id").agg(F.count("*").alias("n"))


@register("k16_lock_classes", "tracks", """, v AS (SELECT match_id, track_id, class, count(*) AS n, min(frame_idx) AS seen FROM tracks GROUP BY ALL),
  s AS (SELECT match_id, track_id, sum(n) AS total, coalesce(sum(n) FILTER (class = 'referee'), 0) AS ref, coalesce(sum(n) FILTER (class = 'goalkeeper'), 0) AS gk, first(class ORDER BY n DESC, seen) AS major FROM v GROUP BY ALL)
  --- SELECT match_id, track_id, CASE WHEN ref >= 10 AND ref / total >= 0.02 THEN 'referee' WHEN gk >= 10 AND gk / total >= 0.02 THEN 'goalkeeper' ELSE major END AS role FROM s""")
def _(t):
    return tracklets.lock_classes(t.tracks)


def vectors(t):
    """Track rows with their embeddings, where there is one."""
    return t.track_vectors.join(t.file("embeddings").select("vec_id", "embedding"), "vec_id")


@register("a01_calibration_sample", "track_vectors track_role", """, used AS (SELECT v.* FROM track_vectors v JOIN track_role r ON r.match_id = v.match_id AND r.track_id = v.track_id AND r.role = 'player' WHERE frame_idx % 15 = 0 AND vec_id IS NOT NULL)
  --- SELECT match_id, frame_idx, track_id FROM used QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY md5('42:' || match_id || ':' || frame_idx || ':' || track_id), frame_idx, track_id) <= 6000""")
def _(t):
    return teams.calibration_sample(t.track_vectors, t.track_role).select(*FRAME, "track_id")


@register("a02_standardise", "ball_frame", """, z AS (SELECT match_id, frame_idx, (ball_pitch_x - avg(ball_pitch_x) OVER w) / CASE WHEN stddev_pop(ball_pitch_x) OVER w > 0 THEN stddev_pop(ball_pitch_x) OVER w ELSE 1 END AS x, (ball_pitch_y - avg(ball_pitch_y) OVER w) / CASE WHEN stddev_pop(ball_pitch_y) OVER w > 0 THEN stddev_pop(ball_pitch_y) OVER w ELSE 1 END AS y
  FROM ball_frame WHERE ball_pitch_x IS NOT NULL WINDOW w AS (PARTITION BY match_id)) --- SELECT match_id, frame_idx, x, y FROM z""", "x y")
def _(t):
    z = teams.standardise(t.ball_frame.filter("ball_pitch_x is not null"), ["ball_pitch_x", "ball_pitch_y"])
    return z.select(*FRAME, F.col("ball_pitch_x_z").alias("x"), F.col("ball_pitch_y_z").alias("y"))


def clusters(t):
    sample = teams.calibration_sample(t.track_vectors, t.track_role).join(t.file("embeddings").select("vec_id", "embedding"), "vec_id")
    return io.materialize(teams.calibrate(sample), "kits")


@register("a03_kit_clusters")
def _(t):
    return clusters(t).select("match_id", "team", "n", F.size("centre").alias("width"))


@register("a04_silhouette")
def _(t):
    return clusters(t).select("match_id", "silhouette", "band").distinct()


@register("a05_classify_kits")
def _(t):
    return teams.classify(vectors(t), clusters(t), t.track_role)


@register("a03_pooled_clusters")
def _(t):
    """One pair of kits over all matches: the sample of each, clustered together."""
    sample = teams.calibration_sample(t.track_vectors, t.track_role).join(t.file("embeddings").select("vec_id", "embedding"), "vec_id")
    rows, found = teams.pooled_clusters(io.materialize(sample.select(*FRAME, "track_id", "embedding"), "kit-sample"))
    return rows.groupBy("match_id", "team").agg(F.count("*").alias("n_here")).join(found.select("team", "n"), "team").select("match_id", "team", "n_here", "n")


#: Moments of each team's vectors by place; the teams are given, so that SQL has the same labels.
@register("a04_squared_silhouette", "track_vectors track_team", """, v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS len2 FROM embeddings),
u AS (SELECT match_id, team, vec_id, count(*) AS k FROM track_vectors JOIN track_team USING (match_id, track_id) WHERE vec_id IS NOT NULL GROUP BY ALL),
p AS (SELECT match_id, team, i, sum(k * x[i]) AS s FROM (SELECT u.*, x, unnest(range(1, len(x) + 1)) AS i FROM u JOIN v USING (vec_id)) q GROUP BY ALL),
c AS (SELECT match_id, team, list(s ORDER BY i) AS total FROM p GROUP BY ALL),
m AS (SELECT u.match_id, u.team, sum(k) AS n, sum(k * len2) AS sum2 FROM u JOIN v USING (vec_id) GROUP BY ALL),
d AS (SELECT u.match_id, u.team, u.vec_id, u.k, m.team AS other, m.n, (m.sum2 + m.n * v.len2 - 2 * list_dot_product(v.x, c.total)) / nullif(m.n - (m.team = u.team)::INT, 0) AS dist FROM u JOIN v USING (vec_id) JOIN m ON m.match_id = u.match_id JOIN c ON c.match_id = m.match_id AND c.team = m.team),
s AS (SELECT match_id, team, vec_id, k, greatest(max(dist) FILTER (other = team), 0) AS a, greatest(min(dist) FILTER (other <> team), 0) AS b, max(n) FILTER (other = team) AS own FROM d GROUP BY ALL)
  --- SELECT match_id, sum(k)::BIGINT AS n, sum(k * CASE WHEN own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(k) AS silhouette FROM s GROUP BY match_id""", "silhouette")
def _(t):
    used = t.track_vectors.filter("vec_id is not null").join(t.track_team, ["match_id", "track_id"]).groupBy("match_id", "team", "vec_id").agg(F.count("*").alias("k"))
    return teams.squared_silhouette(used.join(t.file("embeddings").select("vec_id", "embedding"), "vec_id"), ["match_id"], "k")


#: Clusters that SQL can make too: the centres are two of the vectors, the scales go from 1 to 3.
@register("a05_classify_given_kits", "track_vectors track_role", """, e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
kit AS (SELECT DISTINCT t.match_id, (t.match_id * 31 + 5) % n.n AS p, (t.match_id * 31 + 12) % n.n AS q FROM track_vectors t, n),
used AS (SELECT t.match_id, t.frame_idx, t.track_id, e.x, p.x AS p, q.x AS q FROM track_vectors t JOIN track_role r ON r.match_id = t.match_id AND r.track_id = t.track_id AND r.role = 'player' JOIN e USING (vec_id) JOIN kit ON kit.match_id = t.match_id JOIN e p ON p.vec_id = kit.p JOIN e q ON q.vec_id = kit.q WHERE t.frame_idx % 8 = 0),
off AS (SELECT match_id, frame_idx, track_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: power((x[i] - 0.01 * i) / (1 + i % 3) - p[i], 2))) AS a, list_sum(list_transform(range(1, len(x) + 1), lambda i: power((x[i] - 0.01 * i) / (1 + i % 3) - q[i], 2))) AS b FROM used)
  --- SELECT match_id, frame_idx, track_id, CASE WHEN b < a THEN 1 ELSE 0 END AS team FROM off""")
def _(t):
    e = t.file("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("centre"))
    n = t.vectors
    at = F.inline(F.array(*(F.struct(F.lit(k).alias("team"), ((F.col("match_id") * 31 + shift) % F.col("n")).alias("vec_id")) for k, shift in enumerate((5, 12)))))
    kits = t.ev.select("match_id").distinct().crossJoin(F.broadcast(n)).select("match_id", at).join(e, "vec_id")
    place = F.sequence(F.lit(1), F.size("centre"))
    kits = kits.withColumns({"mean": F.transform(place, lambda i: i * F.lit(0.01)), "scale": F.transform(place, lambda i: (1 + i % 3).cast("double"))})
    return teams.classify(vectors(t), kits, t.track_role)


VOTES = """, c AS (SELECT match_id, frame_idx, track_id, CASE WHEN (frame_idx + track_id) % 3 = 0 THEN 1 - team ELSE team END AS team FROM tracks JOIN track_team USING (match_id, track_id) WHERE frame_idx % 8 = 0 AND track_id NOT IN (11, 22)),
v AS (SELECT match_id, track_id, team, count(*) AS votes, min(frame_idx) AS seen FROM c GROUP BY ALL),
locked AS (SELECT match_id, track_id, first(team ORDER BY votes DESC, seen) AS team, max(votes) / sum(votes) AS majority_frac FROM v GROUP BY ALL)"""


def votes(t):
    seen = t.tracks.filter("frame_idx % 8 = 0 and track_id not in (11, 22)").join(t.track_team, ["match_id", "track_id"])
    return seen.select(*FRAME, "track_id", F.expr("case when (frame_idx + track_id) % 3 = 0 then 1 - team else team end").alias("team"))


@register("a06_lock_teams", "tracks track_team", VOTES + " --- SELECT match_id, track_id, team, majority_frac, majority_frac < 0.7 AS is_weak, count(*) OVER (PARTITION BY match_id, team) AS team_players FROM locked", "majority_frac")
def _(t):
    return teams.lock_teams(votes(t))


TX, TY = project_sql("((x1 + x2) / 2)", "y2")
PLACES = f""", pos AS (SELECT match_id, frame_idx, track_id, {TX} AS pitch_x, {TY} AS pitch_y FROM tracks JOIN homography USING (match_id, frame_idx) WHERE frame_idx % 10 = 0 AND h0 IS NOT NULL),
cen AS (SELECT match_id, team, avg(pitch_x) AS cx, avg(pitch_y) AS cy FROM pos JOIN track_team USING (match_id, track_id) WHERE track_id NOT IN (11, 22) GROUP BY ALL),
mean AS (SELECT match_id, track_id, avg(pitch_x) AS x, avg(pitch_y) AS y FROM pos WHERE track_id IN (11, 22) GROUP BY ALL),
gk AS (SELECT m.match_id, m.track_id, CASE WHEN sqrt(pow(x - c0.cx, 2) + pow(y - c0.cy, 2)) < sqrt(pow(x - c1.cx, 2) + pow(y - c1.cy, 2)) THEN 0 ELSE 1 END AS team FROM mean m JOIN cen c0 ON c0.match_id = m.match_id AND c0.team = 0 JOIN cen c1 ON c1.match_id = m.match_id AND c1.team = 1)"""


@register("a07_sampled_positions", "tracks homography track_team", PLACES + " --- SELECT * FROM pos", "pitch_x pitch_y")
def _(t):
    return teams.sampled_positions(t.tracks, t.homography)


def centroids(t):
    return teams.team_centroids(teams.sampled_positions(t.tracks, t.homography), t.track_team.filter("track_id not in (11, 22)"))


@register("a08_team_centroids", "tracks homography track_team", PLACES + " --- SELECT * FROM cen", "cx cy")
def _(t):
    return centroids(t)


def keepers(t):
    return teams.goalkeeper_teams(teams.sampled_positions(t.tracks, t.homography), t.track_role, centroids(t))


@register("a09_goalkeeper_teams", "tracks homography track_team", PLACES + " --- SELECT * FROM gk")
def _(t):
    return keepers(t)


@register("a10_merge_teams", "tracks homography track_team", VOTES + PLACES + " --- SELECT match_id, track_id, team FROM locked WHERE track_id NOT IN (11, 22) UNION ALL SELECT * FROM gk")
def _(t):
    return teams.merge_teams(teams.lock_teams(votes(t)), keepers(t))
