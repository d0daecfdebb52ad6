"""Football tables derived from the driver's ``events`` and ``embeddings`` by integer arithmetic.

The test tables hold no tracking data; these stand for the upstream outputs that the library reads.
Every table has the same definition as a DuckDB common table expression in ``SQL``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it needs, SQL that both engines run)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT event_id {div} 500 AS match_id, event_id % 500 AS frame_idx, user_id, event_type, value FROM events"),
    "ball_frame": (
        ("ev",),
        """SELECT match_id, frame_idx, ball_source, ball_pitch_x, ball_pitch_y, carrier_track_id, carrier_team,
        last_value(carrier_team IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS possession_team
        FROM (SELECT *, CASE WHEN carrier_track_id = 7 THEN NULL ELSE carrier_track_id % 2 END AS carrier_team
        FROM (SELECT match_id, frame_idx,
          CASE WHEN event_type = 'error' AND value > 60 THEN 'lost' WHEN event_type = 'signup' AND value > 40 THEN 'smoothed' ELSE 'detected' END AS ball_source,
          CASE WHEN event_type = 'error' AND value > 60 THEN NULL ELSE CAST((frame_idx * 3 + match_id * 11) % 1250 AS DOUBLE) / 10 - 8 END AS ball_pitch_x,
          CASE WHEN event_type = 'error' AND value > 60 THEN NULL ELSE CAST((frame_idx * 7 + match_id * 5) % 700 AS DOUBLE) / 10 - 1 END AS ball_pitch_y,
          CASE WHEN event_type = 'error' THEN NULL WHEN value < 2 THEN 1 + (user_id % 22)
            ELSE 1 + ((frame_idx {div} (9 + match_id % 7)) * 6 + ((frame_idx {div} (9 + match_id % 7)) {div} 4) * 5 + match_id * 3) % 22 END AS carrier_track_id
        FROM ev) x) y""",
    ),
    "player_frame": (
        ("ev", "ball_frame", "direction"),
        """SELECT p.match_id, p.frame_idx, p.track_id, role, p.team, pitch_x, pitch_y, coalesce(b.carrier_track_id = p.track_id, false) AS is_carrier, d.attack_direction
        FROM (SELECT match_id, frame_idx, track_id,
          CASE WHEN track_id IN (11, 22) THEN 'goalkeeper' WHEN track_id = 23 THEN 'referee' ELSE 'player' END AS role,
          CASE WHEN track_id IN (7, 23) THEN NULL ELSE track_id % 2 END AS team,
          CASE WHEN (frame_idx + track_id) % 37 = 0 THEN NULL WHEN track_id = 22 THEN 3 + CAST(frame_idx % 20 AS DOUBLE) / 10 WHEN track_id = 11 THEN 102 - CAST(frame_idx % 20 AS DOUBLE) / 10
            ELSE CAST((track_id * 47 + frame_idx * (1 + track_id % 3) + match_id * 13) % 1150 AS DOUBLE) / 10 - 4 END AS pitch_x,
          CASE WHEN (frame_idx + track_id) % 37 = 0 THEN NULL WHEN track_id IN (11, 22) THEN 34.0
            ELSE CAST((track_id * 31 + frame_idx * (1 + track_id % 2) + match_id * 7) % 760 AS DOUBLE) / 10 - 4 END AS pitch_y
        FROM (SELECT match_id, frame_idx, {explode(1, 23)} AS track_id FROM ev) t) p
        JOIN ball_frame b ON b.match_id = p.match_id AND b.frame_idx = p.frame_idx
        LEFT JOIN direction d ON d.match_id = p.match_id AND d.team = p.team""",
    ),
    "direction": (("ev",), "SELECT DISTINCT match_id, team, CASE WHEN team = 0 THEN 1 ELSE -1 END AS attack_direction FROM (SELECT match_id, {explode(0, 1)} AS team FROM ev) t"),
    "track_role": (("ev",), "SELECT DISTINCT match_id, track_id, CASE WHEN track_id IN (11, 22) THEN 'goalkeeper' WHEN track_id = 23 THEN 'referee' ELSE 'player' END AS role FROM (SELECT match_id, {explode(1, 23)} AS track_id FROM ev) t"),
    "track_team": (("ev",), "SELECT DISTINCT match_id, track_id, track_id % 2 AS team FROM (SELECT match_id, {explode(1, 22)} AS track_id FROM ev) t WHERE track_id <> 7"),
    "tracks": (
        ("ev",),
        """SELECT match_id, frame_idx, track_id, fx - 15 AS x1, fy - 70 AS y1, fx + 15 AS x2, fy AS y2, CAST(50 + (frame_idx * 7 + track_id * 13) % 50 AS DOUBLE) / 100 AS conf,
          CASE WHEN track_id = 23 THEN 'referee' WHEN track_id IN (11, 22) AND (frame_idx + track_id) % 9 <> 0 THEN 'goalkeeper' WHEN (frame_idx * track_id) % 97 = 1 THEN 'referee' ELSE 'player' END AS class
        FROM (SELECT match_id, frame_idx, track_id, CAST((track_id * 83 + frame_idx * (1 + track_id % 3) * 2 + match_id * 29) % 1900 AS DOUBLE) AS fx,
          CAST(200 + (track_id * 59 + frame_idx * (1 + track_id % 2) + match_id * 17) % 800 AS DOUBLE) AS fy
        FROM (SELECT match_id, frame_idx, {explode(1, 24)} AS track_id FROM ev) t WHERE (track_id < 24 OR frame_idx < 120) AND (frame_idx + match_id) % 89 <> 5) u""",
    ),
    "detections": (
        ("ev", "tracks"),
        """SELECT match_id, frame_idx, track_id * 10 AS det_id, x1, y1, x2, y2, conf, class, 'multi' AS source FROM tracks
        UNION ALL SELECT match_id, frame_idx, track_id * 10 + 1, x1 + 4, y1, x2 + 4, y2, conf - 0.1, class, 'multi' FROM tracks WHERE (track_id + frame_idx) % 5 = 0
        UNION ALL SELECT match_id, frame_idx, track_id * 10 + 2, x1 + 3, y1, x2 + 3, y2, conf - 0.2, 'player', 'multi' FROM tracks WHERE class = 'goalkeeper' AND (track_id + frame_idx) % 7 = 0
        UNION ALL SELECT match_id, frame_idx, 9000 + k, CAST((frame_idx * 13 + match_id * 7 + k * 40) % 1900 AS DOUBLE) - 6, CAST(200 + (frame_idx * 7 + match_id * 3) % 800 AS DOUBLE) - 6,
          CAST((frame_idx * 13 + match_id * 7 + k * 40) % 1900 AS DOUBLE) + 6, CAST(200 + (frame_idx * 7 + match_id * 3) % 800 AS DOUBLE) + 6,
          CAST((user_id * 7 + frame_idx * (1 + k)) % 100 AS DOUBLE) / 100, 'ball', CASE WHEN k = 2 THEN 'multi' ELSE 'ball_model' END
        FROM (SELECT match_id, frame_idx, user_id, event_type, {explode(0, 2)} AS k FROM ev) t WHERE event_type <> 'error' AND (k = 0 OR event_type = 'click')""",
    ),
    "homography": (
        ("ev",),
        """SELECT match_id, frame_idx, """
        + ", ".join(f"CAST(CASE WHEN frame_idx % 53 <> 0 THEN {v} END AS DOUBLE) AS h{i}" for i, v in enumerate(("CASE WHEN frame_idx % 101 = 7 THEN 2.2 ELSE 0.55 END", "0.02", "5.0 + match_id % 3", "0.01", "0.66", "-20.0", "0.00001", "0.00002", "1.0")))
        + " FROM ev",
    ),
    "homography_raw": (
        ("homography",),
        """SELECT match_id, frame_idx, CASE WHEN flip THEN -h0 + 1050 * h6 ELSE h0 END AS h0, CASE WHEN flip THEN -h1 + 1050 * h7 ELSE h1 END AS h1, CASE WHEN flip THEN -h2 + 1050 * h8 ELSE h2 END AS h2, h3, h4, h5, h6, h7, h8,
          CAST(CASE WHEN (frame_idx + match_id) % 4 = 0 THEN NULL ELSE (frame_idx * 7 + match_id) % 20 END AS INT) AS n_inliers,
          CASE WHEN frame_idx % 11 = 5 THEN 'unresolved' WHEN frame_idx % 13 = 3 THEN 'bootstrap' WHEN frame_idx % 17 = 2 THEN NULL ELSE 'anchor' END AS tag
        FROM (SELECT *, frame_idx % 10 = 0 AND frame_idx % 150 = 50 AS flip FROM homography) f""",
    ),
    "vectors": ((), "SELECT count(*) AS n FROM embeddings"),
    "raw_tracks": (
        ("tracks", "vectors"),
        """SELECT match_id, frame_idx, track_id * 100 + frame_idx {div} 120 AS raw_track_id, x1, y1, x2, y2, conf, class, (track_id * 7 + match_id * 31) % (SELECT max(n) FROM vectors) AS vec_id
        FROM tracks WHERE (frame_idx + track_id * 13) % 120 < 100""",
    ),
    "track_vectors": (("tracks", "vectors"), "SELECT match_id, frame_idx, track_id, CASE WHEN (frame_idx + track_id) % 19 <> 0 THEN (track_id * 7 + match_id * 31 + frame_idx % 3) % (SELECT max(n) FROM vectors) END AS vec_id FROM tracks"),
    "ball_px": (
        ("ev", "tracks"),
        """SELECT match_id, frame_idx, CASE WHEN lost THEN NULL ELSE at_x END AS x_px, CASE WHEN lost THEN NULL ELSE at_y END AS y_px,
          CASE WHEN lost THEN 'lost' WHEN event_type = 'signup' AND value > 40 THEN 'smoothed' ELSE 'detected' END AS source, CASE WHEN lost OR event_type = 'signup' AND value > 40 THEN NULL ELSE CAST((user_id * 7) % 100 AS DOUBLE) / 100 END AS conf
        FROM (SELECT e.match_id, e.frame_idx, e.user_id, e.event_type, e.value, e.gone OR t.track_id IS NULL AS lost, (t.x1 + t.x2) / 2 + (e.frame_idx % 9) * 5 - 20 AS at_x, t.y2 - 8 + (e.frame_idx % 4) * 4 AS at_y
          FROM (SELECT *, event_type = 'error' AND value > 60 AS gone, 1 + ((frame_idx {div} (9 + match_id % 7)) * 6 + match_id * 3) % 22 AS near FROM ev) e
          LEFT JOIN tracks t ON t.match_id = e.match_id AND t.frame_idx = e.frame_idx AND t.track_id = e.near) b""",
    ),
}


#: The same without the frames that ``tracks`` leaves out to make holes.
SQL["whole_tracks"] = (SQL["tracks"][0], SQL["tracks"][1].replace(" WHERE (track_id < 24 OR frame_idx < 120) AND (frame_idx + match_id) % 89 <> 5", " WHERE track_id < 24 OR frame_idx < 120"))
SQL["whole_detections"] = (("ev", "whole_tracks"), SQL["detections"][1].replace("FROM tracks", "FROM whole_tracks"))


#: Several rows a frame. Spark takes what comes out of a generator for as large as what goes in, and would broadcast such a table
#: where its few columns of ``events`` would do for that; the size of a product is that of both sides.
PER_FRAME = r"SELECT (match_id, frame_idx, (?:\w+, )*)\{explode\((\d+), (\d+)\)\} AS (\w+) FROM ev\b"


def _render(text: str, spark: bool) -> str:
    text = text.replace("{div}", "div" if spark else "//")
    if spark:
        text = text.replace("last_value(carrier_team IGNORE NULLS)", "last_value(carrier_team, true)")
        text = re.sub(PER_FRAME, lambda m: f"SELECT /*+ BROADCAST(each) */ {m[1]}{m[4]} FROM ev CROSS JOIN (SELECT id AS {m[4]} FROM range({m[2]}, {int(m[3]) + 1}, 1, 1)) each", text)
    for lo, hi in ((1, 22), (1, 23), (1, 24), (0, 1), (0, 2)):
        call = f"explode(sequence({lo}L, {hi}L))" if spark else f"unnest(generate_series({lo}, {hi}))"
        text = text.replace("{explode(%d, %d)}" % (lo, hi), call)
    return text


def _needs(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*_needs(SQL[n][0]), n):
            if x not in out:
                out.append(x)
    return out


def oracle(names: str, body: str) -> str:
    """DuckDB text: the common table expressions that ``names`` need, then ``body``. Each is computed
    once, as chains of them would else be computed again at every use."""
    ctes = [f"{n} AS ({_render(SQL[n][1], False)})" for n in _needs(names.split())]
    text = f"WITH {'RECURSIVE ' if ' UNION ALL SELECT r.' in body else ''}{', '.join(ctes)}{body if body.lstrip().startswith(',') else chr(10) + body}"
    return re.sub(r"(\b\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame; its inputs are common table expressions of the same query."""
    ctes = {n: _render(SQL[n][1], True) for n in _needs([name])}
    ctes["ev"] = ctes["ev"].replace("FROM events", "FROM {events}") if "ev" in ctes else ""
    if "vectors" in ctes:
        ctes["vectors"] = ctes["vectors"].replace("FROM embeddings", "FROM {embeddings}")
    text = ", ".join(f"{n} AS ({q})" for n, q in ctes.items() if q)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings") if f"{{{t}}}" in text}
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **tables)
