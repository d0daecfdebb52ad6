"""One run through all stages: raw tracks, identities, roles and teams, ball and carrier, frame tables, passes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.geometry import centre
from matchloom.operators import ball, carrier, detections, frames, homographies, passes, teams, tracklets
from matchloom.plans import tracking_queries
from matchloom.plans.registry import register
from matchloom.sources import io

FRAME, BOX = detections.FRAME, detections.BOX


def tracks_of(t, least: int = tracklets.TrackingConfig.min_track_rows) -> DataFrame:
    """Tracklet rows under the numbers of their identities; short identities are left out."""
    ids = tracking_queries.chains(t).select("match_id", "tracklet_id", "track_id")
    rows = tracking_queries.kept(t).join(ids, ["match_id", "tracklet_id"]).select(*FRAME, "track_id", *BOX, "conf", "class", "vec_id")
    return tracklets.drop_ghosts(rows, least)


def teams_of(t, tracks: DataFrame, roles: DataFrame, homography: DataFrame) -> DataFrame:
    vectors = t.file("embeddings").select("vec_id", "embedding")
    kits = io.materialize(teams.calibrate(teams.calibration_sample(tracks, roles).join(vectors, "vec_id")), "run-kits")
    players = teams.lock_teams(teams.classify(tracks.join(vectors, "vec_id"), kits, roles)).select("match_id", "track_id", "team")
    places = teams.sampled_positions(tracks, homography)
    return teams.merge_teams(players, teams.goalkeeper_teams(places, roles, teams.team_centroids(places, players)))


def run(t, least: int = tracklets.TrackingConfig.min_track_rows, folder: str | None = None) -> dict[str, DataFrame]:
    """All tables of a run; each stage reads what the one before has written. Frame tables are partitioned by match."""
    folder = folder or f"{io.shared_folder(t.spark)}/matchloom/run-{uuid.uuid4().hex}"

    def stage(name: str, df: DataFrame, partition_by=()) -> DataFrame:
        io.write(df, f"{folder}/{name}", partition_by)
        return io.read(t.spark, f"{folder}/{name}", df.schema)

    tracks = stage("tracks", tracks_of(t, least))
    roles = stage("roles", tracklets.lock_classes(tracks))
    homography = stage("homography", homographies.smooth(homographies.enforce(t.homography_raw, homographies.calibrate(t.homography_raw))))
    sides = stage("teams", teams_of(t, tracks, roles, homography))
    cx, cy = centre()
    people = tracks.join(roles.filter("role <> 'referee'"), ["match_id", "track_id"]).select(*FRAME, cx.alias("x"), cy.alias("y"))
    tracked = stage("ball", ball.track_ball(t.ev.select(*FRAME), ball.candidates(t.detections), people, homography))
    held = stage("carrier", carrier.assign_carrier(carrier.decisions(t.ev, tracked, tracks, roles, homography)))
    players = frames.drop_implausible(frames.player_frames(tracks, roles, sides, homography, held))
    players = stage("player_frames", frames.attach_direction(players, frames.attack_directions(players)), ["match_id"])
    balls = stage("ball_frames", frames.fill_possession(frames.ball_frames(t.ev, tracked, held, sides)), ["match_id"])
    events = stage("passes", passes.pass_events(balls, sides, passes.PassConfig(max_gap_frames=frames.POSSESSION_GAP)))
    return {"tracks": tracks, "roles": roles, "homography": homography, "teams": sides, "ball": tracked, "carrier": held, "player_frames": players, "ball_frames": balls, "passes": events}


@register("m01_match_run")
def _(t):
    """Quality of the frame tables and number of passes of each match, from raw tracks on."""
    tables = run(t)
    n = tables["passes"].groupBy("match_id").agg(F.count("*").alias("n_passes"), F.count("outcome").alias("n_decided"))
    return frames.quality(tables["player_frames"], tables["ball_frames"]).join(n, "match_id", "left").na.fill(0, ["n_passes", "n_decided"])
