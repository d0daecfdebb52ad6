"""Tables of a row, or more, a frame are never taken for small ones and broadcast: that needs them whole in the driver."""

import re

import numpy as np
import pytest

from matchloom import plans
from matchloom.operators import teams
from matchloom.sources import fixtures

JOINED = (
    "b07_gap_summary c01_touch_candidates c02_proximity_candidates c03_best_with_margin c04_velocity_change c05_touch_like f03_ball_frames "
    "g01_iou g03_pixel_to_pitch g04_project_all_feet g05_point_to_box g06_player_feet k03_contacts k04_contact_runs k05_split_points k06_apply_splits k07_drop_short k08_mean_vectors k08_motion_features"
).split()
WRITTEN = "c06_carrier_candidates c06_hold_carrier c07_carrier_stats k10_best_links".split()
#: Bytes: more than Spark takes the columns of ``events`` for, less than any table of a row a player and frame has.
THRESHOLD = "200k"


def large(plan: str) -> list[str]:
    """Broadcast joins by frame or by tracklet, of which there are some for each player."""
    return re.findall(r"BroadcastHashJoin \[[^\]]*(?:frame_idx|tracklet_id)[^\]]*\]", plan)


@pytest.fixture
def eager(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", THRESHOLD)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", JOINED)
def test_no_frames_are_broadcast(eager, sf, name):
    assert not large(planned(plans.QUERIES[name](eager, sf)))


@pytest.mark.parametrize("name", WRITTEN)
def test_no_frames_are_broadcast_before_a_table_is_written(eager, sf, name, monkeypatch):
    from matchloom.plans import ball_queries
    from matchloom.sources import io

    seen = []

    def stop(df, *_):
        seen.append(planned(df))
        raise InterruptedError

    monkeypatch.setattr(ball_queries, "materialize", stop)
    monkeypatch.setattr(io, "materialize", stop)
    monkeypatch.setattr(io, "complete", lambda *_: False)
    with pytest.raises(InterruptedError):
        plans.QUERIES[name](eager, sf)
    assert seen and not large(seen[0])


@pytest.mark.parametrize("name", ["tracks", "whole_tracks", "player_frame", "detections"])
def test_size_of_what_is_generated(spark, sf, name):
    """Spark's size of three columns is at least that of their rows."""
    df = fixtures.table(spark, sf, name)
    few = df.select(*df.columns[:3])
    assert few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= few.count() * 3 * 8


def test_silhouette_of_counted_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(rng.integers(0, 3)), rng.normal(0, 1, 4).tolist(), int(rng.integers(1, 6))) for _ in range(30)] + [(2, 0, [1.0, 2.0], 3), (3, 0, [1.0], 2), (3, 1, [1.0], 1), (3, None, [5.0], 4), (3, 1, None, 4)]
    counted = spark.createDataFrame(rows, "m long, team long, embedding array<double>, k long")
    each = counted.selectExpr("m", "team", "embedding", "explode(sequence(1L, k))")
    got, want = ({r.m: (r.n, r.silhouette) for r in out.collect()} for out in (teams.squared_silhouette(counted, ["m"], "k"), teams.squared_silhouette(each, ["m"])))
    assert {k: (n, s and pytest.approx(s)) for k, (n, s) in want.items()} == got and got[1][0] > 30


def test_equal_vectors_of_a_team_meet_clusters_once(spark, sf):
    """They are counted before their embeddings join them."""
    text = planned(plans.QUERIES["a04_squared_silhouette"](spark, sf))
    assert re.search(r"Aggregate\(keys=\[match_id#\d+L, team#\d+L, vec_id#\d+L\]", text)
