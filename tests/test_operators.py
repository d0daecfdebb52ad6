"""Edge cases on small tables and sequential helpers against plain models."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import geometry
from matchloom.operators import assignment, ball, carrier, detections, frames, homographies, intervals, passes, pressing, teams, tracklets
from matchloom.sources import io, schemas

BALL = "match_id long, frame_idx long, ball_source string, ball_pitch_x double, ball_pitch_y double, carrier_track_id long, carrier_team long, possession_team long"
CFG = passes.PassConfig(max_gap_frames=8)


def ball_table(spark, spells, n, lost=(), out=(), start=0):
    """One match from (first, last, carrier) spells."""
    held = {f: c for a, b, c in spells for f in range(a, b + 1)}
    rows = [(1, f, "lost" if f in lost else "detected", None if f in lost else 120.0 if f in out else 50.0, None if f in lost else 30.0, held.get(f), None, None) for f in range(start, n)]
    return spark.createDataFrame(rows, BALL)


def dim(spark, **teams_):
    return spark.createDataFrame([(1, int(k[1:]), v) for k, v in teams_.items()], "match_id long, track_id long, team long")


def segs(spark, spells, n=200):
    df = passes.possession_segments(ball_table(spark, spells, n), dim(spark, t1=0, t2=1), CFG)
    return [(r.track_id, r.start_frame, r.end_frame, r.n_frames) for r in df.orderBy("start_frame").collect()]


def test_bridge_of_eight_but_not_nine(spark):
    assert segs(spark, [(0, 4, 1), (12, 16, 1)]) == [(1, 0, 16, 17)]
    assert segs(spark, [(0, 4, 1), (13, 17, 1)]) == [(1, 0, 4, 5), (1, 13, 17, 5)]


def test_blip_splits_and_same_player_is_no_pass(spark):
    spells = [(0, 9, 1), (10, 11, 2), (12, 20, 1), (21, 30, 2)]
    assert segs(spark, spells) == [(1, 0, 9, 10), (1, 12, 20, 9), (2, 21, 30, 10)]
    events = passes.pass_events(ball_table(spark, spells, 40), dim(spark, t1=0, t2=1), CFG).collect()
    assert [(e.passer_id, e.receiver_id, e.gap_frames, e.ball_lost_frac, e.outcome) for e in events] == [(1, 2, 0, 0.0, "failed")]


@pytest.mark.parametrize("lost, turnover", [((10, 11), False), ((10, 11, 12), True)])
def test_lost_share_must_exceed_half(spark, lost, turnover):
    b = ball_table(spark, [(0, 9, 1), (14, 20, 3)], 30, lost=lost)
    (e,) = passes.pass_events(b, dim(spark, t1=0, t3=0), CFG).collect()
    assert e.is_turnover is turnover and e.outcome == (None if turnover else "completed") and e.gap_frames == 4


def test_out_of_bounds_and_unknown_team(spark):
    b = ball_table(spark, [(0, 9, 1), (14, 20, 3), (30, 40, 7)], 50, out=(11,))
    e = passes.pass_events(b, dim(spark, t1=0, t3=0), CFG).orderBy("passer_end_frame").collect()
    assert (e[0].ball_out_of_bounds, e[0].is_turnover) == (True, True)
    assert (e[1].is_turnover, e[1].outcome, e[1].receiver_team) == (False, None, None)


def test_edge_of_pitch_margin(spark):
    rows = [(1, i, 1, x, y) for i, (x, y) in enumerate([(-5.0, 0.0), (-5.1, 0.0), (110.0, 73.0), (50.0, 73.01), (None, None)])]
    p = spark.createDataFrame(rows, "match_id long, frame_idx long, track_id long, pitch_x double, pitch_y double")
    assert [r.pitch_x is not None for r in frames.drop_implausible(p).orderBy("frame_idx").collect()] == [True, False, True, False, False]
    r = frames.plausibility(p).first()
    assert (r.n_bad, r.n_total) == (2, 4)


def test_possession_fill_reaches_eight_frames(spark):
    rows = [(1, f, 1 if f == 0 else None) for f in range(12)]
    out = frames.fill_possession(spark.createDataFrame(rows, "match_id long, frame_idx long, carrier_team long"))
    assert [r.possession_team for r in out.orderBy("frame_idx").collect()] == [1] * 9 + [None] * 3


def test_keeper_on_halfway_line_attacks_left(spark):
    p = spark.createDataFrame([(1, 0, 9, "goalkeeper", 0, 52.5), (1, 1, 8, "goalkeeper", 1, 52.4)], "match_id long, frame_idx long, track_id long, role string, team long, pitch_x double")
    assert {r.team: r.attack_direction for r in frames.attack_directions(p).collect()} == {0: -1, 1: 1}


def test_overlap_at_threshold_suppresses(spark):
    row = lambda i, x, conf, c="player": (1, 0, i, x, 0.0, x + 30.0, 30.0, conf, c, "multi")
    df = spark.createDataFrame([row(1, 0.0, 0.9), row(2, 10.0, 0.8), row(3, 20.0, 0.7), row(4, 10.0, 0.6, "referee")], "match_id long, frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, class string, source string")
    assert sorted(r.det_id for r in detections.suppress(df, 0.5).collect()) == [1, 3, 4]
    assert sorted(r.det_id for r in detections.suppress_across(df, 0.5).collect()) == [4]


def test_contested_at_margin(spark):
    df = spark.createDataFrame([(1, 0, 5, 7.0), (1, 0, 6, 10.0), (1, 1, 5, 6.9), (1, 1, 6, 10.0), (1, 2, 5, 0.0), (1, 2, 6, 0.0), (1, 3, 4, 9.0)], "match_id long, frame_idx long, track_id long, dist double")
    assert [(r.track_id, r.ambiguous) for r in carrier.best_with_margin(df).orderBy("frame_idx").collect()] == [(5, True), (5, False), (5, True), (4, False)]


def test_convergence_needs_both_frames(spark):
    players = [(1, f, t, "player", 0, x, 30.0) for f, t, x in [(0, 1, 60.0), (1, 1, 58.0), (2, 1, 58.0), (3, 1, 57.0), (0, 2, 55.0), (2, 2, 54.0), (3, 2, 53.0)]]
    p = spark.createDataFrame(players, "match_id long, frame_idx long, track_id long, role string, team long, pitch_x double, pitch_y double")
    b = ball_table(spark, [], 4, lost=(2,))
    got = {(r.frame_idx, r.team): (r.n_in_radius, r.n_converging) for r in pressing.convergence(p, b).collect()}
    assert got[(0, 0)] == got[(2, 0)] == got[(3, 0)] == (None, None) and got[(1, 0)] == (1, 1) and got[(1, 1)] == (0, 0)


def test_phase_of_one_frame_and_gap(spark):
    rows = [(1, f, t) for f, t in enumerate([None, 0, 1, None, 1, None])]
    b = spark.createDataFrame(rows, "match_id long, frame_idx long, possession_team long")
    spells = pressing.phases(b)
    assert [(r.start_frame, r.end_frame, r.defending_team) for r in spells.orderBy("start_frame").collect()] == [(1, 1, 1), (2, 4, 0)]
    assert [r.phase for r in pressing.frame_phases(b, spells).orderBy("frame_idx").collect()] == [None, 0, 1, 1, 1, None]


def test_majority_role_and_locks(spark):
    rows = [(1, f, t, c) for t, cs in {1: ["referee"] * 10 + ["player"] * 400, 2: ["referee"] * 9 + ["player"] * 20, 3: ["goalkeeper"] * 10 + ["player"] * 491}.items() for f, c in enumerate(cs)]
    out = tracklets.lock_classes(spark.createDataFrame(rows, "match_id long, frame_idx long, track_id long, class string"))
    assert {r.track_id: r.role for r in out.collect()} == {1: "referee", 2: "player", 3: "player"}


def best_by_force(weight):
    n, m = weight.shape
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        totals = [sum(weight[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k)]
        top = max((t for t in totals if np.isfinite(t)), default=None)
        if top is not None:
            return k, top
    return best


def test_assignment_prefers_more_links_then_score():
    assert tracklets.assign(np.array([[0.9, 0.5], [0.8, -np.inf]])) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(4)
    for _ in range(150):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        w[rng.random(w.shape) < 0.4] = -np.inf
        pairs = tracklets.assign(w)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert (len(pairs), sum(w[p] for p in pairs)) == pytest.approx(best_by_force(w))


def test_linking_three_fragments_and_a_decoy(spark):
    rng = np.random.default_rng(7)
    person, decoy = (v / np.linalg.norm(v) for v in (rng.normal(size=512), rng.normal(size=512)))
    parts = [(0, 0, 19, 100, 2, 0), (1, 40, 59, 178, 2, 0), (2, 90, 109, 276, 2, 0), (3, 45, 64, 500, -1, 1)]
    rows = [(1, f, i, float(x + v * (f - a)), 100.0, float(x + v * (f - a)) + 40, 180.0, e) for i, a, b, x, v, e in parts for f in range(a, b + 1)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, tracklet_id long, x1 double, y1 double, x2 double, y2 double, vec_id long")
    vectors = spark.createDataFrame([(0, person.tolist()), (1, decoy.tolist())], "vec_id long, embedding array<double>")
    keys = ["match_id", "tracklet_id"]
    f = tracklets.motion_features(df, keys).join(tracklets.mean_vectors(df, keys, vectors), keys).withColumn("class", F.lit("player"))
    links = tracklets.best_links(tracklets.link_candidates(f, tracklets.TrackingConfig(max_gap=50)))
    ids = tracklets.identities(f, links)
    groups = ids.groupBy("track_id").agg(F.sort_array(F.collect_list("tracklet_id")).alias("m")).collect()
    assert sorted(r.m for r in groups) == [[0, 1, 2], [3]]


def plain_hold(rows, cfg):
    now, streak, idle, out = None, {}, 0, []
    for candidate, touch in rows:
        if candidate is None:
            idle += 1
            if idle > cfg.grace_frames:
                now, streak = None, {}
        else:
            idle = 0
            if candidate == now:
                streak[candidate] = 0
            elif touch:
                streak[candidate] = streak.get(candidate, 0) + 1
                if streak[candidate] >= cfg.switch_frames:
                    now, streak = candidate, {}
        out.append(now)
    return out


def test_carrier_islands_equal_one_run(spark):
    rng, cfg = np.random.default_rng(3), carrier.CarrierConfig(switch_frames=3)
    rows = []
    for m in range(3):
        f = 0
        while f < 300:
            for _ in range(rng.integers(1, 25)):
                rows.append((m, f, int(rng.integers(1, 4)), bool(rng.random() < 0.7), "overlap", "detected"))
                f += 1
            for _ in range(rng.choice([1, 7, 8, 9, 10, 20])):
                rows.append((m, f, None, True, None, "lost"))
                f += 1
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, candidate long, touch_like boolean, method string, ball_source string")
    got = {s: [(r.match_id, r.frame_idx, r.track_id) for r in carrier.assign_carrier(df, cfg, split=s).orderBy("match_id", "frame_idx").collect()] for s in (True, False)}
    want = [(m, r[1], h) for m in range(3) for r, h in zip([r for r in rows if r[0] == m], plain_hold([(r[2], r[3]) for r in rows if r[0] == m], cfg))]
    assert got[True] == got[False] == want
    assert carrier.islands(df, cfg).select("match_id", "island").distinct().count() > 6


def test_ball_islands_equal_one_run(spark):
    rng = np.random.default_rng(8)
    rows, x, f = [], np.array([500.0, 400.0]), 0
    while f < 700:
        for _ in range(rng.integers(1, 40)):
            x = x + rng.normal(0, 4, 2)
            rows.append((1, f, float(x[0]), float(x[1]), float(rng.uniform(0.2, 1))))
            f += 1
        f += int(rng.choice([1, 3, 20, 38, 39, 40, 60]))
    found = spark.createDataFrame(rows, "match_id long, frame_idx long, x_px double, y_px double, conf double")
    every = spark.range(f).select(F.lit(1).cast("long").alias("match_id"), F.col("id").alias("frame_idx"))
    people = found.filter("frame_idx % 5 = 0").select("match_id", "frame_idx", F.col("x_px").alias("x"), F.col("y_px").alias("y")).crossJoin(spark.range(2)).drop("id")
    h = every.select("match_id", "frame_idx", *(F.lit(v).alias(f"h{i}") for i, v in enumerate([0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0])))
    runs = [ball.track_ball(every, found, people, h, split=s).orderBy("frame_idx").toPandas() for s in (True, False)]
    pd.testing.assert_frame_equal(*runs, check_exact=False, rtol=1e-6)
    assert set(runs[0]["source"]) == {"detected", "smoothed", "lost"} and runs[0]["source"].size == f
    seen = runs[0].merge(found.toPandas(), on="frame_idx", suffixes=("", "_raw"))
    hit = seen[seen["source"] == "detected"]
    assert np.allclose(hit["x_px"].astype(float), hit["x_px_raw"])


def test_gap_of_38_misses_is_bridged_and_39_not(spark):
    for gap, bridged in ((38, True), (39, False)):
        found = spark.createDataFrame([(1, f, 10.0, 10.0, 0.9) for f in [*range(5), *range(5 + gap, 10 + gap)]], "match_id long, frame_idx long, x_px double, y_px double, conf double")
        every = spark.range(10 + gap).select(F.lit(1).cast("long").alias("match_id"), F.col("id").alias("frame_idx"))
        h = every.select("*", *(F.lit(None).cast("double").alias(c) for c in geometry.H))
        people = found.select("match_id", "frame_idx", F.col("x_px").alias("x"), F.col("y_px").alias("y")).limit(0)
        out = ball.track_ball(every, found, people, h).filter(f"frame_idx between 5 and {4 + gap}").select("source").distinct().collect()
        assert [r.source for r in out] == ["smoothed" if bridged else "lost"]


def test_homography_starts_at_anchor_and_carries(spark):
    eye = [10.0, 0.0, 5.0, 0.0, 10.0, 7.0, 0.0, 0.0, 1.0]
    rows = [(1, 0, *eye, 15, "bootstrap"), (1, 1, *eye, 15, "anchor"), (1, 2, *([None] * 9), None, None), (1, 3, *[v + (50 if i == 2 else 0) for i, v in enumerate(eye)], 3, "anchor")]
    raw = spark.createDataFrame(rows, "match_id long, frame_idx long, " + ", ".join(f"h{i} double" for i in range(9)) + ", n_inliers int, tag string")
    out = homographies.smooth(raw).orderBy("frame_idx").collect()
    assert [r.h0 for r in out] == [None, 10.0, 10.0, pytest.approx(10.0)] and out[3].h2 == pytest.approx(0.06 * 55 + 0.94 * 5)
    assert homographies.disagreement(np.zeros((3, 3)), np.eye(3)) == float("inf") and homographies.disagreement(np.eye(3), np.eye(3)) == 0


def test_two_means_finds_kits():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.1, (80, 5)), rng.normal(3, 0.1, (40, 5))]
    label, _ = teams.two_means(x)
    assert len(set(label[:80])) == len(set(label[80:])) == 1 and label[0] != label[-1]
    assert teams.silhouette(x, label) > 0.8 and np.isnan(teams.silhouette(x, np.zeros(120, int)))


def test_load_or_build(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return [spark.range(3), spark.range(4)]

    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    for force, times in ((False, 1), (False, 1), (True, 2)):
        assert [d.count() for d in io.load_or_build(spark, paths, build, force)] == [3, 4] and len(made) == times


def test_empty_events(spark):
    e = passes.pass_events(ball_table(spark, [], 20), dim(spark, t1=0), CFG)
    assert e.count() == 0 and passes.team_stats(e).columns == ["match_id", "passer_team", "completed", "failed", "attempted", "completion_pct"]


def test_frame_spine_reads_all_rows(spark, monkeypatch):
    import matchloom.plans.vision_queries  # noqa: F401
    from matchloom.plans import registry
    from matchloom.sources import fixtures

    ev = spark.createDataFrame([(1, 0), (1, 3), (1, 7), (2, 2)], "match_id long, frame_idx long")
    monkeypatch.setattr(fixtures, "table", lambda spark, sf_dir, name: ev)
    got = {(r.match_id, r.frame_idx) for r in registry.QUERIES["s06_frame_spine"](spark, "").collect()}
    assert got == {(1, i) for i in range(8)} | {(2, i) for i in range(3)}


def test_registered_identity_report_and_kits(spark, sf):
    """The queries without SQL against plain counts and nearest centres of their own inputs."""
    from collections import Counter, defaultdict

    from matchloom import plans
    from matchloom.plans import registry, tracking_queries

    chains = defaultdict(list)
    for r in plans.QUERIES["k12_track_numbers"](spark, sf).collect():
        chains[r.match_id, r.track_id].append(r["class"])
    want = defaultdict(Counter)
    for (m, _), c in chains.items():
        assert len(set(c)) == 1
        want[m][f"chains_{min(len(c), 3)}"] += 1
        want[m][f"n_{c[0]}"] += 1
    assert sorted(n for m, n in chains if m == 0) == list(range(1, 1 + sum(m == 0 for m, _ in chains)))
    for r in plans.QUERIES["k13_identity_report"](spark, sf).collect():
        assert all(r[c] == want[r.match_id][c] for c in ("chains_1", "chains_2", "chains_3", "n_player", "n_goalkeeper", "n_referee"))
        assert (r.over_goalkeeper, r.over_referee) == (r.n_goalkeeper > 2, r.n_referee > 3)
    t = registry.Tables(spark, sf)
    kits = {(r.match_id, r.team): [np.array(r[c]) for c in ("centre", "mean", "scale")] for r in tracking_queries.clusters(t).collect()}
    rows = tracking_queries.vectors(t).filter("frame_idx % 8 = 0").join(t.track_role.filter("role = 'player'"), ["match_id", "track_id"], "left_semi").collect()
    near = {}
    for r in rows:
        off = [np.linalg.norm((np.array(r.embedding) - kits[r.match_id, k][1]) / kits[r.match_id, k][2] - kits[r.match_id, k][0]) for k in (0, 1)]
        near[r.match_id, r.frame_idx, r.track_id] = int(np.argmin(off))
    got = {(r.match_id, r.frame_idx, r.track_id): r.team for r in plans.QUERIES["a05_classify_kits"](spark, sf).collect()}
    same = np.mean([got[k] == v for k, v in near.items()])
    assert got.keys() == near.keys() and max(same, 1 - same) == 1


def test_homography_jump(spark):
    """A sure matrix that moves the key points by more than the limit is followed fast."""
    eye = [10.0, 0.0, 5.0, 0.0, 10.0, 7.0, 0.0, 0.0, 1.0]
    far = [v + (500 if i in (2, 5) else 0) for i, v in enumerate(eye)]
    rows = [(1, 0, *eye, 15, "anchor"), (1, 1, *far, 15, "anchor"), (1, 2, *far, 6, "anchor"), (1, 3, *far, None, None)]
    raw = spark.createDataFrame(rows, "match_id long, frame_idx long, " + ", ".join(f"h{i} double" for i in range(9)) + ", n_inliers int, tag string")
    out = homographies.smooth(raw).orderBy("frame_idx").collect()
    x1 = 0.8 * 505 + 0.2 * 5
    x2 = 0.12 * 505 + 0.88 * x1
    assert [r.jump for r in out] == [False, True, False, False]
    assert [r.h2 for r in out] == [5.0, pytest.approx(x1), pytest.approx(x2), pytest.approx(0.3 * 505 + 0.7 * x2)]
    assert homographies.coverage(raw, homographies.smooth(raw)).first().n_jumps == 1


def test_parts_of_a_long_chain_need_few_rounds(spark, monkeypatch):
    chain = [(1, "p", 2 * a, 2 * b + 1) for a, b in zip(range(100), range(100))] + [(1, "p", 2 * (a + 1), 2 * a + 1) for a in range(99)] + [(2, "p", 8, 3)]
    rounds = []
    real = tracklets.materialize
    monkeypatch.setattr(tracklets, "materialize", lambda df, label: rounds.append(label) or real(df, label))
    df = spark.createDataFrame(chain, "match_id long, class string, u long, v long")
    got = tracklets._parts(df, ["match_id", "class"]).collect()
    assert {(r.match_id, r.label) for r in got} == {(1, 0), (2, 3)} and len(got) == 202 and rounds.count("link-steps") < 12


def test_sparse_assignment_and_its_prices():
    """Equal to exhaustive search, with ties; prices cover every edge and sum to the worth of the links."""
    rng = np.random.default_rng(5)
    for turn in range(300):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 5))) if turn % 2 else rng.integers(0, 4, (rng.integers(1, 5), rng.integers(1, 5))) / 3 - 0.5
        w[rng.random(w.shape) < 0.45] = -np.inf
        edges = [(10 + int(r), 20 + int(c), float(w[r, c])) for r, c in zip(*np.nonzero(np.isfinite(w)))]
        chosen, of_i, of_j, bonus = assignment.assign(edges)
        assert len({i for i, _, _ in chosen}) == len({j for _, j, _ in chosen}) == len(chosen) and set(chosen) <= {(i, j, round(s * assignment.UNIT) / assignment.UNIT) for i, j, s in edges}
        assert (len(chosen), sum(s for *_, s in chosen)) == pytest.approx(best_by_force(w))
        assert all(of_i[i] + of_j[j] >= bonus + s - 1e-9 for i, j, s in edges) and min([0, *of_i.values(), *of_j.values()]) == 0
        assert sum(of_i.values()) + sum(of_j.values()) == pytest.approx(sum(bonus + s for *_, s in chosen))


def test_large_part_is_solved_in_seconds():
    rng = np.random.default_rng(6)
    n = 5000
    edges = [(i, int(j), float(s)) for i in range(n) for j, s in zip(np.unique(np.clip(i + rng.integers(-60, 60, 10), 0, n - 1)), 0.3 + 0.7 * rng.random(10))]
    began = time.process_time()
    chosen, of_i, of_j, bonus = assignment.assign(edges)
    assert time.process_time() - began < 10
    assert sum(of_i.values()) + sum(of_j.values()) == pytest.approx(sum(bonus + s for *_, s in chosen))


def test_too_large_part_is_an_error(monkeypatch):
    monkeypatch.setattr(assignment, "MAX_EDGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        assignment._solve(pd.DataFrame({"match_id": [1] * 3, "i": [1, 2, 3], "j": [1, 2, 3], "score": [0.5] * 3}))


def test_interval_join_equals_nested_loop(spark):
    rng = np.random.default_rng(8)
    spells = [(int(m), k, int(s), int(s + n)) for k, (m, s, n) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-300, 900, 400), rng.choice([0, 0, 1, 2, 7, 8, 9, 60, 700, 5000, -3], 400)))]
    spells += [(1, 900, None, 5), (1, 901, 5, None), (1, 902, 10, 20), (1, 903, 10, 20), (1, 904, 0, 1 << 40)]
    points = [(int(m), int(f)) for m, f in zip(rng.integers(0, 4, 300), rng.integers(-400, 1000, 300))] + [(1, None), (1, 15), (1, 15)]
    p, s = spark.createDataFrame(points, "m long, f long"), spark.createDataFrame(spells, "m long, k long, a long, b long")
    out = intervals.interval_join(p, s, ["m"], "f", "a", "b")
    want = sorted((m, f, k) for m, f in points for n, k, a, b in spells if f is not None and None not in (a, b) and m == n and a <= f <= b)
    assert sorted((r.m, r.f, r.k) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert intervals.interval_join(p, s.filter("k < 0"), ["m"], "f", "a", "b").count() == 0


def test_nearest_equals_search(spark):
    rng = np.random.default_rng(9)
    known = sorted({(int(k), int(f)) for k, f in zip(rng.integers(0, 3, 60), rng.integers(0, 300, 60))})
    asked = sorted({(int(k), int(f)) for k, f in zip(rng.integers(0, 4, 200), rng.integers(-20, 330, 200))})
    k, a = spark.createDataFrame([(*x, 1000 * x[0] + x[1]) for x in known], "k long, f long, v long"), spark.createDataFrame(asked, "k long, f long")
    for reach in (0, 5, 500):
        got = {(r.k, r.f): r.v for r in intervals.nearest(a, k, ["k"], "f", ["v"], reach).collect()}
        want = {(i, f): min(((abs(g - f), g) for j, g in known if j == i and abs(g - f) <= reach), default=None) for i, f in asked}
        assert got == {x: None if w is None else 1000 * x[0] + w[1] for x, w in want.items()}


def test_bucketed_and_partitioned_tables(spark, sf, tmp_path):
    """Tables in buckets of frames join and group without an exchange; a partitioned one reads one match's folder alone."""
    from matchloom.plans import QUERIES, registry, vision_queries

    t = registry.Tables(spark, sf)
    players, balls = vision_queries.match_tables(t)
    out = players.join(balls.select("match_id", "frame_idx", "ball_source").hint("merge"), ["match_id", "frame_idx"]).groupBy("match_id", "frame_idx").count()
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    path = str(tmp_path / "players")
    io.write(t.player_frame, path, partition_by=["match_id"])
    one = io.read(spark, path, schemas.PLAYER_FRAMES).filter("match_id = 1")
    assert "PartitionFilters: [isnotnull(match_id" in one._jdf.queryExecution().executedPlan().toString() and len(one.inputFiles()) >= 1
    assert {r.match_id for r in one.select("match_id").distinct().collect()} == {1} and one.count() == t.player_frame.filter("match_id = 1").count()
    assert QUERIES["s02_join_bucketed"](spark, sf).count() == t.player_frame.select("match_id", "frame_idx").distinct().count()
    with pytest.raises(TypeError, match="frame_idx: missing"):
        schemas.conform(spark.range(1), "id long, frame_idx long")
    with pytest.raises(TypeError, match="id: bigint, not int"):
        schemas.conform(spark.range(1), "id int")


def test_pooled_clusters_equal_the_helper_on_one_match(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.4, (90, 6)), rng.normal(2, 0.4, (50, 6))] * [1, 5, 1, 1, 20, 1]
    df = spark.createDataFrame([(1, i, 1, v.tolist()) for i, v in enumerate(x)], "match_id long, frame_idx long, track_id long, embedding array<double>")
    label, _ = teams.two_means((x - x.mean(axis=0)) / x.std(axis=0))
    rows, found = teams.pooled_clusters(df)
    got = np.array([r.team for r in rows.orderBy("frame_idx").collect()])
    assert (got == label).all() or (got == 1 - label).all()
    assert sorted(r.n for r in found.collect()) == [50, 90]


def test_squared_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(0, 1, (40, 4)), np.r_[rng.integers(0, 3, 39), 9]
    rows = [(1, int(k), v.tolist()) for k, v in zip(label, x)] + [(2, 0, [1.0, 2.0])] * 3 + [(3, 0, [1.0]), (3, 1, [1.0]), (3, 0, [1.0]), (3, None, [5.0]), (3, 1, None)]
    out = {r.m: r for r in teams.squared_silhouette(spark.createDataFrame(rows, "m long, team long, embedding array<double>"), ["m"]).collect()}
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    score = []
    for i, k in enumerate(label):
        own = (label == k).sum()
        a = d[i, label == k].sum() / max(own - 1, 1)
        b = min(d[i, label == j].mean() for j in set(label.tolist()) - {int(k)})
        score.append((b - a) / max(a, b) if own > 1 else 0)
    assert out[1].silhouette == pytest.approx(np.mean(score)) and out[1].n == 40
    assert out[2].silhouette is None and (out[3].silhouette, out[3].n) == (0.0, 3)


def test_many_inverses_equal_single_ones():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 3, 3))
    m[7] = 0
    got = homographies.image_points(m)
    pitch = np.c_[homographies.KEY_POINTS * 10, np.ones(len(homographies.KEY_POINTS))].T
    for k in range(50):
        if k == 7:
            assert np.isnan(got[k]).all()
        else:
            p = np.linalg.inv(m[k]) @ pitch
            assert got[k] == pytest.approx(p[:2] / p[2], rel=1e-6)


def test_composed_run(spark, sf, tmp_path):
    """From raw tracks to passes: every stage's output fits the next one, and totals agree along the way."""
    from matchloom.plans import match_run, registry

    t = registry.Tables(spark, sf)
    out = match_run.run(t, least=60, folder=str(tmp_path / "run"))
    n = {k: df.count() for k, df in out.items()}
    assert all(n[k] > 0 for k in ("tracks", "roles", "teams", "player_frames", "ball_frames", "carrier"))
    assert n["player_frames"] == n["tracks"] and n["ball_frames"] == n["ball"] == t.ev.count()
    # One row a track and frame, one role a track, teams of players and keepers only.
    assert out["tracks"].groupBy("match_id", "frame_idx", "track_id").count().filter("count > 1").isEmpty()
    assert out["roles"].groupBy("match_id", "track_id").count().filter("count > 1").isEmpty()
    assert out["teams"].join(out["roles"].filter("role = 'referee'"), ["match_id", "track_id"]).isEmpty()
    ids = {(r.match_id, r.track_id) for r in out["tracks"].select("match_id", "track_id").distinct().collect()}
    assert {(r.match_id, r.track_id) for r in out["carrier"].filter("track_id is not null").select("match_id", "track_id").distinct().collect()} <= ids
    assert all((r.match_id, r.passer_id) in ids and (r.match_id, r.receiver_id) in ids and r.passer_id != r.receiver_id for r in out["passes"].collect())
    one = io.read(spark, str(tmp_path / "run" / "player_frames"), out["player_frames"].schema).filter("match_id = 0")
    assert "PartitionFilters: [isnotnull(match_id" in one._jdf.queryExecution().executedPlan().toString()
