"""Teams: kit clusters, votes, goalkeepers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.geometry import distance, dot, foot, project
from matchloom.operators.detections import FRAME

SAMPLE, SILHOUETTE_SAMPLE, RESTARTS, SEED = 6000, 2000, 10, 42


def calibration_sample(rows: DataFrame, roles: DataFrame, every: int = 15, most: int = SAMPLE, salt: str = "42") -> DataFrame:
    """Player rows of every ``every``-th frame with a vector; ``most`` a match by a hash of their keys."""
    used = rows.filter((F.col("frame_idx") % every == 0) & F.col("vec_id").isNotNull()).join(roles.filter("role = 'player'").select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")
    key = F.md5(F.concat_ws(":", F.lit(salt), "match_id", "frame_idx", "track_id").cast("binary"))
    nth = F.row_number().over(Window.partitionBy("match_id").orderBy("_key", "frame_idx", "track_id"))
    return used.withColumn("_key", key).withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n", "_key")


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation within each match; a constant column keeps scale 1."""
    w = Window.partitionBy("match_id")
    scale = lambda c: F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w)).otherwise(1.0)
    return rows.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / scale(c) for c in columns})


def two_means(x: np.ndarray, restarts: int = RESTARTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several runs of 2-means."""
    rng, best = np.random.default_rng(seed), (np.inf, None, None)
    for _ in range(restarts):
        first = x[rng.integers(len(x))]
        far = ((x - first) ** 2).sum(axis=1)
        p = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
        centres = np.stack([first, x[rng.choice(len(x), p=p)]])
        label = None
        while True:
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if label is not None and (new == label).all():
                break
            label = new
            centres = np.stack([x[label == k].mean(axis=0) if (label == k).any() else centres[k] for k in (0, 1)])
        loss = d.min(axis=1).sum()
        if loss < best[0]:
            best = (loss, label, centres)
    return best[1], best[2]


def silhouette(x: np.ndarray, label: np.ndarray, most: int = SILHOUETTE_SAMPLE, seed: int = SEED) -> float:
    """Mean silhouette by Euclidean distance on a sample; NaN unless both clusters are present."""
    if len(x) > most:
        at = np.random.default_rng(seed).choice(len(x), most, replace=False)
        x, label = x[at], label[at]
    if len(np.unique(label)) < 2:
        return float("nan")
    sq = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0))
    one = label == 1
    to = np.stack([d[:, ~one].sum(axis=1), d[:, one].sum(axis=1)], axis=1)
    n = np.array([(~one).sum(), one.sum()])
    own = to[np.arange(len(x)), label] / np.maximum(n[label] - 1, 1)
    other = to[np.arange(len(x)), 1 - label] / n[1 - label]
    s = np.where(n[label] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0)
    return float(s.mean())


def _calibrate(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["frame_idx", "track_id"])
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    std = x.std(axis=0)
    mean, std = x.mean(axis=0), np.where(std > 0, std, 1.0)
    z = (x - mean) / std
    label, centres = two_means(z)
    score = silhouette(z, label)
    band = "unknown" if np.isnan(score) else "good" if score > 0.5 else "fair" if score >= 0.2 else "poor"
    return pd.DataFrame({"match_id": rows["match_id"].iloc[0], "team": [0, 1], "centre": list(centres), "mean": [mean, mean], "scale": [std, std], "n": [int((label == k).sum()) for k in (0, 1)], "silhouette": score, "band": band})


def calibrate(sample: DataFrame) -> DataFrame:
    """Two kit clusters a match from (match_id, frame_idx, track_id, embedding). Kits differ between
    matches, and the sample bounds a match, so each is one small group."""
    schema = "match_id long, team int, centre array<double>, mean array<double>, scale array<double>, n long, silhouette double, band string"
    return sample.select("match_id", "frame_idx", "track_id", "embedding").groupBy("match_id").applyInPandas(_calibrate, schema)


def pooled_clusters(sample: DataFrame, k: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Kit clusters over all rows of (.., embedding) at once, where one kit pair holds for all of them.

    (rows with ``team``, clusters (team, n, centre)): distributed k-means with parallel seeding on columns scaled to
    unit population deviation. Rows of any number; nothing but k centres reaches the driver. A null vector is left out.
    """
    held = sample.filter("embedding is not null").withColumn("_raw", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_z").fit(held)
    scaled = scaler.transform(held)
    fitted = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="team", initMode="k-means||", maxIter=50).fit(scaled)
    centres = sample.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.clusterCenters())], "team int, centre array<double>")
    rows = fitted.transform(scaled).drop("_raw", "_z")
    return rows, rows.groupBy("team").agg(F.count("*").alias("n")).join(centres, "team")


def squared_silhouette(rows: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """(keys, n, silhouette) over all rows of (keys, team, embedding) by squared Euclidean distance. A row stands for
    ``count`` equal ones, if such a column is named.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum of vectors and sum of squared lengths,
    so that no two rows meet. Of several other clusters the nearest counts; a cluster of one row scores 0, as does
    a row that equals all; without a second cluster the silhouette is null. Rows without a vector or team are left out.
    """
    held = rows.filter("embedding is not null and team is not null").select(*keys, F.col("team").alias("_team"), F.transform("embedding", lambda x: x.cast("double")).alias("_x"), (F.col(count) if count else F.lit(1)).cast("long").alias("_k"))
    held = held.withColumn("_length2", dot(F.col("_x"), F.col("_x")))
    sums = held.groupBy(*keys, "_team").agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("_length2")).alias("_sum2"), Summarizer.sum(array_to_vector(F.transform("_x", lambda x: x * F.col("_k")))).alias("_total"))
    clusters = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_team").alias("team"), F.col("_n").alias("n"), F.col("_sum2").alias("sum2"), vector_to_array("_total").alias("total"))).alias("_clusters"))

    def mean(c):
        """Mean squared distance to a cluster; to one's own, the row itself left out."""
        own = F.when(c.team == F.col("_team"), 1).otherwise(0)
        return F.struct((own == 1).alias("own"), c.n.alias("n"), ((c.sum2 + c.n * F.col("_length2") - 2 * dot(F.col("_x"), c.total)) / F.nullif(c.n - own, F.lit(0))).alias("d"))

    near = held.join(clusters, keys).select(*keys, "_k", F.transform("_clusters", mean).alias("_means"))
    mine = F.get(F.filter("_means", lambda c: c.own), F.lit(0))
    other = F.array_min(F.transform(F.filter("_means", lambda c: ~c.own), lambda c: c.d))
    scored = near.select(*keys, "_k", F.greatest(mine.d, F.lit(0.0)).alias("_a"), F.greatest(other, F.lit(0.0)).alias("_b"), mine.n.alias("_n"), other.isNotNull().alias("_two"))
    s = F.when(F.col("_two"), F.when((F.col("_n") > 1) & (F.greatest("_a", "_b") > 0), (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).otherwise(0.0))
    return scored.groupBy(*keys).agg(F.sum("_k").alias("n"), (F.sum(F.col("_k") * s) / F.sum("_k")).alias("silhouette"))


def kit_rules(clusters: DataFrame) -> DataFrame:
    """(match_id, first, second, w, b) of two clusters: a vector x belongs to the first unless w.x > b.

    Which of two centres is nearer after scaling is a linear question, so mean, scale and both centres fold into one
    weight vector a match.
    """
    side = F.row_number().over(Window.partitionBy("match_id").orderBy("team"))
    pair = clusters.withColumn("_side", side).groupBy("match_id").agg(*(F.max(F.when(F.col("_side") == i + 1, F.struct("team", "centre", "mean", "scale"))).alias(x) for i, x in enumerate("pq")))
    delta = F.zip_with("q.centre", "p.centre", lambda q, p: q - p)
    w = F.zip_with(delta, "p.scale", lambda d, s: d / s)
    b = (dot(F.col("q.centre"), F.col("q.centre")) - dot(F.col("p.centre"), F.col("p.centre"))) / 2 + dot(F.col("w"), F.col("p.mean"))
    return pair.filter("q is not null").withColumn("w", w).select("match_id", F.col("p.team").alias("first"), F.col("q.team").alias("second"), "w", b.alias("b"))


def classify(rows: DataFrame, clusters: DataFrame, roles: DataFrame, every: int = 8) -> DataFrame:
    """Nearest of the match's two clusters for the player rows of every ``every``-th frame; the first on a tie."""
    used = rows.filter(F.col("frame_idx") % every == 0).join(roles.filter("role = 'player'").select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")
    off = dot(F.transform("embedding", lambda x: x.cast("double")), F.col("w"))
    return used.join(kit_rules(clusters), "match_id").select(*FRAME, "track_id", F.when(off > F.col("b"), F.col("second")).otherwise(F.col("first")).alias("team"))


def lock_teams(classified: DataFrame, weak: float = 0.7) -> DataFrame:
    """Team of each track by votes, the one seen first on a tie, with the share, a weak flag and how many tracks the team has."""
    votes = classified.groupBy("match_id", "track_id", "team").agg(F.count("*").alias("votes"), F.min("frame_idx").alias("seen"))
    out = votes.groupBy("match_id", "track_id").agg(F.min_by("team", F.struct(-F.col("votes"), F.col("seen"))).alias("team"), F.max("votes").alias("top"), F.sum("votes").alias("total"))
    return out.select("match_id", "track_id", "team", (F.col("top") / F.col("total")).alias("majority_frac"), (F.col("top") / F.col("total") < weak).alias("is_weak"), F.count("*").over(Window.partitionBy("match_id", "team")).alias("team_players"))


def sampled_positions(tracks: DataFrame, homography: DataFrame, every: int = 10) -> DataFrame:
    """Projected feet of every ``every``-th frame that has a matrix."""
    joined = tracks.filter(F.col("frame_idx") % every == 0).join(homography.filter("h0 is not null"), FRAME)
    x, y = project(*foot())
    return joined.select(*FRAME, "track_id", x.alias("pitch_x"), y.alias("pitch_y"))


def team_centroids(positions: DataFrame, teams: DataFrame) -> DataFrame:
    return positions.join(teams, ["match_id", "track_id"]).groupBy("match_id", "team").agg(F.avg("pitch_x").alias("cx"), F.avg("pitch_y").alias("cy"))


def goalkeeper_teams(positions: DataFrame, roles: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each keeper joins the team whose centroid is nearer; team 1 on a tie."""
    keeper = positions.join(roles.filter("role = 'goalkeeper'").select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")
    mean = keeper.groupBy("match_id", "track_id").agg(F.avg("pitch_x").alias("x"), F.avg("pitch_y").alias("y"))
    at = lambda c, k: F.max(F.when(F.col("team") == k, F.col(c))).alias(f"{c}{k}")
    both = centroids.groupBy("match_id").agg(*(at(c, k) for k in (0, 1) for c in ("cx", "cy")))
    off = lambda k: F.coalesce(distance(F.col("x"), F.col("y"), F.col(f"cx{k}"), F.col(f"cy{k}")), F.lit(float("inf")))
    return mean.join(both, "match_id", "left").select("match_id", "track_id", F.when(off(0) < off(1), 0).otherwise(1).alias("team"))


def merge_teams(players: DataFrame, keepers: DataFrame) -> DataFrame:
    """Player teams with those of the keepers put in their place; referees have none."""
    others = players.join(keepers, ["match_id", "track_id"], "left_anti")
    return others.select("match_id", "track_id", "team").unionByName(keepers.select("match_id", "track_id", "team"))
