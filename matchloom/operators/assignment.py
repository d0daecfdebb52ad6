"""One-to-one assignment over a sparse graph of candidate links, with a proof of its optimum.

The links chosen are as many as can be, and among those of the largest total score. Each connected part
of the graph is solved by itself. Row by row, the cheapest way to place one more is searched from it
(Dijkstra over reduced costs), which may rearrange rows placed before or leave one out for good. The
prices that this keeps are a dual solution: with them a join proves that no other choice is better.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores count in steps of 2^-40, so that sums and comparisons are exact.
UNIT = 1 << 40
#: Candidate links of one connected part, above which it is an error: some 200 MB of Python objects in one task.
MAX_EDGES = 500_000


def assign(edges: list[tuple[int, int, float]]) -> tuple[list[tuple[int, int, float]], dict[int, float], dict[int, float], float]:
    """(chosen edges, price of each i, price of each j, bonus of a pair) of edges (i, j, score).

    For every edge price(i) + price(j) >= bonus + score, equal on chosen ones; prices aren't negative and
    are 0 for what is left out, so their sum is the best that any choice reaches. Ties go by the smaller j.
    """
    best: dict[tuple[int, int], int] = {}
    for i, j, score in edges:
        worth = round(score * UNIT)
        best[i, j] = max(best.get((i, j), worth), worth)
    if not best:
        return [], {}, {}, 0.0
    top = max(best.values())
    out: dict[int, list[tuple[int, int]]] = {}
    for (i, j), worth in sorted(best.items()):
        out.setdefault(i, []).append((j, top - worth))
    # Leaving a row out costs more than any rearrangement could save.
    alone = (top - min(best.values())) * (len(out) + 1) + UNIT
    row_price = {i: min(alone, min(c for _, c in held)) for i, held in out.items()}
    col_price: dict[int, int] = {}
    of_col: dict[int, int] = {}
    of_row: dict[int, int] = {}
    for first in out:
        far: dict[int, int] = {}
        via: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[int, int, int]] = []
        row, at, leaving = first, 0, (alone - row_price[first], first)
        reached = [(first, 0)]
        end = None
        while True:
            leaving = min(leaving, (at + alone - row_price[row], row))
            for col, cost in out[row]:
                new = at + cost - row_price[row] - col_price.get(col, 0)
                if col not in done and new < far.get(col, new + 1) and new < leaving[0]:
                    far[col], via[col] = new, row
                    heapq.heappush(heap, (new, 0 if col not in of_col else 1, col))
            while heap and (heap[0][2] in done or heap[0][0] > far[heap[0][2]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= leaving[0]:
                break
            at, _, col = heapq.heappop(heap)
            done.add(col)
            if col not in of_col:
                end = col
                break
            row = of_col[col]
            reached.append((row, at))
        total = leaving[0] if end is None else at
        for row, near in reached:
            row_price[row] += total - near
        for col in done:
            if far[col] < total:
                col_price[col] = col_price.get(col, 0) - (total - far[col])
        if end is None:
            # The row that gives way loses its column to the one before it on the path.
            row = leaving[1]
            col = of_row.pop(row, None)
        else:
            col = end
        while col is not None:
            row = via[col]
            of_col[col] = row
            col, of_row[row] = of_row.get(row), col
    chosen = [(i, j, best[i, j] / UNIT) for i, j in sorted(of_row.items())]
    cols = {j for _, j in best}
    return chosen, {i: (alone - p) / UNIT for i, p in row_price.items()}, {j: -col_price.get(j, 0) / UNIT for j in cols}, (alone - top) / UNIT


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    if len(rows) > MAX_EDGES:
        raise ValueError(f"one part of match {rows['match_id'].iloc[0]} has more than {MAX_EDGES} candidate links; narrow the gap or raise the least score")
    chosen, price_i, price_j, bonus = assign(list(zip(rows["i"].tolist(), rows["j"].tolist(), rows["score"].tolist())))
    of = {(i, j) for i, j, _ in chosen}
    out = rows[["match_id", "class", "i", "j", "score"]].copy()
    out["chosen"] = [k in of for k in zip(out["i"], out["j"])]
    out["price_i"], out["price_j"], out["bonus"] = out["i"].map(price_i), out["j"].map(price_j), bonus
    out["part"] = rows["label"]
    return out


PRICED = "match_id long, class string, i long, j long, score double, chosen boolean, price_i double, price_j double, bonus double, part long"


def priced_links(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Every candidate with whether it is chosen and the prices of both ends; ``parts`` is (match_id, class, i, label)."""
    return candidates.join(parts, ["match_id", "class", "i"]).groupBy("match_id", "class", "label").applyInPandas(_solve, PRICED)


def certificate(priced: DataFrame) -> DataFrame:
    """By match and class: candidates, links, and what speaks against the optimum.

    n_cheap counts candidates whose prices are too low, n_negative negative prices, n_shared ends with
    two links, all 0 for a feasible pair of solutions; gap is the sum of all prices less the bonus and score of
    all links, 0 if both are the best.
    """
    keys = ["match_id", "class"]
    edges = priced.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"), F.sum("score").alias("all_scores"), F.count_if("chosen").alias("n_links"),
        F.count_if(F.col("price_i") + F.col("price_j") < F.col("bonus") + F.col("score") - 1e-9).alias("n_cheap"),
        F.count_if((F.col("price_i") < 0) | (F.col("price_j") < 0)).alias("n_negative"), F.sum(F.when(F.col("chosen"), F.col("bonus") + F.col("score")).otherwise(0.0)).alias("worth"),
    )
    ends = [priced.groupBy(*keys, F.col(x)).agg(F.max(f"price_{x}").alias("price"), F.count_if("chosen").alias("n")) for x in "ij"]
    ends = ends[0].select(*keys, "price", "n").unionByName(ends[1].select(*keys, "price", "n"))
    prices = ends.groupBy(*keys).agg(F.sum("price").alias("prices"), F.count_if(F.col("n") > 1).alias("n_shared"), F.count("*").alias("n_ends"))
    out = edges.join(prices, keys)
    return out.select(*keys, "n_candidates", "n_ends", "all_scores", "n_links", "n_cheap", "n_negative", "n_shared", (F.col("prices") - F.col("worth")).alias("gap"))
