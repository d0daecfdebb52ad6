"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one a shard.

Vectors of a shard are inserted in batches into layered neighbour graphs; many queries walk a graph
side by side. Every vector queries every shard: a task holds two shards, whose vectors query the other's
graph, so that a pair counts for both if either search finds it. The beam is doubled until an audit
against brute force passes, for vectors of each length by itself; if none passes, or the audit finds no links, all is brute force. A vector with more links than FULL in a
shard is compared with all of the shard. Every reported pair is checked in double precision.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import connected_components, materialize, release, roots

THRESHOLD = 0.95
NEIGHBOURS = 16
BUILD_BEAM = 64
BEAMS = (32, 64, 128, 256, 512, 1024)
TARGET_RECALL = 0.99
#: At least so many shards; more where one would hold more than SHARD_ROWS vectors or SHARD_BYTES.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 50_000, 128 << 20
#: Vectors asked in the audit, round by round, until so many of them have links.
AUDIT_QUERIES, AUDIT_LINKED = (2000, 8000, 32_000), 20
#: Links in one shard from which a vector's own are counted by brute force.
FULL = 256
STEP = 4
VISITED = 32 << 20
SLACK = 1e-4


class Layer:
    """A neighbour graph over some vectors: ``links`` holds positions in ``vectors``, -1 for none."""

    def __init__(self, vectors: np.ndarray, width: int):
        self.vectors, self.width = vectors, width
        self.links = np.full((len(vectors), width), -1, dtype=np.int32)
        self.size = 0

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the best ``beam`` vectors found for each query, -1 for none."""
        out = [self._walk(queries[at : at + step], entry[at : at + step], beam) for step in [max(1, min(1024, VISITED // max(self.size, 1)))] for at in range(0, len(queries), step)]
        if not out:
            return np.empty((0, beam), np.int64), np.empty((0, beam), np.float32)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _walk(self, queries, entry, beam):
        q = len(queries)
        seen = np.zeros((q, self.size), dtype=bool)
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -np.inf, dtype=np.float32)
        spent = np.ones((q, beam), dtype=bool)
        ids[:, 0], spent[:, 0] = entry, False
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entry])
        seen[np.arange(q), entry] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(spent[live], -np.inf, sims[live])
            step = min(STEP, beam)
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step]
            usable = np.take_along_axis(open_, pick, 1) > -np.inf
            some = usable.any(axis=1)
            live, pick, usable = live[some], pick[some], usable[some]
            if not len(live):
                break
            spent[live[:, None], pick] = True
            near = np.where(usable[:, :, None], self.links[np.where(usable, ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            new = np.full(near.shape, -np.inf, dtype=np.float32)
            new[r, c] = np.einsum("kd,kd->k", queries[live[r]], self.vectors[near[r, c]])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], new], axis=1)
            all_spent = np.concatenate([spent[live], ~fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            spent[live] = np.take_along_axis(all_spent, best, 1)
        return ids, sims

    def insert(self, upto: int, entry) -> None:
        """Insert the vectors up to position ``upto``; ``entry`` gives start positions for queries."""
        while self.size < upto:
            new = np.arange(self.size, min(upto, self.size + max(64, min(self.size, 1024))))
            v = self.vectors[new]
            mates = v @ v.T
            np.fill_diagonal(mates, -np.inf)
            few = min(len(new) - 1, BUILD_BEAM // 2)
            near = np.argpartition(-mates, few - 1, axis=1)[:, :few] if few else np.empty((len(new), 0), int)
            ids, sims = new[near], np.take_along_axis(mates, near, 1)
            if self.size:
                at = entry(v)
                found, found_sims = self.search(v, np.where(at < self.size, at, 0), BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, found_sims], axis=1)
            self.links[new] = self._choose(ids, sims, self.width)
            self.size = int(new[-1]) + 1
            self._link_back(new)

    def _choose(self, ids, sims, most: int) -> np.ndarray:
        """Spread neighbours: one closer to a chosen neighbour than to the vector comes last."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.vectors[np.maximum(ids, 0)]
        between = np.einsum("nid,njd->nij", v, v)
        n, k = ids.shape
        closest = np.full((n, k), -np.inf, dtype=np.float32)
        rank = np.full((n, k), 2 * k, dtype=np.int64)
        for i in range(k):
            good = (ids[:, i] >= 0) & (closest[:, i] < sims[:, i])
            rank[good, i] = i
            rank[~good, i] = k + i
            closest = np.where(good[:, None], np.maximum(closest, between[:, i]), closest)
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((n, most), -1, dtype=np.int32)
        out[:, : keep.shape[1]] = np.take_along_axis(ids, keep, 1)
        return out

    def _link_back(self, new) -> None:
        to = self.links[new].ravel()
        source = np.repeat(new, self.width)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        most = 2 * BUILD_BEAM - self.width
        for at in range(0, len(nodes), 512):
            part = slice(at, at + 512)
            wide = int(min(count[part].max(), most))
            extra = np.full((len(nodes[part]), wide), -1, dtype=np.int64)
            for i, (f, c) in enumerate(zip(first[part], count[part])):
                extra[i, : min(c, wide)] = source[f : f + min(c, wide)]
            ids = np.concatenate([self.links[nodes[part]], extra], axis=1).astype(np.int64)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("nd,nkd->nk", self.vectors[nodes[part]], self.vectors[np.maximum(ids, 0)])
            self.links[nodes[part]] = self._choose(ids, np.where(ids >= 0, sims, -np.inf), self.width)


class Graph:
    """Layers over nested prefixes of the vectors; the first is the sparsest."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        sizes = [len(vectors)]
        while sizes[-1] > 4 * NEIGHBOURS:
            sizes.append(sizes[-1] // NEIGHBOURS)
        self.layers = []
        for size in reversed(sizes):
            layer = Layer(vectors[:size], 2 * NEIGHBOURS if size == len(vectors) else NEIGHBOURS)
            layer.insert(size, self._entry)
            self.layers.append(layer)

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        at = np.zeros(len(queries), dtype=np.int64)
        for layer in self.layers:
            ids, sims = layer.search(queries, at, 4)
            at = ids[np.arange(len(ids)), sims.argmax(axis=1)]
        return at

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Positions of similarity ``least`` or more, and which queries have more than FULL of them. A
        beam that is full of them is doubled until then."""
        *upper, base = self.layers
        at = np.zeros(len(queries), dtype=np.int64)
        for layer in upper:
            ids, sims = layer.search(queries, at, 4)
            at = ids[np.arange(len(ids)), sims.argmax(axis=1)]
        out, many = [np.empty(0, np.int64)] * len(queries), np.zeros(len(queries), bool)
        todo = np.arange(len(queries))
        while len(todo):
            beam = min(beam, base.size)
            ids, sims = base.search(queries[todo], at[todo], beam)
            linked = sims >= least
            many[todo] = linked.sum(axis=1) > FULL
            full = linked.all(axis=1) & (beam < base.size) & ~many[todo]
            for k in np.flatnonzero(~full & ~many[todo]):
                out[todo[k]] = ids[k][linked[k]]
            todo, beam = todo[full], 2 * beam
        return out, many


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square over- or underflows."""
    flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _build(table: pa.Table) -> pa.Table:
    # The insertion order must not follow the input: the layers are prefixes of it.
    table = table.take(pa.array(np.argsort(np.asarray(table["h1"]) * np.int64(-7046029254386353131))))
    unit = _matrix(table["v"])
    graph = Graph(unit.astype(np.float32))
    blob = pickle.dumps((unit, [x.links for x in graph.layers], *(np.asarray(table[c]) for c in ("rep", "h1", "m"))), protocol=5)
    return pa.table([table["d"][:1], table["parts"][:1], table["shard"][:1], pa.array([blob], pa.binary())], names=["d", "parts", "shard", "graph"])


def _load(blob: bytes):
    unit, links, rep, h1, m = pickle.loads(blob)
    graph = Graph.__new__(Graph)
    graph.vectors = unit.astype(np.float32)
    graph.layers = []
    for part in links:
        layer = Layer.__new__(Layer)
        layer.vectors, layer.width, layer.links, layer.size = graph.vectors[: len(part)], part.shape[1], part, len(part)
        graph.layers.append(layer)
    return unit, graph, rep, h1, m


def _exact(unit, queries, threshold) -> list[np.ndarray]:
    """Positions within the threshold by brute force, in blocks of queries and vectors."""
    out = []
    for at in range(0, len(queries), 1024):
        part = [np.nonzero(queries[at : at + 1024] @ unit[i : i + 16384].T >= threshold - SLACK) for i in range(0, len(unit), 16384)]
        a, b = np.concatenate([p[0] for p in part]), np.concatenate([p[1] + 16384 * k for k, p in enumerate(part)])
        order = np.argsort(a, kind="stable")
        out += np.split(b[order], np.searchsorted(a[order], np.arange(1, min(1024, len(queries) - at))))
    return out


def _checked(unit, queries, found, threshold):
    """(query, position) of the found pairs whose cosine reaches the threshold in double precision."""
    a = np.repeat(np.arange(len(found)), [len(f) for f in found])
    b = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    good = np.concatenate([*(np.einsum("kd,kd->k", queries[a[i : i + 65536]], unit[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)), np.empty(0, bool)])
    return a[good], b[good]


_LINKS = "rep long, h1 long, links long, a long, b long"


class _Tally:
    """Links of two shards: weighted counts for both, and labels of what hangs together."""

    def __init__(self, left: int, right: int, own: bool):
        self.counts = np.zeros(left, np.int64), np.zeros(right, np.int64)
        self.label, self.left = np.r_[np.arange(left), np.arange(right) + (0 if own else left)], left

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[self.left + b]
        differ = a != b
        pairs = np.unique(np.stack([a[differ], b[differ]]), axis=1)
        if pairs.shape[1]:
            self.label = roots(len(self.label), pairs[0], pairs[1])[self.label]


def _exact_rows(rows: np.ndarray, unit: np.ndarray, threshold: float):
    """(row, position) of all pairs of the given rows by brute force, in blocks of bounded size."""
    for at in range(0, len(rows), 256):
        for i in range(0, len(unit), 8192):
            a, b = np.nonzero(rows[at : at + 256] @ unit[i : i + 8192].T >= threshold - SLACK)
            good = np.einsum("kd,kd->k", rows[at + a], unit[i + b]) >= threshold
            yield at + a[good], i + b[good]


def _links(threshold: float, beam: int, table: pa.Table) -> pa.Table:
    """The links between the vectors of two shards (one with itself, if the table has one row): for each
    vector the number of vectors linked, and spanning links. Pairs of vectors are kept only while there
    are FULL or fewer of a vector; the others come from brute force, block by block."""
    shards = [_load(g.as_py()) for g in table["graph"]]
    (lu, lg, lrep, lh, lm), (ru, rg, rrep, rh, rm) = shards[0], shards[-1]
    own = len(shards) == 1
    tally = _Tally(len(lu), len(ru), own)

    def search(queries, graph):
        if not beam:
            return [np.empty(0, np.int64)] * len(queries), np.ones(len(queries), bool)
        return graph.within(queries.astype(np.float32), threshold - SLACK, beam)

    def count(a, b, left=True, right=True):
        if own:
            a, b = a[a != b], b[a != b]
        if left:
            tally.counts[0][:] += np.bincount(a, weights=rm[b], minlength=len(lu)).astype(np.int64)
        if right:
            tally.counts[1][:] += np.bincount(b, weights=lm[a], minlength=len(ru)).astype(np.int64)
        tally.tie(a, b)

    found, hot = search(lu, rg)
    back, hot_back = (found, hot) if own else search(ru, lg)
    code = []
    for lists, flip in ((found, False), (back, True)):
        a, b = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
        a, b = (b, a) if flip else (a, b)
        ok = ~hot[a] & ~hot_back[b]
        code.append(a[ok] * len(ru) + b[ok])
    code = np.unique(np.concatenate(code))
    for at in range(0, len(code), 1 << 18):
        a, b = np.divmod(code[at : at + (1 << 18)], len(ru))
        good = np.einsum("kd,kd->k", lu[a], ru[b]) >= threshold
        count(a[good], b[good], right=not own)
    for a, b in _exact_rows(lu[hot], ru, threshold):
        a = np.flatnonzero(hot)[a]
        # A hot vector of one shard meets every other hot one from both sides.
        count(a, b, right=False)
        rest = ~hot[b] if own else np.ones(len(b), bool)
        if own:
            tally.counts[0][:] += np.bincount(b[rest], weights=lm[a[rest]], minlength=len(lu)).astype(np.int64)
        else:
            tally.counts[1][:] += np.bincount(b, weights=lm[a], minlength=len(ru)).astype(np.int64)
    if not own:
        for b, a in _exact_rows(ru[hot_back], lu, threshold):
            b = np.flatnonzero(hot_back)[b]
            rest = ~hot[a]
            count(a[rest], b[rest])
    # Equal vectors are one vector; a shard has each once, so only counts of others are here.
    sides = [(lrep, lh, tally.counts[0])] + ([] if own else [(rrep, rh, tally.counts[1])])
    rep, h1, links = (np.concatenate([side[i] for side in sides]) for i in range(3))
    some, every = links > 0, np.r_[lrep, rrep]
    tied = np.flatnonzero(tally.label[: len(rep)] != np.arange(len(rep)))
    none = lambda n: pa.nulls(n, pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("rep", "h1", "links", "a", "b")])
    counts = pa.table([pa.array(rep[some]), pa.array(h1[some]), pa.array(links[some]), none(some.sum()), none(some.sum())], schema=schema)
    ties = pa.table([none(len(tied)), none(len(tied)), none(len(tied)), pa.array(every[tied]), pa.array(every[tally.label[tied]])], schema=schema)
    return pa.concat_tables([counts, ties])


def _audit(threshold: float, graphs: pa.Table, queries: pa.Table) -> pa.Table:
    """For each beam and audit query the links to others found in one shard, and those by brute force.
    Once a beam finds all links, larger ones are not tried."""
    rows = []
    if graphs.num_rows and queries.num_rows:
        unit, graph, rep, h1, _ = _load(graphs["graph"][0].as_py())
        q, qrep, qh1 = _matrix(queries["v"]), np.asarray(queries["rep"]), np.asarray(queries["h1"])

        def links(found, many=None):
            a, b = _checked(unit, q, found, threshold)
            n = np.bincount(a[(qrep[a] != rep[b]) | (qh1[a] != h1[b])], minlength=len(q))
            return n if many is None else np.where(many, exact, n)

        exact = links(_exact(unit, q, threshold))
        found = np.zeros_like(exact)
        for beam in BEAMS if exact.any() else ():
            if (found < exact).any():
                found = links(*graph.within(q.astype(np.float32), threshold - SLACK, beam))
            rows += [(beam, *x) for x in zip(qrep, qh1, found, exact) if x[3]]
    d = pa.array([graphs["d"][0].as_py()] * len(rows) if rows else [], pa.int32())
    return pa.table([d, *(pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(5))], names=["d", "beam", "rep", "h1", "found", "exact"])


def passing(recall, target: float) -> int:
    """The smallest beam whose recall of (beam, pooled, mean, n) reaches the target both over all links and
    as the mean of the queries that have links; 0 (brute force) if there is none, or too few queries have links
    for a verdict."""
    good = {r["beam"] for r in recall if r["n"] >= AUDIT_LINKED and r["pooled"] >= target and r["mean"] >= target}
    return min(good, default=0)


def audited_beams(graphs: DataFrame, reps: DataFrame, sizes: DataFrame, threshold: float, target: float) -> dict[int, int]:
    """The beam for vectors of each length. A round that finds too few vectors with links asks more of them; where the
    last one does too, or all have been asked, no beam has a verdict and all is brute force."""
    todo, beams = {r["d"]: r["count"] for r in sizes.select("d", "count").collect()}, {}
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    for most in AUDIT_QUERIES:
        if not todo:
            break
        # Those whose hash is low enough: about as many as asked for, without an order over all.
        drawn = F.shiftrightunsigned(F.xxhash64("h1", "rep"), 1) <= F.least(F.lit(1.0), most / F.col("count")) * float(1 << 63)
        sample = reps.filter(F.col("d").isin([*todo])).filter(drawn).withColumn("shard", everywhere).select("d", "shard", "rep", "h1", "v")
        audit = graphs.groupBy("d", "shard").cogroup(sample.groupBy("d", "shard")).applyInArrow(lambda g, q: _audit(threshold, g, q), "d int, beam long, rep long, h1 long, found long, exact long")
        audit = audit.groupBy("d", "beam", "rep", "h1").agg(F.sum("found").alias("found"), F.sum("exact").alias("exact"))
        recall = audit.groupBy("d", "beam").agg((F.sum("found") / F.sum("exact")).alias("pooled"), F.avg(F.col("found") / F.col("exact")).alias("mean"), F.count("*").alias("n")).collect()
        for d in list(todo):
            own = [r for r in recall if r["d"] == d]
            if todo[d] <= most or max((r["n"] for r in own), default=0) >= AUDIT_LINKED:
                beams[d] = passing(own, target)
                del todo[d]
    return beams | dict.fromkeys(todo, 0)


def usable(vector) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.coalesce(F.when(bad, False).otherwise(largest > 0), F.lit(False))


def near_embeddings(rows: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, target: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Equal vectors are indexed once with their number. A vector that is null or zero, has null or
    non-finite components, or has a null vec_id links with nothing. Vectors of different length are
    never compared. A repeated vec_id belongs to the groups of all its vectors. Lengths of any scale count, from the least
    double to the greatest. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    reps = rows.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    reps = materialize(reps.withColumn("d", F.size("v")), "hnsw-vectors")
    # Shards of vectors of one length, each bounded in rows and bytes; h2 deals the vectors out.
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(SHARD_BYTES / (8 * F.col("d") + 8 * NEIGHBOURS))))
    sizes = reps.groupBy("d").count().withColumn("parts", F.greatest(F.lit(shards), F.ceil(F.col("count") / most))).select("d", "parts", "count")
    reps = reps.join(sizes, "d").withColumn("shard", F.pmod("h2", F.col("parts")))
    # Small shards too are built side by side: partitions asked for by number aren't put together again.
    many = 4 * int(sizes.agg(F.sum("parts")).first()[0] or 1)
    graphs = materialize(reps.select("d", "parts", "shard", "rep", "h1", "m", "v").repartition(many, "d", "shard").groupBy("d", "shard").applyInArrow(lambda t: _build(t), "d int, parts long, shard long, graph binary"), "hnsw-graphs")
    beams = audited_beams(graphs, reps, sizes, threshold, target)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = graphs.withColumn("other", everywhere).select("d", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "graph")
    found = materialize(cells.groupBy("d", "low", "high").applyInArrow(lambda t: _links(threshold, beams[t["d"][0].as_py()], t), _LINKS), "hnsw-links")
    release(graphs)
    # A repeated vec_id ties the vectors that it stands for.
    named = rows.filter("ok").select("vec_id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep").distinct()
    again = named.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b < last").select("vec_id", "b")
    ties = found.filter("a is not null").select("a", "b").unionByName(named.join(again, "vec_id").select(F.col("rep").alias("a"), "b"))
    groups = connected_components(ties, "hnsw-components")
    counts = found.filter("links is not null").groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    named = reps.select("h1", "h2", "rep", "m").join(counts, ["rep", "h1"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select(F.lit(True).alias("ok"), "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "ok", "h1", "h2").join(named, ["ok", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
