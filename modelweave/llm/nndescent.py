"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Method: a neighbour graph of K neighbours per vector begins with exact neighbours within blocks of
FORESTS random divisions of the space.  Then ITERATIONS rounds of NN-descent improve it: each vector
gathers a sample of its new and old neighbours and of those that have it as a neighbour, and every two
of these that meet there may become each other's neighbours (joins of neighbours of neighbours).
A query starts at its own neighbours and walks the graph greedily: in each of STEPS rounds the EXPAND
best vectors of its list of BEAM whose neighbours weren't looked at yet are expanded.

Equal vectors are one class, known by the 64-bit hash of its components; graph and search see each
class once, and every class found stands for the smallest of its ids.  Graph and search use single
precision, with each vector divided by a power of two of its own, so neither large nor small ones lose
digits; the final list is scored on the original vectors in double precision.

Defined cases: vectors that are null, zero or hold null or non-finite components, of another length
than most (the shortest, among equals), or with a null id take no part, neither as queries; rows that
repeat an id count once, with the first of its vectors by order; with at most 20 candidates a query
gets all; ties go to the smaller id; an empty table gives no rows; extra columns are ignored.

Scale: a round shuffles K rows per vector, and per task of PART vectors each vector that it needs
once; no task holds more than PART * 4 * SAMPLE vectors of PART_WIDTH components, or as many numbers in
longer ones.  The divisions cut the space into blocks of about BLOCK vectors; blocks that are larger are
worked through in pieces, and those of over LARGE * BLOCK vectors, which are counted, in several tasks.  How
many vectors may have one vector as a neighbour isn't limited, but of those SAMPLE are gathered a
round, before they are shuffled.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import usable

K, SAMPLE, UPDATES = 48, 16, 4
FORESTS, BLOCK, FIRST = 16, 1024, 8
ITERATIONS, STEPS, EXPAND, BEAM = 4, 3, 16, 96
#: Blocks that hold more than so many times BLOCK vectors are dealt over several tasks.
LARGE = 16
#: Vectors of a task's own and the length of vectors up to which that holds; longer vectors make smaller tasks.
PART, PART_WIDTH = 4096, 64
SEED = 404


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision vectors, each divided by a power of two of its own, and these powers (up to a common factor)."""
    power = np.frexp(np.abs(v).max(1, initial=0))[1]
    return np.ldexp(v, -power[:, None]).astype(np.float32), np.ldexp(1.0, power - 32)


def _planes(forest: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, forest, dim]).normal(size=(dim, 64))[:, :bits]


def best_per(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int, old: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k best distinct others of each owner, in order; of repeated ones an old one stays."""
    order = np.lexsort((other, owner) if old is None else (~old, other, owner))
    o, p = owner[order], other[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1])
    order = order[fresh]
    order = order[np.lexsort((-score[order], owner[order]))]  # stable: ties stay in the order of the others
    o = owner[order]
    begins = np.ones(len(o), bool)
    begins[1:] = o[1:] != o[:-1]
    place = np.arange(len(o)) - np.maximum.accumulate(np.where(begins, np.arange(len(o)), 0))
    return order[place < k]


def _first_graph(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """Candidates (p, q, s) of the blocks of random divisions."""
    bits = max(0, min(62, int(np.round(np.log2(max(1, n) / BLOCK)))))
    schema = "p long, q long, s double"
    out = common.pa_schema(schema)

    def sides(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in common.slices(batches, 2048):
            v, _ = scaled(_vectors(batch["v"]))
            for f in range(FORESTS):
                side = (v @ _planes(f, bits, dim) > 0) @ weights if bits else np.zeros(len(v), np.int64)
                block = [pa.array(np.full(len(v), f, np.int32)), pa.array(side.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch["id"], *block, batch["v"]] if whole else block, names=["id", "forest", "side", "v"] if whole else ["forest", "side"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own, size = None, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            v, m = scaled(np.concatenate([x[1] for x in held]))
            s = (v @ v.T) * m
            np.fill_diagonal(s, -np.inf)
            t = min(FIRST, len(ids) - 1)
            best = np.argpartition(-s, t - 1, axis=1)[:, :t] if t else np.zeros((len(ids), 0), int)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, t)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], schema=out)

        for batch in batches:
            key = np.stack([batch["forest"].to_numpy().astype(np.int64), batch["side"].to_numpy()], 1)
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            ids, v = batch["id"].to_numpy(), _vectors(batch["v"])
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                while a < b:
                    if held and (own != tuple(key[a]) or size >= 2 * BLOCK):
                        yield flush()
                        held, size = [], 0
                    own = tuple(key[a])
                    stop = min(b, a + 2 * BLOCK - size)
                    held.append((ids[a:stop], v[a:stop]))
                    size += stop - a
                    a = stop
        if held:
            yield flush()

    own = vectors.select("id", "v")
    # a block that holds more than one task should get is dealt over several
    counted = own.mapInArrow(lambda x: sides(x, False), "forest int, side long").groupBy("forest", "side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE * BLOCK)
    large = common.durable(counted.select("forest", "side", F.ceil(F.col("n") / (LARGE * BLOCK)).alias("shares")), "large")
    divided = own.mapInArrow(lambda x: sides(x, True), f"id long, forest int, side long, v {vectors.schema['v'].dataType.simpleString()}")
    mixed = F.xxhash64("id", "forest")
    divided = common.join_checked(divided, large, ["forest", "side"], "left", large.count()).withColumn("share", F.pmod(mixed, F.coalesce("shares", F.lit(1)))).select("id", "forest", "side", "v", "share")
    return divided.repartition("forest", "side", "share").sortWithinPartitions("forest", "side", mixed).mapInArrow(meet, schema)


def _merge(graph: DataFrame, updates: DataFrame, parts: int, turn: int) -> DataFrame:
    """The K best neighbours per vector of graph and updates; ``pick`` marks the samples of the next
    round: 1 new, 2 old, 0 neither.  Picked new neighbours are old afterwards."""
    part = F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int").alias("part")
    schema = "p long, q long, s double, fresh boolean, pick int"
    out = common.pa_schema(schema)

    def run(rows: pa.Table) -> pa.Table:
        p, q, s, fresh = (rows[c].to_numpy() for c in ("p", "q", "s", "fresh"))
        keep = best_per(p, q, s, K, ~fresh)
        p, q, s, fresh = p[keep], q[keep], s[keep], fresh[keep].copy()
        pick = np.zeros(len(p), np.int32)
        mixed = (p * 31 + q) * np.int64(-7046029254386353131) + turn
        mixed ^= mixed >> 29
        for kind in (True, False):
            own = np.flatnonzero(fresh == kind)
            order = own[np.lexsort((mixed[own], p[own]))]
            o = p[order]
            begins = np.ones(len(o), bool)
            begins[1:] = o[1:] != o[:-1]
            place = np.arange(len(o)) - np.maximum.accumulate(np.where(begins, np.arange(len(o)), 0)) if len(o) else np.zeros(0, int)
            pick[order[place < SAMPLE]] = 1 if kind else 2
        fresh[pick == 1] = False
        return pa.Table.from_arrays([pa.array(p), pa.array(q), pa.array(s), pa.array(fresh), pa.array(pick)], schema=out)

    rows = graph.select("p", "q", "s", "fresh", part).union(updates.select("p", "q", "s", F.lit(True).alias("fresh"), part))
    return common.durable(rows.groupBy("part").applyInArrow(run, schema), "graph")


def _local_joins(graph: DataFrame, vectors: DataFrame, parts: int, turn: int) -> DataFrame:
    """Updates (p, q, s) from pairs that meet at a common neighbour, better than p's worst."""
    picked = graph.where("pick > 0")
    # of those that have a vector as a neighbour some are chosen, before they are shuffled
    backward = picked.select(F.col("q").alias("u"), F.col("p").alias("v"), "pick", F.xxhash64("p", "q", F.lit(turn)).alias("h"))
    backward = backward.withColumn("k", F.row_number().over(Window.partitionBy("u", "pick").orderBy("h"))).where(F.col("k") <= SAMPLE)
    part = F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int").alias("part")
    met = picked.select(F.col("p").alias("u"), F.col("q").alias("v"), "pick").union(backward.select("u", "v", "pick")).groupBy("u", "v").agg(F.min("pick").alias("pick")).select(part, "u", "v", "pick")
    met = common.durable(met, "met")
    worst = graph.groupBy("p").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("n")).select("p", F.when(F.col("n") >= K, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("worst"))
    sent = vectors.join(worst, F.col("id") == F.col("p"), "left").select("id", "v", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    needed = met.select((F.col("part") + 0).alias("part"), F.col("v").alias("need")).distinct().join(sent, F.col("need") == F.col("id")).select(F.col("part").alias("to"), "id", "v", "worst")
    schema = "p long, q long, s double"
    out = common.pa_schema(schema)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        ids = own["id"].to_numpy()
        order = np.argsort(ids)
        ids, worst = ids[order], own["worst"].to_numpy()[order]
        if not len(ids) or not rows.num_rows:
            return out.empty_table()
        x, m = scaled(_vectors(own["v"])[order])
        x, m = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), np.append(m, 0)
        u, v, pick = (rows[c].to_numpy() for c in ("u", "v", "pick"))
        order = np.lexsort((v, pick, u))
        u, v, pick = u[order], np.searchsorted(ids, v[order]), pick[order]
        edges = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1], [True])))
        width = 4 * SAMPLE
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(edges) - 1, 256):
            stop = min(at + 256, len(edges) - 1)
            sizes = np.diff(edges[at : stop + 1])
            span = slice(edges[at], edges[stop])
            r = np.repeat(np.arange(stop - at), sizes)
            c = np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok = c < width
            a = np.full((stop - at, width), len(ids))
            new = np.zeros((stop - at, width), bool)
            a[r[ok], c[ok]] = v[span][ok]
            new[r[ok], c[ok]] = pick[span][ok] == 1
            s = (x[a] @ x[a].transpose(0, 2, 1)) * m[a][:, None, :]
            # two old neighbours have met before
            s[~(new[:, :, None] | new[:, None, :]) | (a == len(ids))[:, :, None] | (a == len(ids))[:, None, :] | (a[:, :, None] == a[:, None, :])] = -np.inf
            best = np.argpartition(-s, UPDATES, axis=2)[:, :, :UPDATES]
            score = np.take_along_axis(s, best, 2)
            p = np.broadcast_to(a[:, :, None], best.shape)
            q = np.take_along_axis(np.broadcast_to(a[:, None, :], s.shape), best, 2)
            bound = np.append(worst, 0)[p]
            good = np.isfinite(score) & (score > bound)
            found.append((p[good], q[good], score[good]))
        p, q, s = (np.concatenate([f[k] for f in found]) for k in range(3))
        keep = best_per(p, q, s, K)
        return pa.Table.from_arrays([pa.array(ids[p[keep]]), pa.array(ids[q[keep]]), pa.array(s[keep])], schema=out)

    return met.groupBy("part").cogroup(needed.groupBy("to")).applyInArrow(run, schema)


def neighbour_graph(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """(p, q, s): the K approximate neighbours of each of n distinct vectors (id, v); s is their product up to a factor of p's."""
    parts = common.parts_for(n, max(64, PART * PART_WIDTH // max(PART_WIDTH, dim)))
    parts = max(parts, min(vectors.sparkSession.sparkContext.defaultParallelism * 2, common.parts_for(n, 256)))
    empty = vectors.sparkSession.createDataFrame([], "p long, q long, s double, fresh boolean")
    graph = _merge(empty, _first_graph(vectors, n, dim), parts, 0)
    for turn in range(1, ITERATIONS + 1):
        graph = _merge(graph, _local_joins(graph, vectors, parts, turn), parts, turn)
    return graph.select("p", "q", "s")


def _score(rows: DataFrame, vectors: DataFrame, f, schema: str) -> DataFrame:
    """Send each part of the queries its rows (part, p, q, ...) and each vector (id, v, ...) that these need, once."""
    needed = rows.select((F.col("part") + 0).alias("part"), F.explode(F.array("p", "q")).alias("need")).distinct().join(vectors, F.col("need") == F.col("id")).select(F.col("part").alias("to"), *vectors.columns)
    out = common.pa_schema(schema)

    def run(own: pa.Table, some: pa.Table) -> pa.Table:
        return f(own, some.take(np.argsort(some["id"].to_numpy())), out) if some.num_rows else out.empty_table()

    return rows.groupBy("part").cogroup(needed.groupBy("to")).applyInArrow(run, schema)


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, rows: int) -> DataFrame:
    """(p, q): the BEAM best vectors q that greedy search finds for each query p (column id)."""
    parts = common.parts_for(rows, 256)
    part = F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int").alias("part")
    beam = graph.join(queries.select(F.col("id").alias("i")), F.col("p") == F.col("i"), "left_semi").select(part, "p", "q", F.lit(None).cast("double").alias("s"), F.lit(False).alias("done"))
    schema = "p long, q long, s double, done boolean, next boolean"

    def walk(own: pa.Table, some: pa.Table, out: pa.Schema) -> pa.Table:
        ids, (x, m) = some["id"].to_numpy(), scaled(_vectors(some["v"]))
        p, q, done = (own[c].to_numpy() for c in ("p", "q", "done"))
        keep = p != q
        p, q, done = p[keep], q[keep], done[keep]
        order = np.lexsort((~done, q, p))  # an expanded one stands for its repetitions
        p, q, done = p[order], q[order], done[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        p, q, done = p[fresh], q[fresh], done[fresh]
        i, j = np.searchsorted(ids, p), np.searchsorted(ids, q)
        s = np.concatenate([np.einsum("nd,nd->n", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, max(1, len(i)), 65536)]) * m[j]
        keep = best_per(p, q, s, BEAM)
        p, q, s, done = p[keep], q[keep], s[keep], done[keep]
        chosen = np.zeros(len(p), bool)
        chosen[best_per(p[~done], q[~done], s[~done], EXPAND)] = True
        turn = np.zeros(len(p), bool)
        turn[np.flatnonzero(~done)[chosen[: (~done).sum()]]] = True
        return pa.Table.from_arrays([pa.array(p), pa.array(q), pa.array(s), pa.array(done | turn), pa.array(turn)], schema=out)

    for turn in range(STEPS + 1):
        state = common.durable(_score(beam, vectors, walk, schema), "beam")
        if turn == STEPS:
            return state.select("p", "q")
        step = state.where("next").select("p", F.col("q").alias("at"))
        reached = step.join(graph.select(F.col("p").alias("from"), "q"), F.col("at") == F.col("from")).select("p", "q").distinct()
        beam = state.select(part, "p", "q", "s", "done").union(reached.select(part, "p", "q", F.lit(None).cast("double"), F.lit(False)))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each vector whose id is divisible by ``every``."""
    own = usable(embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding"))).where("ok AND id IS NOT NULL")
    own = own.groupBy("id").agg(F.min("embedding").alias("e"))
    own = common.durable(own, "vectors")
    lengths = own.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    own = own.where(F.size("e") == lengths["d"]).withColumn("c", F.xxhash64("e"))
    # equal vectors are one: graph and search know it by its smallest id
    classes = common.durable(own.groupBy("c").agg(F.min("id").alias("id"), F.first("e").alias("v")), "classes")
    vectors = classes.select("id", "v")
    graph = neighbour_graph(vectors, vectors.count(), lengths["d"])
    queries = own.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "c")
    asked = common.durable(queries.select("c").distinct().join(classes.select("c", "id"), "c").select("id"), "asked")
    rows = asked.count()
    found = search(asked, graph, vectors, rows).union(asked.select("id", "id"))
    part = F.pmod(F.xxhash64("p"), F.lit(common.parts_for(rows, 256))).cast("int").alias("part")
    # of a class k + 1 ids are enough, as one may be the query's own
    place = F.row_number().over(Window.partitionBy("c").orderBy("id"))
    members = own.select("c", "id").withColumn("place", place).where(F.col("place") <= k + 1).groupBy("c").agg(F.collect_list("id").alias("ids"))
    classes = classes.join(members, "c").select("id", "v", "c", "ids")
    lists = "c long, ids array<long>, scores array<double>"

    def rank(own: pa.Table, some: pa.Table, out: pa.Schema) -> pa.Table:
        ids, x, c = some["id"].to_numpy(), _vectors(some["v"]).astype(np.float64), some["c"].to_numpy()
        i, j = np.searchsorted(ids, own["p"].to_numpy()), np.searchsorted(ids, own["q"].to_numpy())
        s = np.array([np.dot(x[a], x[b]) for a, b in zip(i, j)])
        sizes = some["ids"].combine_chunks().value_lengths().to_numpy()
        begins, n = np.cumsum(sizes) - sizes, sizes[j]
        q = some["ids"].combine_chunks().flatten().to_numpy()[np.repeat(begins[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        i, s = np.repeat(i, n), np.repeat(s, n)
        order = np.lexsort((q, -s, i))
        i, q, s = i[order], q[order], s[order]
        begins = np.ones(len(i), bool)
        begins[1:] = i[1:] != i[:-1]
        top = np.arange(len(i)) - np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0)) <= k
        i, q, s = i[top], q[top], s[top]
        which, at = np.unique(i, return_index=True)
        offsets = pa.array(np.append(at, len(i)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(c[which]), pa.ListArray.from_arrays(offsets, pa.array(q)), pa.ListArray.from_arrays(offsets, pa.array(s))], schema=out)

    ranked = common.durable(_score(found.select(part, "p", "q"), classes, rank, lists), "ranked")
    each = common.join_checked(queries, ranked, "c", "inner", rows * (k + 1)).select("query_id", F.arrays_zip("ids", "scores").alias("all"))
    others = F.slice(F.filter("all", lambda x: x["ids"] != F.col("query_id")), 1, k)
    each = each.select("query_id", F.posexplode(others).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
