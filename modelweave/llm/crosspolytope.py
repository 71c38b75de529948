"""Near-duplicate embeddings by cross-polytope hashing.

Method: a vector is rotated by three rounds of random signs and fast Hadamard transforms; the
nearest corner of the cross-polytope, the coordinate of the largest size with its sign, is a hash
value, and three of them make a bucket of a table.  Besides its own bucket a vector enters the
PROBES - 1 next best ones, by what their corners fall short.  Pairs that share a bucket are verified
by their cosine in double precision.  At a cosine of 0.98 a table misses a pair with a probability of
about 0.14, and all TABLES tables with less than one in a million.

Only vectors with equal labels that aren't null are compared.

Defined cases: vectors that are null, zero or hold null or non-finite components, and those without a
label, link with nothing; vectors of different lengths don't link; repeated rows link with each other
and count each; null ids are counted as links, their own component is the smallest other id or
null, and they are kept if that is null; an empty table gives no rows; extra columns are ignored.

Scale: equal vectors of a label are one class with a count, so copies are never expanded.  Buckets
with a single class are dropped before vectors are shuffled.  A large bucket is compared in blocks
of BLOCK x BLOCK, in separate tasks, which return a row per class and the links of a spanning forest
instead of all pairs.  A pair that meets in several buckets is counted in the first of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .vectors import usable

TABLES, CORNERS, PROBES = 8, 3, 3
BLOCK = 512
#: Shorter vectors are padded with zeros, as random signs and Hadamard transforms of few components give few rotations.
LEAST_WIDTH = 16
SEED = 611
_COMBOS = np.array(list(itertools.product(range(3), repeat=CORNERS)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, up to a factor."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """[rows, TABLES * PROBES] keys; the columns of a table are neighbours, the best bucket first."""
    width = max(LEAST_WIDTH, 1 << (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([SEED, width]).choice([-1.0, 1.0], (TABLES, CORNERS, 3, width))
    row = np.arange(len(x))[:, None]
    keys = []
    for t in range(TABLES):
        codes, short = [], []
        for c in range(CORNERS):
            y = x
            for s in signs[t, c]:
                y = hadamard(y * s) / np.sqrt(width)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :3]
            codes.append(2 * top + (y[row, top] < 0))
            short.append((size[row, top[:, :1]] - size[row, top]) ** 2)
        cost = sum(short[c][:, _COMBOS[:, c]] for c in range(CORNERS))
        best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        joint = np.full((len(x), len(_COMBOS)), t, np.int64)
        for c in range(CORNERS):
            joint = joint * (2 * width) + codes[c][:, _COMBOS[:, c]]
        keys.append(np.take_along_axis(joint, best, 1))
    return np.concatenate(keys, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keyed(classes: DataFrame) -> DataFrame:
    schema = "c long, keys array<long>"
    out = common.pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2048):
            sizes = np.array(batch["embedding"].value_lengths().to_pylist())
            for n in np.unique(sizes):
                own = batch.filter(pa.array(sizes == n))
                keys = bucket_keys(_matrix(own["embedding"]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([own["c"], pa.array(list(keys), pa.list_(pa.int64()))], schema=out)

    return classes.select("c", "embedding").mapInArrow(run, schema)


def compare(threshold: float):
    """For each block task: (class, null, linked vectors) rows and (class, class, null) links of a forest."""
    out = common.pa_schema("a long, b long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            tasks = batch["task"].to_numpy()
            cuts = np.flatnonzero(np.diff(tasks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(tasks)]):
                if a == b:
                    continue
                if held and tasks[a] != task:
                    yield block(held)
                    held = []
                task = tasks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        side, c, m, key = (rows[x].to_numpy(zero_copy_only=False) for x in ("side", "c", "m", "key"))
        keys, v = _matrix(rows["keys"]), _matrix(rows["embedding"]).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        one = not (side == 1).any() or not (side == 0).any()
        left = np.arange(len(c)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        close = v[left] @ v[right].T >= threshold
        if one:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        i, j = left[i], right[j]
        place = (keys == key[:, None]).argmax(1)  # where a row's list of buckets has this one; earlier tables come first
        first = np.ones(len(i), bool)
        table = place // PROBES
        for t in range(TABLES):
            own = slice(t * PROBES, (t + 1) * PROBES)
            for p, q in itertools.product(range(PROBES), repeat=2):
                same = keys[i, own][:, p] == keys[j, own][:, q]
                # met in an earlier table, or in this one in a bucket that comes first by its key
                first &= ~(same & ((t < table[i]) | ((t == table[i]) & (keys[i, own][:, p] < key[0]))))
        i, j = i[first], j[first]
        n = np.bincount(i, m[j], len(c)) + np.bincount(j, m[i], len(c))
        root = list(range(len(c)))
        forest = []
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = a, b
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((a, b))
        some = np.flatnonzero(n)
        a = np.concatenate([c[some], c[[x for x, _ in forest]]]) if forest else c[some]
        b = [None] * len(some) + c[[y for _, y in forest]].tolist() if forest else [None] * len(some)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n[some].astype(np.int64).tolist() + [None] * len(forest), pa.int64())], schema=out)

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of ``embeddings``."""
    own = usable(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    for salt in range(8):
        rows = common.spread(own.withColumn("c", F.when(F.col("ok") & F.col("label").isNotNull(), F.xxhash64(F.lit(salt), "label", F.size("embedding"), "embedding"))))
        grouped = rows.where("c IS NOT NULL").groupBy("c", "label", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"))
        classes = common.durable(grouped, "classes")
        # classes are grouped by the vectors themselves; if two share a hash, another one names them
        if classes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        common.drop(classes)
    keyed = common.durable(_keyed(classes), "keyed")
    each = keyed.join(classes.select("c", F.xxhash64("label", F.size("embedding")).alias("l")), "c").select("c", "l", F.explode("keys").alias("key"))
    full = each.groupBy("l", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("l").alias("l_"), F.col("key").alias("key_"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    shared = each.join(full, (F.col("l") == F.col("l_")) & (F.col("key") == F.col("key_")))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks"))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct((mine > o).cast("int").alias("side"), F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y")))
    dealt = shared.select("c", "l", "key", F.explode(tasks).alias("t")).select("c", "key", F.xxhash64("l", "key", "t.x", "t.y").alias("task"), "t.side")
    dealt = dealt.join(keyed, "c").join(classes.select("c", "m", "embedding"), "c")
    found = dealt.repartition("task").sortWithinPartitions("task", "c").mapInArrow(compare(threshold), "a long, b long, n long")
    found = common.durable(found, "links")
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "c")
    # the class of a component is any hash; its id is the smallest of its members'
    parts = components(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "c", "component": "root"})
    named = classes.select("c", "m", "rep").join(parts, "c", "left").withColumn("root", F.coalesce("root", "c"))
    low = named.groupBy("root").agg(F.min("rep").alias("low"))
    named = named.join(low, "root").join(counts, "c", "left").select(F.col("c").alias("c_"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "low")
    out = rows.select("vec_id", "c").join(named, F.col("c") == F.col("c_"), "left")
    component = F.coalesce("low", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
