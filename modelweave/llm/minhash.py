"""Near-duplicate documents by circulant MinHash.

Method: a document's words (ASCII letters in lower case, white space as in C) give its set of
distinct five-word shingles, hashed to 64 bits.  Two permutations make all coordinates of a
signature: the first scatters the shingles over the bins, the second, shifted by one place per
coordinate, orders them.  BANDS bands of ROWS coordinates make the buckets; pairs within a bucket are
confirmed on the full sets.

Documents are linked if 100 * intersection >= percent * union.  A pair at the limit of 85 %
shares no band with a probability of (1 - 0.85 ** 5) ** 24, about 8 in 10 million.

Groups of copies are never expanded into pairs.  Equal sets are one class.  Of each bucket, members
are compared to its smallest one, then, where they aren't yet in its component, to LEADERS members
chosen by hash; what is still apart is compared in blocks of BLOCK x BLOCK sets, of which only the
links that join components are returned.  So no pair of a bucket whose documents are in different
components stays uncompared.  A class is known by 64 bits of its digest.

Defined cases: fewer than five words are one shingle of all words; without words or text the set is
empty and linked with nothing; null ids take no part (component null, kept); rows that repeat an
id with other texts are compared by each of these and share one component; an empty table gives no
rows; extra columns are ignored.

Scale: signatures are a map; classes, buckets and leaders are grouped minima with map-side
combination; sets are shuffled only for documents that share a bucket and whose sizes allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

WORDS = 5
BANDS, ROWS = 24, 5
BINS = 1 << 20
LEADERS, BLOCK = 4, 256
SEED = 20240229

_state: dict = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the shifted one (row i: its values at i, i + 1, ...)."""
    if not _state:
        rng = np.random.default_rng(SEED)
        first, second = rng.permutation(BINS).astype(np.int32), rng.permutation(BINS).astype(np.int32)
        wide = np.concatenate([second, second[: BANDS * ROWS]])
        _state["p"] = first, np.lib.stride_tricks.sliding_window_view(wide, BANDS * ROWS)
        _state["odd"] = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        _state["words"] = {}
    return _state["p"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    _permutations()
    known: dict[bytes, int] = _state["words"]
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 400_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    joint = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        joint = _mix(joint * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(len(h) if len(h) < size else size))
    return np.unique(joint)


def _forget() -> None:
    _state.get("words", {}).clear()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, BANDS * ROWS] coordinates of non-empty sets."""
    first, windows = _permutations()
    out = np.empty((len(sets), BANDS * ROWS), np.int32)
    at = 0
    while at < len(sets):
        stop, rows = at, 0
        while stop < len(sets) and (stop == at or rows + len(sets[stop]) <= 20_000):
            rows += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *map(len, sets[at : stop - 1])])
        bins = first[(flat & np.uint64(BINS - 1)).astype(np.int64)]
        if rows <= 20_000:
            wide = windows[bins]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], rows]), at):
                out[k] = wide[a:b].min(0)
        else:  # one large set
            out[at] = np.min([windows[bins[k : k + 20_000]].min(0) for k in range(0, rows, 20_000)], axis=0)
        at = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """[sets, BANDS] bucket keys."""
    own = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mix((own * _state["odd"]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), digest of the set (null if empty), bands (bucket keys)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch["text"].to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[k] for k in full])) if full else []
        bands: list = [[] for _ in sets]
        for k, row in zip(full, keys):
            bands[k] = row
        return {"doc_id": batch["doc_id"], "t": batch["t"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "bands": bands}

    return common.map_arrow(_texts(docs), run, "doc_id long, t long, n long, digest binary, bands array<long>", done=_forget)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _sets(docs: DataFrame) -> DataFrame:
    """id and shingles (as signed 64-bit)."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch["id"], "s": [shingles(t).view(np.int64) for t in batch["text"].to_pylist()]}

    return common.map_arrow(docs, run, "id long, s array<long>", done=_forget)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")  # a is the leader: many rows share its set
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("i", inter).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def links(reps: DataFrame, docs: DataFrame, percent: int = 85) -> DataFrame:
    """Links (a, b) between classes (rep, first, n, bands) that give the components of all links."""
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    spark = docs.sparkSession
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lead")).where("size > 1")
    members = common.durable(rows.join(counted, "key").withColumnRenamed("rep", "id"), "buckets")
    wanted = members.select("id").distinct()
    wanted = common.durable(wanted.join(reps.select(F.col("rep").alias("id"), F.col("first.doc_id").alias("d"), F.col("first.t").alias("h")), "id"), "wanted")
    # of rows that repeat an id, those with the text that stands for its class
    chosen = common.join_checked(_texts(docs), wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("h")), "inner", wanted.count())
    sets = common.durable(_sets(chosen.select("id", "text")).dropDuplicates(["id"]), "sets")

    sizes = F.expr(f"100 * least(n, nb) >= {percent} * greatest(n, nb)")
    leads = reps.select(F.col("rep").alias("lead"), F.col("n").alias("nb"))
    star = members.where("id <> lead").select("id", "n", "lead").distinct().join(leads, "lead").where(sizes)
    found = common.durable(_confirmed(star.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), sets, percent), "found")
    placed = _placed(members, found)
    finished = [members, wanted, sets, found, placed]

    # members apart from their bucket's component: some others, chosen by hash
    others = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "component")).alias(f"o{k}") for k in range(LEADERS)]
    mixed = placed.where("size > 2").groupBy("key").agg(*others, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    probes = placed.join(mixed.select("key", F.explode(F.array(*(f"o{k}" for k in range(LEADERS)))).alias("o")), "key")
    probes = probes.where("component <> o.component").select(F.col("o.id").alias("a"), F.col("id").alias("b"), "n", F.col("o.n").alias("nb")).where(sizes)
    found = common.durable(found.union(_confirmed(probes.select("a", "b").distinct(), sets, percent)), "found")
    placed = _placed(members, found)
    finished += [found, placed]

    # what is still apart: blocks
    parts = placed.where("size > 2").groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("component", "c").alias("main"), F.max("c").alias("main_size"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = mixed.select("key", "main", F.ceil((F.col("all") - F.col("main_size")) / BLOCK).alias("outer"), F.ceil(F.col("main_size") / BLOCK).alias("inner"))
    blocks = placed.join(mixed, "key").withColumn("h", F.xxhash64("id"))
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.pmod("h", "inner")).otherwise(F.pmod("h", "outer"))
    # a main block meets every outer block, an outer block every main and every outer block
    tasks = F.when(is_main, F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.struct(F.lit(1).alias("kind"), F.lit(0).alias("side"), own.alias("x"), o.alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda m: F.struct(F.lit(1).alias("kind"), F.lit(1).alias("side"), m.alias("x"), own.alias("y"))),
            F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.struct(F.lit(2).alias("kind"), (own > o).cast("int").alias("side"), F.least(own, o).alias("x"), F.greatest(own, o).alias("y"))),
        )
    )
    dealt = blocks.select("key", "id", "component", F.explode(tasks).alias("t")).select(F.xxhash64("key", "t.kind", "t.x", "t.y").alias("task"), "t.side", "id", "component")
    dealt = dealt.join(sets, "id")
    schema = "a long, b long"
    last = dealt.repartition("task").sortWithinPartitions("task", "id").mapInArrow(_compare_blocks(percent), schema)
    found = common.durable(found.union(last), "found")
    common.drop(*finished)
    return found


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members with their component so far."""
    known = components(found).withColumnRenamed("node", "id")
    return common.durable(members.drop("lead").join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")


def _compare_blocks(percent: int):
    out = common.pa_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def flush() -> pa.RecordBatch:
            pairs = block_links(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=out)

        for batch in common.slices(batches, 256):
            sets = batch["s"]
            for k, (own, side, i, component) in enumerate(zip(*(batch[x].to_pylist() for x in ("task", "side", "id", "component")))):
                if own != task:
                    if held:
                        yield flush()
                    task, held = own, []
                held.append((side, i, component, sets[k].values.to_numpy(zero_copy_only=False)))
        if held:
            yield flush()

    return run


def block_links(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of rows (side, id, component, sorted set) that join different components.

    Sides 0 and 1 are compared with each other; rows of one side only, with one another.
    """
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1] or left
    if not left:
        left = right
    flat = np.concatenate([r[3] for r in right])
    owner = np.repeat(np.arange(len(right)), [len(r[3]) for r in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(r[3]) for r in right])
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    found = []
    for _, i, component, own in left:
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        counts = hi - lo
        total = int(counts.sum())
        if not total:
            continue
        place = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(total)
        inter = np.bincount(owner[place], minlength=len(right))
        for k in np.flatnonzero(100 * inter >= percent * (sizes + len(own) - inter)).tolist():
            a, b = top(component), top(right[k][2])
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((i, right[k][1]))
    return found


def _same_id(own: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat an id with other texts."""
    rows = own.where("digest IS NOT NULL").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id", "low")
    return rows.join(several, "doc_id").where("digest <> low").select(F.xxhash64("low").alias("a"), F.xxhash64("digest").alias("b")).distinct()


def _grouped(own: DataFrame, docs: DataFrame, percent: int, more: DataFrame | None = None) -> DataFrame:
    """digest and, of the component of its class, the smallest (doc_id, t), null ids last; ``own``: rows of ``describe``,
    ``more``: links besides those of near-duplicates."""
    rows = own.where("digest IS NOT NULL").withColumn("first", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    classes = rows.groupBy("digest").agg(F.min("first").alias("first"), F.min_by("bands", "first").alias("bands"), F.first("n").alias("n"))
    classes = common.durable(classes.withColumn("rep", F.xxhash64("digest")), "classes")
    found = links(classes, docs, percent)
    known = common.durable(components(found.union(more) if more is not None else found), "components")
    # the class of a component is any hash; what it is called is the smallest of its members'
    low = known.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("low"))
    low = common.durable(low, "low")
    known = common.join_checked(known, low, "component", "inner", low.count()).select(F.col("node").alias("rep"), "low")
    return classes.select("digest", "rep", "first").join(known, "rep", "left").select(F.col("digest").alias("d"), F.coalesce("low", "first").alias("low"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``."""
    own = common.durable(describe(docs), "signatures")
    some = own.where("doc_id IS NOT NULL")
    named = _grouped(some, docs, percent, _same_id(some)).select("d", F.col("low.doc_id").alias("c"))
    out = own.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of each group of near-duplicates exactly one row: that with the smallest
    id, null last, and of rows that share it that with the smallest hash of its text.  Each row is judged by its own
    text, also where ids repeat or are null.  Documents without words are in no group and stay."""
    own = common.durable(describe(docs), "signatures")
    named = _grouped(own, docs, percent)
    rows = own.where("digest IS NOT NULL").groupBy("digest", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows")).join(named, F.col("digest") == F.col("d"))
    first = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("t") == F.col("low.t"))
    marked = common.durable(rows.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), first.alias("__first"), "rows").where("NOT __first OR rows > 1").drop("rows"), "copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t"))
    single = common.join_checked(docs, marked, same, "left_anti", marked.count())
    repeated = marked.where("__first")
    if not (n := repeated.count()):
        return single
    # rows that are equal in id and text may differ in other columns
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = common.join_checked(docs, repeated, same, "inner", n).groupBy("__id", "__t").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("__row"))
    return single.union(again.select("__row.*"))
