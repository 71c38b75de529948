"""Removal of long repeated byte strings, by prefix-free parsing.

Method: wherever a rolling hash of eight bytes triggers, a phrase of the text ends, so equal
stretches of text are cut alike wherever they stand.  The phrases are the dictionary, the sequence
of a text's phrases is its parse.  Whether a string of ``size`` bytes starts elsewhere too is a
question to the corpus order of suffixes, but only to the depth of ``size`` bytes, and only whether
neighbours are equal; so suffixes of dictionary and parse are brought together by 128-bit digests of
their first bytes and phrases instead of being sorted by their letters (README: what sorting costs):

1. Dictionary: phrases that occur once can't lie within a repeated string.
2. Parse: the windows between two phrase ends share their enclosing and their inner phrase
   sequence.  If the inner phrases all repeat and the enclosing sequence occurs twice with the same
   windows in it, all these windows are repeated, and no byte of them is looked at.
3. Where only the inner sequence occurs again, as at the edges of a passage, and in the rare windows
   without a whole phrase, the windows themselves are compared, by digests of their bytes.

Nothing depends on how far texts repeat; a highly repetitive corpus has a small dictionary.
Texts, phrase sequences and windows are known by 128 bits of digests that are no polynomials, so
structured texts don't collide more than others: n of them have a wrong match with a probability of
n * n / 2**129.  A phrase is known by 64 bits, but always in a sequence that holds its neighbours.

Defined cases: a null text is empty; texts shorter than ``size`` stay as they are; documents with
equal texts of at least ``size`` bytes lose all bytes; rows that repeat an id count as other
documents, null ids too; an empty table gives no rows; extra columns are ignored.

Scale: equal texts are parsed as one.  Dictionary and parse are counted with map-side combination,
so a passage that all documents share is one row per task.  Each table of a step is deleted when the
next ones are written.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from . import common

SIZE = 400
TRIGGER_BYTES = 8
#: Mean phrases in a string of the length sought.
PHRASES = 8
#: Most digests that a task counts before it passes the counts on.
HELD = 1 << 18
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_ODD = _U(0xD6E8FEB86659FD93)
_IN_WORD = np.array([chr(c) not in " \t\n\r\v\f" for c in range(256)], np.int8)


def digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """[strings, 2] 128-bit digests of stretches of ``raw``, as signed integers."""
    own = b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())])
    return np.frombuffer(own, "<i8").reshape(-1, 2)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first of each digest, number of each row's digest, how often each occurs)."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    edge = np.ones(len(h), bool)
    edge[1:] = (h[order][1:] != h[order][:-1]).any(1)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(edge) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(edge)) if len(h) else order
    return first, which, np.bincount(which)


def phrase_ends(raw: bytes, size: int) -> np.ndarray:
    """Places right after the bytes that trigger, one in ``size / PHRASES`` on average."""
    if len(raw) < TRIGGER_BYTES:
        return np.zeros(0, np.int64)
    words = np.ndarray(len(raw) - TRIGGER_BYTES + 1, "<u8", raw, strides=(1,))
    mixed = words * _MUL
    mixed ^= mixed >> _U(29)
    mixed *= _ODD
    return np.flatnonzero(mixed < _U((1 << 64) * PHRASES // size)) + TRIGGER_BYTES


def parse(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the phrases from 0 to the length, hashes of the phrases)."""
    bounds = np.unique(np.concatenate(([0], phrase_ends(raw, size), [len(raw)]))).astype(np.int32)
    at = bounds.tolist()
    return bounds, np.array([xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)


def window_groups(bounds: np.ndarray, phrases: np.ndarray, is_end: np.ndarray, repeated: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Groups of windows [x0, x1) that may be repeated: x0, x1, where the enclosing sequence begins, its digest (two) with the windows' place in it, the inner one's hash.

    ``is_end``: which bounds are phrase ends by a trigger; ``repeated``: which phrases repeat.
    Only ends whose trigger lies within a window cut its copies alike, so the inner phrases are
    those between the first and the last of these.  Without inner phrases the hash is 0.
    """
    n = int(bounds[-1])
    places = np.flatnonzero(is_end)
    ends = bounds[places].astype(np.int64)
    x = np.concatenate(([0], ends - TRIGGER_BYTES + 1, ends - size))
    x0 = np.unique(x[(x >= 0) & (x <= n - size)])
    x1 = np.append(x0[1:], n - size + 1)
    first = np.searchsorted(ends, x0 + TRIGGER_BYTES, "left")
    last = np.searchsorted(ends, x0 + size, "right") - 1
    inner = last > first
    a, b = np.where(inner, first, 0), np.where(inner, last, 0)
    a, b = (places[a], places[b]) if len(places) else (a, b)
    single = np.concatenate(([0], np.cumsum(~repeated)))
    keep = ~inner | (single[b] == single[a])
    x0, x1, a, b, inner = x0[keep], x1[keep], a[keep], b[keep], inner[keep]
    raw = phrases.tobytes()
    within = np.array([xxh3_64_intdigest(raw[8 * i : 8 * j]) if some else 0 for i, j, some in zip(a.tolist(), b.tolist(), inner.tolist())], np.uint64).view(np.int64)
    o0 = np.searchsorted(bounds, x0, "right") - 1
    o1 = np.searchsorted(bounds, x1 - 1 + size, "left")
    # with the place of the windows in it, as a text may hold the same sequence around fewer windows than another does
    within_outer = np.stack([x0 - bounds[o0], x1 - bounds[o0]], 1).astype("<i4").tobytes()
    own = b"".join([xxh3_128_digest(raw[8 * i : 8 * j] + within_outer[8 * k : 8 * k + 8]) for k, (i, j) in enumerate(zip(o0.tolist(), o1.tolist()))])
    outer = np.frombuffer(own, "<i8").reshape(-1, 2)
    return x0, x1, bounds[o0], outer[:, 0], outer[:, 1], within


def read_windows(raw: bytes, x0: np.ndarray, x1: np.ndarray, sure: np.ndarray, read: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(start, digest, sure) of each window of the groups to read."""
    x0, n, sure = x0[read], (x1 - x0)[read], sure[read]
    x = np.repeat(x0 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return x, digests(raw, x, x + size), np.repeat(sure, n)


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that intervals [start, stop) cover."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    inside = np.concatenate(([0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _rows(f, out: pa.Schema, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, rows):
            yield f(batch, out)

    return run


def _numpy(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def parses(texts: DataFrame, size: int) -> DataFrame:
    """One row per text of at least ``size`` bytes: key, rep (smallest id), copies, bounds, phrases (hashes), open (no trigger at the end)."""
    schema = "key binary, doc_id long, bounds array<int>, phrases array<long>, open boolean"

    def one(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
        bounds, phrases, opens = [], [], []
        for text in batch["text"].to_pylist():
            raw = text.encode()
            b, h = parse(raw, size)
            bounds.append(b)
            phrases.append(h)
            opens.append(not len(phrase_ends(raw[-TRIGGER_BYTES:], size)))
        return pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], *(pa.array(v, f.type) for v, f in zip((bounds, phrases, opens), list(out)[2:]))], schema=out)

    own = common.small_batches(texts).where(F.octet_length("text") >= size).select("key", "doc_id", "text").mapInArrow(_rows(one, common.pa_schema(schema)), schema)
    whole = F.struct("bounds", "phrases", "open")
    return own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(whole).alias("p")).select("key", "rep", "copies", "p.*")


def word_windows(raw: bytes, words: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, digest) of the strings of so many whole words that have less than ``size`` bytes."""
    inside = np.concatenate(([0], _IN_WORD[np.frombuffer(raw, np.uint8)], [0]))
    edges = np.flatnonzero(np.diff(inside))
    x, stop = edges[::2][: max(0, len(edges) // 2 - words + 1)], edges[1::2][words - 1 :]
    short = stop - x < size
    x, stop = x[short], stop[short]
    return x, stop - x, digests(raw, x, stop)


def _passages(texts: DataFrame, size: int, words: int) -> DataFrame:
    """key, rep_, copies_ and the places (px, pn) of strings of ``words`` words and less than ``size`` bytes that occur twice.

    Strings are counted in each task before they are shuffled, and found again in the texts: by a
    broadcast if those that repeat were counted as few, else by a join."""
    spark, rows = texts.sparkSession, texts.select("key", "doc_id", "text")

    def strings(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, i, text in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "text"))):
            yield key, i, *word_windows(text.encode(), words, size)

    schema = "h long, h2 long, n long"
    counted = common.pa_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(held.values()), pa.int64())], schema=counted)

        for batch in common.slices(batches, 256):
            for _, _, _, _, h in strings(batch):
                raw = h.tobytes()
                held.update(raw[k : k + 16] for k in range(0, len(raw), 16))
            if len(held) > HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    again = rows.mapInArrow(count, schema).groupBy("h", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h", "h2")
    again = common.durable(again, "again")
    if again.count() <= common.BROADCAST_ROWS:
        known = spark.sparkContext.broadcast({np.array([r["h"], r["h2"]], "<i8").tobytes() for r in again.collect()})
        schema = "key binary, doc_id long, px array<int>, pn array<int>"

        def find(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
            found = []
            for key, i, x, n, h in strings(batch):
                raw = h.tobytes()
                if at := [k for k in range(len(x)) if raw[16 * k : 16 * k + 16] in known.value]:
                    found.append((key, i, x[at].tolist(), n[at].tolist()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(out)], schema=out)

        each = rows.mapInArrow(_rows(find, common.pa_schema(schema)), schema)
        places = F.first(F.struct("px", "pn")).alias("p")  # equal texts have equal places
        found = each.groupBy("key").agg(F.min("doc_id").alias("rep_"), F.count(F.lit(1)).alias("copies_"), places)
    else:
        schema = "key binary, doc_id long, px array<int>, pn array<int>, h array<long>, h2 array<long>"

        def spell(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
            own = [(key, i, x.tolist(), n.tolist(), h[:, 0].tolist(), h[:, 1].tolist()) for key, i, x, n, h in strings(batch) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], f.type) for k, f in enumerate(out)], schema=out)

        whole = rows.mapInArrow(_rows(spell, common.pa_schema(schema)), schema).groupBy("key").agg(F.min("doc_id").alias("rep_"), F.count(F.lit(1)).alias("copies_"), F.first(F.struct("px", "pn", "h", "h2")).alias("w"))
        whole = common.durable(whole, "strings")
        each = whole.select("key", F.explode(F.arrays_zip("w.px", "w.pn", "w.h", "w.h2")).alias("w")).select("key", "w.*")
        each = each.join(again, ["h", "h2"]).groupBy("key").agg(F.collect_list(F.struct("px", "pn")).alias("p"))
        found = whole.select("key", "rep_", "copies_").join(each, "key").select("key", "rep_", "copies_", F.struct(F.col("p.px").alias("px"), F.col("p.pn").alias("pn")).alias("p"))
    found = common.durable(found.select("key", "rep_", "copies_", "p.px", "p.pn"), "passages")
    common.drop(again)
    return found


def repeats(docs: DataFrame, size: int = SIZE, words: int = 0) -> DataFrame:
    """A durable table with key (digest of the text), start and stop of the maximal repeated runs, sha (of the rest) and
    the rest itself, for texts that have any; texts of several documents have ``whole`` set instead.
    With ``words``, strings of so many whole words that repeat are removed as well if they are shorter than ``size``."""
    texts = docs.select(F.unhex(F.md5("text")).alias("key"), "doc_id", "text")
    parsed = common.durable(parses(texts, size), "parse")
    heads = common.durable(parsed.select("key", "rep", "copies"), "heads")

    # 1. dictionary
    each = parsed.select("key", F.posexplode("phrases").alias("i", "h"))
    known = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    marked = common.durable(each.join(known, "h").groupBy("key").agg(F.collect_list("i").alias("repeated")), "dictionary")

    # 2. parse
    schema = "key binary, x0 array<int>, x1 array<int>, at array<int>, outer array<long>, outer2 array<long>, inner array<long>"

    def groups(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in list(out)[1:]]
        for k, open_ in enumerate(batch["open"].to_pylist()):
            bounds, phrases = _numpy(batch["bounds"], k), _numpy(batch["phrases"], k)
            is_end = np.ones(len(bounds), bool)
            is_end[0], is_end[-1] = False, not open_
            repeated = np.zeros(len(phrases), bool)
            if batch["repeated"][k].is_valid:
                repeated[_numpy(batch["repeated"], k)] = True
            for c, v in zip(cols, window_groups(bounds, phrases, is_end, repeated, size)):
                c.append(v)
        return pa.RecordBatch.from_arrays([batch["key"], *(pa.array(c, f.type) for c, f in zip(cols, list(out)[1:]))], schema=out)

    found = parsed.join(marked, "key", "left").select("key", "bounds", "phrases", "open", "repeated").mapInArrow(_rows(groups, common.pa_schema(schema)), schema)
    found = found.select("key", F.explode(F.arrays_zip(*(x.split()[0] for x in schema.split(", ")[1:]))).alias("g")).select("key", "g.*")
    found = common.durable(found, "groups")
    common.drop(parsed, marked)
    place = F.struct("key", "at")  # neighbouring groups may share an enclosing sequence, which then is one occurrence
    outer = found.groupBy("outer", "outer2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("outer", "outer2", "first")
    placed = found.join(outer, ["outer", "outer2"], "left").withColumn("sure", F.col("first").isNotNull())
    placed = placed.withColumn("leads", F.coalesce(F.col("first") == place, F.lit(False))).drop("outer", "outer2", "first", "at")
    placed = common.durable(placed, "placed")
    common.drop(found)
    # windows without inner phrases may repeat within one group
    inner = placed.groupBy("inner").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x1") - F.col("x0")).alias("w"), F.max(~F.col("sure")).alias("unsure"))
    inner = inner.where("(n > 1 OR inner = 0 AND w > 1) AND unsure").select(F.col("inner").alias("inner_"))
    both = placed.join(inner, F.col("inner") == F.col("inner_"), "left").withColumn("again", F.col("inner_").isNotNull())
    # sure groups are read once per outer sequence, to hold unsure ones against them
    groups_ = F.struct("x0", "x1", "sure", (F.col("again") & (~F.col("sure") | F.col("leads"))).alias("read"))
    per_text = both.where(F.col("sure") | F.col("again")).groupBy("key").agg(F.collect_list(groups_).alias("g"))
    per_text = per_text.select("key", *(F.col(f"g.{c}").alias(c) for c in ("x0", "x1", "sure", "read")))
    marks = per_text.join(heads, "key")
    passages = _passages(texts, size, words) if words else None
    if passages is not None:
        marks = marks.join(passages, "key", "full")
        kinds = {"x0": "int", "x1": "int", "sure": "boolean", "read": "boolean", "px": "int", "pn": "int"}
        lists = [F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in kinds.items()]
        marks = marks.select("key", *lists, F.coalesce("rep", "rep_").alias("rep"), F.coalesce("copies", "copies_").alias("copies"))
    else:
        marks = marks.select("*", *(F.array().cast("array<int>").alias(c) for c in ("px", "pn")))
    marks = common.durable(marks.select(F.col("key").alias("k"), *marks.columns[1:]), "marks")
    common.drop(placed)
    # of a text that stands several times nothing is left anyway, but its windows count for other texts
    some = texts.join(marks, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).drop("k", "rep", "doc_id")
    some = common.durable(some, "texts")
    common.drop(marks)

    # 3. windows
    schema = "key binary, x array<int>, h array<long>, h2 array<long>, sure array<boolean>, n array<int>"

    def windows(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(5)]
        for k, text in enumerate(batch["text"].to_pylist()):
            x, h, sure = read_windows(text.encode(), *(_numpy(batch[c], k) for c in ("x0", "x1", "sure", "read")), size)
            first, _, n = distinct(h)
            # what repeats within the text is found there; here it only stands for others
            for c, v in zip(columns, (x[first].astype(np.int32), h[first, 0], h[first, 1], sure[first] | (n > 1), np.minimum(n, 2).astype(np.int32))):
                c.append(v)
        return pa.RecordBatch.from_arrays([batch["key"], *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:]))], schema=out)

    read = some.where(F.exists("read", lambda r: r)).select("key", "text", "x0", "x1", "sure", "read").mapInArrow(_rows(windows, common.pa_schema(schema), 64), schema)
    read = read.select("key", F.explode(F.arrays_zip("x", "h", "h2", "sure", "n")).alias("w")).select("key", "w.*")
    again = read.groupBy("h", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h", "h2")
    hits = common.durable(read.where("NOT sure").join(again, ["h", "h2"]).groupBy("key").agg(F.collect_list("x").alias("hits")), "hits")

    schema = "key binary, start array<int>, stop array<int>, sha string, rest string"

    def runs(batch: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
        starts, stops, shas, rests = [], [], [], []
        for k, text in enumerate(batch["text"].to_pylist()):
            raw = text.encode()
            x0, x1, sure, read = (_numpy(batch[c], k) for c in ("x0", "x1", "sure", "read"))
            x, h, known = read_windows(raw, x0, x1, sure, read, size)
            _, which, n = distinct(h)
            twice = x[(n[which] > 1) & ~known] if len(x) else x
            hit = _numpy(batch["hits"], k) if batch["hits"][k].is_valid else np.zeros(0, np.int32)
            px, pn = _numpy(batch["px"], k), _numpy(batch["pn"], k)
            spans = covered(len(raw), np.concatenate([x0[sure], hit, twice, px]), np.concatenate([x1[sure] - 1 + size, hit + size, twice + size, px + pn]))
            starts.append([a for a, _ in spans])
            stops.append([b for _, b in spans])
            kept = b"".join(raw[a:b] for a, b in zip([0, *stops[-1]], [*starts[-1], len(raw)]))
            shas.append(hashlib.sha256(kept).hexdigest())
            rests.append(kept.decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([batch["key"], *(pa.array(v, f.type) for v, f in zip((starts, stops, shas, rests), list(out)[1:]))], schema=out)

    single = some.where("copies = 1").join(hits, "key", "left").select("key", "text", "x0", "x1", "sure", "read", "hits", "px", "pn").mapInArrow(_rows(runs, common.pa_schema(schema)), schema)
    columns = [("start", "array<int>"), ("stop", "array<int>"), ("sha", "string"), ("rest", "string")]
    several = heads.where("copies > 1").select("key")
    if passages is not None:
        several = several.union(passages.where("copies_ > 1").select("key")).distinct()
    whole = several.select("key", F.lit(True).alias("whole"), *(F.lit(None).cast(t).alias(c) for c, t in columns))
    out = common.durable(single.where(F.size("start") > 0).select("key", F.lit(False).alias("whole"), *(c for c, _ in columns)).union(whole), "repeats")
    common.drop(some, hits, heads, *([passages] if passages is not None else []))
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text, which is what is left (without parts of cut characters)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(own, size)
    removed = F.aggregate(F.zip_with("start", "stop", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    narrow = found.select(F.col("key").alias("k"), "whole", F.size("start").alias("spans"), removed.alias("removed"), "sha", "rest")
    rows = own.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    joined = rows.join(narrow, F.col("key") == F.col("k"), "left")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.sha2("text", 256))).alias("kept_sha256"),
        F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce("rest", "text")).alias("text"),
    )


def cleaned(docs: DataFrame, size: int = SIZE, words: int = 0) -> DataFrame:
    """``docs`` with the repeated strings removed from ``text`` (parts of cut characters go, too) and ``n_chars``, if
    there is one, counted anew; documents of which nothing is left are dropped."""
    names = docs.columns
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(own, size, words=words).select(F.col("key").alias("k"), F.when(F.col("whole"), F.lit("")).otherwise(F.col("rest")).alias("rest"))
    # columns by place, so that no name of the input is in the way
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = F.col(f"c{names.index('text')}")
    joined = rows.join(found, F.unhex(F.md5(F.coalesce(text, F.lit("")))) == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    new = {"text": F.when(hit, F.col("rest")).otherwise(text)}
    if "n_chars" in names:
        chars = f"c{names.index('n_chars')}"
        new["n_chars"] = F.when(hit, F.length("rest")).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType)
    return joined.where(~hit | (F.length("rest") > 0)).select(*(new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(names)))
