"""Token shards: ids of documents in a compressed binary file format with random access.

Method: Re-Pair grammar compression.  In each shard frequent pairs of neighbouring symbols are
replaced by new symbols (nonterminals), again and again; the file holds the rules with the length
that each symbol expands to, the documents' places and the remaining symbols.  No pair contains the
end id, so no rule reaches over a document's end and each document can be decoded alone.

A round replaces the most frequent pairs at once instead of one pair, which gives the same kind of
grammar at the speed of array operations.  Rounds go on until no pair is frequent enough for a rule to
pay or no symbol is left: symbols of two bytes end at 65,536; where the vocabulary is too large for
that, symbols take four bytes and 65,536 rules are made at most.

Defined cases: a null or empty text has only the end id; repeated ids keep one entry per row, in
the order of a hash of their texts; null ids come first; an empty table gives no files and no rows; extra
columns are ignored.

Scale: documents are range-partitioned by id and hash (a shuffle of the texts, which are shorter than
their ids), and a partition writes a file per ``SHARD_IDS`` ids, so memory doesn't depend on the input.
A hot source doesn't matter, and rows that share an id are cut by their hashes.  Files get unique names and only those that
the durable manifest names are read, so a task that ran twice leaves nothing wrong behind.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import BLANK_WORDS, ChunkEncoder

END_ID = 0
SHARD_IDS = 2_000_000
#: Most tasks that read files.
READ_TASKS = 20_000
MAGIC = b"MWRP0002"
_HEAD = "<IIIII"
#: A rule takes eight bytes and saves two at each place, so a pair that is rarer than LEAST is left alone.
LEAST = 5
#: Rules of a round: three quarters of the symbols that are left, RULES_A_ROUND at least.
RULES_A_ROUND = 512
#: Symbols take two bytes where the vocabulary leaves room for so many rules, else four.
ROOM = 4096
_SLOTS = 20
_rng = np.random.default_rng(11)
#: A round hashes pairs with a multiplier of its own, so two pairs that share a slot in one round are apart in the next.
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def width(first_symbol: int) -> int:
    """Bytes of a symbol in files of a vocabulary with ids below ``first_symbol``."""
    return 2 if first_symbol + ROOM <= 1 << 16 else 4


def compress(ids: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules [n, 2], lengths that the rules expand to) of an array of ids below ``first_symbol``."""
    if len(ids) and int(ids.max()) >= first_symbol:
        raise ValueError(f"id {int(ids.max())} isn't below {first_symbol}")
    size = width(first_symbol)
    most = 1 << 16 if size == 2 else first_symbol + (1 << 16)
    code_type = np.uint32 if size == 2 else np.uint64
    bits = code_type(8 * size)
    symbols = ids.astype(code_type)
    rules: list[np.ndarray] = []
    lengths = np.ones(most, np.uint32)
    made = first_symbol
    while len(symbols) > 1 and (left := most - made):
        room = min(max(RULES_A_ROUND, left * 3 // 4), left)
        code = symbols[:-1] << bits | symbols[1:]
        ends = np.flatnonzero(symbols == END_ID)
        ends = np.concatenate([ends[ends < len(code)], ends[ends > 0] - 1])  # pairs that hold an end id (some stand twice)
        odd = _ODD[len(rules) % len(_ODD)].astype(code_type)
        slot = (code * odd) >> code_type(16 * size - _SLOTS)
        counts = np.bincount(slot, minlength=1 << _SLOTS)
        hot = counts >= max(LEAST, int(np.partition(counts, -room)[-room]))
        some = hot[slot]
        some[ends] = False
        at = np.flatnonzero(some)
        code, slot = code[at], slot[at]
        # of the pairs in a slot the one that is more frequent among the first two met
        held, counts = _holders(code, slot)
        other = held[slot] != code
        rival, more = _holders(code[other], slot[other])
        wins = more > counts
        held[wins], counts[wins] = rival[wins], more[wins]
        chosen = np.flatnonzero(counts >= LEAST)
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:room]]
        if not len(chosen):
            break
        pairs = held[chosen]
        sides = np.stack([pairs >> bits, pairs & code_type((1 << 8 * size) - 1)], 1)
        rule = np.zeros(1 << _SLOTS, code_type)
        rule[chosen] = made + np.arange(len(chosen))
        fits = (held[slot] == code) & (rule[slot] != 0)
        at, slot = at[fits], slot[fits]
        # of pairs that overlap, every other one from the left
        begins = np.concatenate(([True], np.diff(at) != 1))
        run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        first = (np.arange(len(at)) - run_start) % 2 == 0
        at, slot = at[first], slot[first]
        lengths[made : made + len(chosen)] = lengths[sides[:, 0]] + lengths[sides[:, 1]]
        symbols[at] = rule[slot]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        rules.append(sides)
        made += len(chosen)
    kind = f"<u{size}"
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), code_type)
    return symbols.astype(kind), grammar.astype(kind), lengths[first_symbol:made].astype("<u4")


def _holders(code: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pair of each slot and how often it occurs."""
    held = np.zeros(1 << _SLOTS, code.dtype)
    held[slot] = code
    return held, np.bincount(slot[held[slot] == code], minlength=1 << _SLOTS)


def expand(symbols: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Undo the rules; each pass replaces all nonterminals by their two sides."""
    out = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(out >= first_symbol)):
        grown = np.repeat(out, np.where(out >= first_symbol, 2, 1))
        left = at + np.arange(len(at))
        pair = rules[out[at] - first_symbol]
        grown[left], grown[left + 1] = pair[:, 0], pair[:, 1]
        out = grown
    return out


def pack_shard(doc_ids: list[int | None], ids: list[bytes], first_symbol: int) -> bytes:
    """The bytes of one file.  ``ids``: per document, little-endian unsigned 32-bit, the end id last."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    symbols, rules, lengths = compress(flat, first_symbol)
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    every = np.ones(first_symbol + len(lengths), np.int64)
    every[first_symbol:] = lengths
    upto = np.cumsum(every[symbols]) if len(symbols) else np.zeros(0, np.int64)
    places = np.searchsorted(upto, np.cumsum(sizes, dtype=np.int64)).astype("<u4") + np.uint32(1)  # symbols up to each document's end
    known = np.array([x is not None for x in doc_ids], "u1")
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    out = io.BytesIO()
    out.write(MAGIC + struct.pack(_HEAD, len(ids), len(rules), len(symbols), first_symbol, symbols.itemsize))
    for part in (keys, known, sizes, places.astype("<u4"), rules, lengths, symbols):
        out.write(part.tobytes())
    return out.getvalue()


class Shard:
    """A file read back, by ranges: the directory and the rules at once, a document's symbols when it is asked for.

    ``source``: the file's bytes, or a function that gives so many bytes from a place.
    """

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = (lambda at, n: source[at : at + n]) if isinstance(source, bytes) else source
        at = len(MAGIC) + struct.calcsize(_HEAD)
        head = self.read(0, at)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        n, r, s, self.first, self.size = struct.unpack_from(_HEAD, head, len(MAGIC))
        parts = []
        sizes = [("<i8", n), ("u1", n), ("<u4", n), ("<u4", n), (f"<u{self.size}", 2 * r), ("<u4", r)]
        raw, place = self.read(at, sum(np.dtype(kind).itemsize * count for kind, count in sizes)), 0
        for kind, count in sizes:
            parts.append(np.frombuffer(raw, kind, count, place))
            place += parts[-1].nbytes
        keys, known, self.sizes, self.places, rules, self.lengths = parts
        self.at, self.n_symbols = at + place, s
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.rules = rules.reshape(-1, 2)

    def symbols(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.read(self.at + self.size * start, self.size * (stop - start)), f"<u{self.size}")

    def _own(self, k: int) -> np.ndarray:
        return self.symbols(int(self.places[k - 1]) if k else 0, int(self.places[k]))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; no other document's symbols are read."""
        return expand(self._own(k), self.rules, self.first)

    def window(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the k-th document; only symbols that reach into the window are expanded."""
        own = self._own(k)
        every = np.ones(self.first + len(self.lengths), np.int64)
        every[self.first :] = self.lengths
        upto = np.cumsum(every[own])
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
        before = int(upto[a - 1]) if a else 0
        return expand(own[a:b], self.rules, self.first)[start - before : stop - before]

    def all_ids(self) -> list[np.ndarray]:
        """The ids of each document; each rule is expanded once and then copied to its places."""
        if not len(self.sizes):
            return []
        every = np.ones(self.first + len(self.lengths), np.int64)
        every[self.first :] = self.lengths
        grown = expand(np.arange(self.first, len(every), dtype=np.uint32), self.rules, self.first)
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), grown])
        own = self.symbols(0, self.n_symbols)
        n = every[own]
        at = np.repeat((np.cumsum(every) - every)[own] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return np.split(flat[at], np.cumsum(self.sizes[:-1], dtype=np.int64))


@contextmanager
def open_shard(path: str) -> Iterator[Shard]:
    """A file in the shared folder, read by ranges."""
    system, at = common.filesystem(path)
    with system.open_input_file(at) as f:
        yield Shard(lambda place, n: f.read_at(n, place))


def write_token_shards(docs: DataFrame, tokenizer: str, folder: str, partitions: int | None = None) -> DataFrame:
    """Write all documents, ascending by ``doc_id``, and return the durable manifest of the files.

    Manifest: part (the files' order: part, then seq), seq, path, n_docs, n_ids, bytes,
    start (ids of the same part before the file).
    """
    schema = "part int, seq int, path string, n_docs long, n_ids long, bytes long, start long"
    out = common.pa_schema(schema)
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer, BLANK_WORDS)
        first = encoder.n_ids
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            system, at = common.filesystem(folder)
            system.create_dir(at, recursive=True)
            name = f"shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.rp"
            raw = pack_shard(keys, held, first)
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(raw)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{name}", "n_docs": len(keys), "n_ids": size // 4, "bytes": len(raw), "start": start}], schema=out)

        for batch in common.slices(batches, 256):
            for key, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                keys.append(key)
                held.append(ids + end)
                size += len(held[-1])
                if size >= 4 * SHARD_IDS:
                    yield flush()
                    seq, start, size = seq + 1, start + size // 4, 0
                    keys, held = [], []
        if keys:
            yield flush()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # only ids and hashes are sampled for the ranges, so texts don't reach the driver
    ranged = rows.repartitionByRange(partitions, "doc_id", "h") if partitions else rows.repartitionByRange("doc_id", "h")
    return common.durable(ranged.sortWithinPartitions("doc_id", "h", "text").mapInArrow(write, schema), "manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    # sums over a row per part, so the window over all of them stays short
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    files = manifest.join(base, "part").select("path", (F.col("base") + F.col("start")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out = common.pa_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                with open_shard(path) as shard:
                    sizes = shard.sizes.astype(np.int64)
                    starts = start + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    crc = [zlib.crc32(x.astype("<u4", copy=False)) for x in shard.all_ids()]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], schema=out)

    # a fixed number of tasks, as rows of the manifest are too few for Spark to keep tasks apart by their size
    return files.repartition(max(1, min(manifest.count(), READ_TASKS)), "path").mapInArrow(read, schema)


def token_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    return read_token_shards(write_token_shards(docs, tokenizer, common.shared_path(docs.sparkSession, "tokens")))
