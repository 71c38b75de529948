"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: bounded-space online best-fit.  A fixed number of bins is open; a bitset over free-space
values finds the tightest bin that still takes a piece in a few machine words, and when a new bin
is needed beyond the bound, the fullest one closes.

Defined cases: a null or empty text is one piece that holds only the end id; repeated rows are
packed once each; rows of a null ``doc_id`` are packed as well; an empty table gives no rows;
extra columns of the input are ignored.

Scale: tokenising is a map without shuffle.  Only the pieces' lengths (not their ids) are shuffled,
into shards of about ``shard_pieces`` pieces that a hash fills evenly, whatever the sources are.
Within a shard the stream is ordered by falling length, so that small pieces fill what large ones
leave; the last few bins of a shard, one in several thousand, are all that sharding costs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import WORDS, ChunkEncoder

END_ID = 0


class BestFit:
    """Bounded-space best fit: ``put(length)`` returns (bin number, offset in the bin)."""

    def __init__(self, capacity: int = 2048, open_bins: int = 32_768):
        self.capacity, self.most = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0  # bit f is set if free[f] isn't empty
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            space = (fits & -fits).bit_length() - 1 + length
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space


def cut(n_ids: int, capacity: int) -> Iterable[tuple[int, int]]:
    """(start, length) of each piece; only what is longer than a sequence is cut."""
    return ((s, min(capacity, n_ids - s)) for s in range(0, n_ids, capacity))


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (binary)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batch: pa.RecordBatch) -> dict:
        encoder = ChunkEncoder.of(tokenizer, WORDS)
        rows = []
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, k, start, length, zlib.crc32(own), own)[: len(names)])
        return dict(zip(names, zip(*rows))) if rows else {x: [] for x in names}

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pieces, schema)


def pack_pieces(pieces: DataFrame, rows: int, capacity: int = 2048, open_bins: int = 32_768, shard_pieces: int = 131_072) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    ``rows`` is the counted number of pieces; it sets the number of shards.
    """
    shards = common.parts_for(rows, shard_pieces)
    spark = pieces.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = common.pa_schema(schema)
    names = out.names[:5]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, BestFit(capacity, open_bins)
        for batch in batches:
            places = []
            for own, length in zip(batch["shard"].to_pylist(), batch["length"].to_pylist()):
                if own != shard:
                    shard, bins = own, BestFit(capacity, open_bins)
                bin_, offset = bins.put(length)
                places.append((shard << 40 | bin_, offset))
            sequence, offset = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays([batch[x] for x in names] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=out)

    dealt = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard"))
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 8)
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece").mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 32_768, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack.  With ``with_ids`` the pieces' ids (unsigned 32-bit, little-endian) come along."""
    pieces = common.durable(tokenize_pieces(docs, tokenizer, capacity, with_ids), "pieces")
    packed = pack_pieces(pieces, pieces.count(), capacity, open_bins)
    if with_ids:  # a document's crc and place tell repeated rows apart no better than they are equal
        ids = pieces.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
        on = [packed[c].eqNullSafe(ids[c]) for c in ("doc_id", "piece", "ids_crc32")]
        packed = packed.join(ids, on[0] & on[1] & on[2]).select(*(packed[c] for c in packed.columns), "ids")
    return packed
