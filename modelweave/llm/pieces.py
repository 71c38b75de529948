"""SentencePiece encoding and decoding for models of the merge (BPE) type.

Method: exact merge-type encoding by backtracking.  An Aho-Corasick automaton over the pieces gives
the longest piece at each place; going left to right, a piece is taken if it is compatible with the
one before it, that is, if merging the two pieces' characters anew gives these two pieces again.
If not, a shorter piece is tried, and where none is left the previous piece is taken back; a
bitfield remembers the places from which the rest can't be encoded.

A text is cut beforehand where no piece can reach over: before a blank that follows another
character, and around characters that no piece has.  Each distinct segment is encoded once per
worker.  Characters without a piece become byte pieces.

Defined cases: null is an empty text, and an empty text has the end id only; repeated rows are
encoded once each; an empty table gives no rows; extra columns are ignored.

Scale: a map without shuffle; the automaton is built once per worker, its memory is that of the
model, and the memory of known segments is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from . import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MERGES = 2


class PieceModel:
    """Encoder and decoder of one model file.

    Models with a character map, user-defined or unused pieces, or without byte fallback
    need more than merges and are refused.
    """

    _own: dict[str, PieceModel] = {}

    def __init__(self, path: str, cache: int = 500_000):
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != _MERGES or not trained.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trained.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only plain merge-type models with byte fallback are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.text: list[str] = []
        self.bytes_: dict[int, int] = {}  # id of a byte piece -> byte
        self.control: set[int] = set()
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            self.score.append(p.score)
            self.text.append(p.piece)
            if p.type == NORMAL:
                self.ids[p.piece] = i
            elif p.type == BYTE:
                self.bytes_[i] = int(p.piece[1:-1], 16)
            elif p.type == CONTROL:
                self.control.add(i)
            elif p.type == UNKNOWN:
                self.unknown = i
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        self.of_byte = {b: i for i, b in self.bytes_.items()}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == (trained.eos_piece or "</s>"))
        self.unknown_surface = trained.unk_surface
        self.chars = {c for piece in self.ids for c in piece}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.most = max(map(len, self.ids))
        # the next shorter piece that is a prefix of a piece
        self.shorter: dict[int, tuple[int, int] | None] = {}
        # a piece never has a blank after another character (checked here, used for cutting)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces reach over blanks")
        alone = "".join(c for c in "\n\r\t" if c not in self.chars)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone)).findall
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, int, str]] = {}
        self.bound = cache

    @classmethod
    def of(cls, path: str) -> PieceModel:
        """The worker's own model, kept between tasks."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def merge(self, text: str) -> list[int]:
        """Ids by merging: the pair whose joint piece scores best goes first, from the left."""
        symbols: list[str | None] = list(text)
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(joint := symbols[a] + symbols[b])) is not None:
                heapq.heappush(queue, (-self.score[i], a, b, joint))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, joint = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != joint or after[a] != b:
                continue
            symbols[a], symbols[b] = joint, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [self.ids[s] for s in symbols if s is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces stay as they are when their characters are merged anew?"""
        key = left << 20 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.text[left] + self.text[right]) == [left, right]
        return known

    def next_shorter(self, piece: int) -> tuple[int, int] | None:
        """The longest piece (length, id) that is a proper prefix of this one."""
        if piece not in self.shorter:
            text = self.text[piece]
            self.shorter[piece] = next(((n, self.ids[text[:n]]) for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), None)
        return self.shorter[piece]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        if (whole := self.ids.get(text)) is not None and self.merge_reaches(whole):
            return [whole]
        n = len(text)
        longest: list[tuple[int, int] | None] = [None] * n
        for end, (size, i) in self.automaton.iter(text):
            at = end - size + 1
            if longest[at] is None or longest[at][0] < size:
                longest[at] = (size, i)
        failed = 0  # bit p: the rest from place p can't be encoded after what was tried
        out: list[tuple[int, int]] = []  # (place, id)
        at, choice = 0, longest[0]
        while at < n:
            while choice is not None:
                size, i = choice
                if not failed >> (at + size) & 1 and (not out or self.compatible(out[-1][1], i)) and (size == 1 or self.merge_reaches(i)):
                    break
                choice = self.next_shorter(i)
            if choice is not None:
                out.append((at, choice[1]))
                at += choice[0]
                choice = longest[at] if at < n else None
            else:
                failed |= 1 << at
                if not out:
                    return self.merge(text)
                at, last = out.pop()
                choice = self.next_shorter(last)
        return [i for _, i in out]

    def merge_reaches(self, piece: int) -> bool:
        """Does merging the characters of a piece give the piece itself?"""
        key = -1 - piece
        if (known := self.fits.get(key)) is None:
            known = self.fits[key] = self.merge(self.text[piece]) == [piece]
        return known

    def encode_segment(self, segment: str) -> list[int]:
        if SPACE * 2 in segment:  # runs of blanks have pieces of equal score, which only merging itself settles
            solve = self.merge
        else:
            solve = self.backtrack
        if self.chars.issuperset(segment):
            return solve(segment)
        out, run = [], []
        for c in [*segment, None]:
            if c is not None and c in self.chars and c in self.ids:
                run.append(c)
                continue
            if run:
                out += solve("".join(run))
                run = []
            if c is not None:
                out += [self.of_byte[b] for b in c.encode()]
        return out

    def cut(self, text: str) -> list[str]:
        return self.segments(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [i for s in self.cut(text) for i in self.encode_segment(s)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of byte pieces are put together, the blank that encoding added goes."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.bytes_:
                raw.append(self.bytes_[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i in self.control:
                continue
            piece = self.unknown_surface if i == self.unknown else self.text[i].replace(SPACE, " ")
            if not out and self.prefix and piece.startswith(" ") and i != self.unknown:
                piece = piece[1:]
                out.append("")
            out.append(piece)
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text)."""
        known = self.known
        if len(known) > self.bound:
            known.clear()
        segments = self.cut(text)
        for s in segments:
            if s not in known:
                ids = self.encode_segment(s)
                known[s] = (b"".join(b"%d " % i for i in ids), len(ids), self._surface(ids))
        got = [known[s] for s in segments]
        ids = b"".join([x[0] for x in got]) + b"%d" % self.end
        decoded = "".join([x[2] for x in got])
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        n = sum([x[1] for x in got]) + 1
        for s in segments:
            if len(s) > 64:
                known.pop(s, None)
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def _surface(self, ids: list[int]) -> str:
        """Decoded text of a segment that something stands before."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_:
                raw.append(self.bytes_[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            out.append(self.text[i].replace(SPACE, " "))
        return "".join(out) + (_utf8(bytes(raw)) if raw else "")


def _utf8(raw: bytes) -> str:
    """Bytes that are no UTF-8 become a replacement character each."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array, with the end id)."""

    def run(batch):
        pieces = PieceModel.of(model)
        return {"doc_id": batch["doc_id"], "ids": [pieces.encode(t or "") for t in batch["text"].to_pylist()]}

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batch):
        pieces = PieceModel.of(model)
        return {"doc_id": batch["doc_id"], "text": [pieces.decode(ids or []) for ids in batch["ids"].to_pylist()]}

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, segment by segment."""

    def run(batch):
        pieces = PieceModel.of(model)
        rows = [pieces.digest(t or "") for t in batch["text"].to_pylist()]
        n, ids, decoded = zip(*rows) if rows else ((), (), ())
        return {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
