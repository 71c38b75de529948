"""Exact library tokenisation at the speed of a dictionary.

Both byte-pair vocabularies split a text before merging, and never inside a run of characters
that are not white space.  So the ids of a text are those of its white-space delimited chunks,
one after the other, and each distinct chunk has to go through the library only once while it is
remembered.  A new chunk of plain characters is normalised and split here, by the rules that the
tokenizer's file states, and the library's merges run on its words; any other chunk, and any text with
a special token in it, goes through the whole library.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from collections.abc import Iterable
from operator import attrgetter

import regex
from tokenizers import Tokenizer

#: Unicode White_Space, which is what ``\s`` means to the library (Python's has four more).
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks of a tokenizer that drops white space.
WORDS = f"[^{WS}]+"
#: Chunks of a tokenizer that gives one leading blank to a word and keeps other white space.
BLANK_WORDS = f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
_PYTHON_ONLY_WS = "\x1c\x1d\x1e\x1f"
#: What a text that is simply cut at blanks and line feeds has none of: other white space, and runs of it.
_NOT_SIMPLE = ("  ", " \n", "\n ", "\n\n\n", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Chunks whose normal form and classes of characters are the same in all versions of Unicode: ASCII, Latin-1 and
#: Latin Extended-A without the letters whose lower case is longer than themselves.
_PLAIN = re.compile(" ?[!-~\xa1-\xac\xae-\u012f\u0131-\u0148\u014a-\u017f]+").fullmatch
#: How GPT-2's byte-level vocabularies split text (a fixed value).
_BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in itself else next(others)) for b in range(256))


_LETTERS = _byte_letters()
_BLANK = _LETTERS[0x20]
#: Letters of ASCII and one of these after them are two words to a byte-level vocabulary.
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``cache``: most distinct chunks remembered (about 200 bytes each).  When they are too many, those
    used since the last time are kept for as long again.
    Chunks of over 64 characters are not remembered.
    """

    _own: dict[tuple, ChunkEncoder] = {}

    def __init__(self, path: str, pattern: str, cache: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.words_only = pattern == WORDS
        self.find = re.compile(pattern).findall
        self.known, self.spaced = _Memory(self, ""), _Memory(self, " ")
        self.most = cache // 2
        self.n_ids = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.specials = [t["content"] for t in rules["added_tokens"]]
        self.lower, split = self._plain_rules(rules)
        self.split = regex.compile(split).findall if split else None
        self.merge = self.tokenizer.model.tokenize

    @staticmethod
    def _plain_rules(rules: dict) -> tuple[bool, str | None]:
        """(lower case?, pattern that splits a chunk) where the file's rules are among the known ones, else (False, None)."""
        steps = (rules["normalizer"] or {}).get("normalizers", [rules["normalizer"]] if rules["normalizer"] else [])
        kinds = [x["type"] for x in steps]
        pre = rules["pre_tokenizer"] or {}
        if not kinds and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return False, _BYTE_LEVEL_SPLIT
        if kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " " and pre.get("type") == "Sequence":
            cut, letters = [*pre["pretokenizers"], {}, {}][:2]
            if (cut.get("type"), cut.get("behavior"), cut.get("invert")) == ("Split", "Removed", True) and letters.get("type") == "ByteLevel" and not letters["use_regex"] and not letters["add_prefix_space"]:
                return True, cut["pattern"]["Regex"]
        return False, None

    @classmethod
    def of(cls, path: str, pattern: str) -> ChunkEncoder:
        """The worker's own encoder, kept between tasks."""
        if (path, pattern) not in cls._own:
            cls._own[path, pattern] = cls(path, pattern)
        return cls._own[path, pattern]

    def chunks(self, text: str) -> list[str]:
        if self.words_only and not any(c in text for c in _PYTHON_ONLY_WS):
            return text.split()
        return self.find(text)

    def _word(self, word: str, id_of=attrgetter("id")) -> bytes:
        """The ids of one word, which no rule splits further."""
        if word.isascii() and " " not in word[1:]:
            letters = word if word[0] != " " else _BLANK + word[1:]
        else:
            letters = codecs.charmap_decode(word.encode(), "strict", _LETTERS)[0]
        return _bytes(map(id_of, self.merge(letters)))

    def learn(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't known."""
        if self.split and not self.lower and chunk.isascii():
            # what most chunks are: a word, or one with a mark after it
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return self._word(chunk)
            if word[-1:] in _MARKS and word[:-1].isalpha():
                return (self.spaced[word[:-1]] if chunk[0] == " " else self.known[word[:-1]]) + self.known[word[-1]]
        if self.split is None or not _PLAIN(chunk):
            return _bytes(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids)
        plain = chunk.lower() if self.lower else chunk
        if (plain if plain[0] != " " else plain[1:]).isalpha() or len(words := self.split(plain)) == 1:
            return self._word(plain) if plain == chunk else self.known[plain]
        return b"".join([self.known[w] if w[0] != " " else self.spaced[w[1:]] for w in words])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null is an empty text."""
        if len(self.known) + len(self.spaced) > self.most:
            self.known, self.spaced = _Memory(self, "", self.known), _Memory(self, " ", self.spaced)
        return [self._encode(t) if t else b"" for t in texts]

    def _encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        known = self.known.__getitem__
        if self.words_only or text.endswith("\n\n") or any(c in text for c in _NOT_SIMPLE):
            return b"".join(map(known, self.chunks(text)))
        # single blanks and line feeds only: each word but a line's first has the blank before it
        spaced, feed, out = self.spaced.__getitem__, known("\n"), []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append((known(first) if first else b"") + b"".join(map(spaced, rest)))
        return feed.join(out)


class _Memory(dict):
    """Ids of chunks, which all begin with ``prefix``, by what follows it; what is missing is learnt.

    ``before``: the memory that this one follows; what is still used of it is taken over."""

    def __init__(self, encoder: ChunkEncoder, prefix: str, before: _Memory | None = None):
        self.encoder, self.prefix, self.before = encoder, prefix, before or {}
        if before:
            before.before = {}

    def __missing__(self, rest: str) -> bytes:
        if (ids := self.before.get(rest)) is None:
            ids = self.encoder.learn(self.prefix + rest)
        if len(rest) <= 64:
            self[rest] = ids
        return ids


def _bytes(ids: Iterable[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()
