"""Language identification by cross-parsing entropy.

Method: the letters of labelled texts of each language go into a suffix automaton.  A text is parsed
against each automaton: a phrase is the longest match that begins where the last one ended.  The
fewer phrases a language needs, each charged the logarithm of its reference's length, the fewer bits
a symbol costs, and the cheapest language wins (the first by name, if two cost the same).

Texts are lower-cased, anything but letters becomes one blank, and they are parsed whole, in
stretches of STRETCH symbols, at whose ends a phrase ends for every language alike.  All stretches
of a batch advance together, one array operation a step.

Defined cases: a null text or one without letters is ``und`` with score 0; without any labelled row
every text is; rows repeated are predicted once each; an empty table gives no rows; extra columns
are ignored.  The score is the winner's share of 2 ** (-SHARPNESS * bits per symbol).

Fitting: at most PIECES pieces of PIECE characters per language, chosen by a hash of the id and cut
at a hashed place of whole texts, of which at most SYMBOLS symbols enter the automaton.  This bound
is per language; everything else is a map over all rows without shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIECES, PIECE, SYMBOLS = 300, 600, 16_000
STRETCH = 256
SHARPNESS = 4.0
#: Bits a symbol; letters drawn at random need over 6, and the four languages of the test data 2 to 3.
MOST_BITS = 6.5
UNDETERMINED = "und"
_UNKNOWN = 255


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transition table [states, width] of all substrings; row 0 is the dead state, row 1 the start."""
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.zeros((len(step), width), np.int32)
    for state, out in enumerate(step):
        for c, to in out.items():
            table[state, c] = to
    return table


@dataclass
class LanguageModel:
    """Languages in the order of their names, with the automaton and the symbol cost of each."""

    languages: list[str]
    letters: dict[str, int]  # letter -> symbol from 1; 0 is a blank, 255 any other letter
    tables: list[np.ndarray]  # transitions, states multiplied by the width
    cost: list[float]  # bits of a phrase

    @property
    def width(self) -> int:
        return _UNKNOWN + 1 if len(self.letters) >= _UNKNOWN - 1 else len(self.letters) + 2

    def codes(self) -> np.ndarray:
        """Symbol of each code point."""
        if not hasattr(self, "_codes"):
            own = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000).astype(np.uint8) * (self.width - 1)
            for c, k in self.letters.items():
                own[ord(c)] = k
            self._codes = own
        return self._codes

    def symbols(self, text: str) -> np.ndarray:
        """Letters as symbols, all else as single blanks."""
        own = self.codes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        blank = own == 0
        if len(own):
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            own = own[keep]
        return own

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """([texts, languages] bits per symbol, has letters)."""
        coded = [self.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        has = np.array([bool(x.any()) for x in coded], bool)
        sizes = np.array([len(x) for x in coded])
        flat = np.concatenate([*coded, np.zeros(STRETCH, np.uint8)]).astype(np.int32)
        base = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = base[owner] + nth * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches longer than j
        phrases = np.ones((len(self.tables), len(owner)), np.int32)
        state = np.full((len(self.tables), len(owner)), self.width, np.int32)
        for j in range(STRETCH):
            n = active[j]
            if not n:
                break
            c = flat[start[:n] + j]
            for k, table in enumerate(self.tables):
                to = table[state[k, :n] + c]
                ended = to == 0
                phrases[k, :n] += ended
                again = table[self.width + c]
                state[k, :n] = np.where(ended, np.where(again == 0, self.width, again), to)
        total = np.stack([np.bincount(owner, p, len(texts)) for p in phrases], 1) if len(self.tables) else np.zeros((len(texts), 0))
        return total * np.array(self.cost) / np.maximum(sizes, 1)[:, None], has


def fit(samples: dict[str, list[str]], symbols: int = SYMBOLS) -> LanguageModel:
    """Automata of the given texts per language."""
    counts: dict[str, int] = {}
    for texts in samples.values():
        for t in texts:
            for c in t.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
    letters = {c: k for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[: _UNKNOWN - 1], 1)}
    model = LanguageModel(sorted(samples), letters, [], [])
    for name in model.languages:
        text = " ".join(dict.fromkeys(samples[name]))  # a text that many documents repeat counts once
        own = model.symbols(text)[:symbols]
        model.tables.append((suffix_automaton(own, model.width) * model.width).ravel())
        model.cost.append(float(np.log2(len(own) + 2)))
    return model


def sample(labelled: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> dict[str, list[str]]:
    """At most so many pieces of text per language (columns doc_id, text, lang)."""
    mixed = F.xxhash64(F.col("doc_id"))
    own = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", mixed.alias("h"), F.substring("text", F.lit(1) + F.pmod(F.shiftright(mixed, 7), F.greatest(F.length("text") - piece, F.lit(1))).cast("int"), F.lit(piece)).alias("piece")
    )
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= pieces)
    found: dict[str, list[str]] = {}
    for row in first.orderBy("lang", "k").select("lang", "piece").collect():  # languages * pieces rows at most
        found.setdefault(row["lang"], []).append(row["piece"])
    return {name: texts for name, texts in found.items() if any(c.isalpha() for t in texts for c in t)}


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def predictor(spark: SparkSession, model: LanguageModel, sharpness: float = SHARPNESS) -> Callable[[Column], Column]:
    """A function of a text column: struct of lang_pred, score and bits (per symbol, by the winner).

    Only texts are sent to Python, and only these three values come back."""
    shared = spark.sparkContext.broadcast(model)  # languages * SYMBOLS states

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            parts = [judge(own, texts.slice(at, 1024)) for at in range(0, len(texts), 1024)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    def judge(own: LanguageModel, texts: pa.Array) -> pa.Array:
        bits, has = own.bits(texts.to_pylist())
        if own.languages:
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(-sharpness * (bits - low[:, None])).sum(1)
            lang = [own.languages[k] if ok else UNDETERMINED for k, ok in zip(best, has)]
        else:
            low = share = np.zeros(len(texts))
            lang = [UNDETERMINED] * len(texts)
            has = np.zeros(len(texts), bool)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(has, share, 0.0)), pa.array(np.where(has, low, 0.0))], fields=list(kind))

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
    return F.arrow_udf(run, "lang_pred string, score double, bits double")


def predict(docs: DataFrame, model: LanguageModel, sharpness: float = SHARPNESS) -> DataFrame:
    """All columns of ``docs`` but those that clash, with lang_pred, score and bits (per symbol, by the winner)."""
    added = ("lang_pred", "score", "bits")
    own = predictor(docs.sparkSession, model, sharpness)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    found = common.small_batches(docs).select(*kept, own(F.col("text")).alias("lang_pred"))
    return found.select(*kept, *(F.col(f"lang_pred.{c}").alias(c) for c in added))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out, and predict all."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(sample(narrow.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))))
    texts = narrow.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict(texts, model).drop("text")


def known_language(docs: DataFrame, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents, with all their columns, that are in a language learned from the others: those without letters go,
    and those of which no language explains the letters with at most ``most_bits`` bits a symbol."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(sample(narrow.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))))
    own = predictor(docs.sparkSession, model)(F.col("text"))
    return common.small_batches(docs).where((own["lang_pred"] != UNDETERMINED) & (own["bits"] <= most_bits))
