"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns all documents that it keeps, with the columns of
``documents``; the last one returns packed pieces.  Between stages the documents are written and
read again.

Defined cases, by stage, each judged on its own input:

* language ID: a document without letters (a null or empty text, too) goes, as does one that no
  learned language explains with MOST_BITS bits a symbol; without any labelled row all go.
* quality: rows are judged one by one, with their text and site; without labels of both kinds all stay.
* near-dedup: of each group exactly one row stays, that with the smallest id (null last), of rows that
  share it that with the smallest hash of its text, and of equal rows one; a document without words is
  in no group and stays.  Rows that share an id are judged by their own texts.
* repeats: every place of a passage that starts twice goes, the first one too; a document of which
  nothing is left goes, an empty one stays; ``n_chars`` is counted anew.
* packing: a null or empty text is a piece with the end id only; null and repeated ids are packed as rows.

An empty table gives no rows at each stage.  Columns besides those used come along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from modelweave.llm import common, langid, minhash, packing, quality, substrings

#: Near-duplicates: percent of the union of five-word shingles that two documents share.
PERCENT = 80
#: Bytes of the shortest string that is removed where it repeats: some 40 to 50 words; and words of a string that is
#: removed even if it has fewer bytes.
REPEAT_BYTES, REPEAT_WORDS = 240, 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return langid.known_language(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality stay; the classifier learns from ``labels``."""
    return quality.good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash.one_of_each(docs, PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat, within a document or between documents, are removed from the texts."""
    return substrings.cleaned(docs, REPEAT_BYTES, REPEAT_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality classifier", good), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", pack)]

#: Cross-parsing, the classifier's fit and packing can't be expressed in SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop(before)
        before = docs
    return docs
