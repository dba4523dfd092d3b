"""A corpus pipeline: quality rules, SimHash near-dedup, substring dedup,
benchmark decontamination, SentencePiece round trip.

Each stage gets the documents that the one before it kept, as written to the
shared folder and read again; all but the last return the columns of
``documents``. No SQL can express the tokenizer or the fingerprints, so
``ORACLE_SQL`` is None and tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup
from ledgerlens.llm.common import materialise, read
from ledgerlens.llm.queries import tokenizer_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and every rule. Null and empty
    texts fail the base."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group within two bits
    (fingerprints of three-word shingles). Of repeated rows one stays."""
    return simhash_dedup.keep_one(docs, shingle=3, distance=2)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has are cut; a text
    that loses words has the rest joined by single spaces, and n_chars follows.
    A document that loses all its words goes; others keep their text."""
    cut = substring_dedup.remove_repeats(docs, window=50, carry=docs.columns).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    return cut.select(*[
        F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new
        else F.col(f"row.`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, and the digest of what they decode to."""
    out = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", substrings),
          ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the
    shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
