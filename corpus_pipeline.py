"""A corpus through five of the operators: rules, near-duplicates, repeated passages, benchmark, encoding.

Rows of ``documents`` are addressed by doc_id: rows that share an id are one document and share its fate;
rows with a null id pass every filter (all but the quality rules have no verdict on them). Each stage sees all
that the one before kept; the tables between stages are Parquet in the shared folder, the last but one is
deleted when the next is written.

Defined results: a null or empty text fails the quality rules, so its id goes; repeated rows stay or go
together; of a near-duplicate group the smallest id stays (ids cannot tie; rows of one id are one document);
an empty table gives an empty result of the same columns; further columns pass through every stage whatever
their names, but for the last stage, which returns ids and pieces only.

The near-duplicate stage links texts as ``op6_simhash_near_dedup`` does: three-word shingles, two bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribewash.llm.common import discard, materialise, table, without_ids
from scribewash.llm.decontaminate import decontaminate
from scribewash.llm.quality_rules import quality_rules
from scribewash.llm.sentencepiece_viterbi import encode
from scribewash.llm.simhash import simhash_groups
from scribewash.llm.suffix_dedup import suffix_dedup

#: Not expressible in SQL (robust estimates, sequential majorities, Viterbi): tests/llm holds it against brute force.
ORACLE_SQL: str | None = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return without_ids(docs, quality_rules(docs).where("NOT kept").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the smallest id stays."""
    return without_ids(docs, simhash_groups(docs).where("doc_id <> component_id").select("doc_id"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are cut; a text that is cut whole stays as an empty one."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    prefix = "cut_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    cut = suffix_dedup(docs, keep=others, as_text=True, prefix=prefix)
    kept = f"{prefix}kept"
    texts = {"text": F.col(kept).alias("text"), "n_chars": F.length(kept).cast("long").alias("n_chars")}
    return cut.select(*[texts.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_ids(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces."""
    return encode(docs).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
