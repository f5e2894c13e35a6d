"""The corpus pipeline: five stages, each a DataFrame in and a DataFrame out, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_id, mixing, near_copies, packing, quality
from quillspark.llm.common import table, unused, written
from quillspark.llm.queries import MIX, tokenizer_path

#: A text whose likeliest language has less than this is rejected, as is one without a letter.
LANGUAGE_SCORE = 0.4
#: Near copies: words of a shingle, and the least Jaccard similarity. Fingerprints of the shingles meet within so many bits.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, all columns as they are.

    Edge cases: null, empty and letterless texts go, and all do where no label was learned. Null ids and repeated rows stay, and
    so do columns of any name; an empty table gives no rows."""
    found = unused(docs, "__found")
    known = docs.select("*", language_id.language_of(F.col("text"), language_id.fit(docs)).alias(found))
    return known.where((F.col(f"{found}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{found}.score") >= LANGUAGE_SCORE)).drop(found)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, all columns as they are.

    Edge cases: null and empty texts have the evidence of no words, all texts that of 0.5 where labels don't tell good from bad;
    null sources are one host, null languages one path of it. Null ids and repeated rows stay; an empty table gives no rows;
    columns may have any names but those that begin with ``__``."""
    evidence = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, evidence, F.col("source"), F.col("lang"))
    return scored.where("__q.keep").drop("__q")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more, directly or by a chain): the one with the
    smallest id, null after all others. SimHash fingerprints find them by op9's index, exact sets decide, and bands find those
    whose fingerprints are too far apart. Rows count by id and text, so rows that share an id, or have none, are treated like others.

    Edge cases: null, empty and wordless texts are one group; of rows that are equal in id and text one stays, whatever else they
    hold. An empty table gives no rows; columns may have any names."""
    found = near_copies.near_copies(docs.select("doc_id", "text"), SIMILARITY, SHINGLE, radius=RADIUS)
    key = unused(docs, "__key")
    keyed = docs.select("*", near_copies.row_key(F.col("doc_id"), F.col("text")).alias(key))
    return keyed.join(found.where("keep").select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order: blocks of all sources permuted, copies of a document in blocks apart.

    Edge cases: null sources are one source; null and empty texts have no tokens and stay, as often as their source is taken
    whole. Null ids and repeated rows are documents of their own; an empty table gives no rows; columns may have any names but
    those that begin with ``__mix``."""
    return mixing.in_order(mixing.temperature_mix(docs, **MIX))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences.

    Edge cases: a null or empty text is its end token alone. Null ids and repeated rows are documents of their own; an empty table
    gives no rows; other columns are not read."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Networks, tokenizers and components by iteration: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What stands between them is Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
