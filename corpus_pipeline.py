"""A training corpus from documents: language ID, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs. Decisions are by doc_id:
rows that share an id share their fate, and rows without an id are never dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.llm import language, minhash, mixing, sstable, tiling
from ladle.llm.storage import discard, materialize

#: Near copies share 80 % of their shingles of five words; in 54 bands of 7 a pair at 80 % is missed with a chance of 3e-6.
NEAR = {"per_cent": 80, "shingle": 5, "bands": 54, "rows": 7}
#: Decisions on so many documents may be broadcast (16 bytes each); more of them are joined by shuffles.
BROADCAST_DECISIONS = 1_000_000
#: Words whose ids a worker remembers while it writes tokens, twice that at most; it forgets them after each task, as the workers serve all stages.
CACHE_WORDS = 80_000


def _small(decisions: DataFrame) -> DataFrame:
    decisions = materialize(decisions, "decisions")
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_DECISIONS else decisions.hint("merge")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(_small(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those whose language compression can't tell.

    Rows without an id stay whatever their text. Where nothing is learned, as from an empty table or one without languages, every document with an id goes."""
    dictionaries = language.learn(docs.where(language.fold() != 1))
    return _without(docs, language.identify(docs, dictionaries).where("rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class.

    Null, empty and blank texts are like nothing and stay, as rows without an id do. Rows that share an id share their class. An empty table stays empty."""
    return _without(docs, minhash.near_duplicates(docs, **NEAR).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item.

    Null and empty texts leak nothing, and null and empty items are leaked by nothing. Rows without an id stay. Without documents or items nothing goes."""
    return _without(docs, tiling.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    A null source is a source, the last in order; texts without words have size 0. Of rows that share an id each comes as often as the one of them that the mix takes most often. Ties in
    rank go by hash and id, so that reruns agree. An empty table stays empty."""
    taken = mixing.mix_sources(docs.select("doc_id", "text", "source")).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    # what the mix says stands in structs and at the end, whatever the columns of docs are called
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    met = rows.join(_small(taken.select(F.struct("doc_id", "copies").alias("mixed"))), F.col("document.doc_id").eqNullSafe(F.col("mixed.doc_id")))
    return met.select("document", F.explode(F.sequence(F.lit(1), F.col("mixed.copies").cast("int")))).select("document.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids to shards and reads them back: (doc_id, start, n_tokens, ids_crc32) of each row, in the order of ids, null first.

    A null or empty text has the end id alone; rows that share an id have a row each, in the order of their texts. An empty table gives none."""
    manifest = sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, cache_words=CACHE_WORDS, keep=False)
    return sstable.read_shards(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("tokens", write_tokens)]

#: Compression, tokenization and hashing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's documents are deleted when those of the next one are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
