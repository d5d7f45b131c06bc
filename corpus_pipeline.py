"""A training corpus from the table of documents, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.chunk_bpe import encode
from evenhand.llm.language import fit_profiles, held_out, predict
from evenhand.llm.mixing import label_weights, mix
from evenhand.llm.ngram_trie import near_classes
from evenhand.llm.queries import table, vocabulary
from evenhand.llm.scratch import remove
from evenhand.llm.substring import remove_repeats
from evenhand.sources.sinks import scratch_path


#: Texts that score less are in none of the learned languages. Documents of the test tables score 0.39 and more, also those
#: of one word; a text in another script scores 0.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents in which a language is found; those without a letter (or without text), or far from every profile, go."""
    profiles = fit_profiles(docs.filter(~held_out()))
    found = predict(docs, profiles, keep=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies; of rows that repeat an id and a text, one."""
    near = near_classes(docs)
    kept = near.filter(F.col("id").eqNullSafe(F.col("component")))
    kept = kept.groupBy(F.col("id").alias("kept_id")).agg((F.count(F.lit(1)) > 1).alias("repeated"))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once, more = rows.filter("NOT repeated").select(*docs.columns), rows.filter("repeated").select(*docs.columns)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that already stand elsewhere are cut out; ``n_chars`` follows the text."""
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix(docs, quality=label_weights(table(spark, sf_dir, "labels")), carry=True)
    copies = mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return copies.select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    coded = encode(docs, vocabulary(), extra=["source"])
    return coded.select(F.col("id").alias("doc_id"), F.col("x0").alias("source"), "n_tokens", "ids")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("BPE encoding", encode_texts),
]

#: Language ID and BPE have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # a stage's table goes when the next one's is written
            remove(spark, before)
        before = path
    return docs
