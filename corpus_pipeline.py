"""Corpus preparation: the stages that turn ``documents`` into packed training sequences."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import mixing, packing, quality_classifier, simhash, suffix_dedup
from basketlens.llm.common import bounded_batches, table
from basketlens.llm.queries import tokenizer_path
from basketlens.session import drop_scratch, ensure_checkpoint_dir, materialize, recorded_scratch, scratch_path

#: Bytes of a string that counts as repeated in the pipeline: passages of over 50 words are hardly ever shorter.
REPEAT_BYTES = 200
#: Bytes of its anchors: narrow ones, since the anchors of short strings lie close together.
GRAM_BYTES = 64

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: dict[str, list[str]] = {}


def stage(fn: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the stages before it.

    Those stages' results have been written by then, as the stages of a pipeline
    are called in turn, each on what the one before has left on disk. A stage's
    own tables stay until a later stage begins or the process ends, since its
    frame still reads them.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        bounded_batches(spark)
        for name in [n for n in _tables if n != fn.__name__]:
            for path in _tables.pop(name):
                drop_scratch(spark, path)
        with recorded_scratch() as paths:
            out = fn(spark, docs, sf_dir)
        _tables.setdefault(fn.__name__, []).extend(paths)
        return out
    return run


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps (a text without a word goes)."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the id, or for a row without one a negative hash of its text."""
    return docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text") % 2 ** 62) - 1))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class: the first by id, fingerprint and text hash (rows that share an id are rows of their own)."""
    numbered = materialize(_keyed(docs).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    classes = simhash.near_duplicate_classes(numbered, id_col="__row", shingle=3, max_bits=3)
    ranks = numbered.select("__row", "__key", F.sha2("text", 256).alias("__hash")).join(classes.withColumnRenamed("doc_id", "__row"), "__row")
    keep = ranks.groupBy("component_id").agg(F.min_by("__row", F.struct("__key", "fingerprint", "__hash", "__row")).alias("__row")).select("__row")
    return numbered.join(keep, "__row", "left_semi").select(docs.columns)


@stage
def suffix_dedup_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of ``REPEAT_BYTES`` bytes that also start elsewhere."""
    return suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, gram=GRAM_BYTES).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the words that each document gives, once or twice (a row per copy)."""
    keyed = _keyed(docs)
    mixed = mixing.mixed_texts(keyed, id_col="__key").select(docs.columns)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 2,048 tokens."""
    return packing.pack(docs, tokenizer_path(), window=2048, end_id=1)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup_texts),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
