"""A training-corpus pipeline over the operators of ``tallyframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: documents of poor
quality go, one document of each near-duplicate group stays, documents that
overlap the benchmark go, secrets are blanked in place, and the rest is mixed by
source. All but the last return the columns of documents. The last returns the
mixed corpus: a row for each time a document is drawn, by shard and in the
shard's order, with the columns of ``mixing.OWN`` beside those of documents.

Edge cases, in every stage: a null text counts as empty and stays null where its
row stays; null ids, langs and sources are kept; extra columns are carried and
never read, whatever their names (but the last stage's own names replace equal
ones); rows may be repeated; an empty table gives an empty result.
Quality: empty texts score by the bias alone; without labels of both kinds no row
goes. Near-duplicates: empty texts are one group; of rows equal in id and text one
stays; of a group the row with the least hash of id and text stays, the same in
every run. Benchmark: empty texts and empty items overlap nothing. Secrets: texts
without a span stay as they are; n_chars follows the text. Mixing: texts without
words are never drawn; a source of any size takes its target, rounded down, but
for rows equal in id and text at its cut. Very long texts are read whole
everywhere, a row or a bounded piece at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixing, quality, secrets, simhash
from tallyframe.sources.encodings import table
from tallyframe.storage import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]
#: Learned scores, sketches and spaced seeds have no counterpart in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
