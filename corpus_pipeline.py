"""Documents to a training mix: toxicity, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and gives the table reread to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelogic.llm.common import Scratch
from tracelogic.llm.decontaminate import decontaminate
from tracelogic.llm.minhash import near_duplicates
from tracelogic.llm.mixing import mix
from tracelogic.llm.secrets import scan
from tracelogic.llm.toxicity import score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score below 0.7)."""
    return score(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Rows are found again by doc_id and text hash, so each row follows its own verdict: null ids and different texts
    under one doc_id are documents like others. Of rows that repeat both, one stays; texts without words are linked
    with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs).where("chosen").groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"), F.max("n_shingles").alias("_shingles"))
    found = Scratch(spark).save(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), ((F.col("_n") > 1) & (F.col("_shingles") > 0)).alias("_repeats")))
    kept = docs.withColumn("_text", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    if not found.where("_repeats").isEmpty():
        kept = kept.where(~F.col("_repeats")).unionByName(kept.where("_repeats").dropDuplicates(["doc_id", "_text"]))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; each row, whatever its doc_id, by its own text."""
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=rest).where("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in text and n_chars counted anew where one was."""
    found = scan(docs.select(*COLUMNS))
    text = F.col("clean_text")
    n = F.when(F.col("n_secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each."""
    return mix(docs.select(*COLUMNS)).where("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the forest and the seeded mix; tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
