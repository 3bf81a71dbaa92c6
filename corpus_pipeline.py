"""Documents to training tokens in five stages, each written as Parquet and read again as the next one's documents.

1. Language ID: documents without a language, or far from every prototype, go.
2. Near-duplicates on shingles of five words: SimHash classes and MinHash bands name candidates, and one document of each class of
   similarity 0.8 or more stays, the one of the smallest id.
3. Benchmark decontamination: documents that contain a benchmark item go.
4. Mixing: every document comes as often as the mix of sources takes it.
5. Token output: documents are written as packed ids; the rows report what the files hold.

Documents without an id pass the first, third and fourth stage like any other; of those the second keeps one per class.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import decontaminate, language, mixing, near_copies, packing
from logsieve.llm.queries import END_ID, VOCABULARY_SIZE, vocabulary_path
from logsieve.llm.work import new_folder, read

#: A text whose cosine with the nearest language is below this is no text of a known language: vectors of 1,024 places that
#: have nothing in common are some 0.03 apart from 0, and a short sentence of a known language lies above 0.05.
LEAST_COSINE = 0.05


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("row"))
    found = language.identify(rows, ~language.held_out())
    keep = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_COSINE)
    return found.where(keep).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.round_trip(docs, vocabulary_path(), VOCABULARY_SIZE, END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", token_files),
]

#: SQL can express neither the language model nor fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
