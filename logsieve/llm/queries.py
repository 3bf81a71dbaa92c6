"""One query per operator, over the whole tables of a folder."""

import os

from pyspark.sql import DataFrame, SparkSession

from logsieve.llm import conversation_trie, decontaminate, exact_dedup, html_text, language, lexical, licenses, line_runs, mixing, packing, ppm, simhash, unit_dedup
from logsieve.llm.work import read

#: Vocabulary file, its size and the id that ends a document, for token output.
VOCABULARY, VOCABULARY_SIZE, END_ID = "word_bpe_49k.json", 49_408, 2


def vocabulary_path() -> str:
    """Where the tokenizer file lies: LOGSIEVE_VOCABULARY, or else the installed public files."""
    if path := os.environ.get("LOGSIEVE_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"), ppm.held_out())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup_line_runs(read(spark, sf_dir, "documents"), min_words=50)


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.dedup_units(read(spark, sf_dir, "documents"), min_words=20, min_stretch=20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.round_trip(read(spark, sf_dir, "documents"), vocabulary_path(), VOCABULARY_SIZE, END_ID)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.held_out()
    found = language.identify(read(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_openings(read(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_simhash, op2_html_text, op3_decontaminate, op4_ppm, op5_mixing, op6_exact_dedup, op7_line_runs, op8_unit_dedup, op9_packing,
        op10_language, op11_licenses, op12_conversation_trie, op13_lexical_search,
    )
}
