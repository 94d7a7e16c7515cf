"""A training corpus from raw documents, in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm import decontam, langid, mixing, near_dedup, token_output
from quernlake.llm.common import write_and_reread


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _row_key():
    """What tells rows apart in the eyes of the operators: the id and the text, nulls being values of their own."""
    said = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(said[0], F.lit(" "), said[1])))


def _without(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without the rows that judge(docs with a key column, its name) returns. Rows that share an id and a text share their fate."""
    key = _fresh(docs, "row_key")
    keyed = docs.withColumn(key, _row_key())
    gone = judge(keyed, key).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, and texts without a letter. Profiles are learned from the documents at hand."""
    del spark, sf_dir
    lang, score = _fresh(docs, "lang_found"), _fresh(docs, "lang_score")
    told = langid.identify(docs, langid.train_on(docs), lang_col=lang, score_col=score)
    return told.where(F.col(lang) != langid.UNDETERMINED).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows without an id stay. Rows that repeat an id are judged each: one may stay while another, of another group, goes.
    """
    del spark, sf_dir
    return _without(docs, lambda keyed, key: near_dedup.near_dedup(keyed, carry=(key,)).where("NOT kept AND doc_id IS NOT NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items in a twentieth of their words or more go, each row being judged by its own text."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda keyed, key: decontam.decontaminate(keyed, tests, carry=(key,)).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, be it never."""
    del spark, sf_dir
    mixed = mixing.mix(docs, carry=True).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and what is read back from them: doc_id, start, n_tokens, ids_crc32 of each row."""
    del spark, sf_dir
    return token_output.token_output(docs, token_output.default_tokenizer())


STAGES = [
    ("language id", identify_language),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: SQL has no tokenizer; tests/llm/test_oracles_and_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = write_and_reread(docs, name.replace(" ", "-"))
    return docs
