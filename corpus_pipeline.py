"""From raw documents to packed training sequences, in five stages.

Each stage reads what the stage before it kept, as a written table. Quality rules and language ID reject documents,
near-duplicate groups keep one, the mix repeats or drops words of a source to reach its target, and packing gives the
pieces' places in the sequences.

Nulls: a null text has no words, so quality rules reject it; a null lang or source is kept, and so is a null doc_id, unless a
near copy of the document has an id. Empty texts are rejected too; very long ones are read whole by each stage. Of repeated
rows near-dedup keeps one, of a group of copies the one with the smallest id. A document whose score equals a threshold
stays. Extra columns pass all stages but the last, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import language, mixing, near_copies, packing, quality_rules, queries
from cadenza.llm._work import TEXTS, discard, scratch, written

#: Below this share of n-grams known in the best language, a text is taken for noise or a mixture.
LANGUAGE_FROM = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trained model. Labels are in the labels table."""
    model = quality_rules.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).where("kept").select("row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough of their n-grams."""
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_FROM)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles): the one with the smallest id."""
    return near_copies.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each time that a document comes."""
    return mixing.rows(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]

#: Trained models and a tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:  # what the stage worked with goes when its table is written
            docs = written(stage(spark, docs, sf_dir), "stage", batches=TEXTS)
            made.pop()
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
