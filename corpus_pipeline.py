"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, minhash_dedup, mixing, token_output
from tidemark.llm.common import shared_folder
from tidemark.llm.queries import table, vocabulary

#: A document whose named language has a smaller share of its letters is a mixture that no language's corpus wants.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or without a clear language go.

    So null, empty and blank texts go; long ones are read whole, repeated rows are judged alike, no documents give none, and columns
    named as the operator's results keep their values.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # no name of the operator's can be among them
    found = language_id.identify(docs.toDF(*names), language_id.learn(docs), text=names[docs.columns.index("text")])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (4-word shingles, 0.8): that with the smallest doc_id.

    Rows equal in id and text become one. Rows with a null id take part and yield to rows with one; rows that share an id but not the
    text are documents of their own. Null and empty texts are no duplicates of one another. No documents give none.
    """
    return minhash_dedup.keep_one(docs, width=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule doesn't mark, judged row by row: ids may be null or repeated.

    Null and empty texts stay, a text exactly at the rule's share goes, repeated rows are judged alike, no documents give none.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to the corpus's weights: a document of an over-full leaf may go, one of a short leaf may come twice.

    Null lang, source or id count as ''; null and empty texts as one token; rows that tie (equal ids) stay or go together; no
    documents give none.
    """
    mine = ["doc_id", "text", "lang", "source"]
    others = [c for c in docs.columns if c not in mine]
    away = docs.select(*mine, F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("others"))  # no name of the operator's can be among them
    back = {c: F.col(f"others.c{k}") for k, c in enumerate(others)}
    return mixing.mix(away, mixing.corpus_weights(spark), mixing.corpus_domain()).select(*[back.get(c, F.col(c)).alias(c) for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; null ids come first and repeated ones in order of text; a text may span any number of
    batches; no documents give no files and no rows.
    """
    return token_output.encode_documents(docs, vocabulary(), shared_folder(spark) + "/tokens")


STAGES = [("language_id", identify_language), ("minhash_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixture", mix_sources), ("token_output", write_tokens)]

#: SQL can't express the language model, the mixture's hashes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; a stage reads what the one before has written."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
