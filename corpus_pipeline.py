"""A corpus pipeline of five stages, each one operator of lodestream.llm.

Every stage takes what its predecessor kept (the columns of documents) and
returns the same columns, but for the last.  Further columns of docs pass
through the first four, whatever their names.  An empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from lodestream.llm.common import table
from lodestream.sources.scratch import temporary

NEAR_WORDS = 5  # of a shingle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it learns from the labelled ones among docs.

    Null and empty texts score as no words at all.  Each row is decided by its
    own text, also without an id or where an id repeats.  Without any label
    nothing is rejected.
    """
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found on many sites; n_chars follows the text where it lost lines.

    Null texts stay null, and a text that loses all its lines becomes empty.
    Rows that repeat stay, cleaned alike; a null source is no site.
    """
    # columns that no stage needs travel in a struct, so none can clash with what the operator adds
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    cleaned = line_dedup.remove_lines(docs.select("doc_id", "source", "text", F.struct(*rest).alias("rest")))
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    own = {c: F.col(f"rest.`{c}`") for c in rest} | {"n_chars": shorter}
    return cleaned.select(*(own.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null and empty texts are like nothing and stay, and so do rows without an
    id.  Rows that repeat a doc_id stay or go together.
    """
    dropped = minhash.near_duplicates(docs, n_words=NEAR_WORDS).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, docs.doc_id.eqNullSafe(dropped.doc_id), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark text.

    Null and empty texts overlap nothing and stay.  Each row is decided by its
    own text, also without an id or where an id repeats.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, one row for each row of docs.

    Null and empty texts have no ids.
    """
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage writes on its way is dropped once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
