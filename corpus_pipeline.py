"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of ``documents``:
doc_id, text, lang, source, n_chars.  Further columns of docs are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._store import written
from quern.llm.decontaminate import contaminated
from quern.llm.mixing import mix_sources
from quern.llm.ngram_join import near_duplicates
from quern.llm.pii import pseudonymise
from quern.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic; null and empty texts stay with the others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, keep=("text", "lang", "source", "n_chars")).where("predicted = 0").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with an id, of equal (doc_id, text) one, that of the least (lang, source, n_chars), nulls first; ``number`` is
    a row's own and orders rows as (doc_id, text) does.
    """
    one = docs.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    one = written(one.select("doc_id", "text", "r.lang", "r.source", "r.n_chars", F.sha2("text", 256).alias("h")), "rows")
    # Sorted by ranges, so the number of a row is that of its partition and its place in it.
    numbers = written(one.select("doc_id", "h").orderBy("doc_id", "h").withColumn("number", F.monotonically_increasing_id()), "numbers")
    return written(one.join(numbers, (one.doc_id == numbers.doc_id) & one.h.eqNullSafe(numbers.h)).select(*[one[c] for c in COLUMNS], "number"), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, and of repeated rows (equal id and text) one.

    Rows with null id are linked with nothing and all stay.  An id with several texts stands for several documents here, each
    judged by its own text; of these the text of least digest comes first.  Null and empty texts are linked with nothing.
    """
    docs = docs.select(COLUMNS)
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        later = near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(written(later, "later"), "doc_id", "left_anti").select(COLUMNS)
    rows = _numbered(known)
    later = near_duplicates(rows, id_col="number").where("component_id <> doc_id").select(F.col("doc_id").alias("number"))
    return rows.join(written(later, "later"), "number", "left_anti").select(COLUMNS).union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, and rows with null id stay.

    If one of several rows of an id holds an item, all rows of the id go.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = written(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.select(COLUMNS).join(found, "doc_id", "left_anti").select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones repeatedly, with surrogates for personal data and n_chars of the new text; null text and its n_chars are null."""
    out = pseudonymise(docs, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document is taken, with its text; null and empty texts count as one token,
    rows of null source as a source of their own.
    """
    return mix_sources(docs, keep=("text", "lang"), max_epochs=4.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix),
]

#: SQL cannot express the learned stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
