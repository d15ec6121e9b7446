"""A corpus pipeline: each stage takes the documents that the one before it kept.

Every stage decides on each row by a key of its own, made of the file and the place in
it, so null and repeated ids do no harm, no text is moved to make keys, and stages share no
state.  All stages but the last return the columns of ``documents``.

Results in the odd cases: null text has no language and goes in the first stage; of equal or
alike rows the one of the smallest id stays (null last; of equal ids, the first in the
files); an empty table gives an empty result; extra columns are kept, whatever their
names, but for names that start with ``_veriloom_``, which are an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.llm.common import few, scoped, written
from veriloom.llm.exact_dedup import exact_dedup
from veriloom.llm.language import UNKNOWN, fit, held_out, predict
from veriloom.llm.mixing import mix
from veriloom.llm.near_dedup import near_dedup
from veriloom.llm.packing import pack
from veriloom.llm.tokens import vocabulary

#: SQL can't express the trained, random and tokenized stages; tests compare with brute force.
ORACLE_SQL = None

OWN = "_veriloom_"
ROW, FILE, GONE, COPIES, COPY = (OWN + x for x in ("row", "file", "gone", "copies", "copy"))
#: Rows that a file may have.
IN_FILE = 1 << 40


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row: the number of its file, in order of names, and its place there."""
    if taken := [c for c in docs.columns if c.startswith(OWN)]:
        raise ValueError(f"columns {taken} have a reserved name")
    try:
        placed = docs.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    except AnalysisException:  # rows of no file
        docs = written(docs, "rows")
        placed = docs.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    # one row for each file
    files = placed.select(FILE).distinct().select(FILE, (F.row_number().over(Window.orderBy(FILE)) - 1).cast("long").alias(OWN + "no"))
    return placed.join(few(written(files, "files")), FILE).withColumn(ROW, F.col(OWN + "no") * IN_FILE + F.col(ROW)).drop(FILE, OWN + "no")


def spared(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of keyed ``docs`` whose key is not in ``rejected``, without keys."""
    gone = few(written(rejected.select(F.col(ROW).alias(GONE)), "gone"))
    return docs.join(gone, F.col(ROW) == F.col(GONE), "left_anti").drop(ROW)


def others(docs: DataFrame, decided: DataFrame, group: str, size: str) -> DataFrame:
    """Keys of all rows of a group but the one of the smallest id.  Only groups of several rows are looked at."""
    several = few(written(decided.where(F.col(size) > 1).select(F.col("doc_id").alias(ROW), F.col(group).alias("g")), "groups"))
    rows = written(docs.select(ROW, "doc_id").join(several, ROW), "members")
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("first"))).alias("f"))
    return rows.join(few(written(first.select("g", "f.first"), "firsts")), "g").where(F.col(ROW) != F.col("first")).select(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: those without letters, and those that state no
    language and whose codeword is less certain than any that was decoded as stated."""
    docs = keyed(docs)
    found = predict(docs, fit(docs.where(~held_out("doc_id"))), keep=(ROW, "lang"))
    least = found.where(F.col("lang_pred") == F.col("lang")).agg(F.min("score")).first()[0]
    unsure = F.col("lang").isNull() & (F.col("score") < F.lit(least)) if least is not None else F.lit(False)
    return spared(docs, found.where((F.col("lang_pred") == UNKNOWN) | unsure))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of equal texts."""
    docs = keyed(docs)
    return spared(docs, others(docs, exact_dedup(docs, ROW), "keep_id", "group_size"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    docs = keyed(docs)
    return spared(docs, others(docs, near_dedup(docs, ROW), "class_id", "class_size"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    columns, docs = docs.columns, keyed(docs)
    copies = written(mix(docs, ROW).select(F.col("doc_id").alias(GONE), F.col("copies").alias(COPIES)).where(F.col(COPIES) > 0), "copies")
    known = docs.join(few(copies), F.col(ROW) == F.col(GONE))
    return known.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*[F.col(f"`{c}`") for c in columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end=0)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again.

    What a stage wrote besides its result goes when it ends or fails, and its result
    when the next stage has ended.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scoped(spark):
        for name, stage in STAGES[:-1]:
            with scoped(spark):
                out = stage(spark, docs, sf_dir)
                docs = written(out, name, outside=True)
        return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0], outside=True)
