"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwell.llm.decontaminate import decontaminate
from shockwell.llm.lines import drop_shared_lines
from shockwell.llm.packing import pack_documents
from shockwell.llm.scratch import discard, materialise
from shockwell.llm.shingles import shingle_groups, text_mark
from shockwell.llm.toxicity import fit_toxicity, score_toxicity

#: The other columns of a stage's input travel as one beside id and text, so whatever names they have, no operator's clash.
ROW = "row"


#: Words that a worker of the last stage remembers: half of what packing alone does, as workers are large by then.
PACKING_WORDS = 400_000
#: Rows and bytes that a batch for Python holds at most: a batch is held several times over by an executor and its workers.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def _bounded(spark: SparkSession) -> None:
    """Makes the session's batches for Python smaller, if they may be larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _packed(docs: DataFrame) -> DataFrame:
    _bounded(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(ROW))


def _unpacked(df: DataFrame, like: DataFrame, text: str = "text", edited: bool = False) -> DataFrame:
    """The columns of `like`, with the column `text` as text; if it was edited the count of characters is brought up to date."""
    new: dict[str, Column] = {"text": F.col(text)}
    if edited and "n_chars" in like.columns:
        new["n_chars"] = F.length(text).cast(like.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay; those of null or empty text have no toxic word and stay. Every row is judged
    by its own text, so rows of one id may part. An empty table gives no rows."""
    _bounded(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(score_toxicity(_packed(docs), model).where("toxicity_score < 0.5"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by five documents stay in one. All rows stay; null texts stay null. An empty table gives no rows."""
    return _unpacked(drop_shared_lines(_packed(docs)), docs, "kept_text", edited=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at 0.8 of their 5-word shingles one row of the smallest id stays. Null and empty texts are alike;
    a null id comes after all others; rows alike in id and text stay once."""
    _bounded(spark)
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_mark": text_mark("doc_id", "text")}
    first = shingle_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark")).distinct()
    own = _packed(docs).withColumns(keys).dropDuplicates(["_id", "_mark"])
    return _unpacked(own.join(first, ["_id", "_mark"], "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; all documents stay, rows of one id and repeated ones each with its
    own text. Null texts stay null. An empty benchmark cuts nothing; an empty table gives no rows."""
    return _unpacked(decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs, edited=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. Null and empty texts are one piece, the end id alone; rows of one
    id, and repeated rows, are packed each for itself; other columns are ignored. An empty table gives no rows."""
    _bounded(spark)
    return pack_documents(docs, most_words=PACKING_WORDS, keep_words=False)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Classifiers and fingerprints aren't SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
