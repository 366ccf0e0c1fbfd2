"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept. All but the last return the
columns of `docs`; the last returns the pieces of packed sequences. Other columns, whatever their names, go along
unchanged, and an empty table gives an empty table. What stages do with nulls, empty and very long texts, ties and
repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import language, mixing, packing, secret_scan, simhash
from keyloom.operators.lineage import new_folder

#: a document whose main language has less than this share of its letters is rejected
LEAST_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without one that clearly leads, are rejected.

    A null or empty text has no letter and goes. The model learns from labels outside its held-out fold; null labels and
    ids teach nothing, and without any label every document goes. Equal scores go to the language first by code point.
    Repeated rows are judged alike; a very long text is judged whole.
    """
    model = language.train_outside_fold(docs)
    return language.with_language(docs, model, "_language_of_text", "_share_of_letters").filter((F.col("_language_of_text") != language.UNKNOWN) & (F.col("_share_of_letters") >= LEAST_SHARE)).drop("_language_of_text", "_share_of_letters")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: a row with the smallest id.

    Near-duplicates are texts whose fingerprints of 3-word shingles differ in two bits or fewer, as in `op8_simhash`,
    and what is linked through them. Null and blank texts are copies of each other. A null id stands for a component
    only if no other id is in it; of rows that repeat an id and its text one stays. Very long texts count whole.
    """
    return simhash.first_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked; n_chars, if there is such a column, follows the text.

    Null texts stay null, empty ones empty; repeated rows and null ids are rows like others; overlapping secrets are
    masked together; very long texts are scanned whole.
    """
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often, and the last copy as far, as its source's target takes it.

    A null source is a source, the last one. Texts without a word, null ones too, are left out. Order within a source is
    by a hash of id and size, ties by id and size, so repeated rows of one id are interchangeable; null ids have a place
    of their own. A very long text may be cut, by words, where its source's budget ends.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    A null or empty text is the single end token. Null ids stay null, repeated rows are packed once each, and very long
    texts are cut into whole sequences and a rest.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: language models, fingerprints and token ids cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # the table before it was read for the last time
            files.delete(path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}"), True)
    return docs
