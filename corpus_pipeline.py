"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; every stage but the last returns the columns of documents.

1. quality: documents that the learnt ranking puts below its threshold go.
2. language: documents without a letter, or whose language isn't recognised
   with at least even odds, go.
3. near_duplicates: of each group of texts whose sets of five-word shingles
   are alike by 0.8 or more, the document with the least id stays; of rows
   with the least id of a group, one of them; null ids come last.
4. secrets: found credentials are masked in the text, and n_chars follows.
5. packing: the pieces of all documents with their token ids.

Null texts count as empty. Rows that repeat an id with different texts are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import language, packing, quality, secrets, simhash
from tidewright.llm.common import shared_folder, table

#: Least score of a recognised language.
MIN_LANGUAGE_SCORE = 0.5

#: SQL can't express the learnt stages; the tests check them one by one.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model, out="_score").filter("_score >= 0.5").drop("_score")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs, ~language.held_out())
    found = language.predict(docs, model, out="_lang", score="_sure")
    return found.filter((F.col("_lang") != language.NONE) & (F.col("_sure") >= MIN_LANGUAGE_SCORE)).drop("_lang", "_sure")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is named by its id and a hash of its text; null ids come last.
    name = {"__last": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__same": F.xxhash64(F.coalesce("text", F.lit("")))}
    keyed = docs.withColumns(name)
    first = simhash.first_copies(keyed.select(*name, "text"), list(name))
    rest = [c for c in docs.columns if c != "text"]
    row = F.min(F.struct("text", *rest)).alias("row")
    return keyed.join(first, list(name), "left_semi").groupBy(*name).agg(row).select("row.*").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    The files lie in the folder that driver and executors share.
    """
    folder = f"{shared_folder(spark)}/pipeline-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
