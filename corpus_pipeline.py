"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table: all but the last the
columns of documents, the last one row for each piece of a sequence. Nothing is
sampled; what a stage decides takes effect in what it returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import near, packing, repeats, secrets
from statloom.llm.bpe import ByteBpe
from statloom.llm.common import Scratch, load
from statloom.llm.queries import fit_toxicity

#: A document goes if its calibrated chance to be toxic is this or more.
TOXIC = 0.5
#: Bytes of the shortest passage that goes where it repeats: fifty words of average length.
PASSAGE = 250

#: The model and the classes are no SQL expressions; tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels does not call toxic."""
    model = fit_toxicity(spark, sf_dir, docs)
    return model.transform(docs, score="_toxicity").where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id."""
    return near.drop_near(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; a character cut in two goes as a whole."""
    found = repeats.remove_repeats(docs, window=PASSAGE, kept="_kept", spans="_cut")
    rest = F.when(F.size("_cut") > 0, repeats.whole_characters("_kept")).otherwise(F.col("text"))
    return _with_text(docs, found.withColumn("text", rest))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mask in place of each secret."""
    return _with_text(docs, secrets.redact(secrets.find_secrets(docs, spans="_spans"), spans="_spans"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024 tokens and of smaller powers of two, each a sequence."""
    return packing.pack(docs, ByteBpe.from_merges(public_tokenizers.path("byte_bpe_50k.json")))


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    counted = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return counted.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read by the next."""
    tables = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
