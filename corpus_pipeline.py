"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows as Parquet
in the shared folder and reads them again as the next one's docs.

1. language_id: documents go whose text has no letter, or in which no language holds
   half of the network's pooled probability.
2. line_dedup: lines that repeat or nearly repeat an earlier line go; a document
   that had text and keeps none of it goes too.  n_chars follows the text.
3. simhash_dedup: one document of each near-duplicate group stays, that of least id
   (of rows repeating that id, one).
4. mix_sources: documents come as often as their source's weight asks for.
5. byte_bpe: the ids' count and digests of every document left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import encode
from edgeloom.llm.common import table
from edgeloom.llm.language_id import keep_known
from edgeloom.llm.line_dedup import line_dedup
from edgeloom.llm.mixing import mix_sources
from edgeloom.llm.simhash import keep_one
from edgeloom.plans.lineage import cut

#: The share of the pooled probability that a document's language must have.
LEAST_SCORE = 0.5
#: Repetition limit of the mixture.
MAX_EPOCHS = 1.25
#: The near-duplicate stage takes five words to a shingle.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup(docs, texts=True, carry=True).where("n_removed = 0 or trim(kept_text) <> ''")
    changed = F.col("n_removed") > 0
    columns = {c: F.col("kept_text") if c == "text" else F.col("doc")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[columns[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, width=SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, max_epochs=MAX_EPOCHS, carry=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", near_dedup),
    ("mix_sources", mix),
    ("byte_bpe", tokenise),
]

#: A trained network decides the first stage, so SQL can't express run()'s rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
