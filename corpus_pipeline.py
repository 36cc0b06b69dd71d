"""From raw documents to tokens: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.shipping import ship
from ledgerloom.llm import pieces, pii, quality, simhash, winnow
from ledgerloom.llm.common import fresh, staged, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps.

    A null text counts as empty and is scored as such; texts are read whole. Rows, repeated, tied or with null ids, are judged one by one.
    An empty table stays empty. Columns stay as they are, whatever their names."""
    ship(spark)
    (name,) = fresh(docs, "quality")
    scored = quality.score(docs, quality.fit(docs), name)
    return scored.where(F.col(name) >= quality.KEEP).select(*_columns(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of smallest doc_id, a null id last.

    Null and empty texts are one group; of rows alike in id and text one stays. Texts are compared whole. An empty table stays empty. Columns
    stay as they are, whatever their names."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    A null or empty text shares none. Rows, repeated, tied or with null ids, are judged one by one, texts whole. An empty table stays empty, and an
    empty benchmark keeps all. Columns stay as they are: those with names that the search uses are set aside."""
    used = ("n_words", "n_hit", "items", "spans")
    own = [c for c in docs.columns if c.lower() in used]
    aside = dict(zip(own, fresh(docs, *[f"own_{c.lower()}" for c in own]), strict=True))
    found = winnow.find(docs.withColumnsRenamed(aside), table(spark, sf_dir, "benchmark"))
    clean = found.where("n_hit = 0").drop(*used).withColumnsRenamed({v: k for k, v in aside.items()})
    return clean.select(*_columns(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text.

    No row goes: a null text stays null with a null n_chars, an empty one empty. Texts are read whole. An empty table stays empty. Other columns stay as
    they are, whatever their names."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to, a row for each row.

    A null text counts as empty: it has the end id alone. Texts are encoded whole; repeated rows and null ids stay. An empty table gives no rows. Other
    columns are left behind."""
    ship(spark)
    return pieces.digests(docs, MODEL)


STAGES = [("quality", classify), ("near_copies", deduplicate), ("benchmark", decontaminate), ("personal_data", redact), ("tokens", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
