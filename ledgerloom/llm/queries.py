"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from ledgerloom.llm import lm, pieces, pii, quality, repeats, simhash, topk, toxicity, warc, winnow
from ledgerloom.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_repeats(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.digests(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_context_tree(spark, sf_dir):
    return lm.report(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op7_winnowing(spark, sf_dir):
    return winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir, model_path: str = MODEL):
    return pieces.digests(table(spark, sf_dir, "documents"), model_path)


def op10_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_repeats, op3_warc, op4_toxicity, op5_context_tree, op6_pii, op7_winnowing, op8_simhash, op9_pieces, op10_quality)}
ORACLES = {"op1_topk": topk.ORACLE, "op3_warc": warc.ORACLE}
