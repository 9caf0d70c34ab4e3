"""The registered queries: each operator over its whole table, with production parameters, reduced to its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from . import backoff_lm, bpe, divergence, langid, packing, quality, runs, simhash, tokenfile, topk, toxicity, vecjoin, wordpiece
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


PIECES = public_tokenizers.path("piece_bpe_32k.model")
MU = 100.0


def op1_langid(spark, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op3_vector_join(spark, sf_dir: str) -> DataFrame:
    return vecjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_backoff_lm(spark, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score(table(spark, sf_dir, "documents"), mu=MU)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, shared_path(spark, "tokens"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_token_counts, op3_vector_join, op4_backoff_lm, op5_bpe, op6_simhash, op7_toxicity, op8_topk, op9_token_file, op10_packing, op11_runs, op12_quality, op13_divergence)}
ORACLES = {"op3_vector_join": vecjoin.ORACLE, "op4_backoff_lm": backoff_lm.ORACLE.format(mu=MU), "op8_topk": topk.ORACLE, "op13_divergence": divergence.ORACLE.format(least=divergence.LEAST_DOCS, top=50)}
