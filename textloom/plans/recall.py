"""Candidate retrieval: preprocess, index, recall, label, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import retrieval as B


def documents(raw: DataFrame, doc: str, fields: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """``doc, tokens`` of the fields in order; rows without identifier leave."""
    return raw.filter(F.col(doc).isNotNull()).select(doc, X.normalized_tokens(X.join_fields(*[X.without_sentinel(f) for f in fields])).alias(tokens))


def candidates(docs: DataFrame, queries: DataFrame, doc: str, query: str, gold: DataFrame | None = None, k: int = 50, folds: int = 5, tokens: str = "tokens") -> DataFrame:
    """``query, doc, corp_sim_score, rank, target, cv``: the k best documents of every query, labelled where gold (query, doc) names them."""
    return labelled(B.bm25_topk(queries, query, tokens, B.build_index(docs, doc, tokens), k), query, doc, gold, folds)


def labelled(found: DataFrame, query: str, doc: str, gold: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """Candidates (query, doc, score, rank) with their labels and folds."""
    found = found.withColumnRenamed("score", "corp_sim_score")
    found = R.label_target(found, gold, query, doc) if gold is not None else found.withColumn("target", F.lit(0))
    return found.withColumn("cv", R.fold_of(F.xxhash64(query), folds))
