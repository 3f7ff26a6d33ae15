"""Features of query-document pairs as columns over one wide row, by blocks with fixed names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.scalars import safe_divide

QUERY, PAPER = ("quer_key", "quer_all"), ("titl", "abst", "corp")
# The columns that a deep model takes.
DEEP = (
    "quer_key_tfidf_corp_cos_dis", "quer_key_tfidf_corp_eucl_dis", "quer_key_corp_bm25_score", "corp_sim_score", "quer_all_tfidf_corp_eucl_dis",
    "quer_all_corp_bm25_score", "quer_key_tfidf_titl_manh_dis", "quer_all_titl_bm25_score", "quer_all_tfidf_corp_cos_dis",
    "jaccard_coef_of_unigram_between_corp_quer_key", "ratio_of_unique_corp_unigram", "jaccard_coef_of_unigram_between_corp_quer_all",
    "jaccard_coef_of_unigram_between_titl_quer_key", "quer_key_tfidf_titl_cos_dis", "jaccard_coef_of_unigram_between_abst_quer_key",
    "quer_key_abst_bm25_score", "quer_all_tfidf_titl_cos_dis", "quer_key_tfidf_titl_eucl_dis", "count_of_quer_key_unigram", "quer_all_tfidf_titl_eucl_dis",
    "ratio_of_unique_quer_all_unigram", "quer_key_tfidf_abst_cos_dis", "count_of_unique_corp_unigram", "ratio_of_unique_abst_unigram",
    "normalized_pos_of_corp_unigram_in_quer_all_max", "quer_all_abst_bm25_score", "normalized_pos_of_titl_unigram_in_quer_all_std",
    "quer_all_tfidf_titl_manh_dis", "jaccard_coef_of_unigram_between_abst_quer_all", "dice_dist_of_unigram_between_corp_quer_key",
)


def _tok(field: str) -> str:
    return f"{field}_unigram"


def counts(df: DataFrame, fields: Sequence[str] = (*QUERY, *PAPER)) -> DataFrame:
    """Adds five counts per field from its token column ``<field>_unigram``."""
    out = {}
    for f in fields:
        n, u, d = F.size(_tok(f)), F.size(F.array_distinct(_tok(f))), A.digit_tokens(_tok(f))
        out |= {f"count_of_{f}_unigram": n, f"count_of_unique_{f}_unigram": u, f"ratio_of_unique_{f}_unigram": safe_divide(u, n), f"count_of_digit_in_{f}": d.cast("double"), f"ratio_of_digit_in_{f}": safe_divide(d, n)}
    return df.withColumns(out)


def overlaps(df: DataFrame, queries: Sequence[str] = QUERY, papers: Sequence[str] = PAPER) -> DataFrame:
    """Adds Jaccard's and Dice's coefficients of distinct tokens."""
    out = {}
    for name, of in (("jaccard_coef", A.jaccard), ("dice_dist", A.dice)):
        out |= {f"{name}_of_unigram_between_{p}_{q}": of(_tok(p), _tok(q)) for q in queries for p in papers}
    return df.withColumns(out)


def positions(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ten statistics of the places of obs tokens that target holds, for (obs, target) pairs.

    Each list of places is made in a projection of its own, so its statistics read one column instead of repeating it.
    """
    pairs = pairs or [*((q, p) for q in QUERY for p in PAPER), *((p, q) for p in PAPER for q in QUERY)]
    cols = df.columns
    df = df.withColumns({f"__pos_{o}_{t}": A.positions(_tok(o), _tok(t)) for o, t in pairs})
    out = {}
    for o, t in pairs:
        for name, value in A.stats(f"__pos_{o}_{t}").items():
            out[f"pos_of_{o}_unigram_in_{t}_{name}"] = value
    plain = df.select(*cols, *[F.size(_tok(o)).alias(f"__n_{o}") for o in dict(pairs)], *[v.alias(k) for k, v in out.items()])
    scaled = {f"normalized_pos_of_{o}_unigram_in_{t}_{s}": safe_divide(f"pos_of_{o}_unigram_in_{t}_{s}", f"__n_{o}") for o, t in pairs for s in A.STATS}
    return plain.withColumns(scaled).drop(*[f"__n_{o}" for o in dict(pairs)])


def keywords(df: DataFrame) -> DataFrame:
    """Adds the features whose names hold ``keyw``: counts but those of digits, overlaps, and places of query tokens among keywords."""
    out = positions(overlaps(counts(df, ["keyw"]), QUERY, ["keyw"]), [(q, "keyw") for q in QUERY])
    return out.drop("count_of_digit_in_keyw", "ratio_of_digit_in_keyw")


def stacked(pairs: DataFrame, models: dict[str, DataFrame], ids: Sequence[str], pred: str) -> DataFrame:
    """Adds ``<model>_prob`` of every model as a float; null where a model lacks the pair."""
    parts = [m.select(*ids, F.col(pred).cast("float").alias(f"{name}_prob")) for name, m in models.items()]
    return reduce(lambda a, b: a.join(b, list(ids), "left"), parts, pairs)


def deep_columns(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Identifiers and the columns of DEEP, in its order; those that are missing are null."""
    return df.select(*ids, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in DEEP])


def feature_vector(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    """Adds an array of the columns as doubles, nulls as 0."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))
