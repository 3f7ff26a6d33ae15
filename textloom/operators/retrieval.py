"""Inverted index, BM25 and TF-IDF over token arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .relational import rows_of

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Places to which scores are rounded before they are ordered, so that the order of additions doesn't decide ties.
PLACES = 9


def bag_of_words(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """``doc, term, tf``: counts of the non-empty tokens of each document, made in its row; only rows that share an identifier meet."""
    own, met = rows_of(docs, doc)
    out = own.select(doc, F.inline(A.term_counts(F.filter(tokens, lambda w: w != "")))).withColumn("tf", F.col("tf").cast("long"))
    if met is None:
        return out
    return out.unionByName(met.select(doc, F.explode(tokens).alias("term")).filter("term <> ''").groupBy(doc, "term").agg(F.count("*").alias("tf")))


def document_frequency(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """``term, df``: as doc_freq of the bag of words, from each document's distinct terms."""
    own, met = rows_of(docs, doc)
    terms = own.select(F.explode(F.array_distinct(tokens)).alias("term"))
    if met is not None:
        terms = terms.unionByName(met.select(doc, F.explode(tokens).alias("term")).distinct().select("term"))
    return terms.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def doc_freq(bow: DataFrame) -> DataFrame:
    """``term, df`` of unique postings."""
    return bow.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, tokens: str) -> DataFrame:
    """One row ``docs, tokens, mean_len``."""
    n = F.size(F.filter(F.col(tokens), lambda w: w != ""))
    return docs.agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.avg(n).alias("mean_len"))


def bm25_idf(df: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``term, df, idf``: ln(N - df + 1/2) - ln(df + 1/2); negative ones become epsilon times the mean over all terms, taken before."""
    raw = df.crossJoin(F.broadcast(stats.select("docs"))).withColumn("raw", F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Index:
    """Postings ``doc, term, tf, len``, terms ``term, df, idf`` and one row of statistics."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    doc: str
    tokens: DataFrame

    def postings_of(self, some: DataFrame) -> DataFrame:
        """Postings of the documents that some names only."""
        return _postings(self.tokens.join(some.select(self.doc).distinct(), self.doc, "left_semi"), self.doc)

    def postings_with(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms in a table of terms only; tokens are dropped before they are counted."""
        kept = self.tokens.select(self.doc, F.size("t").alias("len"), F.explode("t").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
        return kept.groupBy(self.doc, "len", "term").agg(F.count("*").alias("tf"))


#: Rows of a table of query terms up to which it is broadcast.
FEW_TERMS = 200_000


def small(terms: DataFrame) -> DataFrame:
    """Broadcast if it is counted to be small."""
    return F.broadcast(terms) if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS else terms


def _postings(tokens: DataFrame, doc: str) -> DataFrame:
    return tokens.select(doc, F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(doc, "len", "term").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, doc: str, tokens: str) -> Index:
    """Lengths ride along in the postings, so scoring needs no further join.  Document frequencies come from each document's distinct terms, added up before
    they travel; postings are made for the terms or documents that are asked for."""
    clean = docs.select(doc, F.filter(F.col(tokens), lambda w: w != "").alias("t"))
    df = clean.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(docs, tokens)
    return Index(docs.select(doc), _postings(clean, doc), bm25_idf(df, stats), stats, doc, clean)


def weight(tf: Column, length: Column, mean_len: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.try_divide(length, mean_len)))


def bm25_scores(queries: DataFrame, query: str, tokens: str, index: Index) -> DataFrame:
    """``query, doc, score`` of every document that shares a term; a query's repeated terms count once.

    Query terms meet the postings on the term; which side is broadcast, if any, is left to sizes.
    """
    wanted = queries.select(query, F.explode(F.array_distinct(tokens)).alias("term"))
    terms = wanted.join(index.terms.select("term", "idf"), "term")
    hits = index.postings_with(wanted).join(terms, "term").crossJoin(F.broadcast(index.stats.select("mean_len")))
    scored = hits.withColumn("w", weight(F.col("tf"), F.col("len"), F.col("mean_len"), F.col("idf")))
    return scored.groupBy(query, index.doc).agg(F.round(F.sum("w"), PLACES).alias("score"))


def bm25_topk(queries: DataFrame, query: str, tokens: str, index: Index, k: int = 50) -> DataFrame:
    """``query, doc, score, rank``: the k best documents of every query, ties by the smaller document; always k of them if the corpus has as many.

    Documents without shared terms score 0.  Only the first k documents can fill up a query, and negative scores stand behind them.
    """
    scores = bm25_scores(queries, query, tokens, index).cache()
    return filled(queries, query, scores, index.docs, index.doc, index.terms.agg(F.min("idf")).first()[0], k)


def filled(queries: DataFrame, query: str, scores: DataFrame, docs: DataFrame, doc: str, lowest: float | None, k: int) -> DataFrame:
    """The k best of scores (query, doc, score), which hold all documents that a query with fewer than k above 0 hits, and the first others with score 0.

    lowest: the smallest idf.
    """
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col(doc))
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = best.filter("score > 0").groupBy(query).agg(F.count("*").alias("n"))
    short = queries.select(query).distinct().join(found, query, "left").filter(F.coalesce("n", F.lit(0)) < k).select(query)
    hit = scores.join(short, query, "left_semi")
    # Of the first k documents those that a query doesn't hit fill it up; hits that don't score above 0 need as many documents more.
    room = k
    if lowest is not None and lowest <= 0:
        room += hit.filter("score <= 0").groupBy(query).count().agg(F.max("count")).first()[0] or 0
    places = docs.orderBy(doc).limit(room).select(doc)
    fill = short.crossJoin(F.broadcast(places) if room <= FEW_TERMS else places).join(hit.select(query, doc), [query, doc], "left_anti").withColumn("score", F.lit(0.0))
    more = best.select(query, doc, "score").unionByName(fill)
    return more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_pair_scores(pairs: DataFrame, query: str, tokens: Sequence[str], fields: dict[str, Index]) -> DataFrame:
    """Adds ``<tokens>_<field>_bm25_score`` to (query, doc, tokens...) pairs; 0 without shared terms.  Each field has its own statistics."""
    kinds = [F.struct(F.lit(t).alias("kind"), F.array_distinct(t).alias("terms")) for t in tokens]
    first = next(iter(fields.values()))
    wanted = pairs.select(query, first.doc, F.explode(F.array(*kinds)).alias("x")).select(query, first.doc, "x.kind", F.explode("x.terms").alias("term")).distinct()
    out = pairs
    for name, index in fields.items():
        hits = wanted.join(index.postings_of(pairs), [index.doc, "term"]).join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.stats.select("mean_len")))
        hits = hits.withColumn("w", weight(F.col("tf"), F.col("len"), F.col("mean_len"), F.col("idf")))
        cols = {t: f"{t}_{name}_bm25_score" for t in tokens}
        scores = hits.groupBy(query, index.doc).agg(*[F.sum(F.when(F.col("kind") == t, F.col("w"))).alias(c) for t, c in cols.items()])
        out = out.join(scores, [query, index.doc], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols.values()})
    return out


def tfidf(bow: DataFrame, df: DataFrame, stats: DataFrame, doc: str) -> DataFrame:
    """``doc, term, w``: tf * log2(N / df), scaled to length 1 per document; weights of 0 vanish."""
    raw = bow.join(df, "term").crossJoin(F.broadcast(stats.select("docs"))).withColumn("x", F.col("tf") * F.log2(F.col("docs") / F.col("df"))).filter("abs(x) > 1e-12")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("x") / norm).alias("w"))


def distance_summary(df: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Adds ``{max,min,sum}_<name>`` of columns; a sum takes what is below 0 as 0, and a null among them makes all three null."""
    some = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in parts])
    at = lambda x: F.when(~some, x)
    total = reduce(lambda x, y: x + y, [F.greatest(F.col(c), F.lit(0.0)) for c in parts])
    return df.withColumns({f"max_{name}": at(F.greatest(*parts)), f"min_{name}": at(F.least(*parts)), f"sum_{name}": at(total)})


def distances(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, prefix: str, rescaled: bool = False, missing: float | None = None) -> DataFrame:
    """Adds ``<prefix>_{cos,eucl,manh}_dis`` of sparse vectors (a, term, w) and (b, term, w) with weights of 0 or more to pairs (a, b).

    One join on shared terms gives all three: |x - y|1 = sum x + sum y - 2 sum min, |x - y|2 from norms and the product.  The cosine is null if a vector is
    empty.  rescaled: cosines lie in 0 to 1, as (1 + cosine) / 2.  missing: what all three are where a side has no row at all in its table.
    """
    sums = lambda v, key, n: v.groupBy(key).agg(F.sum("w").alias(f"__s{n}"), F.sum(F.col("w") * F.col("w")).alias(f"__q{n}"))
    keys = pairs.select(a, b).distinct()
    shared = keys.join(left.withColumnRenamed("w", "__x"), a).join(right.withColumnRenamed("w", "__y"), [b, "term"])
    met = shared.groupBy(a, b).agg(F.sum(F.col("__x") * F.col("__y")).alias("__dot"), F.sum(F.least("__x", "__y")).alias("__min"))
    out = pairs.join(met, [a, b], "left").join(sums(left, a, 1), a, "left").join(sums(right, b, 2), b, "left")
    out = out.na.fill(0.0, ["__dot", "__min", "__s1", "__q1", "__s2", "__q2"])
    cos = F.try_divide(F.col("__dot"), F.nullif(F.sqrt(F.col("__q1") * F.col("__q2")), F.lit(0.0)))
    eucl = F.sqrt(F.greatest(F.col("__q1") + F.col("__q2") - 2 * F.col("__dot"), F.lit(0.0)))
    manh = F.greatest(F.col("__s1") + F.col("__s2") - 2 * F.col("__min"), F.lit(0.0))
    if rescaled:
        cos = (cos + 1) / 2
    if missing is not None:
        for v, key in ((left, a), (right, b)):
            there = v.select(key).distinct().withColumn(f"__has_{key}", F.lit(True))
            out = out.join(there, key, "left")
        lost = F.col(f"__has_{a}").isNull() | F.col(f"__has_{b}").isNull()
        cos, eucl, manh = (F.when(lost, F.lit(float(missing))).otherwise(x) for x in (cos, eucl, manh))
    out = out.withColumns({f"{prefix}_cos_dis": cos, f"{prefix}_eucl_dis": eucl, f"{prefix}_manh_dis": manh})
    return out.drop("__dot", "__min", "__s1", "__q1", "__s2", "__q2", f"__has_{a}", f"__has_{b}")
