import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions import scalars as S
from textloom.functions import text as X


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_safe_divide_and_scores(spark):
    r = one(spark, a=S.safe_divide(F.lit(1), F.lit(0)), b=S.safe_divide(F.lit(None), F.lit(2)), c=S.safe_divide(F.lit(1), F.lit(4)), d=S.sum_score(F.lit(-1), F.lit(3)))
    assert tuple(r) == (0.0, 0.0, 0.25, 3)


def test_logit_edges(spark):
    r = one(spark, a=S.logit_clip(F.lit(0.0)), b=S.logit_clip(F.lit(1.0)), c=S.logit_clip(F.lit(None).cast("double")), d=S.logit_clip(F.lit(0.5)), e=S.logit_clip(F.lit(1e-9)))
    assert r.a == -12 and r.b == math.inf and r.c is None and r.d == 0 and r.e == -12


def test_logit_above_one_is_no_number(spark):
    r = one(spark, a=S.logit_clip(F.lit(1.12)), b=S.logit_clip(F.lit(math.nan)), c=S.logit_clip(F.lit(1.0)))
    assert math.isnan(r.a) and math.isnan(r.b) and r.c == math.inf


def test_row_mean_passes_over_nulls(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=S.row_mean([F.lit(1.0), n, F.lit(4.0)]), b=S.row_mean([n, n]))
    assert r.a == 2.5 and r.b is None


def test_array_statistics(spark):
    xs = F.array(*[F.lit(x) for x in (4, 1, 3, 2)])
    r = one(spark, **A.stats(xs))
    assert (r.min, r.mean, r.median, r.max) == (1, 2.5, 2.5, 4) and abs(r.std - 1.118033988749895) < 1e-12


def test_overlap_of_empty_arrays(spark):
    none = F.array().cast("array<string>")
    ab, bc = F.array(F.lit("a"), F.lit("b"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    r = one(spark, j0=A.jaccard(none, none), d0=A.dice(none, none), j=A.jaccard(ab, bc), d=A.dice(ab, bc), p0=A.positions(none, ab), p=A.positions(ab, bc), miss=A.positions(ab, none))
    assert r.j0 == 0 and r.d0 == 0 and abs(r.j - 1 / 3) < 1e-12 and r.d == 0.5 and r.p0 == [0] and r.p == [2, 3] and r.miss == [0]


def test_pad_and_tail(spark):
    xs = F.array(*[F.lit(i) for i in range(1, 6)])
    r = one(spark, a=A.pad_left(xs, 3), b=A.pad_left(xs, 7), c=A.tail(xs, 2))
    assert r.a == [3, 4, 5] and r.b == [0, 0, 1, 2, 3, 4, 5] and r.c == [4, 5]


def test_cosine_of_null_vector_is_null(spark):
    z, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    r = one(spark, a=A.cosine(z, v), b=A.cosine(v, v))
    assert r.a is None and abs(r.b - 1) < 1e-12


def test_normalize_order_of_replacements(spark):
    r = one(spark, a=X.normalize(F.lit("Fig. 2: α-Tubulin (et al.) e.g. 5% \n\t done.")), b=X.normalize(F.lit(None).cast("string")))
    assert r.a == "2 alpha-tubulin 5 done" and r.b == ""


#: Words and whether they are numbers.
NUMBERS = {
    "1": True, "1.5": True, ".5": True, "5.": True, "1e5": True, "1_000": True, "+3": True, "-2e-3": True, "nan": True, "INF": True, "-Infinity": True, "½": True, "²": True,
    "1__0": False, "_1": False, "1d": False, "1f": False, "0x10": False, "a": False, "12a": False, "e5": False, "": False, "-": False, "1e": False, "a-1": False, "infinit": False,
}


def test_numbers(spark):
    rows = spark.createDataFrame([(w,) for w in NUMBERS], "w string").select("w", F.col("w").rlike(X.NUMBER).alias("n")).collect()
    assert {r.w: r.n for r in rows} == NUMBERS


def test_tokens_of_empty_text(spark):
    r = one(spark, a=X.tokens(F.lit("")), b=X.split_keep(F.lit("")), c=X.tokens(F.lit(None).cast("string")), d=X.tokens(F.lit("a  b ")))
    assert r.a == [] and r.b == [""] and r.c == [] and r.d == ["a", "b"]


#: Texts and their key sentences: those with a mark, glued to the short fragments behind them.
KEYS = {
    "": "",
    "one two three four [**##**]. next one is here now": "one two three four . ",
    "a. b. c": "",
    "no mark at all. none here either": "",
    "Smith et al. found it [**##**] again. ok. go": "Smith et  found it  againokgogo. ",
}


def test_key_sentences_cases(spark):
    rows = spark.createDataFrame([(t,) for t in KEYS], "t string").select("t", X.key_sentences("t").alias("k")).collect()
    assert {r.t: r.k for r in rows} == KEYS


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["word ", "b c ", "d e f g ", "[**##**]", ". "]), max_size=12).map("".join), min_size=20, max_size=40))
def test_key_sentences_properties(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.key_sentences("t").alias("k")).collect()
    for r in rows:
        assert X.MARK not in r.k and (X.MARK in r.t or r.k == "") and (not r.k or r.k.endswith(". "))
        assert set(r.k.split()) <= set(r.t.replace(X.MARK, " ").split()) | set(r.k.replace(".", " . ").split()) and len(r.k) <= 4 * len(r.t) + 4


def test_truncated_texts_hold_whole_characters(spark):
    for text in ("", "abc", "é" * 9, "a中文字" * 4, "x😀y😀z", None):
        for size in (1, 2, 3, 4, 7, 10, 100):
            got = one(spark, t=X.truncate_utf8(F.lit(text).cast("string"), size)).t
            assert got == (None if text is None else text.encode()[:size].decode(errors="ignore"))


def test_short_fragments_stay_bounded(spark):
    r = one(spark, k=X.key_sentences(F.lit("The. " * 400)))
    assert r.k == ""


def test_unknown_extension(spark):
    from textloom.sources import io

    with pytest.raises(ValueError):
        io.load(spark, "/nowhere/x.feather")
