"""Functions of token arrays and lists of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c, safe_divide

STATS = ("min", "mean", "median", "max", "std")


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(toks) -> Column:
    """``array<struct<term, tf>>``: the distinct tokens in order, each with its number, from the runs of the sorted tokens."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        ends = lambda xs: F.slice(xs, 2, F.size(xs))
        return let(starts, lambda xs: F.zip_with(xs, ends(xs), lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (F.coalesce(b, F.size(s) + 1) - a).alias("tf"))))

    return F.when(F.size(_c(toks)) > 0, let(F.array_sort(_c(toks)), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def mean(xs) -> Column:
    xs = _c(xs)
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


def median(xs) -> Column:
    """Middle element, or the mean of the two middle ones."""
    s = F.array_sort(_c(xs))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def std(xs) -> Column:
    """Population standard deviation, by two passes."""
    both = F.struct(_c(xs).alias("xs"), mean(xs).alias("m"))
    squares = lambda s: F.aggregate(s["xs"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"]))
    return let(both, lambda s: F.sqrt(F.try_divide(squares(s), F.size(s["xs"]))))


def stats(xs) -> dict[str, Column]:
    xs = _c(xs)
    return {"min": F.array_min(xs).cast("double"), "mean": mean(xs), "median": median(xs), "max": F.array_max(xs).cast("double"), "std": std(xs)}


def jaccard(a, b) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 where both are empty."""
    return safe_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def dice(a, b) -> Column:
    """Twice the shared distinct tokens over the sum of distinct tokens; 0 where both are empty."""
    shared = F.size(F.array_intersect(_c(a), _c(b)))
    return safe_divide(2 * shared, F.size(F.array_distinct(_c(a))) + F.size(F.array_distinct(_c(b))))


def positions(obs, target) -> Column:
    """1-based places in obs of tokens that target holds; [0] if there are none."""
    both = F.struct(_c(obs).alias("obs"), F.array_intersect(_c(obs), _c(target)).alias("shared"))
    places = lambda s: F.filter(F.transform(s["obs"], lambda w, i: F.when(F.array_contains(s["shared"], w), i + 1).otherwise(0)), lambda p: p > 0)
    return let(let(both, places), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0))))


def tail(xs, n: int) -> Column:
    """The last n elements."""
    xs = _c(xs)
    return F.when(F.size(xs) > n, F.slice(xs, -n, n)).otherwise(xs)


def pad_left(xs, n: int, with_=0) -> Column:
    """The last n elements, filled up on the left."""
    xs = tail(xs, n)
    return F.concat(F.array_repeat(F.lit(with_), F.greatest(F.lit(n) - F.size(xs), F.lit(0))), xs)


def digit_tokens(xs) -> Column:
    """Tokens of decimal digits only."""
    return F.size(F.filter(_c(xs), lambda w: w.rlike(r"^\p{Nd}+$")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine; null where a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def vector_sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def unit(a) -> Column:
    """The vector scaled to length 1; null elements where it has length 0."""
    both = F.struct(_c(a).alias("a"), norm(a).alias("n"))
    return let(both, lambda s: F.transform(s["a"], lambda x: F.try_divide(x.cast("double"), s["n"])))
