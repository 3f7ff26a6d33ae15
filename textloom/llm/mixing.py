"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document gets whole copies that are certain, and odds for one copy more.  Odds follow a weight for the octave of the document's length, scaled in each
source so that the expected words equal the source's target.  Documents are ranked by Q = [u / (1 - u)] / [p / (1 - p)], with u a uniform number
from a hash of identifier, text and, for rows equal in both, a running number, and p the inclusion probability; of each source and length class, an eighth of
an octave, those of smallest Q are taken, in fixed number.  The numbers are the expected ones, rounded at random from the longest class down, each less or
more by a share of the words that longer classes took beyond or below what they should.  The share is the same whatever was taken, and small enough that no
number falls below 0 or exceeds its class, so every document's chance is p exactly; a source's words come near its target, the nearer the more documents it
has.  The cut of a class is found by histograms over Q, never by one ordered scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Weights of sources in order of their names, repeating; words of the mix per word of input; copies that a document may have.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: A document's weight falls by this part from one octave of words to the next; length classes of an octave.
CLASS_FALL, PARTS = 0.02, 8
#: Octaves from this on count as one class, so sources have a fixed number of them.
TOP_OCTAVE = 40
#: Parts of a word in which that is counted, and cells of one histogram level of the rank.
FINE, CELLS = 1024, 4096
#: Rows of the table of sources and length classes up to which tables of sources are broadcast; beyond, they are joined by shuffles.
FEW = 200_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources by code point, null last, get the repeating weights.  target = min(most * source_size, level * weight), where the level makes the sum
    share * all sizes: the fixed point of cutting at the cap and sharing the excess out by weight.  One row per source passes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
    # Sources reach their cap in order of size / weight; those before the first that doesn't are cut, the others share the rest.
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        ranked.withColumn("goal", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("cut_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.col("cut_before")) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(most)))
    )
    level = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("a"), F.col("place").alias("b"), F.col("level").alias("level")))).over(whole)["level"]
    cap = F.col("source_size") * F.lit(float(most))
    return capped.withColumn("line", level).select("source", "source_size", F.coalesce(F.least(cap, F.col("line") * F.col("weight")), cap).alias("target"))


def digest(seed: str = "") -> Column:
    """What the chance of a row is drawn from: its identifier, its text's hash and its number among rows equal in these."""
    return F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("h").cast("string"), F.col("copy").cast("string")).cast("binary"))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest."""
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(1 << 52))


def _told(docs: DataFrame, id_col: str, text_col: str, source_col: str, *extra: Column) -> DataFrame:
    """``doc_id, source, size, h`` (60 bits of the text's digest) and extra columns."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), h.alias("h"), *extra)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``, the number from 0 of a row among those of one source, identifier and text.

    Such rows are numbered within the partitions that they lie in, after the rows of partitions before, so that a group of any size is never in one task.
    """
    keys = ["source", "doc_id", "h"]
    again = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys]), "mix-again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    placed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    repeated = written(placed.join(again, on, "left_semi"), "mix-repeated")
    of_part = Window.partitionBy(*keys, "__part")
    counts = repeated.groupBy(*keys, "__part").agg(F.count("*").alias("n"))  # a row for each key and partition at most
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("n")
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), before.alias("before"))
    inside = repeated.withColumn("inside", F.row_number().over(of_part.orderBy("__at")) - 1).join(counts, [*on, F.col("__part") == F.col("__p")])
    numbered = inside.select(*rows.columns, (F.col("before") + F.col("inside")).cast("int").alias("copy"))
    return written(rows.join(again, on, "left_anti").withColumn("copy", F.lit(0)).unionByName(numbered), "mix-numbered")


def _class() -> Column:
    """PARTS classes of equal width for each octave of size + 1; class 0 holds texts without words alone."""
    octave = F.length(F.bin(F.col("size") + 1)) - 1
    part = F.expr(f"shiftright((size + 1) * {PARTS}, length(bin(size + 1)) - 1)") - PARTS
    return F.when(octave < TOP_OCTAVE, octave * PARTS + part).otherwise(F.lit(TOP_OCTAVE * PARTS)).cast("int")


def _scaled(classes: DataFrame, most: int) -> DataFrame:
    """``source, class, words, target`` to expected copies for each class: min(most, level * weight of the class), by source to its target."""
    falls = F.array(*[F.lit(class_weight(c)) for c in range(TOP_OCTAVE + 1)])
    classes = classes.withColumn("w", F.element_at(falls, F.floor(F.col("class") / PARTS).cast("int") + 1))
    of = Window.partitionBy("source").orderBy("class")
    before, whole = of.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    # Short documents have the largest weight and so reach the most copies first.
    out = (
        classes.withColumn("full", F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("mass", F.sum(F.col("words") * F.col("w")).over(whole) - F.coalesce(F.sum(F.col("words") * F.col("w")).over(before), F.lit(0)))
        .withColumn("level", F.coalesce(F.try_divide(F.col("target") - F.col("full"), F.col("mass").cast("double")), F.lit(0.0)))
        .withColumn("free", F.col("level") * F.col("w") <= F.lit(float(most)))
    )
    level = F.min(F.when(F.col("free"), F.struct("class", "level"))).over(whole)["level"]
    copies = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(level * F.col("w"), F.lit(float(most)))))
    # What is a whole number but for rounding counts as one.
    return out.withColumn("x", copies).select("source", "class", F.when(F.abs(F.col("x") - F.round("x")) < 1e-9, F.round("x")).otherwise(F.col("x")).alias("copies"))


def class_weight(octave: int) -> int:
    return round(10_000 * (1 - CLASS_FALL) ** octave)


def _numbers(rates: DataFrame, seed: str) -> DataFrame:
    """``source, class, words, docs, copies`` to ``s, c, take``: how many documents of a class get one copy more.

    One fold over a source's classes, of which there are at most TOP_OCTAVE * PARTS + 1, from the longest down.
    """
    p = F.col("copies") - F.floor("copies")
    expected = F.floor(p * F.col("words") * FINE + 0.5).cast("long")
    u = uniform(F.md5(F.concat_ws("/", F.lit(seed), F.lit("class"), F.coalesce("source", F.lit("null")), F.col("class").cast("string")).cast("binary")))
    # What is expected of this class and all shorter ones.
    told = rates.filter((p > 0) & (F.col("words") > 0)).withColumn("p", p).withColumn("e", expected).withColumn("u", u)
    told = told.withColumn("rest", F.sum("e").over(Window.partitionBy("source").orderBy("class")))

    def step(s: Column, x: Column) -> Column:
        """over: words taken beyond what was expected so far; most: what their amount can't exceed, whatever was drawn."""
        rest, mean = x["rest"].cast("double"), (x["words"] * FINE).cast("double") / x["docs"].cast("double")
        there = (s["most"] > 0) & (x["rest"] > 0)
        # Neither below no document nor above all of them.
        room = F.least(F.lit(1.0), (F.lit(1.0) - x["p"]) / x["p"])
        share = F.when(there, F.least(F.lit(1.0) / F.when(there, rest).otherwise(1.0), room / F.when(there, s["most"]).otherwise(1.0))).otherwise(0.0)
        n = F.least(x["docs"], F.floor(x["p"] * x["docs"] * (F.lit(1.0) - share * s["over"]) + x["u"]).cast("long"))
        words = F.floor((n * x["words"] * FINE).cast("double") / x["docs"].cast("double")).cast("long")
        taken = F.concat(s["takes"], F.array(F.struct(x["class"].alias("class"), n.alias("take"))))
        return F.struct((s["over"] + words - x["e"]).alias("over"), (s["most"] * (F.lit(1.0) - share * x["e"]) + mean).alias("most"), taken.alias("takes"))

    xs = F.sort_array(F.collect_list(F.struct("class", "docs", "words", "p", "e", "rest", "u")), asc=False)
    begun = F.struct(F.lit(0).cast("long").alias("over"), F.lit(0.0).alias("most"), F.array().cast("array<struct<class:int,take:bigint>>").alias("takes"))
    folded = told.groupBy("source").agg(F.aggregate(xs, begun, step)["takes"].alias("takes"))
    return folded.select(F.col("source").alias("s"), F.explode("takes").alias("x")).select("s", F.col("x.class").alias("c"), F.col("x.take").alias("take"))


def _cuts(pool: DataFrame, takes: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``sid, k, t``: the (key, tie) of the last one that a stratum takes."""
    fine = F.floor((F.col("key") * CELLS - F.col("cell")) * CELLS).cast("int")
    pool = pool.withColumn("cell", F.floor(F.col("key") * CELLS).cast("int")).withColumn("fine", fine)

    def first_over(rows: DataFrame, at: list[str], room: DataFrame) -> DataFrame:
        """``sid``, the cell in which the room is used up, and the room left there."""
        h = rows.groupBy("sid", *at).agg(F.count("*").alias("n")).join(small(room), "sid")
        h = h.withColumn("run", F.sum("n").over(Window.partitionBy("sid").orderBy(*at))).filter(F.col("run") > F.col("room"))
        h = h.groupBy("sid").agg(F.min(F.struct(*at, (F.col("room") - F.col("run") + F.col("n")).alias("r"))).alias("x"))
        return h.select("sid", *[F.col(f"x.{c}").alias(c) for c in at], F.col("x.r").alias("room"))

    rough = first_over(pool, ["cell"], takes.select("sid", F.col("take").alias("room")))
    inside = pool.join(small(rough.select("sid", "cell")), ["sid", "cell"])
    close = first_over(inside, ["cell", "fine"], rough.select("sid", "room"))
    last = inside.join(small(close), ["sid", "cell", "fine"])
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("sid").orderBy("key", "tie"))).filter(F.col("n") <= F.col("room"))
    last = last.groupBy("sid").agg(F.max(F.struct("key", "tie")).alias("end"))
    out = takes.join(small(close), "sid", "left").join(small(last), "sid", "left")
    edge = (F.col("cell") + F.col("fine") / F.lit(float(CELLS))) / F.lit(float(CELLS))
    k = F.when(F.col("end").isNotNull(), F.col("end.key")).when(F.col("cell").isNotNull(), edge).otherwise(F.lit(2.0))
    return out.select("sid", k.alias("k"), F.coalesce(F.col("end.tie"), F.lit(-(1 << 63))).cast("long").alias("t"))


class Mix:
    """The decisions of one mix: small tables with a row per source and length class, applied to documents without a join on their identifiers."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.cols, self.seed = (id_col, text_col, source_col), seed
        sized = _numbered(written(_told(docs, id_col, text_col, source_col), "mix-sizes"))
        self.sized = sized
        # At most TOP_OCTAVE * PARTS + 1 rows per source.
        by_class = written(sized.withColumn("class", _class()).groupBy("source", "class").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-classes")
        self.few = by_class.count() <= FEW
        self.targets = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
        joined = by_class.join(self._small(self.targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        copies = _scaled(joined, most).withColumnsRenamed({"source": "cs", "class": "cc"})
        rates = joined.join(copies, F.col("source").eqNullSafe(F.col("cs")) & (F.col("class") == F.col("cc"))).drop("cs", "cc")
        rates = written(rates.withColumn("sid", F.monotonically_increasing_id()), "mix-rates")
        takes = rates.join(_numbers(rates, seed), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left")
        self.rates = written(takes.select("sid", "source", "class", "source_size", "target", "copies", F.coalesce("take", F.lit(0)).alias("take")), "mix-takes")
        pool = self._ranked(sized).filter((F.col("key") < 1) & (F.col("size") > 0)).select("sid", "key", "tie")
        self.cuts = written(_cuts(pool, self.rates.select("sid", "take"), self._small), "mix-cuts")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _ranked(self, sized: DataFrame) -> DataFrame:
        """Adds class, stratum, the source's figures, expected copies and the rank: key in [0, 1), 2 where no odds are left, and tie."""
        r = self.rates.select(F.col("source").alias("rs"), F.col("class").alias("rc"), "source_size", "target", "copies", "sid")
        out = sized.withColumn("class", _class()).join(self._small(r), F.col("source").eqNullSafe(F.col("rs")) & (F.col("class") == F.col("rc")), "left").drop("rs", "rc")
        out = out.withColumn("digest", digest(self.seed)).withColumn("tie", F.conv(F.substring("digest", 14, 15), 16, 10).cast("long"))
        u, p = uniform(F.col("digest")), F.col("copies") - F.floor("copies")
        q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
        return out.withColumn("q", F.when(p > 0, q)).withColumn("key", F.when(F.col("q").isNotNull(), F.least(F.col("q") / (F.lit(1.0) + F.col("q")), F.lit(1 - 2.0**-53))).otherwise(F.lit(2.0)))

    def copies_of(self, sized: DataFrame) -> DataFrame:
        """Adds ``source_size, target, taken_copies`` to rows with ``doc_id, source, size, h, copy``."""
        cuts = self.cuts.select(F.col("sid").alias("cut"), "k", "t")
        out = self._ranked(sized).join(self._small(cuts), F.col("sid") == F.col("cut"), "left")
        inside = (F.col("key") < F.col("k")) | ((F.col("key") == F.col("k")) & (F.col("tie") <= F.col("t")))
        taken = F.floor(F.coalesce("copies", F.lit(0.0))) + F.when((F.col("key") < 1) & (F.col("size") > 0) & inside, 1).otherwise(0)
        return out.withColumn("taken_copies", taken.cast("int")).drop("cut", "k", "t", "sid", "class", "copies", "q", "key", "digest", "tie")

    def repeated(self, docs: DataFrame) -> DataFrame:
        """The documents themselves, each as often as the mix takes it."""
        id_col, text_col, source_col = self.cols
        sized = _numbered(_told(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row")))
        out = self.copies_of(sized).filter("taken_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies"))))
        return out.select("row.*")


def mix(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of docs; see Mix for the keywords.

    Null text has size 0; a null source is a source of its own, last in order.  Rows that share an identifier, or have none, are drawn each by itself; of
    rows equal in identifier, source and text it doesn't matter which is taken.  Sources without words have target 0.  An empty table gives no rows.
    Other columns are ignored.
    """
    made = Mix(docs, **kw)
    return made.copies_of(made.sized).select("doc_id", "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).cast("long").alias("taken"), "source")
