"""Repair of the order of roles in conversations at least cost, in DataFrame operations only.

1. Turns are range-partitioned by conversation, turn, role and digest of the text, and get a place in that order.  Blocks of following places are segments,
   so a conversation of any length is spread over many of them, and no task holds more than its share.
2. Windows over equal role and text, first within a partition, then over the first ones of all partitions, tell repeated turns.
3. Each segment's turns are collected and folded: ``aggregate`` carries four (cost, audit) structs, one for each state of the pattern
   (system)? (user assistant)*: nothing yet, after system, after user, after assistant.  ``least`` picks the cheaper, and of equally cheap the audit that
   comes first; of two equally cheap audits of the same turns none begins the other, so the choice holds whatever follows.
4. A segment that continues a conversation is folded from each of the four states.  Per conversation, the segments' results are folded once more, and the
   audit is handed back to the segments, which edit their own turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, prepare, written

#: Costs of edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places of a segment as a power of two, and a cost that no repair reaches.
SEGMENT_BITS, NEVER = 8, 1 << 50
#: Anything but ASCII white space, and what a sound text ends with.
_SEEN, _END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Role initials that may follow each other.
FOLLOWING = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with faults that a checksum of conversation and turn decides: dropped, emptied, cut, repeated or of another role.

    Null roles and texts become one space, as do nulls in what the checksum is taken of.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    told = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    fault = (F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20).cast("int")
    told = told.withColumn("__fault", fault).filter("__fault <> 0")
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__n")).drop("__n")


def _plus(s: Column, cost: Column | int, letters: Column | str) -> Column:
    """State s after an edit; what else it carries stays."""
    add, said = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letters))
    return s.withField("cost", s["cost"] + add).withField("audit", F.concat(s["audit"], said))


def _inserted(s: list[Column]) -> list[Column]:
    """The states after as many inserts as may be needed at one place."""
    user = F.least(s[2], _plus(F.least(s[0], s[1], s[3]), INSERT, "I"))
    return [s[0], s[1], user, F.least(s[3], _plus(user, INSERT, "I"))]


def _fields(states: Column) -> list[Column]:
    return [states[f"s{i}"] for i in range(4)]


def _struct(states: list[Column]) -> Column:
    return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])


def _step(states: Column, turn: Column) -> Column:
    """The four states after a turn (initial, kind); kind 0 is sound, 1 truncated, 2 has to go."""
    s = _inserted(_fields(states))
    stays, extra = turn["kind"] < 2, F.when(turn["kind"] == 1, TRUNCATED).otherwise(0)

    def kept(before: Column, initial: str) -> Column:
        same = turn["initial"] == initial
        return F.when(stays, _plus(before, extra + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    gone = [_plus(x, DELETE, "D") for x in s]
    system = F.when(stays & (turn["initial"] == "s"), _plus(s[0], extra, "K"))
    return _struct([gone[0], F.least(gone[1], system), F.least(gone[2], kept(F.least(s[0], s[1], s[3]), "u")), F.least(gone[3], kept(s[2], "a"))])


def _begun(at: int, path: bool = False) -> Column:
    """The states where only one can be."""
    blank = [F.lit("").alias("audit"), *([F.lit("").alias("path")] if path else [])]
    return _struct([F.struct(F.lit(0 if i == at else NEVER).cast("long").alias("cost"), *blank) for i in range(4)])


def _composed(states: Column, segment: Column) -> Column:
    """The four states after a segment, with a comma after its audit and the state that it was entered in added to the path."""
    s = _fields(states)

    def through(i: int, j: int) -> Column:
        made = segment[f"m{i}"]
        end = made[f"s{j}"]
        return F.when(made.isNotNull(), _plus(s[i], end["cost"], F.concat(end["audit"], F.lit(","))).withField("path", F.concat(s[i]["path"], F.lit(str(i)))))

    return _struct([F.least(*[through(i, j) for i in range(4)]) for j in range(4)])


def flagged(turns: DataFrame) -> DataFrame:
    """Turns with ``place``, their order, and ``kind``, their first fault: blank, duplicate, truncated or sound; written."""
    spark = prepare(turns.sparkSession)
    told = turns.select("conv_id", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    dealt = told.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "turns-placed")
    # A turn that isn't the first of its kind in its partition is a duplicate; of the first ones, all but the first of all are.
    part = F.shiftrightunsigned("place", 33)
    keys = placed.select("conv_id", "role", "digest", "place", part.alias("part"))
    inside = keys.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "part").orderBy("place")))
    met = inside.withColumn("apart", F.when(F.col("n") > 1, F.col("part")))
    met = met.withColumn("m", F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "apart").orderBy("place")))
    again = met.filter("n > 1 OR m > 1").select(F.col("place").alias("again"))
    seen = F.col("text").rlike(_SEEN)
    kind = F.when(~seen, "blank").when(F.col("again").isNotNull(), "duplicate").when(~F.col("text").rlike(_END), "truncated").otherwise("sound")
    return written(placed.join(again, F.col("place") == F.col("again"), "left").select("conv_id", "turn", "role", "text", "place", kind.alias("kind")), "turns-flagged")


def _segments(rows: DataFrame) -> DataFrame:
    """``conv_id, segment``, the states behind it for each state before it, its counts, and the initials at its ends."""
    number = F.when(F.col("kind").isin("blank", "duplicate"), 2).when(F.col("kind") == "truncated", 1).otherwise(0)
    turn = F.struct("place", F.substring("role", 1, 1).alias("initial"), number.alias("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    got = rows.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), *counts)
    fold = lambda i: F.aggregate("turns", _begun(i), _step)
    # A conversation that begins behind the segment's first place has no segment before.
    goes_on = F.col("turns")[0]["place"].bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)) == 0
    initials = F.transform("turns", lambda t: t["initial"])
    followed = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    illegal = F.size(F.filter(F.slice(followed, 1, F.size(initials) - 1), lambda x: ~x.isin(*FOLLOWING)))
    return got.select("conv_id", "segment", fold(0).alias("m0"), *[F.when(goes_on, fold(i)).alias(f"m{i}") for i in (1, 2, 3)], "blank", "duplicate", "truncated", F.when(F.size(initials) > 1, illegal).otherwise(0).cast("long").alias("illegal"), initials[0].alias("head"), F.element_at(initials, -1).alias("tail"))


def audited(rows: DataFrame) -> DataFrame:
    """From flagged turns, per conversation: counts of faults, ``illegal``, ``cost``, and ``segments, pieces, path``: how each segment is edited."""
    fields = ["m0", "m1", "m2", "m3", "blank", "duplicate", "truncated", "illegal", "head", "tail"]
    whole = _segments(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", F.struct(*fields).alias("x")))).alias("xs"))
    states = F.aggregate("xs", _begun(0, True), lambda s, x: _composed(s, x["x"]))
    whole = whole.withColumn("end", states)
    closed = _inserted(_fields(F.col("end")))
    added = lambda c: F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x["x"][c])
    heads = F.slice(F.transform("xs", lambda x: x["x"]["head"]), 2, F.size("xs"))
    between = F.zip_with(F.slice(F.transform("xs", lambda x: x["x"]["tail"]), 1, F.size(heads)), heads, lambda a, b: F.concat(a, b))
    best = whole.select("conv_id", "xs", F.least(closed[0], closed[3]).alias("best"), (added("illegal") + F.when(F.size("xs") > 1, F.size(F.filter(between, lambda x: ~x.isin(*FOLLOWING)))).otherwise(0)).cast("long").alias("illegal"))
    pieces = F.split("best.audit", ",")
    # What is inserted behind the last turn belongs to the last segment.
    pieces = F.concat(F.slice(pieces, 1, F.size("xs") - 1), F.array(F.concat(F.element_at(pieces, F.size("xs")), F.element_at(pieces, -1))))
    counts = [added(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    return best.select("conv_id", *counts, "illegal", F.col("best.cost").alias("cost"), F.translate("best.audit", ",", "").alias("audit"), F.transform("xs", lambda x: x["segment"]).alias("segments"), pieces.alias("pieces"), F.col("best.path").alias("path"))


def _edited(piece: Column, state: Column, turns: Column) -> Column:
    """The repaired turns of a segment, a line each; null if none is left."""
    upto = lambda i, letter: F.length(F.replace(piece.substr(F.lit(1), i), F.lit(letter), F.lit("")))
    first = F.length(piece) - F.length(F.ltrim(piece, F.lit("D"))) + 1
    system = (state == "0") & (piece.substr(first, F.lit(1)) == "K") & (F.substring(F.get(turns, first - 1)["role"], 1, 1) == "s")
    shift = F.when(state == "2", 1).when(system, -1).otherwise(0)

    def line(i: Column) -> Column:
        letter, row = piece.substr(i, F.lit(1)), F.get(turns, upto(i, "I") - 1)
        role = F.when(F.pmod(upto(i - 1, "D") + shift, F.lit(2)) == 0, "user").otherwise("assistant")
        return F.when(letter == "K", F.concat_ws(":", row["role"], row["text"])).when(letter == "R", F.concat_ws(":", role, row["text"])).when(letter == "I", F.concat(role, F.lit(":")))

    lines = F.filter(F.transform(F.sequence(F.lit(1), F.length(piece)), line), lambda x: x.isNotNull())
    return F.when((F.length(piece) > 0) & (F.size(lines) > 0), F.concat_ws("\n", lines))


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    Turns go by number, nulls first; turns of one number by role and digest of the text.  gaps: numbers missing between the smallest and the largest.  A
    blank turn holds white space only, a duplicate repeats role and text of one before, a truncated one doesn't end with a mark; each counts for its first
    fault.  Edits: K keeps a turn, R makes it a user's or assistant's, D deletes it, I inserts an empty one.  repaired: the lines ``role:text`` after
    them, '' if none is left; a conversation's text has to fit in one row.  Null roles and texts are one space; a null conversation is one of its own.
    Repeated rows are duplicates.  An empty table gives no rows; other columns are ignored.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = flagged(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role"), name("text")))
    found = written(audited(rows), "turns-audited")
    parts = found.select(F.col("conv_id").alias("c"), F.posexplode("segments").alias("at", "s"), "pieces", "path")
    parts = parts.select("c", "s", F.get("pieces", F.col("at")).alias("piece"), F.substr("path", F.col("at") + 1, F.lit(1)).alias("state"))
    texts = rows.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    lines = texts.join(parts, same & (F.col("segment") == F.col("s"))).select("conv_id", "segment", _edited(F.col("piece"), F.col("state"), F.col("turns")).alias("lines"))
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("segment", "lines"))), lambda x: x["lines"]))
    edited = lines.groupBy(F.col("conv_id").alias("c")).agg(whole.alias("repaired"))
    numbers = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy(F.col("conv_id").alias("g")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = found.join(edited, same).join(numbers, F.col("conv_id").eqNullSafe(F.col("g")))
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
