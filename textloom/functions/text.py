"""Text normalisation, tokenisation and key sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c

# Literal replacements in order, names of Greek letters first, then punctuation that becomes a space.
GREEK = (
    ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"), ("θ", "theta"), ("ι", "iota"),
    ("κ", "kappa"), ("λ", "lambda"), ("μ", "mu"), ("ν", "nu"), ("ξ", "xi"), ("ο", "omicron"), ("π", "pi"), ("ρ", "rho"), ("ς", "sigma"), ("σ", "sigma"),
    ("τ", "tau"), ("υ", "upsilon"), ("φ", "phi"), ("χ", "chi"), ("ψ", "psi"), ("ω", "omega"), ("ϑ", "theta"), ("ϒ", "gamma"), ("ϕ", "phi"), ("ϱ", "rho"),
    ("ϵ", "epsilon"), ("𝛼", "alpha"), ("𝛽", "beta"), ("𝜀", "epsilon"), ("𝜃", "theta"), ("𝜏", "tau"), ("𝜖", "epsilon"), ("𝜷", "beta"),
)
PUNCTUATION = ("etc.", "et al.", "fig.", "figure.", "e.g.", "(", ")", "[", "]", ";", ":", "!", ",", ".", "?", '"', "'", "%", ">", "<", "+", "&")
# Tokens that are dropped.
SPECIAL = (" ", ",", ".", "DBSCAN", ":", ";", "?", "(", ")", "[", "]", "&", "!", "*", "@", "#", "$", "%", "-", "...", "^", "{", "}")
# The mark of a citation, and how it is cut from a sentence.
MARK, MARK_PATTERN = "[**##**]", r"[\[|,]+\*\*\#\#\*\*[\]|,]+"

#: Frequent function words of English; a parameter wherever stop words are removed.
STOP_WORDS = tuple("a an and are as at be been but by for from had has have he her his i if in into is it its not of on or she so such than that the their them then there these they this to was we were what when which who will with you your".split())

#: A number as a programmer writes it: digits with single underscores, fraction, exponent, or the words for infinity and no number; or one numeric character.
_D = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?$|^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$|^\p{{N}}$"


def replaced(text, table: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    out = _c(text)
    for old, new in table:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


_LONG = tuple(p for p in PUNCTUATION if len(p) > 1)
_BREAK = "[" + "".join("\\" + p for p in PUNCTUATION if len(p) == 1) + r" \t\n\x0B\f\r]+"
_ANY_GREEK = "[" + "".join(g for g, _ in GREEK) + "]"


def normalize(text) -> Column:
    """Lower case, Greek letters by name, punctuation to spaces, single spaces between words; null is empty.

    Letters are replaced where there are any; longer marks before single ones, which with white space are one pattern.
    """
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    named = F.when(low.rlike(_ANY_GREEK), replaced(low, GREEK)).otherwise(low)
    return F.btrim(F.regexp_replace(replaced(named, [(p, " ") for p in _LONG]), _BREAK, " "))


def split_keep(text) -> Column:
    """Parts between single spaces, empty ones too: an empty text is one empty token."""
    return F.split(_c(text), " ")


def tokens(text) -> Column:
    """Parts between single spaces; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), " "), lambda w: w != "")


def normalized_tokens(text) -> Column:
    return tokens(normalize(text))


def without(toks, words: Sequence[str]) -> Column:
    """Tokens but those in words; repeated ones stay repeated."""
    known = F.array(*[F.lit(w) for w in words])
    return F.filter(_c(toks), lambda w: ~F.array_contains(known, w))


def remove_stop_words(toks, words: Sequence[str] = STOP_WORDS) -> Column:
    return without(toks, words)


def remove_special(toks) -> Column:
    return without(toks, SPECIAL)


def remove_numbers(toks) -> Column:
    return F.filter(_c(toks), lambda w: ~w.rlike(NUMBER))


def preprocess(text, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Normalised text without stop words, special tokens and numbers, joined by spaces.  Lemmas are a join: see operators.text.lemmatize."""
    return F.array_join(F.transform(remove_numbers(remove_special(remove_stop_words(normalized_tokens(text), stop_words))), F.lower), " ")


def join_fields(*fields) -> Column:
    """Fields with single spaces between, nulls as empty."""
    parts = [F.coalesce(_c(f), F.lit("")) for f in fields]
    return F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:])


def without_sentinel(text, sentinel: str = "no_content") -> Column:
    return F.replace(F.coalesce(_c(text), F.lit("")), F.lit(sentinel), F.lit(""))


def key_sentences(text, mark: str = MARK, short: int = 3) -> Column:
    """Sentences that carry the mark, without it, each followed by '. '.

    Fragments between '. ' are read from the end.  What is pending is glued on; a result of ``short`` words or fewer becomes pending, before what was
    pending, so it reaches the sentence in front of it; a run of short fragments so repeats its end, as long as what is pending isn't longer than the text.
    If nothing is longer, the fragments themselves are read backwards.
    """
    whole = F.replace(F.coalesce(_c(text), F.lit("")), F.lit("al."), F.lit(""))
    parts, room = F.split(whole, r"\. "), F.length(whole)
    start = F.struct(F.lit("").alias("pending"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        glued = F.concat(part, state["pending"])
        brief = F.size(F.split(glued, " ")) <= short
        fits = F.length(glued) + F.length(state["pending"]) <= room
        pending = F.when(brief & fits, F.concat(glued, state["pending"])).when(brief, glued).otherwise(F.lit(""))
        kept = F.when(brief, state["kept"]).otherwise(F.concat(F.array(glued), state["kept"]))
        return F.struct(pending.alias("pending"), kept.alias("kept"))

    kept = F.aggregate(F.reverse(parts), start, step, lambda s: F.when(F.size(s["kept"]) == 0, F.reverse(parts)).otherwise(s["kept"]))
    marked = F.filter(kept, lambda s: F.contains(s, F.lit(mark)))
    return F.array_join(F.transform(marked, lambda s: F.concat(F.regexp_replace(s, MARK_PATTERN, ""), F.lit(". "))), "")


def pipe_array(text) -> Column:
    """Parts between '|'; none for null."""
    return F.coalesce(F.split(_c(text), r"\|"), F.array().cast("array<string>"))


def truncate_utf8(text: str | Column, size: int = 1000) -> Column:
    """The longest beginning that has at most so many bytes in UTF-8, without half characters."""
    raw = F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")
    cut = F.hex(F.substring(raw, 1, size))
    # If the byte behind the cut continues a character, what the cut left of that character goes as well.
    halved = F.hex(F.substring(raw, size + 1, 1)).rlike("^[89AB]")
    return F.decode(F.unhex(F.when(halved, F.regexp_replace(cut, "[C-F][0-9A-F](?:[89AB][0-9A-F])*$", "")).otherwise(cut)), "UTF-8")
