"""Encoding by public tokenizers in Python workers, with a memory of pieces that were encoded before.

A tokenizer first cuts a text into pieces that no token crosses, then encodes each piece by itself.  Texts in common Latin characters are cut here by the
same rule, all others around ASCII white space only, or not at all where that could change ids.  New pieces go to the tokenizers library, many words in
one text, and what it returns is remembered by piece; so the ids are those of the whole text.  A text that holds the string of a special token goes to the
library as a whole, which gives that token's id for the string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

from .common import cache, claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers, the characters of the longest that it remembers, and words that are encoded in one text.
REMEMBERED, LONGEST, JOINED = 1_200_000, 48, 500
#: Texts that are encoded together.
AT_ONCE = 64
_SPACE = r" \t\n\r\x0b\x0c"
#: Letters whose lower case is one letter and that are the same in composed form, and marks that are neither letters, numbers nor space.
_LETTERS = r"A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
_MARKS = r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-―‘-•…"
_UNCOMMON = re.compile(f"[^{_LETTERS}{_MARKS}0-9{_SPACE}]").search
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: White space beyond ASCII, and separators that libraries treat differently.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]").search
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
_SPACED = re.compile(f" [{_LETTERS}]+").fullmatch


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes.

    word_ends: the vocabulary is of lower-case words with marked ends and drops white space; otherwise a piece carries the space before it.
    """

    def __init__(self, path: str, word_ends: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_ends, self.known = word_ends, cache({})
        marks = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            marks[i] = token.endswith("</w>") if word_ends else token.startswith("Ġ")
        self.marks = marks
        if word_ends:
            self.cut = re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+").findall
            self.around_space = re.compile(f"[^{_SPACE}]+").findall
        else:
            self.cut = re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
            self.around_space = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall

    def pieces(self, text: str) -> list[str]:
        if any(s in text for s in self.specials):
            return [text]
        if not _UNCOMMON(text):
            return self.cut(text.lower() if self.word_ends else text)
        return [text] if not self.word_ends and _OTHER_SPACE(text) else self.around_space(text)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces: plain words are joined to texts, and their ids told apart by the tokens that mark a word's end or beginning."""
        plain = _WORD if self.word_ends else _SPACED
        words = [p for p in pieces if plain(p)]
        found = {}
        for lo in range(0, len(words), JOINED):
            part = words[lo : lo + JOINED]
            raw = self._encoded([(" " if self.word_ends else "").join(part)])[0]
            marked = np.flatnonzero(self.marks[np.frombuffer(raw, "<u4")])
            if len(marked) != len(part):  # not told apart
                found.update(zip(part, self._encoded(part), strict=True))
                continue
            at = (4 * (marked + 1)).tolist() if self.word_ends else [*(4 * marked[1:]).tolist(), len(raw)]
            found.update((w, raw[a:b]) for w, a, b in zip(part, [0, *at], at, strict=False))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._encoded(rest), strict=True))
        return found

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """A few texts at a time, whose pieces then are still in the processor's cache."""
        texts, out = list(texts), []
        for lo in range(0, len(texts), AT_ONCE):
            out += self._few(texts[lo : lo + AT_ONCE])
        return out

    def _few(self, texts: list[str | None]) -> list[bytes]:
        known, get = self.known, self.known.get
        if len(known) > REMEMBERED:
            known.clear()
        cut, out, gaps, new = [], [], [], set()
        for text in texts:
            ps = self.pieces(text or "")
            ids, gap, i = list(map(get, ps)), [], -1
            try:
                while True:
                    i = ids.index(None, i + 1)
                    gap.append(i)
                    new.add(ps[i])
            except ValueError:  # no more pieces that are new
                cut.append(ps)
                out.append(ids)
                gaps.append(gap)
        if new:
            found = self._new(list(new))
            for ps, ids, gap in zip(cut, out, gaps, strict=True):
                for i in gap:
                    ids[i] = found[ps[i]]
            known.update((p, b) for p, b in found.items() if len(p) <= LONGEST)
        return [b"".join(ids) for ids in out]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, word_ends: bool) -> Encoder:
    """The worker's encoder for a vocabulary file, which all machines have at the same path; called once a task."""
    key = (path, word_ends)
    if key not in _encoders:
        _encoders[key] = Encoder(path, word_ends)
    claim(_encoders[key].known)
    return _encoders[key]


def public(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
