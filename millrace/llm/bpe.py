"""Byte-level BPE with the whole-token shortcut.

``whole`` maps every vocabulary string that is proved, by encoding it alone with the library, to
be one pre-token and one token. A pre-token among them needs no merging; any other is merged
and remembered in a table of bounded size. Merging uses ranks read from the same file: a token's
id orders its merge.

Pre-tokens are found by another regex engine than the library's, whose character classes may differ for some
characters. Texts that hold such are cut where both surely end a pre-token, between a printable ASCII character and a
space (white space stands at a pre-token's start only), and just the parts with such characters go to the library.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import regex

#: Code points on which this pattern's character classes and the library's agree.
PLAIN = regex.compile(r"[\x00-՗Ḁ-⁯぀-ゖァ-ヺ一-龥가-힣]*+")
#: A place where any engine ends a pre-token.
BORDER = regex.compile(r"(?<=[!-~])(?= )")
MEMORY = 200_000
#: From this length on a text is cut into pre-tokens here: the merging library fails on very long runs of white space.
LONG = 250_000


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        with open(path, encoding="utf-8") as f:
            names, of = json.load(f)["model"]["vocab"], _bytes_of()
        ranks = {bytes(of[c] for c in s): i for s, i in names.items() if s not in self.special}
        self.merger = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.whole = self._proved()
        self.merged: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _proved(self) -> dict[str, list[int]]:
        """Strings of the vocabulary that alone encode as one token."""
        out = {}
        vocabulary = sorted(i for s, i in self.library.get_vocab().items() if s not in self.special)
        strings = [self.library.decode([i], skip_special_tokens=False) for i in vocabulary]
        for i, s, e in zip(vocabulary, strings, self.library.encode_batch(strings, add_special_tokens=False), strict=True):
            if e.ids == [i] and PLAIN.fullmatch(s) and self.pattern.findall(s) == [s]:
                out[s] = [i]
        return out

    def _merge(self, pre: str) -> list[int]:
        if (found := self.merged.get(pre)) is None:
            found = self.older.get(pre) or self.merger._encode_single_piece(pre)
            if len(pre) <= 64:
                if len(self.merged) >= MEMORY:
                    self.older, self.merged = self.merged, {}
                self.merged[pre] = found
        return found

    def parts(self, text: str):
        """(plain, part) in turn: what this class encodes and what the library must."""
        if text.isascii() or PLAIN.fullmatch(text):
            yield True, text
            return
        if any(" " in s for s in self.special):
            yield False, text
            return
        start, plain = 0, True
        at = 0
        for end in [*(m.start() for m in BORDER.finditer(text)), len(text)]:
            if (own := PLAIN.fullmatch(text, at, end) is not None) != plain:
                if at > start:
                    yield plain, text[start:at]
                start, plain = at, own
            at = end
        yield plain, text[start:]

    def pieces(self, text: str):
        """The ids of each pre-token in turn, or of a whole part that the library encodes."""
        whole, merge = self.whole, self._merge
        for plain, part in self.parts(text) if text else ():
            if not plain:
                yield self.library.encode(part, add_special_tokens=False).ids
                continue
            at = 0
            for m in [*(self.split.finditer(part) if self.split and any(s in part for s in self.special) else ()), None]:
                for pre in self.pattern.findall(part, at, m.start() if m else len(part)):
                    yield whole.get(pre) or merge(pre)
                if m:
                    yield [self.special[m[0]]]
                    at = m.end()

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if len(text) >= LONG:
            return np.fromiter(chain.from_iterable(self.pieces(text)), np.uint32)
        out = [self.merger.encode_to_numpy(x, allowed_special="all") if plain else np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint32) for plain, x in self.parts(text)]
        return out[0] if len(out) == 1 else np.concatenate(out)


_held: dict[str, ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per worker process and file."""
    if path not in _held:
        _held[path] = ByteBpe(path, pattern)
    return _held[path]
