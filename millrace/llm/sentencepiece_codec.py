"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

Every prefix of a text has one BPE encoding, so one last token. A token that an automaton finds
ending at a place is that last token if the last token of the prefix before it is compatible
with it, that is, if the two alone encode as the two. The ids are then read backwards from
the end of the table. Characters outside the vocabulary become byte tokens and part the text.

No vocabulary piece has a space after another character or a line break, which the constructor
checks; so texts are cut before each run of spaces and around line breaks, and what a cut gives is
remembered in a table of bounded size. Runs of two or more spaces, whose pieces tie in score,
are merged pair by pair in a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame

from .common import per_document

SPACE, MEMORY = "▁", 250_000
_CUT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = lib.eos_id()
        self.score, self.id, self.piece = {}, {}, {}
        self.bytes_of = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(lib.get_piece_size()):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_of[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.score[p], self.id[p], self.piece[i] = lib.get_score(i), i, p
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id) or len(self.bytes_of) != 256:
            raise ValueError("the vocabulary must have spaces only in front, no line breaks and a token for each byte")
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.text_of = [str(i) for i in range(lib.get_piece_size())]

    def merge(self, s: str) -> list[int]:
        """The encoding by merging: the best-scored adjacent pair first, of equals the leftmost."""
        part = list(s)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(part)
            if i >= 0 and j < len(part) and (score := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score, i, j, len(part[i]) + len(part[j])))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, j, n = heapq.heappop(heap)
            if not part[i] or not part[j] or after[i] != j or len(part[i]) + len(part[j]) != n:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for p in part if p for x in (self._ids(p))]

    def _ids(self, p: str) -> list[int]:
        return [i] if (i := self.id.get(p)) is not None else [self.bytes_of[b] for b in p.encode()]

    def _pair(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= 4 * MEMORY:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return ok

    def _single(self, a: int) -> bool:
        if (ok := self.alone.get(a)) is None:
            ok = self.alone[a] = self.merge(self.piece[a]) == [a]
        return ok

    def _by_prefix(self, s: str) -> list[int]:
        last: list[int | None] = [None] * (len(s) + 1)  # of the prefix of that length; -1: an unknown character
        size = [1] * (len(s) + 1)
        for end, (n, t) in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                start = end - n
                # a place that no token reaches follows an unknown character
                prior = last[start] if start else -1
                if prior is None and s[start - 1] not in self.id:
                    prior = -1
                if prior is None:
                    continue
                if (ok := self.alone.get(t)) is None:
                    ok = self._single(t)
                if ok and prior >= 0 and (ok := self.pairs.get(prior << 32 | t)) is None:
                    ok = self._pair(prior, t)
                if ok:
                    last[end], size[end] = t, n
        out: list[int] = []
        at = len(s)
        while at:
            t = last[at]
            if t is None:
                if (c := s[at - 1]) in self.id:
                    raise AssertionError(f"no token ends the prefix {s[:at]!r}")
                out += [self.bytes_of[b] for b in reversed(c.encode())]
                at -= 1
            else:
                out.append(t)
                at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """The ids as the library gives them, then the end id."""
        out: list[int] = []
        if text:
            known = self.known
            for s in _CUT.findall(SPACE + text.replace(" ", SPACE)):
                if (ids := known.get(s)) is None:
                    ids = self.older.get(s) or (self.merge(s) if s.startswith(SPACE * 2) else self._by_prefix(s))
                    if len(s) <= 64:
                        if len(known) >= MEMORY:
                            self.older, self.known = known, (known := {})
                        known[s] = ids
                out += ids
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_held: dict[str, PieceBpe] = {}


def codec(path: str) -> PieceBpe:
    """One per worker process and file."""
    if path not in _held:
        _held[path] = PieceBpe(path)
    return _held[path]


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row a document: ``n_tokens`` with the end id, ``ids_sha256`` and ``decoded_sha256``.

    With ``ids``, also the ids themselves and the decoded text. Null and empty texts have the
    end id alone; rows repeat as given; other columns are left out.
    """

    def make():
        bpe = codec(model_path)
        name = bpe.text_of

        def work(texts):
            out = [[] for _ in range(5 if ids else 3)]
            for text in texts:
                found = bpe.encode(text)
                decoded = bpe.decode(found)
                row = (len(found), hashlib.sha256(" ".join([name[i] for i in found]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), found, decoded)
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return per_document(docs, [id_col], fields, make, text_col)
