"""Boolean trigram queries from regular expressions.

A pattern's query is a list of alternatives, each a set of trigrams that any match of it holds,
lower-cased. Where some alternative has no trigram the query is None and nothing can be
left out. Literal runs are followed through small classes, groups, alternations and optional
parts; anything else ends a run.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

#: Most variants that a run is followed in, and most alternatives of a query.
RUNS, ALTERNATIVES, CLASS = 64, 32, 8


def _class(items) -> list[str] | None:
    out = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 2 * CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return sorted(out) if len(out) <= CLASS else None


def _variants(node) -> list[str] | None:
    """All strings that a node can be, if few."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        return _class(arg)
    if op is C.SUBPATTERN:
        return _strings(arg[3])
    if op is C.BRANCH:
        parts = [_strings(p) for p in arg[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        if high is C.MAXREPEAT or int(high) > 3 or (own := _strings(inner)) is None:
            return None
        out = sorted({"".join(x) for n in range(low, int(high) + 1) for x in product(own, repeat=n)})
        return out if len(out) <= RUNS else None
    if op is C.AT:
        return [""]
    return None


def _strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        if (own := _variants(node)) is None or len(out) * len(own) > RUNS:
            return None
        out = [a + b for a in out for b in own]
    return out


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    """All pairs' unions; where that is too many, the more telling side alone."""
    if len(a) * len(b) > ALTERNATIVES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return list(dict.fromkeys(x | y for x in a for y in b))


def _query(nodes) -> list[frozenset]:
    out, runs = [frozenset()], [""]

    def close() -> None:
        nonlocal out, runs
        out, runs = _and(out, list(dict.fromkeys(map(_grams, runs)))), [""]

    for node in nodes:
        own = _variants(node)
        if own is not None and len(runs) * len(own) <= RUNS:
            runs = [a + b for a in runs for b in own]
            continue
        close()
        op, arg = node
        if own is not None:
            runs = own
        elif op is C.SUBPATTERN:
            out = _and(out, _query(arg[3]))
        elif op is C.BRANCH:
            out = _and(out, list(dict.fromkeys(q for p in arg[1] for q in _query(p))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            out = _and(out, _query(arg[2]))
    close()
    return out


def trigram_query(pattern: str) -> list[frozenset] | None:
    """Alternatives of trigrams, one of which any match holds whole; None if there is none to look for."""
    found = _query(_parser.parse(pattern))
    least = [q for q in dict.fromkeys(found) if not any(o < q for o in found)]
    return None if frozenset() in least else least
