"""Boolean trigram queries of regular expressions.

``mandatory(pattern)`` returns a disjunction of conjunctions: every text that
matches ``pattern`` holds, once lower-cased, all trigrams of at least one of the
sets. None: the pattern demands no trigram, so every text must be scanned.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

#: Sets of possible strings, and alternatives, beyond this size are given up for "anything".
MOST = 64

Clauses = list[frozenset[str]] | None


def _of(strings: set[str]) -> Clauses:
    """One conjunction for each string; None if a string is too short to demand anything."""
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if not out or frozenset() in out else _least(out)


def _least(clauses: set[frozenset[str]]) -> Clauses:
    """Without the clauses that a smaller one implies."""
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _both(a: Clauses, b: Clauses) -> Clauses:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return _least({x | y for x, y in product(a, b)})


def _either(parts: list[Clauses]) -> Clauses:
    if any(p is None for p in parts):
        return None
    return _least({x for p in parts for x in p})


def _exact(item: tuple) -> set[str] | None:
    """The strings that an element can match, lower-cased, if they are few."""
    kind, value = item
    if kind is C.LITERAL:
        return {chr(value).lower()}
    if kind is C.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is C.LITERAL:
                chars.add(chr(v).lower())
            elif k is C.RANGE and v[1] - v[0] < 4:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 4 else None
    if kind is C.SUBPATTERN:
        return _exact_all(value[3])
    if kind is C.BRANCH:
        parts = [_exact_all(x) for x in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is C.MAX_REPEAT and value[1] is not C.MAXREPEAT and value[1] <= 4:
        one = _exact_all(value[2])
        if one is None or len(one) ** value[1] > MOST:
            return None
        return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
    return {""} if kind is C.AT else None


def _exact_all(items: list[tuple]) -> set[str] | None:
    out = {""}
    for item in items:
        part = _exact(item)
        if part is None or len(out) * len(part) > MOST:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _demand(item: tuple) -> Clauses:
    kind, value = item
    if kind is C.SUBPATTERN:
        return _demand_all(value[3])
    if kind is C.BRANCH:
        return _either([_demand_all(x) for x in value[1]])
    if kind is C.MAX_REPEAT and value[0] > 0:
        return _demand_all(value[2])
    return None


def _demand_all(items: list[tuple]) -> Clauses:
    found: Clauses = None
    run = {""}
    for item in items:
        part = _exact(item)
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a, b in product(run, part)}
            continue
        found = _both(_both(found, _of(run)), _demand(item) if part is None else None)
        run = part if part is not None else {""}
    return _both(found, _of(run))


def mandatory(pattern: str) -> Clauses:
    return _demand_all(list(_parser.parse(pattern)))
