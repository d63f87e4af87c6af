"""Boolean trigram queries that every match of a regular expression satisfies.

Derived on the driver from the expression's syntax tree: strings that must
stand in a match give the conjunction of their trigrams, alternatives give a
disjunction, and what is open gives no condition.  Queries are over lower-case
text, so they also serve case-insensitive expressions.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

#: Alternatives of one stretch of fixed text at most, and characters of a class that is spelled out.
MOST_STRINGS, MOST_CLASS = 64, 8

#: A query in disjunctive form: any of these sets of trigrams; frozenset() in it means no condition.
Query = frozenset
ALWAYS: Query = frozenset([frozenset()])


def _simple(q: Query) -> Query:
    """Without terms that another term implies."""
    return frozenset(t for t in q if not any(o < t for o in q))


def both(a: Query, b: Query) -> Query:
    out = _simple(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MOST_STRINGS else min(a, b, key=len)


def either(a: Query, b: Query) -> Query:
    return _simple(a | b)


def of_strings(strings: set[str]) -> Query:
    """What text that holds one of these strings satisfies."""
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings that nodes match if they are few, else None, and a query."""
    run: set[str] = {""}
    query, whole = ALWAYS, True
    ends: set[str] | None = {""}

    def flush() -> None:
        nonlocal run, query, whole
        query = both(query, of_strings(run))
        run, whole = {""}, False

    for op, arg in nodes:
        part: set[str] | None = None
        inner = ALWAYS
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN:
            part = None if arg and arg[0][0] is C.NEGATE else _class(arg)
        elif op is C.SUBPATTERN:
            part, inner = _walk(arg[3])
        elif op is C.BRANCH:
            found = [_walk(x) for x in arg[1]]
            inner = frozenset(found and found[0][1])
            for _, q in found[1:]:
                inner = either(inner, q)
            if all(p is not None for p, _ in found):
                part = set().union(*(p for p, _ in found))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            some, q = _walk(body)
            if least and some is not None and len(some) ** least <= MOST_STRINGS and least <= 16:
                fixed = {""}
                for _ in range(least):
                    fixed = {a + b for a in fixed for b in some}
                if least == most:
                    part = fixed
                else:
                    run = {a + b for a in run for b in fixed} if len(run) * len(fixed) <= MOST_STRINGS else run
                    flush()
                    continue
            elif not least and most == 1 and some is not None:
                part = some | {""}
            else:
                inner = q if least else ALWAYS
        elif op is C.AT:
            continue
        if part is not None and len(part) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
        else:
            if part is not None:
                inner = both(inner, of_strings(part))
            flush()
            query = both(query, inner)
    ends = run if whole else None
    return ends, both(query, of_strings(run))


def query_of(pattern: str) -> Query:
    """The query of a pattern; ALWAYS if it has no mandatory trigrams."""
    strings, q = _walk(parser.parse(pattern))
    return q
