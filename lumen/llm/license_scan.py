"""License scans: an Aho-Corasick pass over words, and a shunting-yard evaluation of licence expressions.

One automaton holds the notice phrases and the tag that introduces a licence
expression.  A text's words are laid out with one space around each, so that a
phrase matches only whole consecutive words.  After a tag, the rest of the line
is read as an expression: a shunting-yard parser turns identifiers joined by
AND, OR, WITH and parentheses into postfix order, and one walk over that order
tells which licences it names and whether a given set of them satisfies it.

Scale: a narrow pass over the texts, linear in their length; nothing is
shuffled or collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import prepare

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases with labels of the method's own.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}

#: Identifiers that name a licence by themselves, and the label of each.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache", "gpl-2.0": "gpl", "gpl-2.0-only": "gpl", "gpl-2.0-or-later": "gpl", "gpl-3.0": "gpl", "gpl-3.0-only": "gpl",
    "gpl-3.0-or-later": "gpl", "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl",
    "lgpl-3.0-or-later": "lgpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "mpl-2.0": "mpl", "epl-2.0": "epl", "isc": "isc", "bsl-1.0": "bsl", "cc0-1.0": "cc0", "unlicense": "public-domain", "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
}

TAG = "spdx license identifier"
#: Labels under which text may be used for training without further terms.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc0", "public-domain", "cc-by"})

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.:+-]+")
_REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}
_worker: dict[str, object] = {}


def known(identifier: str) -> str | None:
    """The label of a licence identifier: of a listed one, or of a well-formed reference to a licence of the document's own; else None."""
    low = identifier.lower()
    label = IDENTIFIERS.get(low) or IDENTIFIERS.get(low.rstrip("+"))
    return label or (low if _REFERENCE.fullmatch(low) else None)


def postfix(expression: str) -> list[str]:
    """Tokens of a licence expression in postfix order; stops at the first token that cannot continue it, such as a word that names no licence."""
    out: list[str] = []
    stack: list[str] = []
    operand, nested, of_with = True, 0, False  # what may come next; open parentheses; whether an exception is due
    for m in _TOKEN.finditer(expression):
        t = m[0]
        op = t.upper() if t.upper() in _RANK else None
        if t == "(" and operand and not of_with:
            stack.append(t)
            nested += 1
        elif t == ")" and not operand and nested:
            while (x := stack.pop()) != "(":
                out.append(x)
            nested -= 1
        elif op and not operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand, of_with = True, op == "WITH"
        elif not op and t not in "()" and operand and ("exception" in t.lower() if of_with else known(t)):
            out.append(t)
            operand = of_with = False
        else:
            break
    if operand:
        while stack and stack[-1] == "(":
            stack.pop()  # a parenthesis without content
        if stack:
            stack.pop()  # an operator without its right side
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(expression: str, allowed: frozenset[str] | None = None) -> tuple[frozenset[str], bool]:
    """The labels of the licences that an expression names, and whether those in ``allowed`` (default: PERMISSIVE) satisfy it: AND asks for both sides, OR for one; an exception stays with its licence. Nothing named: not satisfied."""
    allowed = PERMISSIVE if allowed is None else allowed
    labels: set[str] = set()
    stack: list[bool] = []
    for t in postfix(expression):
        if t == "WITH":
            stack.pop()
        elif t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append((a or b) if t == "OR" else (a and b))
        else:
            label = known(t)
            if label:
                labels.add(label)
            stack.append(label in allowed)
    return frozenset(labels), bool(stack) and stack[-1]


@dataclass
class Scan:
    """What one text holds."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)  # start word and label of base phrases
    notices: list[tuple[int, str]] = field(default_factory=list)  # of the method's phrases
    expressions: list[str] = field(default_factory=list)
    values: list[tuple[frozenset[str], bool]] = field(default_factory=list)  # of the expressions

    @property
    def base_labels(self) -> set[str]:
        return {x for _, x in self.places}

    @property
    def labels(self) -> set[str]:
        return self.base_labels | {x for _, x in self.notices} | {x for labels, _ in self.values for x in labels}

    @property
    def permissive(self) -> bool:
        """Whether some expression is satisfied by permissive licences, or all that the text names are such."""
        return any(ok for _, ok in self.values) or bool(self.labels) and self.labels <= PERMISSIVE

    @property
    def score(self) -> float:
        """How sure the text is under a known licence: more for a tag with a valid expression than for phrases, more for more of them; 0 without any."""
        hits = len(self.places) + len(self.notices)
        sure = 0.5**hits
        for labels, _ in self.values:
            sure *= 0.1 if labels else 0.8
        return round(1.0 - sure, 6)


def automaton():
    if "aho" not in _worker:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, (p, label) in enumerate([*BASE.items(), *PHRASES.items(), (TAG, "")]):
            a.add_word(f" {p} ", ("base" if p in BASE else "notice" if p != TAG else "tag", len(p), label))
        a.make_automaton()
        _worker["aho"] = a
    return _worker["aho"]


def scan_text(text: str | None) -> Scan:
    out = Scan()
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()
    out.n_words = len(words)
    if not words:
        return out
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    at, nth, tags = 0, 0, []
    for end, (kind, size, label) in sorted(automaton().iter(line), key=lambda x: x[0] - x[1][1]):
        start = end - size - 1  # the space before the phrase
        nth += line.count(" ", at, start)
        at = start
        if kind == "base":
            out.places.append((nth, label))
        elif kind == "notice":
            out.notices.append((nth, label))
        else:
            tags.append(nth)
    if tags:
        low = text.translate(_LOWER)
        spans = [m.span() for m in _WORD.finditer(low)]
        for nth, then in zip(tags, [*(spans[n][0] for n in tags[1:]), len(low)]):
            begin = spans[nth + 2][1]
            stop = low.find("\n", begin, then)  # an expression ends with its line or at the next tag
            rest = text[begin : stop if stop >= 0 else then].lstrip(" :\t")
            out.expressions.append(rest.strip())
            out.values.append(evaluate(rest))
    return out


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, ``n_words``, base places, labels, expressions, ``permissive`` and ``score``.

    Null and empty texts have no words, no labels and score 0.  Repeated rows
    repeat; an empty table gives an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    schema = f"{id} long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, places array<struct<word: long, label: string>>, expressions array<string>, permissive boolean"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        for b in batches:
            got = [scan_text(t) for t in b.column(1).to_pylist()]
            starts = [[w for w, _ in s.places] for s in got]
            ok = [s.permissive for s in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([s.n_words for s in got], pa.int64()), pa.array([len(x) for x in starts], pa.int64()),
                    pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()),
                    pa.array([sorted(s.base_labels) for s in got], pa.list_(pa.string())), pa.array([sorted(s.labels) for s in got], pa.list_(pa.string())),
                    pa.array([s.score for s in got], pa.float64()), pa.array([[{"word": w, "label": x} for w, x in s.places] for s in got], place),
                    pa.array([s.expressions for s in got], pa.list_(pa.string())), pa.array(ok, pa.bool_()),
                ],
                [id, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places", "expressions", "permissive"],
            )

    return docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text")).mapInArrow(f, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: licence places and labels of every document."""
    from lumen.llm.shared import read

    out = scan_licenses(read(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")
