import random
import re
import time

from helpers import EDGES, clashing, frame, sentences

from lumen.llm import license_scan as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(t):
    w = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    places = sorted((i, label) for i in range(len(w)) for p, label in m.BASE.items() if w[i : i + len(p.split())] == p.split())
    return len(w), places


def test_places_against_brute_force(spark):
    texts = [*EDGES, *sentences(30), "CC BY cc-by\nCC BY-NC 4.0", "the MIT, License. mit  license", "GNU General Public License, GNU general-public license", "apache licenses apache license", "mitlicense mit license"]
    got = sorted(m.scan_licenses(frame(spark, texts)).collect())
    for r, t in zip(got, texts, strict=True):
        n, places = brute(t)
        assert (r["n_words"], [(p["word"], p["label"]) for p in r["places"]]) == (n, places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1


def test_expressions():
    f = frozenset
    assert m.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "AND", "OR"]
    assert m.evaluate("(MIT OR Apache-2.0) AND GPL-3.0-only") == (f({"mit", "apache", "gpl"}), False)
    assert m.evaluate("(MIT OR GPL-2.0-only) AND ISC") == (f({"mit", "gpl", "isc"}), True)
    assert m.evaluate("MIT OR GPL-2.0-only AND LGPL-2.1") == (f({"mit", "gpl", "lgpl"}), True)
    assert m.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == (f({"gpl"}), False)
    assert m.evaluate("GPL-2.0-only WITH Classpath-exception-2.0", f({"gpl"})) == (f({"gpl"}), True)
    assert m.evaluate("GPL-3.0+ or mit") == (f({"gpl", "mit"}), True)
    assert m.evaluate("LicenseRef-Own AND MIT") == (f({"licenseref-own", "mit"}), False)
    assert m.evaluate("see the file called COPYING") == (f(), False)
    assert m.evaluate("MIT see the file") == (f({"mit"}), True)
    for broken in ("", "AND", "(", ")", "MIT AND", "(MIT OR", "MIT OR )", "MIT OR (", "((", "MIT WITH", "MIT WITH (ISC)", ") MIT", "(MIT AND (ISC"):
        assert m.evaluate(broken)[0] <= {"mit", "isc"}
    s = m.scan_text("x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nApache-2.0")
    assert s.expressions == ["(MIT OR GPL-2.0-only)"] and s.labels == {"mit", "gpl"} and s.permissive


def test_expressions_against_brute_force():
    """Random expressions against Python's own evaluation."""
    r = random.Random(3)
    names = ["MIT", "GPL-2.0-only", "ISC", "MPL-2.0", "Apache-2.0"]

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(names)
        return f"({make(depth - 1)} {r.choice(['AND', 'OR'])} {make(depth - 1)})" if r.random() < 0.6 else f"{make(depth - 1)} {r.choice(['AND', 'OR'])} {make(depth - 1)}"

    for _ in range(300):
        x = make(4)
        allowed = frozenset(r.sample([m.known(n) for n in names], 2))
        plain = x.lower().replace(" and ", " & ").replace(" or ", " | ")
        for n in sorted(names, key=len, reverse=True):
            plain = plain.replace(n.lower(), str(m.known(n) in allowed))
        want = eval(plain)  # & binds tighter than |, as AND does
        assert m.evaluate(x, allowed) == (frozenset(m.known(n) for n in names if n in x), want)


def test_hostile_texts_take_linear_time():
    pairs = " AND ".join(f"(MIT OR LicenseRef-{i})" for i in range(4000))
    assert m.evaluate(pairs)[1]
    text = "SPDX-License-Identifier: MIT OR GPL-2.0-only\n" * 10_000
    began = time.time()
    s = m.scan_text(text)
    assert len(s.expressions) == 10_000 and s.labels == {"mit", "gpl"} and time.time() - began < 5
    assert m.scan_text("( " * 50_000).n_words == 0 and m.evaluate("(" * 50_000) == (frozenset(), False)


def test_clashing_columns_and_empty_table(spark):
    assert m.scan_licenses(clashing(spark, ["mit license"])).first()["n_words"] == 2
    assert m.scan_licenses(frame(spark, ["x"]).limit(0)).count() == 0


def test_many_tags_on_one_line():
    import time

    began = time.time()
    got = m.scan_text("SPDX-License-Identifier: MIT OR Apache-2.0 " * 20_000)
    assert time.time() - began < 5 and set(got.expressions) == {"MIT OR Apache-2.0"} and len(got.expressions) == 20_000
    assert sum(map(len, got.expressions)) < 1_000_000
    two = m.scan_text("x SPDX-License-Identifier: MIT AND\nSPDX-License-Identifier: (GPL-3.0) spdx-license-identifier : Apache-2.0 */ end")
    assert two.expressions == ["MIT AND", "(GPL-3.0)", "Apache-2.0 */ end"]
