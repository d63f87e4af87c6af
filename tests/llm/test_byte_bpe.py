import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import EDGES, clashing, frame, sentences

from lumen.llm import byte_bpe as m

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    r = random.Random(1)
    alphabet = list("  \n\t\r''strevmldLA9é中\xa0 \x1c!-_🙂́²Ⅷ​\x85")
    return ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(n)]


def test_ids_match_the_library(library):
    c = m.Codec(PATH)
    texts = [*odd_texts(3000), "it's we'll ''s 's 'tis  I'd've!'s\n\n 's", "", *sentences(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    for t, (ids, n, decoded) in zip(texts, m.encode_texts(c, data, offsets), strict=True):
        want = library.encode_ordinary(t)
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), t.encode())


def test_rows(spark, library):
    texts = [*EDGES, "x" * 3000, "hello " * 20_000, "same", "same"]
    got = sorted(m.encode_decode(frame(spark, texts), PATH).collect())
    for r, t in zip(got, texts, strict=True):
        ids = " ".join(map(str, library.encode_ordinary(t or "")))
        assert r["ids"] == ids and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_clashing_columns_and_empty_table(spark):
    x = m.encode_decode(clashing(spark, ["a b"]), PATH).first()
    assert x["n_tokens"] == 2 and x["digest"] == "x"
    assert m.encode_decode(frame(spark, ["x"]).limit(0), PATH).count() == 0


def test_long_runs_match_the_library(library):
    c = m.Codec(PATH)
    r = random.Random(4)
    letters = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    texts = ["x" * 100_000, " " * 100_000, "-" * 100_000 + "=" * 501, letters, "中文字" * 3000, *("".join(r.choices("ab \n-", k=1500)).replace(" ", "  " * r.randint(1, 200)) for _ in range(5)), *("".join(r.choices("theinga", k=r.randint(200, 1200))) for _ in range(30))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    for t, (ids, n, decoded) in zip(texts, m.encode_texts(c, data, offsets), strict=True):
        want = library.encode_ordinary(t)
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), t.encode())


def test_what_a_query_keeps_is_bounded(library, monkeypatch):
    monkeypatch.setattr(m, "ROWS", 4000)
    c = m.Codec(PATH)
    text = "".join(random.Random(6).choices("etaoinshrdlu", k=1500))
    want = library.encode_ordinary(text)
    assert next(c.encode([text.encode()]))[0] == " ".join(map(str, want))


def test_a_word_of_100000_letters(library):
    c = m.Codec(PATH)
    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    assert next(c.encode([text.encode()])) == (" ".join(map(str, library.encode_ordinary(text))), text.encode())


def test_decoding_takes_the_ids_alone():
    c = m.Codec(PATH)
    c.open()
    the, dog = c.ranks[b"the"], c.ranks[b" dog"]
    c.con.execute(f"update vocabulary set hex = '21' where id = {the}")
    assert c.learn([b"the", b" dog"]) == ([str(the), str(dog)], [b"!", b" dog"])


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    c = m.Codec(PATH)
    monkeypatch.setattr(m, "CACHE", 5000)
    words = [f"wqx{i}zzj".encode() for i in range(400)]
    assert c.learn(words)[1] == words and c.held <= 2500 and len(c.known) + len(c.older) < 30
    c.close()
    assert c.con is None
    assert c.learn(words[::-1])[1] == words[::-1]
