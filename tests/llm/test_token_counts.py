import public_tokenizers as P
from helpers import EDGES, clashing, frame, sentences
from tokenizers import Tokenizer

from lumen.llm import token_counts as m

PATH = P.path("byte_bpe_50k.json")


def expected(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_match_the_library(spark):
    texts = EDGES + sentences(50) + ["<|endoftext|> inside", "ab " * 200_000, "same", "same"]
    got = sorted(m.count_tokens(frame(spark, texts), PATH).collect())
    assert [r["n_tokens"] for r in got] == expected(texts)
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    m.count_tokens(frame(spark, ["a b", "c"]), PATH, cache).collect()
    before = spark.read.parquet(cache).count()
    assert before == 2
    got = m.count_tokens(frame(spark, ["a b", "d", "d", None]), PATH, cache)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(expected(["a b", "d", "d", None]))
    assert spark.read.parquet(cache).count() == 4  # d once, and the empty text
    other = P.path("word_bpe_49k.json")
    assert [r["n_tokens"] for r in m.count_tokens(frame(spark, ["a b"]), other, cache).collect()] == expected(["a b"], other)


def test_empty_table_and_clashing_columns(spark):
    assert m.count_tokens(frame(spark, ["x"]).limit(0), PATH).count() == 0
    got = m.count_tokens(clashing(spark, ["a b c", None]), PATH)
    assert got.columns.count("n_tokens") == 1 and got.columns.count("digest") == 1
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 3]


def test_sentencepiece(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", "", "é"]
    got = sorted(m.count_tokens(frame(spark, texts), path).collect())
    assert [r["n_tokens"] for r in got] == [len(sp.encode(t)) for t in texts]
