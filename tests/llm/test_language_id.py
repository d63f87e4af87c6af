import re

import zstandard
from helpers import EDGES, clashing, frame

from lumen.llm import language_id as m
from lumen.llm.shared import fold

WORDS = {"en": [f"thing{chr(97 + i % 26)}{chr(97 + i // 26)}ly" for i in range(60)], "fr": [f"est{chr(97 + i // 26)}{chr(97 + i % 26)}eaux" for i in range(60)]}


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = m.query(spark, small.replace("sf0.001", "sf0.01"))
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in both) / len(both) > 0.95
    assert all(0 <= r["score"] <= 1 for r in both)


def test_labels_of_the_held_out_fold_are_not_read(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet")
    d = m.fit(docs.where(fold("doc_id", 3) != 1))
    assert set(d) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert len({len(x) for x in d.values()}) == 1 and max(map(len, d.values())) <= m.DICTIONARY


def plain(dictionaries, text):
    """The language of least compressed size and its score, by plain zstandard calls."""
    low = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not low:
        return "und", 0.0
    raw = f" {low} ".encode()
    sizes = []
    for i, (k, d) in enumerate(dictionaries.items()):
        z = zstandard.ZstdCompressor(level=m.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(z.compress(raw[j : j + m.PIECE])) for j in range(0, len(raw), m.PIECE)), i, k))
    (best, _, lang), (second, *_) = sorted(sizes)[:2]
    return lang, min(1.0, 0.5 + 2 * (second - best) / second)


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet")
    d = m.fit(docs.where(fold("doc_id", 3) != 1))
    texts = [r["text"] for r in docs.collect()] + [" ".join(WORDS["en"]) * 300, *EDGES]
    for r, t in zip(sorted(m.classify(frame(spark, texts), d, reject=False).collect()), texts, strict=True):
        lang, score = plain(d, t)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 2e-6


def test_learns_from_the_whole_of_a_long_text(spark):
    text = " ".join(["early"] * 5000 + ["late"] * 5000)
    got = m.fit(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string"))
    words = got["x"].split()
    assert 0.4 < words.count(b"late") / len(words) < 0.6


def test_edges(spark):
    d = {k: f" {' '.join(WORDS[k])} ".encode() for k in WORDS}
    one, two = " ".join(WORDS["en"][10:40:2]), " ".join(WORDS["fr"][10:40:2])
    got = {r["doc_id"]: r for r in m.classify(frame(spark, [*EDGES, "123 !!", one, two.upper()]), d).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 7)] == ["und"] * 4
    assert got[8]["lang_pred"] == "en" and got[9]["lang_pred"] == "fr"
    assert m.classify(frame(spark, ["x"]).limit(0), d).count() == 0
    x = m.classify(clashing(spark, [one]), d).collect()
    assert x[0]["lang_pred"] == "en" and isinstance(x[0]["score"], float)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    d = m.fit(df)
    assert d == {}
    assert m.classify(df, d).first()["lang_pred"] == "und"


def test_narrow_margins_are_rejected(spark):
    d = {"a": b" same words here ", "b": b" same words here "}
    r = m.classify(frame(spark, ["same words here"]), d).first()
    assert r["lang_pred"] == "und" and r["rejected"]
    assert m.classify(frame(spark, ["same words here"]), d, reject=False).first()["lang_pred"] == "a"
