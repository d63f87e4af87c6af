import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with results.
CLASH = "doc_id long, text string, n_tokens string, score string, kept string, spans string, n_words string, lang_pred string, digest string, key string, keys string, n string, _text string, _key string, _digest string, _content string, _id string, _y string, _h string, theirs string, _mine string, _rules string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, *["x"] * 20) for i, t in enumerate(texts)], CLASH)


def sentences(n, seed=0, words=60, vocabulary=400):
    r = random.Random(seed)
    own = ["".join(r.choices("abcdefghijklmnop", k=r.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(r.choices(own, k=r.randint(1, words))) for _ in range(n)]


#: Null, empty, blank, one word, odd characters, control characters.
EDGES = [None, "", " \n\t", "word", "é 中文 😀 ok", "a\x00b \x1c c", "\n\nx\n"]
