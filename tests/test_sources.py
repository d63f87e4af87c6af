import csv
import io
import random

import pytest

from lumen.sources import integrity, readers, records, sinks


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{p}"


def test_csv_with_bom_quotes_and_separators(spark, tmp_path):
    df = readers.read_any(spark, put(tmp_path, "a.csv", b"\xef\xbb\xbfid,Full Name,empty\n1,\"a, b\",\n2,\"c \"\"d\"\"\",\n"))
    assert df.columns == ["id", "Full_Name"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a, b"), (2, 'c "d"')]
    for name, sep in (("b.csv", ";"), ("c.tsv", "\t"), ("d.txt", "|")):
        df = readers.read_any(spark, put(tmp_path, name, "\n".join(f"{i}{sep}x{i}{sep}{i}" for i in ["id", *range(9)])))
        assert len(df.columns) == 3 and df.count() == 9


def test_gates(spark, tmp_path):
    assert integrity.check_csv(spark, put(tmp_path, "ok.csv", "a,b\n" + "1,2\n" * 20))["status"] == "ok"
    assert integrity.check_csv(spark, put(tmp_path, "q.csv", 'a,b\n1,"x\n2,y\n'))["status"] == "blocked"
    ragged = integrity.check_csv(spark, put(tmp_path, "r.csv", "a,b,c\n" + "1,2,3\n" * 8 + "1,2\n" * 2))
    assert ragged["status"] == "blocked" and {f["kind"] for f in ragged["findings"]} == {"ragged"}
    assert integrity.check_csv(spark, put(tmp_path, "h.csv", "a,b\n"))["findings"][0]["kind"] == "no_records"
    nul = integrity.check_csv(spark, put(tmp_path, "n.csv", b"a,b\n1,\x002\n" + b"1,2\n" * 9))
    assert nul["status"] == "flagged"
    with pytest.raises(ValueError, match="blocked"):
        readers.read_any(spark, put(tmp_path, "q2.csv", 'a,b\n1,"x\n2,y\n'))
    with pytest.raises(ValueError, match="empty"):
        readers.read_any(spark, put(tmp_path, "e.csv", ""))
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, f"file://{tmp_path}/none.csv")


def test_json(spark, tmp_path):
    lines = readers.read_any(spark, put(tmp_path, "a.jsonl", '{"a": 1, "b": {"c": "x"}}\n{"a": 2, "b": {"c": "y"}}\n'))
    assert sorted(lines.columns) == ["a", "b_c"] and lines.count() == 2
    listed = readers.read_any(spark, put(tmp_path, "b.json", '[{"a": 1},\n {"a": 2}]'))
    assert sorted(r["a"] for r in listed.collect()) == [1, 2]
    inner = readers.read_any(spark, put(tmp_path, "c.json", '{"meta": [{"z": 1}],\n "rows": [{"a": 1}, {"a": 2}, {"a": 3}]}'))
    assert inner.columns == ["a"] and inner.count() == 3


def test_types_and_names():
    assert readers.file_type("x", b"PAR1....") == "parquet" and readers.file_type("x.tsv") == "tsv" and readers.file_type("x", b"[1]") == "json"
    with pytest.raises(ValueError, match="SQLite"):
        readers.file_type("x", b"SQLite format 3\0")
    assert readers.clean_name(" ﻿Total  Price ($)-x ") == "Total_Price_x"
    assert readers.clean_name("$$").startswith("column_")
    assert readers.encoding_of("é".encode()) == "UTF-8" and readers.encoding_of("café au lait".encode("cp1252")) == "windows-1252"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i long, s string")
    sinks.save_csv(df, f"file://{tmp_path}/out")
    back = readers.read_any(spark, f"file://{tmp_path}/out", check=False)
    assert back.where("i = 1").first()["s"] == 'a "b", c'
    c = sinks.Catalog(spark, f"file://{tmp_path}/cat")
    c.create("x")
    c.save("x", "t", df)
    c.complete("x", rows=2)
    assert c.states()["x"]["state"] == "completed" and c.load("x", "t").count() == 2
    c.delete("x")
    assert c.states() == {}
    assert sinks.frame_digest(df) == sinks.frame_digest(df.orderBy("i", ascending=False)) != sinks.frame_digest(df.limit(1))


@pytest.fixture
def splits(spark):
    """Sets the size of file splits."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def test_damage_is_found_wherever_it_stands(spark, tmp_path, splits):
    splits(20_000)
    good = "a,b\n" + "1,2\n" * 60_000
    assert integrity.check_csv(spark, put(tmp_path, "big.csv", good)) == {"status": "ok", "encoding": "UTF-8", "delimiter": ",", "records": 60_001, "fields": 2, "findings": []}
    assert integrity.check_csv(spark, put(tmp_path, "lines.csv", "a,b\n" + '1,"x\ny"\n' * 9000))["status"] == "ok"
    for name, tail, kind, n in (("open", '1,"x\n1,2\n', "parse_error", 1), ("odd", '1,"x"y\n1,2\n', "parse_error", 1), ("joined", "1,2'3,4\n" * 2 + "1,'2,3,4\n" * 3, "concatenated", 3), ("ragged", "1\n" * 7, "ragged", 7)):
        found = {f["kind"]: f for f in integrity.check_csv(spark, put(tmp_path, f"{name}.csv", good + tail))["findings"]}
        assert found[kind]["affected"] == n and found[kind]["action"] == ("flag" if kind == "ragged" else "block")


@pytest.mark.parametrize("size", [150, 4000, 1 << 27])
def test_records_equal_a_plain_parser_at_every_split_size(spark, tmp_path, splits, size):
    splits(size)
    cells = ["x", '5" pipe', "a,b", 'say ""hi"" "', 'line\nend\n\n"q"', "", "é中", "long\n" * 40, '"', "it's"]
    for seed, end in ((1, "\n"), (2, "\r\n")):
        r = random.Random(seed)
        s = io.StringIO(newline="")
        csv.writer(s, lineterminator=end).writerows([[r.choice(cells) for _ in range(3)] for _ in range(120)])
        raw = s.getvalue().replace("x,", 'x" y,')  # quotes within fields stand for themselves
        path = put(tmp_path, f"{seed}.csv", raw)
        got = records.read_records(spark, path).orderBy("block", "seq").collect()
        want = list(csv.reader(io.StringIO(raw, newline="")))
        assert [next(csv.reader([g["record"]]), []) for g in got] == want and [g["fields"] for g in got] == list(map(len, want))
        assert not any(g["error"] for g in got)
        if size == 150:
            assert records.lines(spark, path).rdd.getNumPartitions() > 20
    assert {g["error"] for g in records.read_records(spark, put(tmp_path, "o.csv", raw + 'a,"open\nand on\n')).collect()} == {None, "unexpected end of data"}


def test_states_after_a_line():
    for line, outside, inside in ((b"a,b", False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'x"y', False, False), (b'"', True, False), (b'""', False, True), (b'","', False, True)):
        assert (records.state_after(line, False, b","), records.state_after(line, True, b",")) == (outside, inside), line


def test_quoted_line_ends_are_read_in_parts(spark, tmp_path, splits):
    splits(3000)
    rows = [(i, f"text {i}\nwith, \"quotes\"\n\nand é", i / 4) for i in range(400)]
    s = io.StringIO(newline="")
    csv.writer(s, lineterminator="\n").writerows([("id", "text", "x"), *rows])
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    df = readers.read_csv(spark, put(tmp_path, "t.csv", s.getvalue()))
    assert df.dtypes == [("id", "int"), ("text", "string"), ("x", "double")] and df.rdd.getNumPartitions() > 5
    assert sorted(tuple(r) for r in df.collect()) == rows and df.agg({"id": "sum"}).first()[0] == sum(range(400))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.csv.parser.columnPruning.enabled"))
    bad = s.getvalue() + "7\n8,b\n"
    with pytest.warns(UserWarning, match="2 records"):
        assert readers.read_csv(spark, put(tmp_path, "u.csv", bad), warn=True).count() == 400


def test_other_line_ends_and_wide_characters(spark, tmp_path):
    mac = readers.read_csv(spark, put(tmp_path, "m.csv", "a,b\r1,x\r2,y\r"))
    assert sorted(tuple(r) for r in mac.collect()) == [(1, "x"), (2, "y")]
    path = put(tmp_path, "w.csv", 'a,b\n1,"é\n中"\n2,z\n'.encode("utf-16"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, path).collect()) == [(1, "é\n中"), (2, "z")]
    assert integrity.check_csv(spark, path)["records"] == 3


def test_records_that_cannot_be_parsed_are_counted(spark, tmp_path):
    path = put(tmp_path, "m.csv", "a,b\n" + "1,2\n" * 50 + "7\n" + "1,2,3\n")
    assert readers.malformed(spark, path) == 2
    with pytest.warns(UserWarning, match="2 records"):
        assert readers.read_any(spark, path).count() == 50


def test_lines_are_read_apart_unless_fields_go_on(spark, tmp_path):
    one = readers.read_csv(spark, put(tmp_path, "s.csv", "a,b\n" + "1,x\n" * 9))
    assert one.count() == 9
    two = readers.read_csv(spark, put(tmp_path, "q.csv", 'a,b\n1,"x\ny"\n2,z\n'))
    assert sorted(r["b"] for r in two.collect()) == ["x\ny", "z"]


def test_fixed_width_rows_like_the_header_stay(spark, tmp_path):
    df = readers.read_fixed_width(spark, put(tmp_path, "f.txt", "name  size\nab    1   \nname  size\ncd    2   \n"))
    assert df.columns == ["name", "size"] and sorted(r["name"] for r in df.collect()) == ["ab", "cd", "name"]


def test_result_tables_and_reports(spark, tmp_path):
    from lumen.plans.cleaning import Decision, Evidence, Result
    from lumen.plans.insights import Insight
    from lumen.plans.ml import Outcome
    from lumen.plans.profile import profile
    from lumen.sources import results

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i long, s string")
    d = [Decision(Evidence("missing", "s", "missing_values", 1, 0.5), "flag")] * 2
    clean = Result(df, "FLAGGED", d, [], ["w"], {"rows": 2}, {"rows": 2})
    model = Outcome("trained", "ridge", "regression", {"r2": 0.5}, [("i", 0.7)])
    found = [Insight("correlation", "i", "x rises with i", 0.5, 0.5, 0.01, 20, 0.8)]
    c = sinks.Catalog(spark, f"file://{tmp_path}/cat")
    names = results.save_analysis(c, "one", profile(df), {"rows": df}, found, [clean, clean], model)
    assert names == ["actions", "importance", "insights", "metrics", "model", "profiles", "rows"]
    assert c.load("one", "actions").count() == 1 and c.load("one", "insights").first()["confidence_label"] == "high" and c.states()["one"]["state"] == "completed"
    text = "# T\n\n" + results.as_markdown(df) + "\n" + results.insights_section(found) + "\n" + results.model_section(model) + "\n" + results.cleaning_section(clean)
    page = results.as_html(text, "T")
    assert "<h1>T</h1>" in page and page.count("<table>") == 3 and "<li>" in page and "<b>correlation</b>" in page
    results.save_report(spark, f"file://{tmp_path}/report", text)
    assert spark.read.text(f"file://{tmp_path}/report/html", wholetext=True).count() == 1


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("windows-1252", "Crème brûlée à la façon d’été, naïve et déjà vue"),
        ("windows-1251", "Съешь же ещё этих мягких французских булок, да выпей чаю"),
        ("koi8-r", "Съешь же ещё этих мягких французских булок, да выпей чаю"),
        ("windows-1256", "مرحبا بالعالم هذا نص عربي قصير للاختبار"),
        ("windows-1253", "Καλημέρα κόσμε, αυτό είναι ένα μικρό κείμενο"),
        ("windows-1255", "שלום עולם זה טקסט קצר בעברית"),
        ("gb18030", "你好世界,这是一段用来测试的中文文本"),
        ("shift_jis", "こんにちは世界、これはテスト用の短い文章です"),
        ("euc-kr", "안녕하세요 세계 이것은 짧은 시험 문장입니다"),
    ],
)
def test_code_pages_are_told_and_read_back(spark, tmp_path, name, text):
    text = text.replace(",", " ")
    raw = ("id,text\n" + "".join(f'{i},"{text} {i}"\n' for i in range(40))).encode(name)
    assert readers.encoding_of(raw) == name
    assert sorted((r["id"], r["text"]) for r in readers.read_csv(spark, put(tmp_path, "x.csv", raw)).collect()) == [(i, f"{text} {i}") for i in range(40)]
