import json

import pytest

import tabulens
from tabulens.functions.text import NA_TOKENS
from tabulens.sources import clean_table, report_document
from tabulens.sources.readers import sniff_delimiter


@pytest.fixture
def write(tmp_path):
    def put(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(text.encode(encoding))
        return str(path)

    return put


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, write, sep):
    lines = [["a", "b", "c"], ["1", "x", "2024-01-01"], ["2", "y", ""], ["3", "z", "2024-01-03"]]
    path = write("t.csv", "\n".join(sep.join(line) for line in lines) + "\n")
    assert sniff_delimiter(spark, path) == sep
    df = tabulens.read_table(spark, path)
    assert df.columns == ["a", "b", "c"] and df.count() == 3


def test_delimiter_must_be_even(spark, write):
    path = write("t.csv", "a;b\n1;2,5\n2;3\n")
    assert sniff_delimiter(spark, path) == ";"
    assert sniff_delimiter(spark, write("u.csv", "word\nother\n")) == ","


def test_long_rows_are_skipped_and_short_ones_padded(spark, write):
    df = tabulens.read_table(spark, write("t.csv", 'a,b\n1,2\n1,2,3\n4\n"5,5","say ""x"""\n'), "csv")
    assert values(df) == [("1", "2"), ("4", None), ("5,5", 'say "x"')]


def test_missing_value_tokens(spark, write):
    lines = "\n".join(f"{i},{token},x" for i, token in enumerate(NA_TOKENS))
    df = tabulens.read_table(spark, write("t.csv", f"i,v,w\n{lines}\n99,na,x\n"))
    assert [r["v"] for r in df.collect()] == [None] * len(NA_TOKENS) + ["na"]


def test_names_and_index_columns(spark, write):
    text = "Unnamed: 0,index,  my   name ,x,x,\n0,0,a,1,2,\n1,1,b,3,4,\n"
    df = tabulens.read_table(spark, write("t.csv", text))
    assert df.columns == ["my name", "x", "x.1"]
    kept = tabulens.read_table(spark, write("u.csv", "index,v\n1,a\n0,b\n"))
    assert kept.columns == ["index", "v"]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None), (None, None, "x")], "a int, b string, c string")
    out = clean_table(df)
    assert out.columns == ["a", "c"] and values(out) == [(1, None), (None, "x")]


def test_only_three_hundred_columns(spark):
    df = spark.createDataFrame([tuple(range(310))], [f"c{i}" for i in range(310)])
    assert clean_table(df).columns == [f"c{i}" for i in range(300)]


def test_true_and_false_words(spark, write):
    df = tabulens.read_table(spark, write("t.csv", "a,b,c\nTrue,true,yes\nFalse,,no\n"))
    assert dict(df.dtypes) == {"a": "boolean", "b": "boolean", "c": "string"}


def test_encoding(spark, write):
    path = write("t.csv", "städt,b\nKöln,1\n", "latin-1")
    df = tabulens.read_csv(spark, path, encoding="ISO-8859-1")
    assert df.columns[0] == "städt" and values(df) == [("Köln", "1")]


RECORDS = [{"z": 1, "a": "x"}, {"z": 2, "a": None, "k": 5}]


@pytest.mark.parametrize(
    "text",
    [json.dumps(RECORDS), json.dumps(RECORDS, indent=2), "\n".join(map(json.dumps, RECORDS))]
    + [json.dumps({key: RECORDS, "n": 2}) for key in ("data", "results", "records", "rows", "items")]
    + [json.dumps({"z": [1, 2], "a": ["x", None], "k": [None, 5]})]
    + [json.dumps({"z": {"0": 1, "1": 2}, "a": {"0": "x"}, "k": {"1": 5}})],
)
def test_json_forms(spark, write, text):
    df = tabulens.read_table(spark, write("t.json", text))
    assert df.columns == ["z", "a", "k"]
    assert sorted(values(df)) == [(1, "x", None), (2, None, 5)]


NESTED = [{"a": i, "s": 'q"],{[ \\', "n": {"k": [[i], []], "m": [{"z": "}"}]}} for i in range(40)]


@pytest.mark.parametrize("split", [None, 64, 200])
@pytest.mark.parametrize(
    "form",
    ["lines", "array", "array of lines", "pretty array", "pretty objects", "one line", "arrays",
     "wrapper", "pretty wrapper", "late wrapper"],
)
def test_all_records_are_read(spark, write, form, split):
    """Whatever the layout and wherever files are cut into splits."""
    own = [json.dumps(r) for r in NESTED]
    text = {
        "lines": lambda: "\n".join(own),
        "array": lambda: json.dumps(NESTED),
        "array of lines": lambda: "[\n" + ",\n".join(own) + "\n]\n",
        "pretty array": lambda: json.dumps(NESTED, indent=1),
        "pretty objects": lambda: "\n".join(json.dumps(r, indent=2) for r in NESTED),
        "one line": lambda: " ".join(own[:39]) + "\n" + own[39],
        "arrays": lambda: "\n".join(json.dumps(NESTED[i : i + 8]) for i in range(0, 40, 8)),
        "wrapper": lambda: '{"n": [1], "records": [\n' + ",\n".join(own) + '], "rows": 1}',
        "pretty wrapper": lambda: json.dumps({"x": {"data": [1]}, "items": NESTED}, indent=1),
        "late wrapper": lambda: json.dumps({"rows": [{"a": 0}], "data": NESTED}, indent=1),
    }[form]()
    path = write("t.json", text)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        if split:
            spark.conf.set(key, str(split))
        df = tabulens.read_json(spark, path, clean=False)
        got = [json.loads(r[0]) for r in df.selectExpr("to_json(struct(*))").collect()]
    finally:
        spark.conf.set(key, before)
    assert df.columns == ["a", "s", "n"]
    assert sorted(got, key=lambda r: r["a"]) == NESTED


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "utf-8-sig", "latin-1", "cp1252"])
def test_records_in_other_encodings(spark, write, encoding):
    own = [{"a": i, "s": "Köln"} for i in range(20)]
    for text in ("\n".join(json.dumps(r, ensure_ascii=False) for r in own), json.dumps(own)):
        df = tabulens.read_json(spark, write("t.json", text, encoding), encoding)
        assert sorted(values(df)) == [(i, "Köln") for i in range(20)]


@pytest.mark.parametrize(
    "text",
    ["", " \n", "[1, 2", '{"a": 1}, {"a": 2}', '{"a": 1} 5', '{"a": 1}\n[{"a": 2}]', '{"a": 1}\n"x"',
     '[{"a": 1}]]', '{"a": [1}', '[{"a": 1}, [2]]', '{"a": "x\ny"}', "nan", '[{"a" 1}]',
     '{"a": 1}\n{"a": }'],
)
def test_text_that_is_not_json(spark, write, text):
    with pytest.raises(ValueError):
        tabulens.read_json(spark, write("t.json", text))


def test_scalars_in_an_array(spark, write):
    assert sorted(values(tabulens.read_json(spark, write("t.json", "[3, 1,\n2]")))) == [(1,), (2,), (3,)]
    df = tabulens.read_json(spark, write("u.json", '{"data": ["x", "y, z"]}'))
    assert df.columns == ["0"] and sorted(values(df)) == [("x",), ("y, z",)]


def test_flat_json_is_one_row(spark, write):
    assert values(tabulens.read_table(spark, write("t.json", '{"z": 1, "a": "q"}'))) == [(1, "q")]


@pytest.mark.parametrize("text", ["{nope", '{"a": [1, 2], "b": [1]}'])
def test_bad_json(spark, write, text):
    with pytest.raises(ValueError):
        tabulens.read_table(spark, write("t.json", text))


def test_unknown_kinds(spark, tmp_path):
    for name in ("t.xlsx", "t.parquet"):
        with pytest.raises(ValueError):
            tabulens.read_table(spark, str(tmp_path / name))


def test_report_is_written_with_finite_numbers(spark, tmp_path):
    df = spark.range(30).selectExpr(
        "id", "CASE WHEN id = 3 THEN double('NaN') ELSE id * 2.0 END AS v", "concat('g', id % 3) AS g"
    )
    report = tabulens.full_report(df, ["id"])
    document = json.loads(report_document(report).first()["document"])
    assert [r["column"] for r in document["profile"]] == ["id", "v", "g"]
    assert document["quality"][0]["total_missing_cells"] == 1
    tabulens.write_report(report, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "profile")).collect()]
    assert [r["column"] for r in lines] == ["id", "v", "g"] and lines[2]["mean"] is None
    assert len(list((tmp_path / "out" / "chart_data").iterdir())) == len(report.charts)


def test_blank_lines_are_no_records(spark, write):
    records = "\n".join(json.dumps({"a": i, "b": "x"}) for i in range(50))
    df = tabulens.read_json(spark, write("t.json", f"\n  \n{records}\n\n"))
    assert df.count() == 50 and df.columns == ["a", "b"]
    one = tabulens.read_json(spark, write("u.json", '\n{"a": 1}\n'))
    assert values(one) == [(1,)]
    with pytest.raises(ValueError):
        tabulens.read_json(spark, write("v.json", '{"a": 1}\nnot json\n'))


def test_quoted_breaks_belong_to_the_value(spark, write):
    path = write("t.csv", 'a,b\n1,"x\ny"\n2,z\n')
    with pytest.warns(UserWarning, match="read as a whole"):
        df = tabulens.read_csv(spark, path)
    assert values(df) == [("1", "x\ny"), ("2", "z")]


def test_a_quote_inside_a_field_is_text(spark, write, recwarn):
    path = write("t.csv", 'a,b\n5" pipe,x\n"6"" rod, long","y"\nz,"q"\n')
    df = tabulens.read_csv(spark, path)
    assert values(df) == [('5" pipe', "x"), ('6" rod, long', "y"), ("z", "q")]
    assert not [w for w in recwarn if "as a whole" in str(w.message)]


def test_other_encodings_are_asked_for(spark, write):
    path = write("t.csv", "name,v\ncafé,1\n", "latin-1")
    with pytest.raises(ValueError, match="latin-1"):
        tabulens.read_csv(spark, path)
    assert values(tabulens.read_csv(spark, path, encoding="latin-1")) == [("café", "1")]
    with pytest.raises(ValueError, match="UTF-8"):
        tabulens.read_json(spark, write("t.json", '{"name": "café"}', "latin-1"))


def test_names_that_look_like_an_index_stay(spark, write):
    df = tabulens.read_csv(spark, write("t.csv", "unnamed7,Unnamed: 3,v\n1,2,3\n"))
    assert df.columns == ["unnamed7", "v"]


def test_dropped_columns_are_named(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    with pytest.warns(UserWarning, match="dropped: c"):
        assert clean_table(df, max_columns=2).columns == ["a", "b"]
    assert clean_table(df, max_columns=None).columns == ["a", "b", "c"]


def test_large_frames_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from tabulens.sources import sinks

    frame = spark.range(1000).orderBy("id")
    sinks.write_frames({"one": frame}, str(tmp_path))
    monkeypatch.setattr(sinks, "ONE_FILE_ROWS", 100)
    sinks.write_frames({"many": frame.repartitionByRange(4, "id")}, str(tmp_path))
    parts = {n: len(list((tmp_path / n).glob("part-*"))) for n in ("one", "many")}
    assert parts["one"] == 1 and parts["many"] > 1
    assert [r.id for r in spark.read.json(str(tmp_path / "one")).collect()] == list(range(1000))
