from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from qaprep.functions import prompts
from qaprep.operators import align, runs
from qaprep.sources import readers, writers

RAW = "query string, title string, abstract string, label string"


def _write(path, name, content):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(content, encoding="utf-8")
    return str(path / name)


def test_csv_round_trip_keeps_every_character(spark, tmp_path):
    rows = [
        (1, 'He said "no", twice', " lead and trail "),
        (2, "line\nbreak\r\nand \\ backslash", "a,b;c"),
        (3, '""', "ünï"),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_table_csv(spark, str(tmp_path / "out"), "id int, a string, b string")
    got = sorted(tuple(r) for r in back.collect())
    assert [(i, a.replace("\r\n", "\n"), b) for i, a, b in got] == [
        (i, a.replace("\r\n", "\n"), b) for i, a, b in rows
    ]


def test_csv_columns_are_checked_and_picked_by_header(spark, tmp_path):
    path = _write(tmp_path, "in.csv", 'label,query,extra\n"L, 1","Q ""x"""," e"\n')
    df = readers.read_table_csv(spark, path, RAW, ("query",))
    assert df.columns == ["label", "query"]
    assert tuple(df.first()) == ("L, 1", 'Q "x"')
    with pytest.raises(ValueError, match="title"):
        readers.read_table_csv(spark, path, RAW, ("title", "query"))


def test_files_are_chosen_by_name(spark, tmp_path):
    _write(tmp_path, "x_Abstract_1.CSV", "query\nyes\n")
    _write(tmp_path / "sub", "abstract-2.csv", "query\nalso\n")
    _write(tmp_path, "other.csv", "query\nno\n")
    glob = readers.name_glob("abstract", ".csv")
    df = readers.read_table_csv(spark, str(tmp_path), RAW, path_filter=glob)
    assert sorted(r[0] for r in df.collect()) == ["also", "yes"]


def test_with_defaults(spark):
    df = spark.createDataFrame([("a", None)], "run string, latency double")
    row = readers.with_defaults(df, {"run": "", "latency": 0.0, "rougeL": 0.5}).first()
    assert tuple(row) == ("a", 0.0, 0.5)


def test_read_lines(spark, tmp_path):
    path = _write(tmp_path, "in.txt", "  one \n\n \n\ttwo　\r\nthree")
    assert [r[0] for r in readers.read_lines(spark, path).collect()] == ["one", "two", "three"]


def test_summary_jsonl_takes_lists_and_missing_keys(spark, tmp_path):
    lines = [
        {"source": ["One.", "Two."], "target": "T"},
        {"source": "[not a list]"},
        {"target": ["A", "B"], "other": 1},
    ]
    path = _write(tmp_path, "in.jsonl", "\n".join(json.dumps(x) for x in lines))
    got = [tuple(r) for r in readers.read_summ_jsonl(spark, path).collect()]
    assert got == [("One. Two.", "T"), ("[not a list]", ""), ("", "A B")]


def test_presplit_files(spark, tmp_path):
    paths = {s: _write(tmp_path, f"{s}.csv", f"input_text\n{s} row\n") for s in ("train", "test")}
    df = readers.read_presplit(spark, paths, "input_text string")
    assert sorted(tuple(r) for r in df.collect()) == [("test row", "test"), ("train row", "train")]


def test_run_metrics(spark, tmp_path):
    _write(tmp_path / "a", "eval_metrics.json", json.dumps({"bleu": 0.5, "loss": 2}, indent=2))
    _write(tmp_path / "b", "other.json", "{}")
    dirs = [str(tmp_path / d) for d in ("a", "b", "c")]
    rows = {(r["run"][-1], r["metric"], r["value"]) for r in readers.read_run_metrics(spark, dirs).collect()}
    assert rows == {("a", "bleu", 0.5), ("a", "loss", 2.0), ("b", None, None), ("c", None, None)}
    assert readers.read_run_metrics(spark, dirs[1:]).count() == 2


@pytest.mark.parametrize("name", ["a b", "a+b", "a%20b", "a%b", "[a]", "{a,b}", "a*?", "é"])
def test_folders_of_any_name(spark, tmp_path, name):
    _write(tmp_path / name, "eval_metrics.json", json.dumps({"bleu": 0.5}))
    _write(tmp_path / "a  b" / "x", "eval_metrics.json", json.dumps({"bleu": 0.75}))
    dirs = [str(tmp_path / name), f"file:{tmp_path}/{name}/", str(tmp_path / "none")]
    found = sorted(map(tuple, readers.read_run_metrics(spark, dirs).collect()), key=str)
    assert found == sorted([(dirs[0], "bleu", 0.5), (dirs[1][:-1], "bleu", 0.5), (dirs[2], None, None)], key=str)
    lines = spark.read.option("recursiveFileLookup", True).text(str(tmp_path))
    assert readers.in_path(lines, f"/{name}/").count() == 1


def test_metrics_log_matches_by_name(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_metrics(spark.createDataFrame([("x", 1.0, 2.0)], "run string, bleu double, loss double"), path)
    writers.append_metrics(spark.createDataFrame([("y", 3.0, 4.0)], "run string, loss double, bleu double"), path)
    table = runs.compare_runs(writers.read_metrics_log(spark, path)).orderBy("run")
    assert [r.asDict() for r in table.collect()] == [
        {"run": "x", "bleu": 1.0, "loss": 2.0},
        {"run": "y", "bleu": 4.0, "loss": 3.0},
    ]


def test_other_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, 'b"\n', "test")], "id int, t string, split string")
    writers.write_jsonl(df, str(tmp_path / "j"), "split")
    writers.write_parquet(df, str(tmp_path / "p"), ["split"])
    writers.write_metrics(df, str(tmp_path / "m"))
    expected = sorted(tuple(r) for r in df.collect())
    for back in (
        spark.read.schema(df.schema).json(str(tmp_path / "j")),
        spark.read.parquet(str(tmp_path / "p")),
        spark.read.schema(df.schema).json(str(tmp_path / "m")),
    ):
        assert sorted(tuple(r) for r in back.select("id", "t", "split").collect()) == expected


def test_load_pairs(spark):
    raw = spark.createDataFrame([("Q", None, " A  b ", "L ")], RAW)
    row = readers.load_pairs(raw, ["query", "title", "abstract"], "label").first()
    assert tuple(row) == ("Question: Q Context: A b", "L")
    ready = raw.selectExpr("query AS input_text", "label AS target_text", "title")
    assert readers.load_pairs(ready, ["nope"], "nope").columns == ["input_text", "target_text"]
    with pytest.raises(ValueError, match="nope"):
        readers.load_pairs(raw, ["query", "nope"], "label")


def test_prompts(spark):
    df = spark.createDataFrame(
        [("What's up?", "", "It is. So", "src", "ctx!", "tgt")],
        "query string, title string, abstract string, source string, context string, target_text string",
    )
    expected = {
        "answer": prompts.ANSWER_INSTRUCTION + " Question: What's up? Abstract: It is. So",
        "columns": "Question: What's up? Context: It is. So",
        "capitalized": "Query: What's up? Title:  Abstract: It is. So",
        "inference": "Question: whats up Context: ctx",
        "training": "Question: Whats up Context: Abstract: It is So",
        "summary": "Instruction: Summarize the abstract in 1-2 sentences. Abstract: src",
        "paraphrase": "Paraphrase: tgt",
    }
    for template, text in expected.items():
        assert prompts.render(df, template).first()["input_text"] == text
    with pytest.raises(ValueError):
        prompts.render(df, "poem")


def test_column_prompt_skips_columns_the_table_lacks(spark):
    df = spark.createDataFrame([("Q", "T")], "query string, title string")
    text = df.select(prompts.column_prompt(df, ("query", "abstract", "title")))
    assert text.first()[0] == "Question: Q Title: T"
    assert df.select(F.lit(1)).first()[0] == 1


def test_lines_keep_their_position_over_files_and_parts(spark, tmp_path):
    """Several files, each cut into many parts, with blank lines and no last line break."""
    wanted = []
    for name in ("a", "b", "c", "d"):
        lines = [f"{name}{i} " + "x" * (i % 50) for i in range(400 if name == "b" else 90)]
        wanted += [x.strip() for x in lines]
        (tmp_path / f"{name}.txt").write_text("\n \n".join(lines) + ("\n" if name < "c" else ""))
    (tmp_path / "c0.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        numbered = readers.read_numbered_lines(spark, str(tmp_path))
        got = sorted((r.position, r.input) for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(wanted))
    shorter = numbered.filter("position < 7").withColumn("input", F.upper("input"))
    zipped = align.zip_by_position(numbered, shorter, ("one", "two")).collect()
    assert sorted(tuple(r) for r in zipped) == [(i, x, x.upper()) for i, x in enumerate(wanted[:7])]


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    part = lambda *rows: spark.createDataFrame(list(rows), "run string, bleu double")
    read = lambda: sorted(tuple(r) for r in writers.read_metrics_log(spark, path).collect())
    writers.append_metrics(part(("x", 1.0)), path)
    writers.append_metrics(part(("y", 2.0)), path, "eval/7 %+")
    once = read()
    writers.append_metrics(part(("y", 2.0)), path, "eval/7 %+")
    assert read() == once == [("x", "bleu", 1.0), ("y", "bleu", 2.0)]
    writers.append_metrics(part(("y", 3.0)), path, "eval/7 %+")
    writers.append_metrics(part(("z", 4.0)), path, "other")
    assert read() == [("x", "bleu", 1.0), ("y", "bleu", 3.0), ("z", "bleu", 4.0)]


@pytest.fixture
def small_parts(spark):
    """Files are cut into parts of a few hundred bytes, several parts a task."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


QUOTED = "id int, query string, label string"


def _quoted_rows(n):
    odd = ['plain', 'two\nlines', 'a "quoted" word', '"\n"', ',\n,', 'x' * 700 + '\n' + 'y' * 700, 'é ß', None]
    return [(i, odd[i % 8], odd[(i // 8 + i) % 8]) for i in range(n)]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("broadcast_parts", [0, 1000])
def test_csv_is_split_inside_quotes(spark, tmp_path, small_parts, ends, broadcast_parts, monkeypatch):
    import csv
    import functools

    path = tmp_path / "in"
    path.mkdir()
    for f in range(2):
        with open(path / f"{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=ends)
            writer.writerows([("id", "query", "label"), *_quoted_rows(150), ()])
    split = functools.partial(readers.read_quoted_csv, broadcast_parts=broadcast_parts)
    monkeypatch.setattr(readers, "read_quoted_csv", split)
    one_task = readers.read_table_csv(spark, str(path), QUOTED)
    many = readers.read_table_csv(spark, str(path), QUOTED, split=True)
    assert many.schema == one_task.schema
    if broadcast_parts:  # else small parts are shuffled into few
        assert many.rdd.getNumPartitions() > 20
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one_task.collect()))
    assert many.count() == 300


def test_split_csv_checks_the_header_of_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,query\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('query,id\n"x\ny",1\n')
    with pytest.raises(Exception, match="header of"):
        readers.read_table_csv(spark, str(tmp_path), "id int, query string", split=True).collect()


def test_split_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,query\n")
    assert readers.read_table_csv(spark, str(tmp_path), "id int, query string", split=True).count() == 0
