import json

import pytest
from pyspark.errors import PySparkException

from tabloom.sources.examples import read_examples, read_predictions, write_examples
from tabloom.sources.stages import StageMismatch, manifests, read_stage, stage_runs, write_stage
from tabloom.sources.tables import read_table, scan_health, schema_alignment


def test_csv_types(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(
        'id,gap,price,flag,holes,day,text,big,odd\n'
        '1,7,1.5,True,true,2024-01-01,"a, b",12345678901,1d\n'
        '2,NA,2,False,,2024-01-02,N/A,5,2\n'
        '3,9,-3e2,true,false,2024-01-03,"say ""hi""",6,3\n'
    )
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "gap": "double", "price": "double", "flag": "boolean", "holes": "string",
        "day": "string", "text": "string", "big": "bigint", "odd": "string",
    }
    rows = df.orderBy("id").collect()
    assert [r["gap"] for r in rows] == [7.0, None, 9.0]
    assert [r["price"] for r in rows] == [1.5, 2.0, -300.0]
    assert [r["text"] for r in rows] == ["a, b", None, 'say "hi"']


def test_shape_of_a_sound_table(spark, tmp_path):
    path = tmp_path / "plants.csv"
    path.write_text("plot;no,height_cm,watered,flower\n" + "".join(f"p{i},{i * 1.5},{i % 3},{'none' if i % 4 else 'red'}\n" for i in range(17)))
    row = scan_health(spark, str(path)).first()
    assert (row["ok"], row["n_rows"], row["n_columns"], row["n_corrupt"]) == (True, 17, 4, 0)


@pytest.mark.parametrize("content", [b"", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR", b"\x07\x1b[31m,\x08\n1,2\n"])
def test_damaged_csv_is_reported(spark, tmp_path, content):
    path = tmp_path / "bad.csv"
    path.write_bytes(content)
    row = scan_health(spark, str(path)).first()
    assert not row["ok"] and "ERROR" in row["message"]


def test_missing_csv_is_reported(spark, tmp_path):
    assert not scan_health(spark, str(tmp_path / "none.csv")).first()["ok"]


def test_header_only_csv(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text("a,b\n")
    row = scan_health(spark, str(path)).first()
    assert row["ok"] and row["n_rows"] == 0 and "no rows" in row["message"]


def test_alignment(spark):
    left = spark.createDataFrame([(1, 2, 3)], "a int, b int, z int")
    right = spark.createDataFrame([(1, 2)], "a int, c int")
    assert [tuple(r) for r in schema_alignment(left, right).collect()] == [
        ("b", "missing in test"), ("z", "missing in test"), ("c", "missing in train"),
    ]
    assert schema_alignment(left, left).isEmpty()


def test_example_array_file(spark, tmp_path):
    path = tmp_path / "all.json"
    rows = [{"instruction": "i", "input": f"x: {i}", "output": "é"} for i in range(5)]
    path.write_text(json.dumps(rows, indent=2))
    assert sorted(r["input"] for r in read_examples(spark, str(path)).collect()) == [f"x: {i}" for i in range(5)]


def test_example_formats(spark, tmp_path):
    df = spark.createDataFrame([("i", "a", "b", "train"), ("i", "c", "d", "test")], "instruction string, input string, output string, split string")
    for fmt in ("json", "parquet"):
        out = str(tmp_path / fmt)
        write_examples(df, out, fmt, ["split"])
        back = read_examples(spark, f"{out}/split=test", fmt).collect()
        assert [r["input"] for r in back] == ["c"]
    with pytest.raises(ValueError):
        write_examples(df, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("text, rows", [('{"label": "A", "predict": "B"}\n{"label": "C"}\n', 2), ("", 0), ('\n\n{"predict": "x"}\n\n', 1)])
def test_prediction_lines(spark, tmp_path, text, rows):
    path = tmp_path / "p.jsonl"
    path.write_text(text)
    assert read_predictions(spark, str(path)).count() == rows


def test_prediction_field_names(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"prediction": "x", "ground_truth": "y"}\n{"predict": "p", "prediction": "q", "label": "l"}\n{}\n')
    assert {tuple(r) for r in read_predictions(spark, str(path), "s").collect()} == {("s", "y", "x"), ("s", "l", "p"), ("s", "", "")}


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('code,remark,ok\n11,"first\nsecond, still one cell",yes\n12,plain,no\n')
    rows = read_table(spark, str(path)).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [(11, "first\nsecond, still one cell", "yes"), (12, "plain", "no")]
    health = scan_health(spark, str(path)).first()
    assert (health["n_rows"], health["n_corrupt"]) == (2, 0)
    assert scan_health(spark, str(path), multi_line=False).first()["n_corrupt"] > 0


def test_damaged_prediction_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"label": "A", "predict": "B"}\n{"label": "C", "pre\n[1]\n{"label": "D"} x\n\n')
    with pytest.raises(PySparkException, match="damaged prediction line"):
        read_predictions(spark, str(path)).count()
    found = sorted(tuple(r) for r in read_predictions(spark, str(path), damaged="report").collect())
    assert found == [("", "", True)] * 3 + [("A", "B", False)]
    with pytest.raises(ValueError):
        read_predictions(spark, str(path), damaged="skip")


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(7)
    assert write_stage(df, root, "a", "examples").count() == 7
    write_stage(df.limit(2), root, "b", "examples")
    assert read_stage(spark, root, "a", "examples").count() == 7
    assert {tuple(r) for r in stage_runs(spark, root, "examples").collect()} == {("a", 7), ("b", 2)}
    with pytest.raises(FileNotFoundError):
        read_stage(spark, root, "c", "examples")


def test_a_killed_write_leaves_the_older_stage(spark, tmp_path):
    root = str(tmp_path)
    write_stage(spark.range(7), root, "a", "examples", {"seed": 1})
    late = spark.range(40).repartition(8).selectExpr("IF(id = 39, raise_error('lost'), id) AS id")
    with pytest.raises(PySparkException):
        write_stage(late, root, "a", "examples", {"seed": 2})
    assert read_stage(spark, root, "a", "examples", {"seed": 1}).count() == 7
    assert [r["version"] for r in manifests(spark, root, "examples").collect()] == [1]


def test_stages_of_other_parameters_are_refused(spark, tmp_path):
    root = str(tmp_path)
    write_stage(spark.range(3), root, "a", "split", {"ratio": 0.2, "seed": 42})
    write_stage(spark.range(5), root, "a", "split", {"ratio": 0.3, "seed": 42})
    assert read_stage(spark, root, "a", "split", {"seed": 42}).count() == 5
    with pytest.raises(StageMismatch, match="ratio: 0.3, not 0.2"):
        read_stage(spark, root, "a", "split", {"ratio": 0.2})
    rows = sorted((r["version"], r["n_rows"]) for r in manifests(spark, root, "split").collect())
    assert rows == [(1, 3), (2, 5)] and {tuple(r) for r in stage_runs(spark, root, "split").collect()} == {("a", 5)}
    assert manifests(spark, root, "none").isEmpty()
