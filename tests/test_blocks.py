"""Records cut by many tasks against single-threaded readers."""

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabloom.session import shared_dir
from tabloom.sources import blocks
from tabloom.sources.examples import array_lines, read_examples
from tabloom.sources.tables import read_table, scan_health
from workload import files


def state_by_character(text, state):
    """The state after a line, one character at a time: outside, or inside a quoted cell."""
    at_start, i = state == blocks.OUTSIDE, 0
    while i < len(text):
        c = text[i]
        if state == blocks.INSIDE:
            if c == '"' and text[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                state, at_start = blocks.OUTSIDE, False
        elif c == '"' and at_start:
            state = blocks.INSIDE
        else:
            at_start = c == ","
        i += 1
    return state


@pytest.mark.parametrize("seed", range(4))
def test_csv_step_equals_a_walk_over_characters(seed):
    draw = random.Random(seed)
    for _ in range(5_000):
        line = "".join(draw.choices('a",', weights=[2, 3, 2], k=draw.randint(0, 9)))
        for state in (blocks.OUTSIDE, blocks.INSIDE):
            assert blocks.csv_step(line.encode(), state) == (state_by_character(line, state), 0), (line, state)


@pytest.mark.parametrize("seed", range(4))
def test_json_step_follows_strings_and_brackets(seed):
    draw = random.Random(seed)
    for _ in range(2_000):
        def value(depth):
            kind = draw.choice("sdan" if depth else "da")
            if kind == "s":
                return "".join(draw.choices('ab"\\{}[],é\n', k=draw.randint(0, 8)))
            if kind == "n":
                return draw.randint(0, 9)
            if kind == "a":
                return [value(depth + 1) for _ in range(draw.randint(0, 3))] if depth < 4 else 1
            return {f"k{i}}}": value(depth + 1) for i in range(draw.randint(0, 3))} if depth < 4 else 2

        text = json.dumps(value(0), ensure_ascii=False)
        state, nesting = blocks.OUTSIDE, 0
        pieces = text.encode().split(b"}")
        for piece in pieces:
            state, change = blocks.json_step(piece, state)
            nesting += change
        # The last piece ends at the end of the text, not at a brace.
        assert (state, nesting) == (blocks.OUTSIDE, -1), text


def csv_rows(seed, n):
    draw = random.Random(seed)
    cells = ["plain", "two words", 'say "hi"', "a,b", "line\nbreak", "\n", "\n\n\nmany\n\n", '"', '""', ',"', '",\n"', "ü 中", "x" * 150, "crlf\r\ninside", "-1", "NA"]
    return [[str(i), draw.choice(cells), draw.choice(cells)] for i in range(n)]


@pytest.mark.parametrize("seed, block, end", [(0, 130, "\n"), (1, 97, "\r\n"), (2, 1_000, "\n"), (4, None, "\r\n")])
def test_csv_equals_a_single_reader(spark, tmp_path, seed, block, end):
    rows = csv_rows(seed, 40)
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL if seed % 2 else csv.QUOTE_ALL).writerows([["key", "one, two", 'the "x"'], *rows])
    path = tmp_path / "t.csv"
    path.write_bytes(out.getvalue().encode())
    df = read_table(spark, str(path), na_tokens=(), block_bytes=block)
    assert df.columns == ["key", "one, two", 'the "x"']
    assert [[str(r[0]), r[1], r[2]] for r in df.orderBy("key").collect()] == rows
    health = scan_health(spark, str(path), block_bytes=block).first()
    assert (health["ok"], health["n_rows"], health["n_corrupt"], health["n_columns"]) == (True, 40, 0, 3)


def test_no_task_reads_a_whole_csv_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(2_000)))
    df = read_table(spark, str(path), block_bytes=1_000)
    assert df.count() == 2_000
    assert "scan csv" not in df._jdf.queryExecution().executedPlan().toString().lower()
    pieces = blocks._pieces(spark, str(path), blocks.CSV)
    reader = spark.newSession()
    reader.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    cut = blocks._pieces(reader, str(path), blocks.CSV)
    assert cut.select("start").distinct().count() >= 20
    assert cut.agg(F.count("*")).first() == pieces.agg(F.count("*")).first()


def test_several_files_blank_lines_and_unequal_rows(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text('\n\nk,v\n1,"a\n\nb"\n\n   \n2,c\n')
    (folder / "b.csv").write_text('k,v\n3,"open to the end\n')
    (folder / "c.csv").write_text("k,v\n")
    (folder / "d.csv").write_text('k,v\n4,d,too many\n5\n6,5" pipe\n7,x"y"z\n')
    for block in (None, 8):
        df = read_table(spark, str(folder), block_bytes=block)
        got = {r["k"]: r["v"] for r in df.collect()}
        assert {k: got[k] for k in (1, 2, 6, 7)} == {1: "a\n\nb", 2: "c", 6: '5" pipe', 7: 'x"y"z'}
        assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and "open to the end" in got[3]
        assert scan_health(spark, str(folder), block_bytes=block).first()["n_corrupt"] == 2


def test_bare_carriage_returns_go_to_one_task(spark, tmp_path):
    path = tmp_path / "mac.csv"
    path.write_bytes(b"a,b\r1,x\r2,y\r")
    assert sorted(tuple(r) for r in read_table(spark, str(path)).collect()) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("seed, block, indent", [(0, 120, None), (1, 300, 2), (3, None, 4)])
def test_json_arrays_equal_a_single_reader(spark, tmp_path, seed, block, indent):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices('ab}{][",\\\n\té中', k=draw.randint(0, 40)))
    rows = [{"instruction": text(), "input": text(), "output": f"{i}"} for i in range(30)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2)))
    got = read_examples(spark, str(path), block_bytes=block).collect()
    assert sorted((r.asDict() for r in got), key=lambda r: int(r["output"])) == rows


def test_empty_and_damaged_arrays(spark, tmp_path):
    for i, text in enumerate(["", "[]", "[\n]\n", "[ ]"]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert read_examples(spark, str(path)).collect() == []
    path = tmp_path / "damaged.json"
    path.write_text('[{"instruction": "a", "input": "b", "output": "c"}, {"x": 1}, {"instruction": "d", "inp')
    got = sorted((tuple(r) for r in read_examples(spark, str(path)).collect()), key=str)
    assert got[0] == ("a", "b", "c") and len(got) == 3


def test_extra_fields_and_nested_values(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text(json.dumps([{"instruction": "i", "input": "x", "output": str(i), "meta": {"a": [{"b": {}}], "c": "}"}} for i in range(9)]))
    got = read_examples(spark, str(path), block_bytes=50).collect()
    assert sorted(r["output"] for r in got) == [str(i) for i in range(9)]


def test_array_is_written_without_holding_it(spark, tmp_path):
    records = spark.range(0, 25_000, 1, 4).selectExpr("to_json(struct(string(id) AS input, 'x' AS output)) AS r")
    lines = array_lines(records)
    shown = lines._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in shown and "Exchange" not in shown
    lines.write.text(str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    assert sorted(int(r["input"]) for r in json.loads(file.read_text())) == list(range(25_000))
    assert read_examples(spark, str(tmp_path / "a"), block_bytes=40_000).count() == 25_000
    array_lines(records.filter("r = ''")).write.text(str(tmp_path / "none"))
    assert "".join(f.read_text() for f in (tmp_path / "none").glob("part-*")).split() == ["[", "]"]


def test_examples_array_is_one_whole_array_whatever_the_keys(spark, tmp_path):
    """Null keys came before the opening bracket, and of several rows with the smallest key none had a comma."""
    rows = [(k, 7, status, 1.5, "5-LOW") for k in (None, 3, 3, 3, 9) for status in "OPF"]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    before = set(Path(shared_dir(spark)).glob("examples_array-*"))
    got = sorted(r["output"] for r in files.examples_array(spark, str(tmp_path)).collect())
    (written,) = set(Path(shared_dir(spark)).glob("examples_array-*")) - before
    (file,) = written.glob("part-*")
    array = json.loads(file.read_text())
    assert got == sorted(r["output"] for r in array) == ["Filled"] * 5 + ["Open"] * 5 + ["Partly Open"] * 5
