import json
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.labels import CHAIN_LIMIT, LabelFinder, extract_label
from tabloom.functions.notes import parse_overrides
from tabloom.functions.payload import extract_json_payload, is_one_json_object, parse_payload, repair_json, repair_text
from tabloom.functions.text import strip
from tabloom.operators.examples import token_count
from tabloom.spec import LabelMap


def one(spark, expr, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


FRUIT = LabelMap({"r": "Raw", "p": "Ripe", "o": "Overripe"}).labels


@pytest.mark.parametrize(
    "labels, text, expected",
    [
        (FRUIT, "Ripe", "Ripe"),
        (FRUIT, "OVERRIPE", "Overripe"),
        (FRUIT, "ripe: soft, sweet", "Ripe"),
        (FRUIT, "I would call it overripe", "Ripe"),
        (["Overripe", "Ripe"], "I would call it overripe", "Overripe"),
        (FRUIT, "Rawhide", "Raw"),
        (FRUIT, "half ripe, half raw", "Raw"),
        (["Ripe", "Overripe"], "overripe, mostly", "Overripe"),
        ([], " two words ", "two words"),
        (FRUIT, "", None),
        (FRUIT, " \u00a0\n ", None),
        (FRUIT, None, None),
        (FRUIT, "\t  raw \n", "Raw"),
        (FRUIT, " unknown ", "unknown"),
    ],
)
def test_extract_label(spark, labels, text, expected):
    assert one(spark, lambda c: extract_label(c, labels), text) == [expected]


def test_many_labels_follow_the_same_rules(spark):
    texts = ["open", "Partly open, yes", "it is filled", "", "x y", "The answer is Partly Open."]
    few = ["Open", "Partly Open", "Filled"]
    many = few + [f"zz{i}" for i in range(CHAIN_LIMIT)]
    assert one(spark, lambda c: extract_label(c, few), *texts) == one(spark, lambda c: extract_label(c, many), *texts)


def by_chain(text, labels):
    """Tier by tier, label by label."""
    low = text.strip().lower()
    for match in (str.__eq__, str.startswith, str.__contains__):
        for label in labels:
            if match(low, label.lower()):
                return label
    return None


@pytest.mark.parametrize("seed", range(5))
def test_one_pass_finds_what_the_tiers_find(seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choices("abAB é", k=draw.randint(seed % 2, n)))
    labels = [word(4) for _ in range(60)]
    finder = LabelFinder(labels)
    for _ in range(3_000):
        text = word(9).strip()
        assert finder.find(text.lower()) == by_chain(text, labels), (text, labels)
    assert LabelFinder([]).find("x") is None and LabelFinder([""]).find("x") == ""


def test_strip_follows_python(spark):
    texts = [" a ", "\x1c\x1fb\x85", "　c d ", "e", "", "\n\t"]
    assert one(spark, strip, *texts) == [t.strip() for t in texts]


def overrides(spark, text):
    rows = parse_overrides(spark.createDataFrame([(text,)], "note string"), "note").collect()
    return {r["key"]: r for r in rows}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("depth: 9", {"depth": "9"}),
        ("depth: 9, rounds: 4", {"depth": "9", "rounds": "4"}),
        ("depth: 9\nstep: 2.5e-3", {"depth": "9", "step": "2.5e-3"}),
        ("", {}),
        ("a remark that sets nothing", {}),
        ("a: 1, a: 2, b:", {"a": "2"}),
        ("url: http://x", {"url": "http://x"}),
    ],
)
def test_overrides(spark, text, expected):
    assert {k: r["value"] for k, r in overrides(spark, text).items()} == expected


@pytest.mark.parametrize(
    "text, kind, column, value",
    [
        ("17", "int", "int_value", 17),
        ("-7", "int", "int_value", -7),
        ("0.25", "float", "float_value", 0.25),
        ("7.5e-4", "float", "float_value", 7.5e-4),
        ("true", "bool", "bool_value", True),
        ("True", "bool", "bool_value", True),
        ("false", "bool", "bool_value", False),
        ("linear", "string", "value", "linear"),
        ("12a", "string", "value", "12a"),
        ("1e", "string", "value", "1e"),
    ],
)
def test_typed_values(spark, text, kind, column, value):
    row = overrides(spark, f"k: {text}")["k"]
    assert row["kind"] == kind and row[column] == value


BROKEN = [
    '{"list": ["p", "note": "fine"}',
    '{"steps": ["wash", "dry; fold", "why": "because"}',
    '{"outer": {"inner": 5}',
    '{"n": [4, 5,',
    '{"s": "open [ here", "t": [6',
    '{"q": ["r \\" [", "z": 7}',
    *['{' + ", ".join(f'"k{i}": ["v{i}"' for i in range(n)) + ', "last": 1}' for n in range(2, 9)],
    '{"list": ["p", "' + "long" * 100 + '": 1}',
    *['{"deep": ' + "[" * n + '1, 2, "key": {"x": 3}' for n in range(1, 9)],
    '{"a": [{"b": [[1, 2], [3, "c": 4}], "d": [5',
    '{"rows": [[{"v": [1, [2, 3, "w": "]"}, {"v": [[4]], "w": [',
]


@pytest.mark.parametrize("text", BROKEN)
def test_repair_makes_valid(text):
    assert isinstance(json.loads(repair_text(text)), dict)


@pytest.mark.parametrize("text", ['{"m": 3, "n": [7, 8]}', '{"say": "mind [the] {gap}"}'])
def test_repair_leaves_valid_text(text):
    assert repair_text(text) == text


def test_repair_values():
    assert json.loads(repair_text('{"n": [4, 5,')) == {"n": [4, 5]}
    assert json.loads(repair_text('{"outer": {"inner": 5}'))["outer"]["inner"] == 5
    assert json.loads(repair_text(BROKEN[8])) == {"k0": ["v0"], "k1": ["v1"], "k2": ["v2"], "k3": ["v3"], "last": 1}
    assert json.loads(repair_text('{"a": [[1, 2, "b": 3}')) == {"a": [[1, 2]], "b": 3}
    assert json.loads(repair_text('{"a": [{"b": [[1, 2], [3, "c": 4}], "d": [5')) == {"a": [{"b": [[1, 2], [3]], "c": 4}], "d": [5]}
    assert repair_text("no json") == "no json"


def test_repair_is_linear_in_depth():
    text = '{"k": ' * 3_000 + "[" * 3_000 + '1, "x": 2'
    assert repair_text(text).count("]") == 3_000


def test_repair_job_touches_broken_rows_only(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*BROKEN, '{"ok": 1}', None, "x"])], "i int, t string")
    found = {r["i"]: r for r in repair_json(rows, "t").collect()}
    assert all(not found[i]["was_valid"] and found[i]["is_valid"] for i in range(len(BROKEN)))
    assert found[len(BROKEN)]["was_valid"] and found[len(BROKEN)]["repaired"] == '{"ok": 1}'
    assert found[len(BROKEN) + 1]["repaired"] is None and not found[len(BROKEN) + 1]["is_valid"]
    assert found[len(BROKEN) + 2]["repaired"] == "x" and not found[len(BROKEN) + 2]["is_valid"]


def test_payload(spark):
    texts = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Sure: {"a": {"b": 2}} bye': '{"a": {"b": 2}}',
        "```\nplain\n```": "plain",
        "  nothing ": "nothing",
        "} {": "} {",
        '{"a": 1': '{"a": 1',
    }
    assert one(spark, extract_json_payload, *texts) == list(texts.values())


def test_one_object_only(spark):
    good = ['{"a": 1}', ' {"a": [1, {"b": "]"}]} ', "{}"]
    bad = ['{"a": 1} x', '{"a":1},{"b":2}', "[1]", "", "1", '{"a": 1', "{'a': 1}", None]
    assert one(spark, is_one_json_object, *good, *bad) == [True] * len(good) + [False] * len(bad)


def test_parse_keeps_a_preview(spark):
    rows = spark.createDataFrame([('{"k": 3}',), ("{" + "x" * 500,)], "t string")
    good, bad = sorted(parse_payload(rows, "t", "k bigint").collect(), key=lambda r: not r["ok"])
    assert good["parsed"]["k"] == 3 and good["preview"] is None
    assert bad["parsed"] is None and bad["preview"] == ("{" + "x" * 500)[:200]


def test_token_count(spark):
    texts = ["a b  c", " lead\ttab\nline ", "", "  ", "one two", None]
    assert one(spark, lambda c: token_count(c), *texts) == [len((t or "").split()) for t in texts]
