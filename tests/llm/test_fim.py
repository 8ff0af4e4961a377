"""Fill-in-the-middle against slices of Python strings."""

import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import fim


def plain_way(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    draw = random.Random(5)
    shared = "".join(draw.choices("aé中😀 \n<PSM>", k=9_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
    made = [None, "", "x", "é", "😀", "<P>", "a<S>b", "<M", "<<P", "a" * 70_000, "中" * 50_000, shared, "head " + shared + " tail", shared + shared[:4_001]]
    made += ["".join(draw.choices("abc é中😀<SPM>", k=draw.randint(1, 3_000))) for _ in range(60)]
    return list(enumerate(made)) + [(None, "no id"), (7, "again"), (7, "again"), (-5, "negative")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report_equals_slices(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, form string")
    got = sorted(tuple(r) for r in fim.fim_report(docs).collect() if r["doc_id"] is not None)
    want = [(i, n, form, a, m, sha(out), sha(t or "")) for i, t in rows if i is not None for n, form, a, m, out in [plain_way(i, t)]]
    assert [repr(r) for r in got] == [repr(r) for r in sorted(want)]


def test_columns_and_round_trip(spark):
    rows = [(i, t, f"c{i}") for i, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_row` string").selectExpr("*", "1 AS fim_form", "2 AS `a.b`", "text AS _text")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "_row", "a.b", "_text", "fim_text", "fim_form"]
    for r in made.collect():
        assert (r["fim_form"], r["fim_text"]) == plain_way(r["doc_id"], r["text"])[1::3]
    back = fim.restore_texts(made.drop("text"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)


def test_empty_table_and_bad_bytes(spark):
    assert fim.fim_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    got = fim.fim_report(row).first()
    assert got["n"] == 3 and got["restored_sha256"] == sha("a�b")


def test_rolling_hash_sees_the_last_32_bytes():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    want = [sum(int(fim.GEAR[data[i - age]]) << age for age in range(min(32, i + 1))) % 2 ** 32 for i in range(len(data))]
    assert fim.rolling_hash(data).tolist() == want


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_shared_passages_share_chunks(monkeypatch, block):
    monkeypatch.setattr(fim, "HASH_BLOCK", block)
    draw = random.Random(6)
    passage = bytes(draw.choices(range(97, 123), k=40_000))
    heads = [bytes(draw.choices(range(97, 123), k=k)) for k in (0, 777, 3_001)]
    cut = []
    for head in heads:
        data = head + passage
        ends = fim.chunk_ends(data)
        assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:]))
        assert max(np.diff([0] + ends)) <= fim.MAX_CHUNK
        cut.append({data[a:b] for a, b in zip([0] + ends, ends)})
    shared = set.intersection(*cut)
    assert sum(map(len, shared)) > 30_000


def test_summaries_are_bounded_and_checked_by_content():
    memory = fim.Summaries(most_bytes=4_000)
    draw = random.Random(7)
    chunks = ["".join(draw.choices("aé中", k=100)).encode() for _ in range(200)]
    for chunk in chunks + chunks[-3:]:
        assert memory.count(chunk) == len(chunk.decode())
        assert sum(map(len, memory.known)) <= 2_000 and sum(map(len, memory.older)) <= 2_000
    assert memory.met >= 3


def test_chunks_may_split_characters():
    data = ("é中😀" * 3_000).encode()
    text = fim.Chunked(data, fim.Summaries())
    whole = data.decode()
    assert text.n == len(whole)
    for i in range(0, len(whole) + 1, 97):
        assert text.byte_of(i) == len(whole[:i].encode())
