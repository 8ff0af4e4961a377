"""Quality rules by tokeniser fertility against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tabloom.llm import fertility

NAMES = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(inside))


def odd_texts():
    draw = random.Random(1)
    made = ["", " ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\r\nx\n x\nx", "é 中 😀 z\x1cq", "#*$% &|<> <>", "\x0b\x0c\t"]
    made += [" ".join(draw.choices(["a", "b", "c", "dé\n", "e|"], k=draw.randint(0, 200))) for _ in range(50)]
    return made


@pytest.fixture(scope="module")
def tools():
    return fertility.Vocabularies(*NAMES)


def measures(tools, text):
    """The three measures by one call of the libraries a word."""
    words = WORD.findall(text)
    ids = [i for w in words for i in tools.encoder.encode_ordinary(" " + w)]
    names = [p for w in words for p in tools.processor.encode(w, out_type=str)]
    n = len(ids)
    if not n:
        return 0, None, None, None
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    share = 1000 * sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p in names) // len(names)
    return n, 1000 * sum(map(len, words)) // n, share, entropy


def test_counts_and_measures_equal_plain_ones(tools):
    for text in odd_texts():
        got = fertility.measures_of(text.encode(), tools)
        n, per_token, share, entropy = measures(tools, text)
        assert got[:8] == (*counts(text), n, per_token, share), text
        assert got[8] == entropy or abs(got[8] - 1000 * entropy) <= 0.51
    assert fertility.measures_of("ᚠᚢᚦ".encode(), tools)[7] > 500


def test_what_is_remembered_does_not_matter(tools, monkeypatch):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abcdeé中", k=draw.randint(1, 90))) for _ in range(300)]
    texts = [draw.choice(["\n", " ", "\t "]).join(draw.choices(vocabulary, k=200)) for _ in range(20)]
    want = [fertility.measures_of(t.encode(), tools) for t in texts]
    monkeypatch.setattr(fertility, "KNOWN_BYTES", 20)
    small = fertility.Vocabularies(*NAMES, known_words=50)
    monkeypatch.setattr(fertility.word_blocks, "__defaults__", (64,))
    assert [fertility.measures_of(t.encode(), small) for t in texts] == want
    assert len(small.known) <= 50 + 40


def test_long_words_are_cut():
    assert "".join(fertility.pieces("x" * 1_001, 100)) == "x" * 1_001
    assert max(map(len, fertility.pieces("x" * 1_001, 100))) == 100


def prose(draw, n, words):
    return " ".join(draw.choices(words, k=n))


def corpus():
    """Usual texts of two languages, and others that are not like them; (id, text, lang, usual)."""
    draw = random.Random(3)
    en = [w for w in "the of and to in is that for it was on with as are this be by from have or one had not but what all were when your can said there each which do how their if will up other about out many then them these some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()]
    de = [w for w in "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte".split()]
    rows = []
    for i in range(600):
        words, lang = (en, "en") if i % 2 else (de, "de")
        rows.append((prose(draw, draw.randint(90, 115), words), lang, True))
    for i in range(12):
        letters = ["".join(draw.choices("bcdfghjklmnpqrstvwxz0123456789", k=draw.randint(3, 9))) for _ in range(100)]
        rows.append((" ".join(letters), "en", False))
        rows.append((" ".join(w + draw.choice(["***", "%%%", "###"]) for w in draw.choices(de, k=100)), "de", False))
    return [(i, text, lang, usual) for i, (text, lang, usual) in enumerate(rows)]


@pytest.fixture(scope="module")
def report(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    return rows, {r["doc_id"]: r for r in fertility.fertility_report(docs, *NAMES).collect()}


def test_unusual_texts_go_and_usual_ones_stay(report):
    rows, got = report
    assert len(got) == len(rows)
    for i, text, _, usual in rows:
        assert not got[i]["base_failed"]
        assert got[i]["kept"] == usual, (text[:80], got[i])


def test_bands_equal_plain_quartiles(spark, report):
    rows, got = report
    measured = spark.createDataFrame([(r["lang"], r["n_tokens"], r["chars_per_token"], r["fallback_share"], r["entropy"]) for r in got.values()],
                                     "lang string, n_tokens long, chars_per_token long, fallback_share long, entropy long")
    table = {(r["lang"], r["size"], r["measure"], r["level"]): (r["low"], r["high"]) for r in fertility.bands(measured, least_docs=20).collect()}
    distinct = {(r["lang"], int(math.log2(r["n_tokens"])), r["n_tokens"], r["chars_per_token"], r["fallback_share"], r["entropy"]) for r in got.values()}
    checked = 0
    for level, key in ((2, lambda d: (d[0], d[1])), (1, lambda d: (None, d[1])), (0, lambda d: (None, None))):
        for group in {key(d) for d in distinct}:
            mine = [d for d in distinct if key(d) == group]
            for place, measure in ((3, "chars_per_token"), (4, "fallback_share"), (5, "entropy")):
                values = sorted(d[place] for d in mine)
                if len(values) < 20:
                    assert (*group, measure, level) not in table
                    continue
                q1, q2, q3 = (values[math.ceil(q * len(values) / 4) - 1] for q in (1, 2, 3))
                floor = fertility.FLOORS[measure]
                want = q2 - 4.5 * max((q2 - q1) / 0.6745, floor), q2 + 4.5 * max((q3 - q2) / 0.6745, floor)
                assert table[(*group, measure, level)] == pytest.approx(want)
                checked += 1
    assert checked >= 9


def test_defined_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None), (2, "", "en"), (3, text, None), (3, text, None), (None, text, "xx"), (4, "a b c " * 40, "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, n_words int, `_row` int")
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["base_failed"], r["kept"]) for r in fertility.fertility_report(docs, *NAMES).collect())
    assert got == [(0, 60, False, True), (1, 0, True, False), (2, 0, True, False), (3, 60, False, True), (3, 60, False, True), (4, 120, True, False)]
    kept = fertility.keep_fertile(docs, *NAMES)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "None"]
    assert fertility.fertility_report(docs.limit(0), *NAMES).collect() == []
