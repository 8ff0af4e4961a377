"""Source divergence against plain loops over every term and pair."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import divergence

ONE = 10 ** 9


def brute(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) by plain loops."""
    groups, found, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        word, terms = "", []
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                if word:
                    terms.append(word)
                word = ""
            else:
                word += c.lower() if "A" <= c <= "Z" else c
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        all_counts = Counter()
        for s in sources:
            all_counts.update(found[lang, s])

        def price(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + ONE * (counts[t] + 1) // size for t in kept}

        p, q = price(found[lang, source]), price(all_counts)
        pairs = []
        for other in sources:
            if other != source:
                o = price(found[lang, other])
                pairs.append((other, sum((p[t] - o[t]) ** 2 // o[t] for t in kept)))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if found[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda i: (-i[1], i[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items[:limit], 1)]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term string, n long")
    return sorted(tuple(r) for r in divergence.source_audit(docs, **options).collect())


def corpus(n, seed):
    draw = random.Random(seed)
    words = ["The", "the", "a", "Straße", "straße", "ÉTÉ", "été", "x9y", "naïve", "中文", "w"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for _ in range(n):
        text = draw.choice([" ", "\n", "-", "7"]).join(draw.choices(words, k=draw.randint(0, 40)))
        rows.append((text, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "ü", "c", None]), "x", 1))
    return rows


def test_equals_loops(spark):
    rows = corpus(120, 1) + [(None, "en", "empty", "x", 1), ("", "xx", "one", "x", 1), ("only twice", "yy", "p", "x", 1), ("only twice", "yy", "q", "x", 1)]
    assert audited(spark, rows) == brute([r[:3] for r in rows])


def test_many_sources_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    draw = random.Random(2)
    rows = [(" ".join(draw.choices([f"t{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], k=60)), "en", f"s{i % 45}", "x", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term string, n long").repartition(5)
    kept = divergence.kept_terms(docs)
    groups = divergence.group_sizes(kept, block_rows=1)
    assert groups.first()["blocks"] > 3
    got = {(r["source"], r["item"]): r["value"] for r in divergence.pair_divergences(kept, groups).collect()}
    assert got == {(s, i): v for _, s, part, i, v, _ in brute([r[:3] for r in rows]) if part == "pair"}


def test_joint_tables_count_every_pair_of_levels():
    levels = np.random.default_rng(0).integers(0, 5, (300, 4))
    seen = Counter()
    for columns, others, product in divergence.joint_tables(levels, range(0, 2), range(1, 4)):
        for i, j in zip(*np.nonzero(product)):
            seen[columns[0][i], columns[1][i], others[0][j], others[1][j]] += int(product[i, j])
    want = Counter((a, x[a], b, x[b]) for x in levels.tolist() for a in range(0, 2) for b in range(1, 4))
    assert {tuple(int(v) for v in k): n for k, n in seen.items()} == dict(want)


def test_exact_beyond_doubles():
    counts = np.array([[10 ** 6, 0], [0, 3]])
    prices = np.array([[999_999_001, 2], [1000, 999_999_999]])
    p, q = prices[:, 0].tolist(), prices[:, 1].tolist()
    total = divergence.price_block(counts, prices)
    assert total[0, 1] == sum((a - b) ** 2 // b for a, b in zip(p, q))
    assert total[1, 0] == sum((b - a) ** 2 // a for a, b in zip(p, q))


def test_empty_table(spark):
    assert audited(spark, []) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    rows = corpus(60, 3) * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term string, n long").repartition(parts)
    assert sorted(tuple(r) for r in divergence.source_audit(docs, top_terms=3).collect()) == brute([r[:3] for r in rows], top=3)
