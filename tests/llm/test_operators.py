"""The ten operators against row-by-row versions, and their edge cases."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import bpe, embeddings, exact, mixing, quality, simhash, surrogates, tokencount, toxicity, trie, warc
from tabloom.llm.components import components
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    (1, "Alpha beta gamma delta", "a", "x"), (2, None, None, None), (3, "", "a", "y"), (4, "alpha beta gamma delta", "b", "x"),
    (5, "Alpha beta gamma delta", "b", "x"), (None, "Alpha beta gamma delta", "a", None), (7, "w " * 40_000, "a", "z"),
    (8, "one", "c", "x"), (8, "one", "c", "x"), (9, "ünïcode 日本語 🙂 text", None, "q"), (10, "  \n ", "c", "q"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and a column with a clashing name."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, kept string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_exact_groups(odd):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    groups = collections.defaultdict(list)
    for i, t, *_ in ODD:
        groups[t or ""].append(i)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        found = [r for r in rows if r["text_sha256"] == sha]
        assert sorted(str(r["doc_id"]) for r in found) == sorted(map(str, ids))
        assert {r["keep_id"] for r in found} == {max((i for i in ids if i is not None), default=None)}
        assert {r["group_size"] for r in found} == {len(ids)} and sum(r["kept"] for r in found) == 1


@pytest.mark.parametrize("options", [{}, {"max_bits": 1}])
def test_exact_dedup_keeps_columns(odd, options):
    kept = exact.exact_dedup(odd, **options)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [3, 4, 5, 7, 8, 9, 10]))


def test_simhash(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    prints = {i: brute.simhash(t) for i, t, *_ in ODD if i is not None}
    ids = sorted(prints)
    roots = brute.components(ids, [(ids[a], ids[b]) for a, b in brute.near_pairs([prints[i] for i in ids])])
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == roots[r["doc_id"]]
    assert simhash.simhash_dedup(odd).columns == odd.columns


@pytest.mark.parametrize("hot", [65_536, 5])
def test_trie_join_loses_no_link(spark, hot):
    random.seed(1)
    values = set()
    for _ in range(20):
        base = random.getrandbits(64)
        for _ in range(40):
            value = base
            for _ in range(random.randint(0, 6)):
                value ^= 1 << random.randrange(64)
            values.add(value)
    values = sorted(values)
    want = brute.components(range(len(values)), brute.near_pairs(values))
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long, node long"), hot=hot)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got.get(i, i) == root for i, root in want.items())


def test_trie_prunes_dense_balls():
    base = 0x0123456789ABCDEF
    ball = sorted({base} | {base ^ 1 << a ^ 1 << b for a in range(48) for b in range(48)})
    values = np.array(ball, np.uint64)
    n = len(values)
    labels = trie.link(values, [np.array([0]), np.array([n]), np.array([0]), np.array([n])], 0, 3)
    assert set(labels) == {0}


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    assert {r["root"] for r in components(path).collect()} == {0}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    rows = np.repeat(base, 10, 0) + rng.normal(size=(200, 16)) * rng.choice([0.05, 0.2, 0.35], 200)[:, None]
    rows[::9] = rows[5]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    unit = embeddings.unit(np.array([v for _, v in data]))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    roots = brute.components(range(200), zip(*np.nonzero(near)))
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (None, data[0][1])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    found = embeddings.near_components(df, block=32).collect()
    assert len(found) == 207
    for r in found:
        i = r["vec_id"]
        if i is not None and i < 900:
            assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), roots[i], roots[i] == i)
        else:
            assert r["n_links"] == 0 and r["component_id"] == i
    assert embeddings.near_components(df.limit(0)).count() == 0


def test_bpe_equals_the_library(odd):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    random.seed(3)
    texts = [t or "" for _, t, *_ in ODD] + ["a" * 3000, " " * 99, "don't we'll"]
    texts += ["".join(random.choice("abcdethe ñéßαβ語0!-'") for _ in range(200)) for _ in range(50)]
    texts += ["".join(encoding.decode([random.randrange(50_000)]) for _ in range(40)) for _ in range(50)]
    coder, tight = bpe.codec(PATH, public_tokenizers.PATTERN), bpe.Codec(PATH, public_tokenizers.PATTERN)
    tight.machine.max_states = 50
    for text in texts:
        ids = encoding.encode_ordinary(text)
        assert coder.ids(text) == ids and tight.ids(text) == ids
        assert "".join(coder.decode([[i] for i in ids])) == text
    row = bpe.roundtrip(odd, PATH, public_tokenizers.PATTERN).filter("doc_id = 9").first()
    ids = encoding.encode_ordinary(ODD[9][1])
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(ODD[9][1].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN).drop("text"), PATH, public_tokenizers.PATTERN)
    assert {r["text"] for r in back.collect()} == {t or "" for _, t, *_ in ODD}


def test_utf8_stream():
    stream, data = bpe.Utf8Stream(), "aé語🙂".encode()
    assert "".join(stream.feed(data[i:i + 1]) for i in range(len(data))) + stream.end() == "aé語🙂"
    broken = bpe.Utf8Stream()
    broken.feed(b"\xe8\xaa")
    with pytest.raises(UnicodeDecodeError):
        broken.end()


def test_quality_on_held_out_documents(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_toxicity_on_held_out_documents(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def test_classifiers_on_odd_rows(odd, labels):
    for scored in (quality.score_quality(odd, labels), toxicity.score_toxicity(odd, labels)):
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == len(ODD)
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == len(ODD)


def test_matcher_and_context():
    model = toxicity.Model(["scoundrel", "knave"], [3.0, 3.0], [2, 1])
    scorer = toxicity.Scorer(model)
    assert scorer.matcher.match("scoundrle") == ((0, 2),) and scorer.matcher.match("knav") == ((1, 1),)
    assert scorer.matcher.match("scandal") == () and scorer.matcher.match("knave") == ((1, 0),)
    assert [h[3] for h in scorer.evidence(b'you knave! then "the knave" left')[0]] == [False, True]
    assert scorer.evidence(b"they called him a knave")[0][0][3]


def test_surrogates(spark):
    key = b"k"
    assert sorted(surrogates.exchanged(key, "t", v, 500) for v in range(500)) == list(range(500))
    assert all(surrogates.exchanged(key, "t", v, 500) != v for v in range(500))
    phones = {surrogates.bare("phone", surrogates.surrogate(key, "phone", f"+1 (017) 555-{n:04d}")) for n in range(300)}
    assert len(phones) == 300
    one, two = surrogates.surrogate(key, "card", "4929 3483 8514 6306"), surrogates.surrogate(key, "card", "4929348385146306")
    assert one.replace(" ", "") == two
    rows = [(1, 'Mrs. Anna Stone mailed a.b@c.example.com, token = "f3ef4d6b2755a36d7d9c"', "x"), (2, None, "y"), (3, "", "z"), (4, "clean 4.0.", "w")]
    rows += [(10 + i, f"Mr. N{chr(97 + i // 26)}{chr(97 + i % 26)} left", "v") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in surrogates.replace_report(df, key=key).collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "clean 4.0." and got[1]["n_entities"] == 4
    assert not any(x in got[1]["text"] for x in ("Anna", "Stone", "a.b@", "f3ef"))
    assert len({got[10 + i]["text"] for i in range(80)}) == 80
    assert surrogates.replace(df, key=key).columns == df.columns and surrogates.shared_surrogates(df, key=key).isEmpty()


def test_warc(spark):
    rows = [(i, f"http://x/{i} y", ("<p>é%d</p>" % (i % 3)) * n) for i, n in enumerate([0, 1, 1, 200_000, 1, 1, 0, 9])] + [(None, None, None), (4, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_and_read(pages).collect()), key=str)
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        origin = first[html or ""]
        revisit = i != origin
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", origin if revisit else None))
    assert got == sorted(want, key=str)


def test_warc_payload_comes_back_in_chunks(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab\r\n" * 700_000)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w")
    chunks = warc.read_archives(archives, 1 << 16, payload=True).orderBy("chunk").collect()
    assert len(chunks) == -(-2_800_000 // (1 << 16)) and b"".join(bytes(c["data"]) for c in chunks).decode() == "ab\r\n" * 700_000


def test_mix(odd):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, mixing.plan_mix(odd.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(odd).columns == odd.columns and mixing.plan_mix(odd.limit(0)).count() == 0


def test_mix_takes_empty_documents_by_rank(spark):
    rows = [(i, "word", "ab"[i % 2]) for i in range(2_000)] + [(10_000 + i, "", "ab"[i % 2]) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = collections.Counter((r["source"], r["text"]) for r in mixing.mix(docs).collect())
    # Of 2,000 words source a gets 5 / 7: each document once and 0.43 of them twice; b gets 2 / 7, 0.57 of its documents.
    assert taken["b", "word"] == 571 and abs(taken["b", ""] - 286) < 50
    assert taken["a", "word"] == 1429 and abs(taken["a", ""] - 714) < 50


def test_mix_with_unequal_inclusion(spark):
    rows = [(i, "word", "ab"[i % 2], 0.871 if i % 4 < 2 else 0.271) for i in range(8_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, p double")
    plan = mixing.plan_mix(docs, expected=F.when(F.col("source") == "b", F.col("p")))
    assert plan.columns == ["doc_id", "size", "source_size", "target", "taken"]
    taken = {r["doc_id"]: r["taken"] for r in plan.collect()}
    shares = collections.Counter()
    for i, _, source, p in rows:
        shares[source, p] += taken[i]
    # 2 / 7 of 8,000 words is 2,286 of the 4,000 of source b: 0.571, the mean of the two.
    assert shares["b", 0.871] + shares["b", 0.271] == 2286
    assert abs(shares["b", 0.871] / 2_000 - 0.871) < 0.03 and abs(shares["b", 0.271] / 2_000 - 0.271) < 0.03


def test_mix_refines_buckets(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, mixing.plan_mix(docs).collect()))
    monkeypatch.setattr(mixing, "RESOLVE_ROWS", 0)
    assert sorted(map(tuple, mixing.plan_mix(docs).collect())) == want


def test_separator_scan(spark, tmp_path, odd):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 3000).astype("<u2")
    ids[ids == 2] = tokencount.END_OF_DOCUMENT
    ids[1000:2000] = 7
    ids.tofile(tmp_path / "a.tokens")
    table = spark.createDataFrame([(str(tmp_path / "a.tokens"), 6000, 2)], "file string, bytes bigint, width int")
    got = sorted((r["place"], r["n_tokens"]) for r in tokencount.count_tokens(table, block_bytes=64).filter("finished").collect())
    at = np.flatnonzero(ids == tokencount.END_OF_DOCUMENT)
    assert got == list(enumerate((np.diff(np.concatenate(([-1], at))) - 1).tolist()))
    counts = tokencount.document_tokens(odd, PATH, public_tokenizers.PATTERN)
    same = bpe.roundtrip(odd, PATH, public_tokenizers.PATTERN).select("doc_id", "n_tokens")
    assert sorted(map(str, counts.collect())) == sorted(map(str, same.collect()))


def test_empty_tables(odd, labels):
    none = odd.limit(0)
    for df in (exact.exact_groups(none), exact.exact_dedup(none), simhash.simhash_dedup(none), mixing.mix(none),
               bpe.roundtrip(none, PATH, public_tokenizers.PATTERN), quality.score_quality(none, labels),
               toxicity.drop_toxic(none, labels), surrogates.replace(none), tokencount.document_tokens(none, PATH, public_tokenizers.PATTERN)):
        assert df.count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, small)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        if name != "mix_sources":
            assert before * 0.5 < docs.count() <= before
    assert docs.count() > 0 and F is not None
