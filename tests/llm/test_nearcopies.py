"""Near copies of the pipeline against a comparison of all pairs."""

import random

import corpus_pipeline
from tabloom.llm import nearcopies
from tests.llm import brute
from tests.llm.test_operators import ODD


def _texts():
    """Groups of near copies around the threshold, of which many differ in more than three bits of SimHash."""
    random.seed(5)
    texts, line = [], " ".join(f"common{i}" for i in range(30))
    for g in range(25):
        base = [f"w{random.randrange(3000)}" for _ in range(random.choice([4, 12, 60, 200]))]
        for _ in range(8 if g else 60):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 40))):
                words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(words) + (" " + line if g % 3 == 1 else ""))
    return texts


def test_components_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIRS_AT_ONCE", 50)
    texts = _texts()
    want = brute.components(range(len(texts)), brute.shingle_pairs(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_components(docs).collect()}
    assert got == want and 25 < len(set(want.values())) < len(texts)
    kept = nearcopies.near_dedup(docs).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


def test_stage_of_the_pipeline_is_simhash(spark):
    """What stays is one document of each component of fingerprints at three or fewer differing bits."""
    texts = [*_texts(), None, "", "  "]
    prints = [brute.simhash(t) for t in texts]
    want = brute.components(range(len(texts)), brute.near_pairs(prints))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert 25 < len(set(want.values())) < len(texts)


def test_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (8, "another text under the same id", "c", "x")], "doc_id long, text string, source string, kept string")
    kept = nearcopies.near_dedup(odd)
    assert kept.columns == odd.columns
    # 1, 4 and 5 are equal but for case; 2, 3 and 10 have no words; both rows of 8 stay with their component.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 7, 8, 8, 8, 9]))
    assert nearcopies.near_dedup(odd.limit(0)).count() == 0
