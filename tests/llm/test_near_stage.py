import random

import numpy as np

import corpus_pipeline as cp
from linkloom.llm import shingle_minhash, simhash_anchor


def five(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_removes_what_five_word_shingles_call_near(spark):
    """Copies with changed words against brute force over all pairs; copies of a copy make chains."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(20, 150))) for _ in range(40)]
    for _ in range(160):
        w = r.choice(texts).split()
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets, lab, far = [five(t) for t in texts], list(range(len(texts))), 0
    fps = [simhash_anchor.fingerprint_of(np.asarray(simhash_anchor.shingle_hashes(t), np.uint64), np.array([0]))[0] for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            near, bits = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8, np.bitwise_count(fps[i] ^ fps[j])
            far += near and bits > 3
            if near or bits <= 3:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    assert far > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in cp.near_duplicates(spark, docs, "").collect()} == set(lab)


def test_buckets_dealt_into_blocks_lose_no_link(spark, monkeypatch):
    """One seed, copies of copies: buckets with several classes, in blocks of few rows."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60))]
    for _ in range(150):
        w = r.choice(texts).split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(60)] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets, lab = [shingle_minhash.shingle_set(t) for t in texts], list(range(len(texts)))
    fps = [simhash_anchor.fingerprint_of(np.asarray(simhash_anchor.shingle_hashes(t), np.uint64), np.array([0]))[0] for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if shingle_minhash.near(sets[i], sets[j]) or np.bitwise_count(fps[i] ^ fps[j]) <= 3:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(shingle_minhash, "BLOCK", 8)
    assert {x.doc_id for x in shingle_minhash.keep_one(docs).collect()} == set(lab) and len(set(lab)) > 1


def test_stage_on_empty_short_and_repeated_rows(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, ""), (4, None), (None, "a b"), (5, "c d"), (5, "c d")]
    kept = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3, 5]
    assert shingle_minhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_that_differ_in_the_sign_bit_link(spark):
    fps = np.array([0x682600B09140C338, 0xE82600B09150C138], np.uint64).view(np.int64).tolist()
    d = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    assert {x.component_id for x in simhash_anchor.classes(d).collect()} == {0}
