import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat_preference, common, embed_cross_polytope, line_dedup, mixing, pack_bfd, pack_kk, pii_feistel, quality_rules, simhash_anchor, token_counts, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long, gone string, key string, kept string"
PROSE = " ".join(f"word{i}" for i in range(60))


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None if k == 2 else "en", None if k == 1 else "s", None, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


ODD = [None, "", "   \n\t", "one", PROSE, PROSE, "x" * 30000, "ab " * 20000, "é \n \n x  <|endoftext|>  y"]


def test_tokens_equal_the_reference_tokenizer():
    from tokenizers import Tokenizer

    hf, enc = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path())
    r = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab 'sé\n\t1|  .中") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids, t


def test_packing_by_differencing(spark):
    from tokenizers import Tokenizer

    d = docs(spark, ODD, [None, 1, 2, 3, 4, 4, 6, 7, 8])
    rows = pack_kk.pack(d, tokens.default_path(), capacity=64, per_flush=8).withColumn("crc", F.crc32("ids")).collect()
    hf = Tokenizer.from_file(tokens.default_path())
    want = [hf.encode(t or "", add_special_tokens=False).ids + [0] for t in ODD]
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start, r.length, r.crc) for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.crc))
    for i, ids in zip([None, 1, 2, 3, 4, 4, 6, 7, 8], want, strict=True):
        for start, length, crc in spans[i, len(ids)]:
            assert crc == zlib.crc32(np.asarray(ids[start : start + length], "<u4").tobytes())
        twice = 2 if i == 4 else 1
        assert sorted(x for s, n, _ in spans[i, len(ids)] for x in range(s, s + n)) == sorted([*range(len(ids))] * twice)
    assert sum(n for *_, n, _ in pieces) == sum(map(len, want))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert pack_kk.pack(d.limit(0), tokens.default_path()).count() == 0


def test_differencing_is_near_equal():
    r = random.Random(5)
    lengths = [r.randint(1, 256) for _ in range(2000)]
    parts = pack_kk.windows(lengths, 1024)
    assert sorted(i for p in parts for i in p) == list(range(2000))
    assert len(parts) <= -(-sum(lengths) // 1024) * 1.01 + 1 and max(sum(lengths[i] for i in p) for p in parts) <= 1024
    assert pack_kk.windows([600, 600, 600], 1024, most=2) is None and len(pack_kk.windows([600, 600, 600], 1024)) == 3


def test_remainders_stay_whole_where_the_padding_allows_it():
    r = random.Random(6)
    halves = [n for _ in range(500) for n in (lambda a: (a, 1024 - a))(r.randint(1, 1023))]
    for lengths, whole in ((halves, True), ([r.randint(300, 1023) for _ in range(1000)], False), ([r.randint(1, 150) for _ in range(4000)], True)):
        got = pack_kk.pieces(lengths, 1024)
        assert len(got) * 1024 <= sum(lengths) * 1.01 + 1024
        assert sorted((i, s) for w in got for i, a, n in w for s in range(a, a + n)) == [(i, s) for i, n in enumerate(lengths) for s in range(n)]
        assert whole == (sum(map(len, got)) == len(lengths)) and all(sum(n for *_, n in w) <= 1024 for w in got)


def test_best_fit_decreasing():
    r = random.Random(7)
    for _ in range(50):
        cap = r.randint(3, 40)
        lengths = [r.randint(1, cap) for _ in range(r.randint(0, 60))]
        room, rows = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [k for k in range(len(rows)) if room[k] >= lengths[i]]
            if fit:
                k = min(fit, key=lambda k: room[k])
            else:
                rows.append([])
                room.append(cap)
                k = len(rows) - 1
            rows[k].append(i)
            room[k] -= lengths[i]
        got = pack_bfd.best_fit_decreasing(lengths, cap)
        assert len(got) == len(rows) and sorted(cap - sum(lengths[i] for i in g) for g in got) == sorted(room)


def test_matrix_round_trip(spark):
    enc = tokens.encoder(tokens.default_path())
    rows = pack_bfd.pack(docs(spark, ODD), tokens.default_path(), capacity=64, hold=300).collect()
    parts = {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for i, t in enumerate(ODD):
        assert [x for _, p in sorted(parts[i]) for x in p] == np.frombuffer(enc.ids(t), "<u4").tolist() + [0]


def test_trie_counts_against_every_segmentation():
    pieces = {"▁": -3.0, "a": -1.0, "b": -1.5, "ab": -1.2, "▁a": -2.0, "ba": -2.2, "bab": -2.3}

    def best(t):
        if not t:
            return 0.0, 0
        n = len(t[0].encode())
        s, k = best(t[1:])
        top = (s + n * token_counts.UNKNOWN, k - n)
        for i in range(1, len(t) + 1):
            if t[:i] in pieces:
                s, k = best(t[i:])
                top = max(top, (s + pieces[t[:i]], k - 1))
        return top

    r = random.Random(9)
    trie = token_counts.Trie(pieces)
    for _ in range(300):
        w = "".join(r.choice("abé") for _ in range(r.randint(1, 8)))
        assert trie.count([w]) == trie._alone(w) == -best("▁" + w)[1]


def test_token_counts_of_odd_texts(spark):
    import public_tokenizers

    rows = token_counts.count_tokens(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows[:3]] == [0, 0, 0] and rows[4].n_tokens == rows[5].n_tokens > 60 and rows[7].n_words == 20000


def test_quality_counts_against_plain_python(spark):
    r = random.Random(2)
    texts = [t for t in ODD if t is None or len(t) < 2000] + ["".join(r.choice(["a", "b", "ab", "\n", "\t", "#"]) + r.choice([" ", " ", "\n"]) for _ in range(r.randint(0, 80))) for _ in range(60)]
    d = docs(spark, texts)
    got = {x["__id"]: x for x in quality_rules.verdicts(d, spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + j for k, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert g.kept == (not g.base_failed)  # too few labels certify no cutoff


def tail(n, a, k):
    from math import comb

    return sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))


def test_certified_cutoffs_are_exact(spark):
    n, a = 400, 0.02
    d = spark.createDataFrame([("=en", i) for i in range(n)], "stratum string, s_x int")
    rules = {"x": ("s_x", [399, 398, 397, 396, 395, 394, 380])}
    cut = quality_rules.cutoffs(d, a, 0.05, rules).first().c_x
    assert cut == min(c for c in rules["x"][1] if tail(n, a, n - 1 - c) <= 0.05)


def test_the_verdict_of_all_rules_together_is_certified(spark):
    """Each rule alone would certify its cutoffs; what the rules reject together may not exceed the bound."""
    n, a = 2000, 0.02
    rules = {r: (f"s_{r}", [99, 49]) for r in "xyz"}
    rows = [("=en", *(100 if i // 15 == j else 50 if 100 + i // 15 == 100 + j + 3 else 0 for j in range(3))) for i in range(n)]
    c = quality_rules.cutoffs(spark.createDataFrame(rows, "stratum string, s_x int, s_y int, s_z int"), a, 0.05, rules).first()
    rejected = [sum(any(r[1 + j] > at[k] for j, k in enumerate("xyz") if at[k] is not None) for r in rows) for at in quality_rules.steps(rules)]
    want = 0
    while want < len(rejected) and tail(n, a, rejected[want]) <= 0.05:
        want += 1
    assert c.step == want and 0 < want < len(rejected) and all(tail(n, a, 15) <= 0.05 for _ in rules)


def test_false_rejection_exceeds_alpha_at_most_delta_of_the_time():
    """Draws of holdouts from known rates: the climb of the operator, with its exact bound, in plain Python."""
    r, a, delta, n, bad = np.random.default_rng(8), 0.02, 0.05, 500, 0
    rate = np.array([0.001, 0.004, 0.012, 0.0201, 0.03, 0.05])  # of good documents above each step's cutoffs
    most = max(k for k in range(n) if tail(n, a, k) <= delta)
    for _ in range(2000):
        u = r.random(n)
        ok = [(u < p).sum() <= most for p in rate]
        step = ok.index(False) if False in ok else len(ok)
        bad += step > 0 and rate[step - 1] >= a
    assert bad / 2000 <= delta + 3 * (delta * (1 - delta) / 2000) ** 0.5


def test_base_failures_and_null_strata(spark):
    """Good documents that the base rule rejects are no part of the holdout; a null stratum is not the empty one."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), lang) for i, lang in enumerate(["en"] * 300 + [None] * 300 + [""] * 300)]
    short = [(1000 + i, "|" * 50, "en") for i in range(100)]
    d = spark.createDataFrame(good + short, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good + short], "doc_id long, quality int, toxic int")
    v = quality_rules.verdicts(d, labels)
    feats = common.materialise(v.drop("base_failed", "kept"))
    cut = {r.stratum: (r.n, r.step) for r in quality_rules.certified(feats, labels).collect()}
    assert {k: n for k, (n, _) in cut.items()} == {"=en": 300, "": 300, "=": 300} and all(s > 0 for _, s in cut.values())
    kept = quality_rules.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r["__id"] for r in v.where("kept").collect()}


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(r.choice([18, 25, 60, 400]))) for _ in range(12)]

    def edit(s):
        i = r.randrange(len(s))
        return r.choice([s[:i] + s[i + 1 :], s[:i] + "z" + s[i + 1 :], s[:i] + "y" + s[i:], s])

    texts = ["\n".join([*(edit(edit(r.choice(base))) if r.random() < 0.6 else edit(r.choice(base)) for _ in range(6)), "short", ""]) for _ in range(40)] + [None, ""]
    seen, want = [], []

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]

    for t in texts:
        if t is None:
            want.append(None)
            continue
        left = []
        for x in t.split("\n"):
            counts = len(x) >= line_dedup.MIN_CHARS and x.strip()
            if not (counts and any(near(x, s) for s in seen)):
                left.append(x)
            if counts:
                seen.append(x)
        want.append("\n".join(left))
    got = line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id")
    assert [x.text for x in got.collect()] == want and got.columns == docs(spark, texts).columns
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0
    named = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    assert [x.text for x in line_dedup.dedup_lines(named).orderBy("doc_id").collect()] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize(("edits", "alphabet"), [(0, "ab "), (2, "ab "), (2, "abcdefghij "), (3, "abcd ")])
def test_line_dedup_with_other_bounds_against_brute_force(spark, edits, alphabet):
    """Lines at distances around the bound, of unequal lengths, periodic ones, chains and ties."""
    r = random.Random(edits)
    some = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    base = [some(r.choice([9, 14, 22])) for _ in range(10)] + ["ab" * 6, "a" * 9, "a" * 12, "abcab" * 3]

    def edit(s):
        for _ in range(r.randint(0, edits + 2)):
            i = r.randrange(len(s) + 1)
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice(alphabet) + s[i + 1 :], s[:i] + r.choice(alphabet) + s[i:]])
        return s

    texts = ["\n".join([edit(r.choice(base)) for _ in range(4)]) for _ in range(30)] + [None, "", "a" * 11]
    seen, want = [], []
    for t in texts:
        left = []
        for x in (t or "").split("\n"):
            counts = len(x) >= 8 and x.strip()
            if not (counts and any(distance(x, s) <= edits for s in seen)):
                left.append(x)
            seen += [x] if counts else []
        want.append(None if t is None else "\n".join(left))
    got = line_dedup.dedup_lines(docs(spark, texts), min_chars=8, edits=edits)
    assert [x.text for x in got.orderBy("doc_id").collect()] == want
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0), edits=edits).count() == 0


def test_any_two_lines_within_the_bound_share_a_first_key(spark):
    r = random.Random(6)
    pairs = []
    for _ in range(300):
        a = b = "".join(r.choice("abc") for _ in range(r.randint(8, 40)))
        for _ in range(2):
            i = r.randrange(len(b) + 1)
            b = r.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i + 1 :], b[:i] + "y" + b[i:]])
        pairs.append((a, b))
    rows = spark.createDataFrame([(i, x, len(x)) for i, p in enumerate(pairs) for x in p], "i int, line string, n int").select("i", F.array_compact(F.array(*line_dedup._coarse(2))).alias("k")).collect()
    of = {}
    for row in rows:
        of.setdefault(row.i, []).append(set(row.k))
    assert all(x & y for x, y in of.values())


def places(fps, crowded):
    """For every fingerprint the buckets it is home in, and all it goes to."""
    out = [(set(), set()) for _ in fps]
    for a, k, z in zip(*simhash_anchor.anchor_rows(fps, crowded), strict=True):
        out[a][1].add(k)
        if z == 0:
            out[a][0].add(k)
    return out


def test_anchor_covering_loses_no_link():
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 63), 1 << 63, 300)
    for bits in (1, 2, 3):
        y = x.copy()
        for row in range(len(y)):
            for b in r.choice(64, bits, replace=False):
                y[row] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
        for crowded in (np.zeros(0, np.int64), np.arange(1 << 23)):
            for (home, _), (_, every) in zip(places(x, crowded), places(y, crowded), strict=True):
                assert home & every


def links_of(fps):
    """Classes by brute force in whole numbers: no arrays, no signs."""
    lab = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 3:
                old, new = max(lab[i], lab[j]), min(lab[i], lab[j])
                lab = [new if v == old else v for v in lab]
    return lab


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_every_bit_counts_once_the_sign_too(spark):
    """For each of 64 bits a pair that differs there and in up to two more, a pair with a fourth, and pairs whose XOR is
    negative with a small absolute value (34 to 63 differing bits), which a count of the absolute value takes for near."""
    r, fps = random.Random(4), []
    for b in range(64):
        for more in (0, 1, 2, 3):
            a = r.getrandbits(64)
            other = r.sample([x for x in range(64) if x != b], more)
            fps += [a, a ^ (1 << b) ^ sum(1 << x for x in other)]
    for low in (0, 1, 30, 40, 60):
        a = r.getrandbits(64)
        fps += [a, a ^ ((1 << 64) - (1 << low))]
    fps = list(dict.fromkeys(fps))
    d = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    for options in ({}, {"refine": 2, "block": 8}):
        got = {x.doc_id: x.component_id for x in simhash_anchor.classes(d, **options).collect()}
        assert [got[i] for i in range(len(fps))] == links_of(fps)


def test_simhash_classes_and_representatives(spark):
    near = PROSE.replace("word30", "other")
    d = docs(spark, [PROSE, PROSE, None, "", "a b", "A  B", near, PROSE], [5, 3, 7, 8, 1, 2, 4, None])
    rows = simhash_anchor.near_duplicates(d).collect()
    by = {r.doc_id: r for r in rows}
    assert by[7].fingerprint == "0" * 16 and by[8].component_id == 7 and by[2].component_id == 1 and by[5].component_id == by[None].component_id
    kept = simhash_anchor.keep_one(d.union(d.where("doc_id = 1")))
    assert kept.columns == d.columns and kept.count() == len({r.component_id for r in rows})
    assert simhash_anchor.keep_one(d.limit(0)).count() == 0


def test_crowded_anchors_and_blocks_give_the_same_classes(spark):
    r = random.Random(2)
    centre = r.getrandbits(64) | 1 << 63
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)})
    d = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    want = links_of(fps)
    for options in ({}, {"refine": 5, "block": 16}):
        got = {x.doc_id: x.component_id for x in simhash_anchor.classes(d, **options).collect()}
        assert [got[i] for i in range(len(fps))] == want


def vector_links(u):
    """(links, smallest index reachable) of unit rows by brute force."""
    near = u @ u.T >= 0.95
    lab = np.arange(len(u))
    while True:
        new = np.array([lab[row].min() for row in near])
        if (new == lab).all():
            return near.sum(1) - 1, lab
        lab = new


@pytest.mark.parametrize(("dim", "n", "spread", "homes"), [(24, 600, 0.045, 1024), (64, 3000, 0.026, 64), (64, 1500, 0.026, 4), (768, 1500, 0.0075, 32)])
def test_vectors(spark, dim, n, spread, homes):
    """Groups of vectors whose cosines lie around the limit; small buckets, so that hashing has several rotations."""
    r = np.random.default_rng(3)
    c = r.normal(size=(n // 6, dim)) / np.sqrt(dim)
    x = [(c[i % len(c)] + r.normal(size=dim) * spread).tolist() for i in range(n)]
    extra = [(n, x[0]), (n + 1, None), (n + 2, []), (n + 3, [0.0] * dim), (n + 4, [float("nan")] * dim), (None, x[0]), (n + 5, [None] * dim), (n + 6, [1.0, 2.0])]
    d = spark.createDataFrame([(i, v, "z") for i, v in [*enumerate(x), *extra]], "vec_id long, embedding array<double>, kept string")
    assert bool(embed_cross_polytope.plan(dim, n, homes=homes)[0]) == (homes < n)
    got = embed_cross_polytope.near_vectors(d, homes=homes, block=64).collect()
    assert len(got) == n + len(extra)
    u = np.asarray([*x, x[0]])
    want, lab = vector_links(u / np.linalg.norm(u, axis=1)[:, None])
    by = {g.vec_id: g for g in got}
    assert want.sum() > n / 2 and sum(by[i].n_links for i in range(n + 1)) >= 0.999 * want.sum() and all(by[i].n_links <= want[i] for i in range(n + 1))
    assert sum(by[i].component_id != lab[i] for i in range(n + 1)) <= n // 500
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(n + 1, n + 7)) and by[None].n_links == 0


@pytest.mark.parametrize(("dim", "n"), [(16, 10**7), (64, 10**5), (64, 10**8), (768, 10**6)])
def test_recall_at_just_the_limit(dim, n):
    """Pairs that the plan has not seen: what all its tables together find."""
    use, tables = embed_cross_polytope.plan(dim, n)
    r = np.random.default_rng(99)
    trials = 4000 if dim < 100 else 600
    x, z = (v / np.linalg.norm(v, axis=1)[:, None] for v in r.normal(size=(2, trials, dim)))
    z -= (z * x).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    met = embed_cross_polytope.meet(embed_cross_polytope.codes(x, use, range(tables)), embed_cross_polytope.codes(y, use, range(tables))).any(1)
    assert met.mean() >= 0.999


def test_mixture(spark):
    d = docs(spark, ODD, [None, 1, 2, 3, 4, 4, 6, 7, 8])
    p = mixing.probabilities(d).collect()
    assert len(p) == len(ODD) and all(0 <= x.p <= 1 for x in p)
    assert mixing.sample(d).columns == d.columns and mixing.sample(d.limit(0)).count() == 0
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "source string, lang string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    for one_task in (100, 0):
        w = {(r.source, r.lang): r.tokens * r.p for r in mixing.rake(cells, ["source", "lang"], {}, 0.3, targets, one_task=one_task).collect()}
        assert w["a", "x"] + w["a", "y"] == pytest.approx(195 / 2, rel=6e-3) and w["a", "x"] + w["b", "x"] == pytest.approx(0.6 * 195, rel=6e-3)


def test_mixture_beyond_what_the_tokens_allow(spark):
    """Targets that 0.8 of the tokens cannot meet: a smaller sample meets them."""
    cells = spark.createDataFrame([("a", "x", 900), ("a", "y", 50), ("b", "x", 30), ("b", "y", 20)], "source string, lang string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}}
    raked = mixing.rake(cells, ["source", "lang"], {}, 0.8, targets)
    assert all(r.got == pytest.approx(r.target, rel=0.01) for r in mixing.shares(raked, ["source", "lang"]).collect())
    assert 0 < sum(r.tokens * r.p for r in raked.collect()) <= 100 and all(0 <= r.p <= 1 for r in raked.collect())


def tempered(have, tau, total):
    """Shares in proportion to T ** tau, none above its room: values are used up from the smallest on."""
    full = set()
    while True:
        left = total - sum(mixing.ROOM * have[k] for k in full)
        mass = {k: v**tau for k, v in have.items() if k not in full}
        over = {k for k, m in mass.items() if left * m / sum(mass.values()) >= mixing.ROOM * have[k]}
        if not over:
            return {k: (mixing.ROOM * have[k] if k in full else left * mass[k] / sum(mass.values())) / total for k in have}
        full |= over


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixture_meets_every_tempered_target(spark, sf):
    d, dims = common.read(spark, f"/root/testdata/{sf}", "documents"), list(mixing.TAU)
    raked = mixing.rake(mixing._cells(d.select(*mixing._dims(d, None, "text"), mixing.n_tokens(F.col("text"))), dims), dims, mixing.TAU, mixing.KEEP)
    cells, got = raked.collect(), {(r.dim, r.value): (r.target, r.got) for r in mixing.shares(raked, dims).collect()}
    total = sum(c.tokens for c in cells) * mixing.KEEP
    for dim in dims:
        have = {}
        for c in cells:
            have[c[dim]] = have.get(c[dim], 0) + c.tokens
        for k, want in tempered(have, mixing.TAU[dim], total).items():
            assert got[dim, k] == (pytest.approx(want, rel=1e-6), pytest.approx(want, rel=0.01))
    assert sum(c.tokens * c.p for c in cells) == pytest.approx(total, rel=0.01)


def test_targets_that_contradict_one_another_warn(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "y", 100)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="no sample"):
        raked = mixing.rake(cells, ["source", "lang"], {}, 0.8, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}})
    assert all(0 <= r.p <= 1 for r in raked.collect())


def test_topics_may_be_a_column(spark):
    d = docs(spark, [PROSE] * 6).withColumn("topic", F.when(F.col("doc_id") < 2, "law"))
    assert {(r.topic, r.n_tokens) for r in mixing.probabilities(d).collect()} == {("law", 60), ("", 60)}


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (4, None, None, None), (5, 0, "user", None), (None, 0, "user", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash"))
    got = {r.pair_id: r for r in chat_preference.preferences(t, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 2}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen == "<|assistant|>\nyes<|end|>\n" and got[0].chosen_mask == "0" * 14 + "1" * 11
    assert got[0].rejected_mask == "0" * 14 + "1" * 10 and got[2].prompt == ""


def test_pseudonyms(spark):
    texts = ["card 4111111111111111, bad 4111111111111112", "4111111111111111 on 2024-02-29, not 2023-02-29, 02/29/2024", "+1 (743) 555-3824 and 743-555-3824", "10.20.30.40 and 300.1.1.1 and Version 2.0.", "a.b@mail5.example.com", "123-45-6789 000-12-3456", None, "", "no digits"]
    got = [r.text for r in pii_feistel.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    card = got[0].split()[1].rstrip(",")
    assert card in got[1] and "4111111111111112" in got[0] and card != "4111111111111111" and luhn(card)
    assert "2023-02-29" in got[1] and "2024-02-29" not in got[1] and got[6:] == [None, "", "no digits"]
    a, b = got[2].split(" and ")
    assert "".join(c for c in a if c.isdigit())[1:] == "".join(c for c in b if c.isdigit()) != "7435553824"
    assert "300.1.1.1" in got[3] and "10.20.30.40" not in got[3] and "000-12-3456" in got[5] and "mail5" not in got[4]


def test_pseudonyms_of_grouped_cards(spark):
    texts = ["4111111111111111 378282246310005", "4111-1111-1111-1111 and 3782 822463 10005.", "4111 1111 1111 1111; 3782-822463-10005", "4111-1111-1111-1112 4111-1111 1111-1111 4111-1111-1111-1111-5"]
    got = [r.text for r in pii_feistel.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    a, b = got[0].split()
    quad, amex = [a[i : i + 4] for i in range(0, 16, 4)], [b[:4], b[4:10], b[10:]]
    assert luhn(a) and luhn(b) and a != "4111111111111111" and len(b) == 15
    assert got[1] == f"{'-'.join(quad)} and {' '.join(amex)}." and got[2] == f"{' '.join(quad)}; {'-'.join(amex)}" and got[3] == texts[3]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms_plan_stays_small(spark):
    """Each task reads the whole plan: values copied at each use made it some 60,000 nodes."""
    plan, nodes = pii_feistel.pseudonymise(docs(spark, ["x"]), "k")._jdf.queryExecution().analyzed(), 0
    while plan.children().size():
        nodes += sum(plan.expressions().apply(i).treeString().count("\n") for i in range(plan.expressions().size()))
        plan = plan.children().apply(0)
    assert 1000 < nodes < 5000


def test_feistel_permutes(spark):
    d = spark.range(35).select(pii_feistel.feistel("t", F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(5), F.lit(7), F.lit("k")).alias("s"))
    assert d.select("s.x", "s.y").distinct().count() == 35 and d.agg(F.max("s.x"), F.max("s.y")).first() == (4, 6)
