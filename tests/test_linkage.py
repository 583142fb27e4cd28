import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.operators import assign, blocking, metrics, normalize, sampling
from linkloom.sources import io

DATA = "/root/testdata/sf0.001"


def clean(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, business_name string, business_address string")
    return normalize.normalize(df, other_scripts=False).orderBy("i").collect()


def test_cleaning_cases(spark):
    a, b, c, d, e, f, g = clean(
        spark, ("m0tors stee1 block5", "1 main st, ohio, texas"), ("baabaa paavr", "oregon drive"), ("baba power", "5 elm st, connecticut"), ("https://www.celina-motors.com/", "12 oak 12 012"),
        ("Private Limited", "12345 x 678901"), ("The Cat", None), ("Straße", "12 x"),
    )
    assert (a.name_clean, a.addr_clean) == ("motors steel blocks", "1 main street oh tx")
    assert b.name_skel == c.name_skel == "b pvr" and b.addr_clean == "oregon drive" and c.addr_clean == "5 elm street court"
    assert (d.name_clean, d.is_web, d.addr_numbers) == ("celina motors", True, ["12", "012"])
    assert (e.name_core, e.legal_form, e.postcode) == ("pvt ltd", "pvt ltd", "678901")
    assert (f.name_core, f.addr_clean, f.addr_numbers, f.addr_missing) == ("cat", "", [], True)
    assert g.name_clean == "strasse" and g.postcode is None


def indel_slow(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def ratio_slow(a, b):
    n = len(a) + len(b)
    return 100 * (n - indel_slow(a, b)) / n if n else 100.0


def partial_slow(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for x, y in ((a, b), (b, a)):
        if len(x) <= len(y):
            spans = {(max(s, 0), min(s + len(x), len(y))) for s in range(1 - len(x), len(y))}
            best = max(best, *(ratio_slow(x, y[s:e]) for s, e in spans))
    return best


def token_set_slow(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    whole = [" ".join([*both, *sorted(z)]) for z in (set(), x - y, y - x)]
    if both and (not x - y or not y - x):
        return 100.0
    # The shared words stand before both texts, so only the rest can differ.
    n = len(whole[1]) + len(whole[2])
    apart = indel_slow(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
    return max([100 * (n - apart) / n, *([ratio_slow(whole[0], whole[1]), ratio_slow(whole[0], whole[2])] if both else [])])


def jaro_winkler_slow(a, b):
    if a == b:
        return 1.0
    near = max(max(len(a), len(b)) // 2 - 1, 0)
    pairs, used = [], set()
    for i in range(len(a)):
        for j in range(len(b)):
            if abs(i - j) <= near and j not in used and a[i] == b[j]:
                pairs.append((i, j))
                used.add(j)
                break
    if not pairs:
        return 0.0
    k, t = len(pairs), sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True)) // 2
    s = (k / len(a) + k / len(b) + (k - t) / k) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return s + 0.1 * p * (1 - s) if s > 0.7 else s


SLOW = {"ratio": ratio_slow, "token_sort": lambda a, b: ratio_slow(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), "token_set": token_set_slow, "partial": partial_slow, "jaro_winkler": jaro_winkler_slow}


@pytest.mark.parametrize("name", sorted(SLOW))
def test_similarities(name):
    """Batches against one pair at a time by plain definitions; long strings, other scripts and empty ones."""
    r = random.Random(1)
    word = lambda k: "".join(r.choice("abcé क") for _ in range(k))
    pairs = [(word(r.randint(0, 9)), word(r.randint(0, 9))) for _ in range(300)] + [(word(r.randint(50, 90)), word(r.randint(60, 150))) for _ in range(6)]
    pairs += [("", ""), ("a", ""), ("martha", "marhta"), ("a b", "b a c"), ("x" * 64, "x" * 65)]
    got = sim.SCORERS[name](*map(list, zip(*pairs, strict=True)))
    assert got.tolist() == pytest.approx([SLOW[name](a, b) for a, b in pairs])


#: Golden rows: known values of the five similarities.
GOLDEN = [
    ("new york mets", "new york meats", {"ratio": 96.29630, "jaro_winkler": 0.98571}), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", {"token_sort": 100.0, "token_set": 100.0}),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", {"token_sort": 84.21053, "token_set": 100.0}), ("this is a test", "this is a test!", {"ratio": 96.55172, "partial": 100.0}),
    ("dwayne", "duane", {"jaro_winkler": 0.84}), ("dixon", "dicksonx", {"jaro_winkler": 0.81333}),
]


def test_golden_similarities(spark):
    from linkloom.operators import features

    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(GOLDEN)] + [(99, None, "x")], "i int, a string, b string")
    rows = features.add_similarities(d, {n: ("a", "b", n) for n in SLOW}).orderBy("i").collect()
    for row, (*_, want) in zip(rows, GOLDEN, strict=False):
        assert {n: row[n] for n in want} == pytest.approx(want, abs=1e-5)
    assert rows[-1].ratio == 0.0 and rows[-1].token_set == 0.0


def test_blocks_over_the_limit_give_nothing(spark):
    s1 = spark.createDataFrame([(0, "x", "k")], "rid int, country string, k string")
    for n, want in ((3, 3), (4, 0)):
        s23 = spark.createDataFrame([(2, i, "x", "k") for i in range(n)], "src int, rid int, country string, k string")
        assert blocking.candidates(s1, s23, [("k", "k")], 3).count() == want


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_rid int, src int, cand_rid int, p double")


def test_owner_ties_and_expected_sets(spark):
    got = assign.one_owner(pairs(spark, [(2, 2, 9, 0.5), (1, 2, 9, 0.5)]), "p").collect()
    assert [(r.s1_rid, r.cand_rid) for r in got] == [(1, 9)]
    got = assign.assign_expected(pairs(spark, [(1, 2, 1, 0.9), (1, 2, 2, 0.8), (1, 2, 3, 0.1), (2, 2, 4, 0.1)])).collect()
    assert sorted((r.s1_rid, r.cand_rid) for r in got) == [(1, 1), (1, 2)]


def test_f05(spark):
    s1 = spark.createDataFrame([(i,) for i in range(4)], "rid int")
    t = spark.createDataFrame([(1, 2, 1), (2, 2, 2), (3, 2, 3), (3, 2, 4)], "s1_rid int, src int, cand_rid int")
    m = spark.createDataFrame([(2, 2, 9), (3, 2, 3)], "s1_rid int, src int, cand_rid int")
    assert [round(r.f05, 4) for r in metrics.f05(m, t, s1).orderBy("s1_rid").collect()] == [1, 0, 0, 0.8333]


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(1000).withColumnRenamed("id", "s1_rid")
    a, b = (sorted(r.s1_rid for r in x.where(sampling.is_holdout()).collect()) for x in (d, d.repartition(7)))
    assert a == b and 100 < len(a) < 300 and sampling.exact_sample(d, 10, "s1_rid").count() == 10


def test_tsv(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\na\t"Ac\\me" Ltd\t\t FR \nb\t\tx\t\n', encoding="utf-8")
    r = io.read_source(spark, str(p), 2).orderBy("rid").collect()
    assert [(x.rid, x.entity_id, x.business_name, x.business_address, x.country) for x in r] == [(0, "a", '"Ac\\me" Ltd', None, "FR"), (1, "b", "", "x", "UNKNOWN")]
    with pytest.raises(ValueError):
        io.read_tsv(spark, str(p), ["x"])
    io.write_tsv(spark.createDataFrame([("a", ""), ("b", "x,y")], "id string, ids string"), str(tmp_path / "o"), "id")
    assert "".join(f.read_text() for f in (tmp_path / "o").glob("part*")) == "id\tids\na\t\nb\tx,y\n"
    io.write_json(spark, str(tmp_path / "j"), {"threshold": 0.65})
    assert io.read_json(spark, str(tmp_path / "j")) == {"threshold": 0.65}


def test_truth_with_unknown_ids_raises(spark):
    t = spark.createDataFrame([("a", "x,y"), ("b", None)], "source1_entity_id string, matched_entity_ids string")
    ids = io.split_ids(t)
    s1 = spark.createDataFrame([(0, "a"), (1, "b")], "rid int, entity_id string")
    s23 = spark.createDataFrame([(2, 0, "x"), (3, 0, "y")], "src int, rid int, entity_id string")
    assert io.truth_pairs(ids, s1, s23).count() == 2
    with pytest.raises(ValueError):
        io.truth_pairs(ids, s1, s23.where("src = 2"))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["one_owner"](spark, DATA).groupBy("src", "cand_rid").count().where(F.col("count") > 1).isEmpty()
