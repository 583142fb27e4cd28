from linkloom import __main__ as cli
from linkloom.sources import io

NAMES = ["celina motors", "baba power", "oak steel works", "river bakery", "north star foods", "blue lake paper", "green hill farm", "silver coin bank"]


def raw(root):
    """Records of two countries; every second one of source 1 has a partner in source 2."""
    for split in ("train", "test"):
        (root / split).mkdir(parents=True)
        rows = {1: [], 2: [], 3: []}
        for i in range(64):
            name, address, country = f"{NAMES[i % 8]} {chr(97 + i // 8) * 4}", f"{i + 10} main st {NAMES[(i * 3) % 8].split()[0]}", ("01", "FR")[i % 2]
            rows[1].append(f"a{i}\t{name} ltd\t{address}\t{country}")
            rows[2].append(f"b{i}\t{name if i % 2 else name[::-1]} pvt ltd\t{address if i % 2 else ''}\t{country}")
            rows[3].append(f"c{i}\tother {i} shop\tsomewhere {i}\t{country}")
        for n, lines in rows.items():
            (root / split / f"{split}_source{n}.tsv").write_text("\n".join(["\t".join(io.SOURCE_COLUMNS), *lines]) + "\n")
    truth = [f"a{i}\t" + (f"b{i}" if i % 2 else "") for i in range(64)]
    (root / "train" / "train_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *truth]) + "\n")


def test_commands_from_raw_files_to_results(spark, tmp_path):
    raw(tmp_path)
    at = ["--data", str(tmp_path), "--work", str(tmp_path / "w"), "--out", str(tmp_path / "o"), "--rounds", "3", "--depth", "3", "--min-rows", "1", "--sample", "50", "--small"]
    for command in ("dictionary", "prepare", "check", "tune", "train", "predict"):
        cli.main([command, *at])
    assert {r.country for r in io.read_clean(spark, io.clean_path(str(tmp_path / "w"), "train", 1)).collect()} == {"01", "FR"}
    lines = [x.split("\t") for f in (tmp_path / "o" / "matching_results.tsv").glob("part*") for x in f.read_text().splitlines()[1:]]
    assert len(lines) == 64 and sum(m == "b" + s[1:] for s, m in lines if int(s[1:]) % 2) >= 28
    assert 0 < io.read_json(spark, str(tmp_path / "w" / "model_config.json"))["threshold"] < 1


def results(at, name):
    return [x.split("\t") for f in (at / f"{name}.tsv").glob("part*") for x in f.read_text().splitlines()[1:]]


def test_staged_learner_from_raw_files_to_results(spark, tmp_path, monkeypatch):
    """Every step saved and resumable; the test split's text scores are the mean of both halves' models."""
    from linkloom.plans import lifecycle

    raw(tmp_path)
    monkeypatch.setattr(lifecycle, "SMALL", {k: {"rounds": 3, "depth": 3, "rate": 0.3, "min_rows": 1} for k in lifecycle.SMALL})
    at = ["--data", str(tmp_path), "--work", str(tmp_path / "w"), "--out", str(tmp_path / "o"), "--sample", "50", "--small"]
    for command in (["prepare"], ["staged", "cands"], ["staged", "dump"], ["staged", "cands", "--split", "test"], ["staged", "dump", "--split", "test"], ["staged", "ce"], ["staged", "train"], ["staged", "eval"], ["staged", "predict"]):
        cli.main([*command, *at])
    shelf = lifecycle.Shelf(spark, str(tmp_path / "w" / "staged"))
    config = shelf.read("config")
    assert config["use"] in ("stage1", "stage2") and set(config["holdout"]) == {"stage1", "stage2"} and set(config["unseen"]) == {"01 -> FR", "FR -> 01"}
    assert config["use"] == ("stage2" if (config["holdout"]["stage2"] or 0) > (config["holdout"]["stage1"] or 0) else "stage1") and config["ceiling"] >= max(config["holdout"].values())
    assert set(shelf.read("eval")) == {"stage1", "stage2"} and shelf.table("evaluation").where("country is null").count() == 2
    scores = lifecycle.text_scores(shelf, "test")
    assert scores.count() == shelf.table("texts_test").count() == scores.select("s1_rid", "src", "cand_rid").distinct().count() and lifecycle.text_scores(shelf, "other") is None
    assert shelf.table("scores_train").count() == shelf.table("texts_train").count()
    lines = results(tmp_path / "o", "matching_results")
    assert len(lines) == 64 and len(results(tmp_path / "o", "candidate_pairs")) == 64 and sum(m == "b" + s[1:] for s, m in lines if int(s[1:]) % 2) >= 24
    # A complete step is read, not made again.
    assert shelf.table("cands_train", lambda: 1 / 0).count() > 0 and lifecycle.pruner(shelf, None) is not None
    limited = ["staged", "cands", "--split", "test", "--test-limit", "3", *at]
    cli.main(limited)
    assert shelf.table("cands_test").select("s1_rid").distinct().count() <= 6


def test_predict_without_a_learner(spark, tmp_path):
    raw(tmp_path)
    at = ["--data", str(tmp_path), "--work", str(tmp_path / "w"), "--out", str(tmp_path / "o")]
    cli.main(["prepare", *at])
    for kind in ("simple", "rule"):
        cli.main(["predict", "--scores", kind, "--threshold", "90", *at])
        lines = results(tmp_path / "o", "matching_results")
        assert len(lines) == 64 and sum(m == "b" + s[1:] for s, m in lines if int(s[1:]) % 2) >= 24


def test_a_learnt_dictionary_is_joined(spark):
    from linkloom.operators import normalize

    words = spark.createDataFrame([("जैन", "jain"), ("मोटर्स", "motors")], "native string, latin string")
    raw_rows = spark.createDataFrame([(0, "जैन मोटर्स", None), (1, "plain ltd", "जैन road"), (2, None, "")], "i int, business_name string, business_address string")
    a = normalize.normalize(raw_rows, words).orderBy("i").collect()
    b = normalize.normalize(raw_rows, {"जैन": "jain", "मोटर्स": "motors"}).orderBy("i").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b] and a[0].name_clean == "jain motors" and a[0].name_nonlatin and a[1].addr_clean == "jain road"
