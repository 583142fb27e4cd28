"""Every query on tables with odd rows and clashing columns, and on empty tables."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from linkloom.llm import queries

PROSE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "  \n\t", "one", PROSE, PROSE, PROSE + " more", "x" * 40000, "ab " * 20000, "4111111111111111 on 2024-02-29\n" + PROSE, "é \n \n<|endoftext|>  y"]
#: Names that the operators use inside or return.
CLASH = ["__id", "__th", "__rk", "__row", "__t", "__w", "__gone", "h", "at", "key", "k", "d", "g", "n", "p", "w", "fp", "stratum", "line", "no", "root", "node", "low", "component_id", "kept", "base_failed",
         "n_words", "n_lines", "n_removed", "ids", "start", "block", "role_", "tokens", "topic", "sampled", "n_tokens", "fingerprint", "id", "embedding_", "m", "side", "conv", "pair_id", "t", "c", "r", "q", "m0", "x", "cid", "ok", "e"]


def tables(spark, root):
    docs = [(i if i != 6 else None, t, "en" if i % 3 else None, "s" if i % 4 else None, None) for i, t in enumerate(TEXTS)]
    docs += [docs[4], docs[4]]
    vectors = [(i, [1.0, i / 100, 0.0, 0.5]) for i in range(5)] + [(0, [1.0, 0.0, 0.0, 0.5]), (7, None), (8, []), (9, [0.0] * 4), (10, [float("nan")] * 4), (None, [1.0] * 4)]
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", ""), (None, None, None, None)]
    made = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(4, 1, None), (4, 0, 1), (None, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int"),
        "embeddings": (vectors, "vec_id long, embedding array<float>"), "conversations": (turns, "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        df = df.select("*", *[F.lit(None if i % 2 else "v").cast("string").alias(c) for i, c in enumerate(CLASH) if c not in df.columns])
        df.write.parquet(f"{root}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return {k: len(v[0]) for k, v in made.items()}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    return at, tables(spark, at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_odd_and_on_empty_tables(spark, root, name):
    at, n = root
    ask = queries.QUERIES[name]
    assert ask(spark, f"{at}/empty").count() == 0
    got = ask(spark, f"{at}/odd")
    rows = got.collect()
    if name.startswith("op3"):
        assert [r.pair_id for r in rows] == [0]
    elif name.startswith("op4"):
        assert len(rows) == n["embeddings"] and all(r.n_links == 0 and (r.vec_id is None or r.vec_id == r.component_id) for r in rows if r.vec_id is None or r.vec_id > 6)
        assert all(r.n_links == 5 and r.component_id == 0 for r in rows if r.vec_id is not None and r.vec_id < 5)
    elif name.startswith("op1_"):
        assert sum(len(r.doc_ids) for r in rows) >= n["documents"]
    elif name.startswith("op9"):
        assert sum(r.start == 0 for r in rows) == n["documents"] and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    else:
        assert len(rows) == n["documents"]
        assert len({tuple(r) for r in rows if r.doc_id == 4}) <= (2 if name.startswith("op6") else 1)


def test_pipeline_stages_on_odd_and_on_empty_tables(spark, root):
    at, _ = root
    for kind in ("odd", "empty"):
        docs = spark.read.parquet(f"{at}/{kind}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, f"{at}/{kind}")
            assert out.columns == docs.columns
            n, before = out.count(), docs.count()
            assert n <= before and (kind == "odd" or n == 0)
        assert cp.STAGES[-1][1](spark, docs, f"{at}/{kind}").count() >= docs.count()
    assert cp.run(spark, f"{at}/empty").count() == 0 and cp.run(spark, f"{at}/odd").count() >= 1
