import duckdb

import corpus_pipeline as cp
from linkloom.llm import common, line_dedup, mixing, quality_rules, simhash_anchor, tokens

DATA = "/root/testdata/sf0.001"


def ask(docs, sql):
    """SQL over a stage's input as documents."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.sql(f"create view labels as select * from read_parquet('{DATA}/labels.parquet')")
    return con.sql(sql).fetchall()


def classes(texts):
    """Brute force: class of each text by its fingerprint's links and by five-word shingles."""
    fps, sets = [], []
    for t in texts:
        h = simhash_anchor.shingle_hashes(t)
        fps.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    lab = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(lab[i], lab[j]), min(lab[i], lab[j])
                lab = [new if v == old else v for v in lab]
    return lab


def test_every_stage_against_its_own_input(spark):
    docs = common.read(spark, DATA, "documents").cache()
    cols, (quality, lines, near, mixture, packing) = docs.columns, [f for _, f in cp.STAGES]
    out = common.materialise(quality(spark, docs, DATA))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in ask(docs, f"select doc_id from ({quality_rules.oracle()}) where kept")} and out.columns == cols
    docs, out = out, common.materialise(lines(spark, out, DATA))
    assert {(r.doc_id, r.text) for r in out.collect()} == {r[:2] for r in ask(docs, line_dedup.ORACLE)} and out.columns == cols
    assert all(r.n_chars == len(r.text) for r in out.collect())
    docs, out = out, common.materialise(near(spark, out, DATA))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    lab = classes([t for _, t in rows])
    assert {r.doc_id for r in out.collect()} == {rows[i][0] for i in set(lab)} and out.columns == cols
    docs, out = out, common.materialise(mixture(spark, out, DATA))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in ask(docs, f"select doc_id from ({mixing.oracle()}) where sampled")} and out.columns == cols
    enc = tokens.encoder(tokens.default_path())
    pieces = packing(spark, out, DATA).collect()
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == {(r.doc_id, len(enc.ids(r.text)) // 4 + 1) for r in out.collect()}
    assert sum(p.length for p in pieces) == sum(len(enc.ids(r.text)) // 4 + 1 for r in out.collect())
