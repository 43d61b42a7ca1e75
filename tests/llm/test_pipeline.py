"""The pipeline against its stages done by hand on a small table, and the registry."""

import random

import pyarrow as pa

import corpus_pipeline
from larkspur.llm import mixing, pieces, pii, queries


def test_stages_by_hand(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(90)) for _ in range(60)]
    texts[7] = texts[3] + " again"
    texts[9] = "too short"
    texts[11] += " write to me@example.org now"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
    kept = {x.doc_id: x for x in seen.collect()}
    assert set(kept) == set(range(60)) - {7, 9}
    assert "[EMAIL]" in kept[11].text and kept[11].n_chars == len(kept[11].text) and all(kept[i].text == pii.redact_text(texts[i]) for i in kept)
    copies = {x.doc_id: x.copies for x in mixing.mix_counts(seen).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == sorted(i for i, n in copies.items() for _ in range(n))
    model = pieces.lattice()
    for x in out[:20]:
        assert x.pieces == model.encode(pa.array([kept[x.doc_id].text]), 1)[0][0][1].tolist() and x.n_pieces == len(x.pieces)


def test_last_stage_encodes_n_best_and_decodes(spark):
    texts = [" ".join(f"w{random.Random(k).randrange(3000)}" for _ in range(20)) for k in range(5)] + ["", "é漢 ▁x\ny", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {x.doc_id: x for x in corpus_pipeline.sentencepiece_ids(spark, docs, "").collect()}
    assert sorted(rows) == list(range(7))
    model = pieces.lattice()
    for i, x in rows.items():
        best, *others = model.encode(pa.array([texts[i]]))[0]
        assert x.pieces == best[1].tolist() and x.n_pieces == len(x.pieces) and x.round_trip
        assert x.other_pieces == [p.tolist() for _, p in others] and x.other_scores == [round(s, 6) for s, _ in others]
    assert all(len(rows[i].other_pieces) == pieces.N_BEST - 1 for i in range(5))


def test_nulls_repeats_and_odd_columns(spark, tmp_path):
    r = random.Random(2)
    made = [" ".join(f"w{r.randrange(3000)}" for _ in range(90)) for _ in range(79)]
    text = made.__getitem__
    rows = [(i, text(i), "en", f"s{i % 3}", 0, "x", "y") for i in range(30)]
    rows += [(3, text(3), "en", "s0", 0, "x", "y")] * 2 + [(None, text(5), None, None, None, "x", "y"), (None, text(77), "en", None, 0, "x", "y"), (4, text(78), "en", "s1", 0, "x", "y")]
    rows += [(90, None, None, None, None, None, None), (91, "", "en", "s1", 0, None, None), (92, " ".join(f"w{r.randrange(3000)}" for _ in range(300)), "en", "s1", 0, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, fertility string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    seen = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = seen.columns
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == columns, name
        if name == "n-gram Jaccard join":
            kept = sorted(((x.doc_id, x.text[:20]) for x in seen.collect()), key=repr)
            assert kept == sorted([*((i, text(i)[:20]) for i in range(30)), (None, text(77)[:20]), (4, text(78)[:20]), (92, rows[-1][1][:20])], key=repr)
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {x.doc_id for x in out} <= {*range(30), None, 92} and all(x.round_trip for x in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_registry():
    assert [f"op{n}_" in " ".join(queries.QUERIES) for n in range(1, 11)] == [True] * 10
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLES) <= set(queries.QUERIES)
