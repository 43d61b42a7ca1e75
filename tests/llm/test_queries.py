"""The registered queries on small tables: their columns, their SQL, and what each adds to its operator."""

import os
import zlib

import duckdb
import pytest

from larkspur.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_jaccard_join": "doc_id n_shingles component_id",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_quality_classifier": "doc_id kept",
    "op7_sentencepiece": "doc_id round_trip",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name in queries.ORACLES:
        r = con.execute(queries.ORACLES[name])
        found = [d[0] for d in r.description]
        assert sorted(found) == sorted(df.columns)
        plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
        assert sorted((tuple(plain(x[c]) for c in found) for x in rows), key=repr) == sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)
    table, ident = ("pages", "page_id") if name == "op8_warc" else ("documents", "doc_id")
    texts = dict(con.execute(f"select {ident}, {'html' if table == 'pages' else 'text'} from {table}").fetchall())
    assert sorted(x[ident] for x in rows) == sorted(texts)
    for x in rows:
        if name == "op1_language_id":
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if name == "op3_token_counts":
            assert x.over_limit == (x.n_tokens > 512) and x.n_bytes == len((texts[x.doc_id] or "").encode())
        if name == "op5_pii":
            import hashlib

            parts = [p for p in x.spans.split(",") if p.split(":")[0] in ("email", "ip", "card", "phone")]
            assert x.base_sha256 == hashlib.sha256(",".join(parts).encode()).hexdigest()
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(p.startswith(k + ":") for p in parts) for k in ("email", "ip", "card", "phone")]
        if name == "op7_sentencepiece":
            assert x.round_trip is not False
        if name == "op9_mixing":
            assert 0 <= x.taken <= 3 * x.size


def test_held_out_languages(spark, con):
    known = dict(con.execute("select doc_id, lang from documents where lang is not null").fetchall())
    held = [x for x in queries.QUERIES["op1_language_id"](spark, SF).collect() if x.held_out and x.doc_id in known]
    assert sum(x.lang_pred == known[x.doc_id] for x in held) >= 0.9 * len(held)
