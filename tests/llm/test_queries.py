"""The registered queries over the driver's smallest tables: SQL where there is any, whole results otherwise."""

import hashlib
import os
import zlib

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

from cairn.llm import queries as llm  # noqa: E402

COLUMNS = {
    "op1_segment_edit_join": "doc_id n_lines n_removed kept_sha256",
    "op2_candidate_boosting": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_nn_descent": "vec_id n_links component_id kept",
    "op5_lexicon_automata": "doc_id held_out score predicted",
    "op6_min_bin_slack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_page_differencing": "page_id url text n_chars",
    "op8_cover_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_token_group_join": "doc_id n_shingles component_id",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_whole_tables(spark, name):
    df = llm.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    table = {"4": "embeddings", "7": "pages"}.get(name[2:].split("_")[0], "documents")
    keys = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(df.columns[0]).collect())
    got = [r[0] for r in df.select(df.columns[0]).collect()]
    assert sorted(set(got) if name.startswith("op6") else got) == keys


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    expected = db.execute(llm.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(expected.fetchall())


def test_round_trip_digest_and_fold(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in llm.queries()["op3_bpe_codec"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in llm.queries()["op5_lexicon_automata"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
