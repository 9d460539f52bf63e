"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from prosegauge.llm import packing, tokens
from prosegauge.llm.common import materialize
from prosegauge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3": ["page_id", "url", "text", "n_chars"],
    "op4": ["query_id", "rank", "vec_id", "score"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "source", "mix_phase", "mix_block", "mix_slot", "mix_place"],
    "op9": ["source", "lang", "tokenizer_version", "docs", "tokens"],
    "op10": ["doc_id", "fingerprint", "component_id"],
}
ROWS = {"op3": "pages", "op1": "documents", "op2": "documents", "op6": "documents", "op7": "documents", "op8": "documents", "op10": "documents"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_query(spark, name):
    op = name.split("_")[0]
    got = QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[op]
    rows = got.collect()
    if op in ROWS:
        assert len(rows) == spark.read.parquet(f"{SF}/{ROWS[op]}.parquet").count()
    modulus = {"op1": (5, 0), "op6": (7, 2), "op7": (4, 2)}.get(op)
    if modulus:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus[0] == modulus[1]) for r in rows)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_what_sql_can_say(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.selectExpr("*", "named_struct('a', doc_id) score", "text _text", "'x' mix_slot")
    columns, sizes = kept.columns, [kept.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(out.collect(), out.schema)
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= ids
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    final = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert not [i for i in final if labels.get(i) == 0]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    encode = tokens.encoder(tokens.default_path()).ids
    assert sum(r["length"] for r in packed) == sum(len(encode(t)) + 1 for t in final.values())
    assert {r["doc_id"] for r in packed} == set(final)


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "12 34", None, None, 5), (None, "Some words without a key.", "en", "a", 9), (4, "Plain words here in a line.", None, "b", 9), (4, "Plain words here in a line.", None, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


def test_sequences_of_the_pipeline_follow_the_mix(spark):
    # all texts of the small source are of one length, so that lengths alone would spread it over all sequences
    rows = [(k, "few words" if k % 10 == 0 else "word " * (k % 97 + 5), "b" if k % 10 == 0 else "a") for k in range(3 * packing.WINDOW)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing_sources"](spark, docs, SF)
    order = [x["doc_id"] for x in mixed.collect()]
    packed = stages["best_fit_packing"](spark, materialize(mixed, "mixed"), SF).orderBy("sequence_id", "offset").collect()
    got = [x["doc_id"] for x in packed]
    assert len(got) == len(rows)
    for first in range(0, len(rows), packing.WINDOW):
        assert set(got[first : first + packing.WINDOW]) == set(order[first : first + packing.WINDOW])
    small = [sum(i % 10 == 0 for i in got[first : first + packing.WINDOW]) for first in range(0, len(rows), packing.WINDOW)]
    assert small[0] > 1.5 * packing.WINDOW / 10 and small[-1] == 0
    unmixed = stages["best_fit_packing"](spark, docs, SF).orderBy("sequence_id", "offset").collect()
    assert [x["doc_id"] for x in unmixed] != got
