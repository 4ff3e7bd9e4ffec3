from __future__ import annotations

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns(spark):
    from stridemap.session import materialize

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == COLUMNS
        assert name == "mixing" or docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == before and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_duplicates_leave_one_row_of_each_group(spark):
    rows = [(3, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "z", "en", "s", 1), (None, "z", "en", "s", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 2), (False, 4), (True, 0), (True, 0)]


def test_stages_pass_columns_of_any_name(spark, odd_rows, odd_labels, tmp_path):
    """Repeated ids and clashing names: what a stage returns are rows of what it took."""
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is there")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    here = {repr(r) for r in odd_rows.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_rows, str(tmp_path))
        assert got.columns == odd_rows.columns and {repr(r) for r in got.collect()} <= here


def test_run_leaves_one_table(spark):
    import os

    from stridemap.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    left = {x for x in set(os.listdir(folder)) - before if not x.startswith("tokens-")}
    assert len(left) == 1


def test_copies_with_an_added_block_go(spark):
    base = [f"w{k}" for k in range(500)]
    longer, least, apart = ([*base, *(f"{mark}{k}" for k in range(n))] for mark, n in (("x", 110), ("y", 124), ("z", 125)))  # five-word similarity 0.818, 0.8 and below
    rows = [(1, base), (2, longer), (3, least), (4, apart)]
    docs = spark.createDataFrame([(k, " ".join(words), "en", "s", 1) for k, words in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == [1, 4]


def test_contaminated_documents_go(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()
    rows = [(1, "before " + item["text"] + " after"), (2, "clean text of its own"), (None, item["text"]), (None, "clean")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()
    assert [r["doc_id"] for r in got] == [2]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_decontamination", "op4_near_dedup", "op6_url_filter"])
def test_query_equals_sql(spark, name):
    import duckdb

    from stridemap.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, want))
