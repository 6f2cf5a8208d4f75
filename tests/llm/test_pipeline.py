"""The corpus pipeline against a plain version, stage by stage, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from larkspur.llm import packing, pii, quality_classifier
from tests.llm import fixtures as X


def test_stages():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "pii", "packing"]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    at = docs
    before = texts(at)
    scored = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels).collect()}
    at = C.quality(spark, at, sf_dir)
    assert at.columns == docs.columns
    after = texts(at)
    assert after == {d: t for d, t in before.items() if scored[d]}

    before, at = after, C.exact(spark, at, sf_dir)
    last = {}
    for d, t in before.items():
        last[t] = max(d, last.get(t, d))
    after = texts(at)
    assert after == {d: t for d, t in before.items() if last[t] == d} and at.columns == docs.columns

    before, at = after, C.near(spark, at, sf_dir)
    parts = X.components(before.items())
    after = texts(at)
    assert after == {d: t for d, t in before.items() if parts[d][1] == d} and at.columns == docs.columns

    before, at = after, C.scrub(spark, at, sf_dir)
    assert at.columns == docs.columns and at.where("n_chars <> length(text)").count() == 0
    after = texts(at)
    assert set(after) == set(before)
    for d, t in before.items():
        spans = X.spans(t)
        if not spans:
            assert after[d] == t or any(f"<{k.upper()}>" in after[d] for k in pii.EXTRA_KINDS)
        assert not X.spans(after[d])

    pieces = C.pack(spark, at, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(after)
    whole = {r.doc_id: 0 for r in pieces}
    for r in pieces:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)


def test_run_chains_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id for r in C.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
    assert [x.split()[0] for x in packing.SCHEMA.split(", ")] == docs.columns


def test_odd_documents_pass_every_stage(spark, tmp_path):
    labels = spark.createDataFrame([(3 * i, i % 2) for i in range(27)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = X.documents(spark).withColumnRenamed("id", "extra")
    given = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    docs = C.quality(spark, docs, str(tmp_path))
    assert docs.columns == C.COLUMNS and texts(docs) == {d: given[d] for d in good}
    docs = docs.unionByName(X.documents(spark).select(*C.COLUMNS).where(~F.col("doc_id").isin(list(good))))  # all cases go on
    last = {}
    for d, t in given.items():
        last[t or ""] = max(d, last.get(t or "", d))
    docs = C.exact(spark, docs, str(tmp_path))
    left = texts(docs)
    assert left == {d: t for d, t in given.items() if last[t or ""] == d}
    docs = C.near(spark, docs, str(tmp_path))
    parts = X.components(left.items())
    left = {d: t for d, t in left.items() if parts[d][1] == d}
    assert texts(docs) == left
    docs = C.scrub(spark, docs, str(tmp_path))
    assert set(texts(docs)) == set(left) and not any(X.spans(t) for t in texts(docs).values())
    pieces = C.pack(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(left)

    docs = X.empty(spark).withColumnRenamed("id", "extra")
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and (name == "packing" or docs.columns == C.COLUMNS)


def test_decisions_are_about_rows(spark, tmp_path):
    long_text = " ".join(f"word{i}" for i in range(60))
    near_text = long_text.replace("word30 ", "other ")
    rows = [(1, "same"), (1, "same"), (1, "else"), (2, "same"), (None, "same"), (5, long_text), (5, near_text), (6, near_text + " end"), (None, None), (None, "")]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    left = C.exact(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        [(1, "else"), (2, "same"), (5, long_text), (5, near_text), (6, near_text + " end"), (0, "")]
    )
    again = C.near(spark, left, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in again) == [0, 1, 2, 5]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = [r.text or "" for r in quality_classifier.classify(docs, labels, keep=["text"]).where("predicted = 1").collect()]
    assert sorted(r.text or "" for r in C.quality(spark, docs, str(tmp_path)).collect()) == sorted(good)


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_warc", "op3_jaccard_join", "op6_exact_dedup", "op8_substring_dedup", "op10_suffix_dedup"])
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    listed = ", ".join(columns)
    want = con.sql(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_digest_queries_of_the_contract(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in entry.queries()["op4_pii"](spark, sf_dir).collect():
        base = X.spans(docs[r.doc_id])
        assert r.base_sha256 == X.sha(",".join(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS]
        assert set(base) <= set(filter(None, r.spans.split(",")))
    for r in entry.queries()["op9_quality_rules"](spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == X.word_stats(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    got = entry.queries()["op1_quality_classifier"](spark, sf_dir)
    assert got.where(F.col("held_out") != (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)).count() == 0
    got = {r.doc_id: r for r in entry.queries()["op5_sentencepiece"](spark, sf_dir).collect()}
    assert all(got[d].round_trip and got[d].decoded_sha256 == X.sha(t) for d, t in docs.items())
