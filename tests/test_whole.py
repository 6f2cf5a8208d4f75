"""Registered queries do the whole job: no prefixes, no filters by id, the reference's sizes."""

import json

from pyspark.sql import functions as F

from larkspur.functions.exprs import uniform
from larkspur.operators import learn, simulate
from larkspur.plans import incremental, registry

registry.load()


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_texts_are_whole(spark, tmp_path):
    late = "x " * 500 + "fixer-upper on the waterfront"
    sf = documents(spark, tmp_path, [(41, late), (9, late), (19, None)])  # phrase 9 has no cue
    flags = {r.doc_id: r for r in registry.QUERIES["lexical_flags"](spark, sf).collect()}
    assert all(flags[k].desc_fixer_tlc and flags[k].desc_waterfront_estate for k in (41, 9)) and not any(flags[19][1:])
    length = {r.doc_id: r.n for r in registry.QUERIES["text_length_truncate"](spark, sf).collect()}
    assert length == {41: 1075, 9: 1043, 19: 0}
    cues = {r.doc_id: (r.cheap_cues, r.premium_cues) for r in registry.QUERIES["cue_score"](spark, sf).collect()}
    assert cues[9] == (1, 1) and cues[19] == (0, 0)


def test_bundle_reads_whole_texts(spark, tmp_path):
    late = "x " * 500 + "fixer-upper on the waterfront"
    sf = documents(spark, tmp_path, [(9, late), (19, late), (29, late), (39, "plain"), (49, None)])
    got = {r.doc_id: (r.cheap_cues, r.premium_cues) for r in registry.QUERIES["text_bundle_svd"](spark, sf).collect()}
    assert got == {9: (1, 1), 19: (1, 1), 29: (1, 1), 39: (0, 0), 49: (0, 0)}


def test_draws_are_the_smallest_keys(spark):
    x = spark.range(5000).select("id", (F.col("id") + 1000.0).alias("value"))
    game = {**simulate.GAME, "props_per_round": 20}
    got = {(r.sim, r["round"], r.slot): r.id for r in simulate.draws(x, "id", 2, game=game).collect()}
    for sim in range(2):
        for turn in range(4):
            key = uniform(F.lit(0), F.lit(sim), F.lit(turn), F.col("id"), F.lit("draw"))
            want = [r.id for r in x.orderBy(key, "id").limit(20).collect()]
            assert [got[sim, turn, i + 1] for i in range(20)] == want
    assert len(got) == 2 * 4 * 20


def test_games_and_grid_of_the_reference(spark, sf_dir, monkeypatch):
    found = registry.QUERIES["auction_sim"](spark, sf_dir).agg(F.count("sim"), F.count_distinct("sim")).first()
    assert tuple(found) == (400, 400)
    seen, draws, errors = [], simulate.draws, learn.choice_errors
    monkeypatch.setattr(simulate, "draws", lambda x, id_, sims, **more: (seen.append(sims), draws(x, id_, sims, **more))[1])
    monkeypatch.setattr(learn, "choice_errors", lambda x, actual, choices: (seen.append(len(choices)), errors(x, actual, choices))[1])
    registry.QUERIES["scale_sweep"](spark, sf_dir)
    registry.QUERIES["edge_grid_simulated"](spark, sf_dir)
    assert seen == [400, 300, 1 + 10 * 4]


def test_prompts_hold_the_text_as_it_is(spark, tmp_path):
    rows = [(1, 'é "quoted"\n\ttab \\ 42 € \U0001f600 ' + "long " * 400), (2, None), (3, "x" * 1399 + "yz"), (17, "")]
    got = {r.batch: r.prompt for r in incremental.prompts(spark, documents(spark, tmp_path, rows)).collect()}
    items = [{"zpid": k, "description": (t or "")[:1400]} for k, t in rows]
    dump = lambda x: json.dumps({"items": x}, ensure_ascii=False, separators=(",", ":"))
    assert got == {0: dump(items[:3]), 1: dump(items[3:])}


def test_components_of_the_reference(spark, sf_dir):
    for name in ("pca_scores", "svd_scores"):  # 128 and 256, but the vectors have 64 columns
        assert [r[0] for r in registry.QUERIES[name](spark, sf_dir).select(F.size("scores")).distinct().collect()] == [64]


def test_keys_of_many_ids_are_those_of_md5():
    import hashlib

    from larkspur.operators import hashed_keys

    ids = [str(7 * i).encode() for i in range(4000)] + [b"12345678901234567890"] * 3
    for prefix in (b"0-3-1-", b"0-42-1-", b"0-312-1-", b"0-1234-1-", b"y" * 50):
        got = {}
        for places, part in hashed_keys.groups(ids, b"-draw"):
            got.update(zip(places.tolist(), part.first_words(prefix).tolist()))
        assert [got[i] for i in range(len(ids))] == [int(hashlib.md5(prefix + x + b"-draw").hexdigest()[:8], 16) for x in ids]


def test_draws_make_no_row_for_a_key_that_is_not_low(spark):
    x = spark.range(20_000).select("id", (F.col("id") + 1000.0).alias("value"))
    drawn = simulate.draws(x, "id", 5)
    assert "Generate" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert drawn.count() == 5 * 4 * 250


def test_bundle_makes_its_vocabulary_once(spark, tmp_path):
    """The vocabulary of a fit is a stored table, and what applies it does not read the fitted texts again."""
    from larkspur.operators import bundle

    sf = documents(spark, tmp_path, [(i, "alpha beta gamma" if i % 2 else "beta delta alpha") for i in range(8)])
    x = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = bundle.TextBundle.fit(x, "doc_id", "text", k=2)
    assert not any("documents.parquet" in f for f in fitted.vocabulary.inputFiles())
    assert {r.term for r in fitted.vocabulary.collect()} >= {"gamma", "delta"}
