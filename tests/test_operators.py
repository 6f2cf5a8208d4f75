"""Operators that SQL cannot check, and guards."""

import importlib.util
import json
import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import images, incremental, joins, knn, learn, simulate, texts
from larkspur.sources import remote, scans
from larkspur.streaming import events as streaming


def test_template_gaps_fail(spark):
    template, values = spark.range(3), spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, p double")
    with pytest.raises(Exception, match="no p for id 2"):
        joins.template_join(template, values, "id", "p").collect()
    got = joins.template_join(template, values, "id", "p", F.lit(9.0)).orderBy("id").collect()
    assert [r.p for r in got] == [1.0, 2.0, 9.0]


def places(n, seed=1):
    import random

    rng = random.Random(seed)
    out = [(i, 25 + rng.random() * 5, -80 - rng.random() * 3, float(i % 11)) for i in range(n)]
    return out + [(n, None, None, 5.0), (n + 1, 60.0, 10.0, 7.0)]


def test_nearest_equals_brute_force(spark):
    rows = places(150)
    x = spark.createDataFrame(rows, "id long, lat double, lon double, y double")
    got = {}
    for r in knn.nearest(x, x, 4, True, cell_degrees=0.3).collect():
        got.setdefault(r.id, set()).add(r.rid)
    lats, lons = sorted(r[1] for r in rows if r[1]), sorted(r[2] for r in rows if r[2])
    mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    at = {r[0]: (r[1] or mid(lats), r[2] or mid(lons)) for r in rows}

    def km(a, b):
        (p, q), (r, s) = at[a], at[b]
        h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
        return round(2 * 6371 * math.asin(math.sqrt(min(1, h))), 9)

    for i in at:
        want = sorted((km(i, j), j) for j in at if j != i)[:4]
        assert got[i] == {j for _, j in want}


def test_nearest_without_reference(spark):
    x = spark.createDataFrame(places(3), "id long, lat double, lon double, y double")
    assert {r.knn for r in knn.mean_target(x, x.limit(0)).collect()} == {0.0}
    one = x.limit(1)
    assert knn.mean_target(one, one, exclude_self=True).first().knn == one.first().y


def test_out_of_fold_scores_every_row_once(spark):
    x = spark.range(300).select("id", (F.col("id") % 3).alias("fold"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("y"))
    out = learn.out_of_fold(x, "fold", 3, ["a"], "y", "p", quantile=0.5)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(300)) and all(r.p is not None for r in rows)
    known = [r for r in rows if r.a is not None]
    assert sum(abs(r.p - r.y) for r in known) / len(known) < 60


def test_risk_needs_two_classes(spark):
    x = spark.range(20).select("id", (F.col("id") * 1.0).alias("a"), F.lit(0).alias("t"))
    assert {r.r for r in learn.fit_predict(x, x, ["a"], "t", "r", kind="risk").collect()} == {0.0}


def test_components_span_the_centred_data(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "id long, v array<double>")
    got = np.array([r.scores for r in learn.standardised_pca(x, "id", "v", 5).orderBy("id").collect()])
    centred = data - data.mean(0)
    assert np.allclose(got @ got.T, centred @ centred.T, atol=1e-6)
    got = np.array([r.scores for r in learn.truncated_svd(x, "id", "v", 5).orderBy("id").collect()])
    assert np.allclose(got @ got.T, data @ data.T, atol=1e-6)


def test_game_is_the_same_for_any_partitioning(spark):
    x = spark.range(400).select("id", (100_000.0 + F.col("id") * 500).alias("value"), (110_000.0 + F.col("id") * 480).alias("pred"))
    game = {**simulate.GAME, "props_per_round": 50}
    one = simulate.play(simulate.draws(x.repartition(1), "id", 2, game=game), simulate.scaled([1.0, 0.8]), game).orderBy("choice", "sim").collect()
    many = simulate.play(simulate.draws(x.repartition(7), "id", 2, game=game), simulate.scaled([1.0, 0.8]), game).orderBy("choice", "sim").collect()
    assert [(r.buys, r.traps) for r in one] == [(r.buys, r.traps) for r in many]
    drawn = simulate.draws(x, "id", 2, game=game).groupBy("sim", "round").agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {(r.n, r.d) for r in drawn} == {(50, 50)} and len(drawn) == 8


def test_ledger_follows_the_capital(spark):
    game = {**simulate.GAME, "start_capital": 1000.0, "max_position": 1.0, "n_rounds": 1}
    rows = [(0, 0, 1.0, 1, 700.0, 1000.0, 500.0, None), (0, 0, 1.0, 2, 900.0, 1000.0, 600.0, None), (0, 0, 1.0, 3, 10.0, 1000.0, 100.0, 900.0), (0, 0, 1.0, 4, 300.0, 1000.0, 100.0, 400.0)]
    x = spark.createDataFrame(rows, "sim int, round int, s double, slot int, value double, pred double, asking double, rival double").drop("s")
    got = simulate.play(x, simulate.scaled([1.0]), game).first()
    # buys 1 for 510, cannot pay 612 for 2, loses 3 to the rival, pays the rival's 400 for 4
    left = 1000 - 510 - 408
    assert (got.buys, got.traps) == (2, 1)
    assert got.roi == pytest.approx((190 + 300 - 408 - left * 0.04) / 10)


def test_tfidf_matches_the_formula(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat dog", "cat cat bird", "Dóg bird cat", None])], "id long, t string")
    got = {(r.id, r.term): r.weight for r in texts.tfidf(docs, "id", "t", min_docs=2, max_share=1.0).collect()}
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in (("cat", 3), ("dog", 2), ("bird", 2))}
    w = {"cat": (1 + math.log(2)) * idf["cat"], "bird": idf["bird"]}
    norm = math.sqrt(sum(v * v for v in w.values()))
    assert got[1, "cat"] == pytest.approx(w["cat"] / norm) and got[1, "bird"] == pytest.approx(w["bird"] / norm)
    assert (2, "dog") in got and not any(i == 3 for i, _ in got)


def test_flags_of_unicode_blanks(spark):
    x = spark.createDataFrame([("cap rate",), (None,)], "t string")
    narrow = [r.desc_investor_language for r in texts.lexical_flags(x, "t").collect()]
    wide = [r.desc_investor_language for r in texts.lexical_flags(x, "t", unicode=True).collect()]
    assert narrow == [0, 0] and wide == [1, 0]


def test_entropy_of_one_type(spark):
    x = spark.createDataFrame([(1, 0, "interior", 1.0)], "listing_id long, image_index long, type string, suffix double")
    r = images.scalars(x).first()
    assert r.type_entropy == pytest.approx(-1e-9, abs=1e-12) and r.suffix_std == 0.0


def test_masked_pool_without_fallback(spark):
    rows = [(1, "interior", [1.0, 3.0]), (1, "satellite", [3.0, 5.0]), (2, "satellite", [7.0, 7.0])]
    x = spark.createDataFrame(rows, "listing_id long, type string, vector array<double>")
    assert {r.listing_id: r.pooled for r in images.masked_pool(x, ["interior"]).collect()} == {1: [1.0, 3.0], 2: [7.0, 7.0]}
    assert {r.listing_id: r.pooled for r in images.masked_pool(x, ["interior"], fallback=False).collect()} == {1: [1.0, 3.0], 2: None}


def test_replies_of_both_shapes(spark):
    rows = [('{"rows":[[7,"yes",null],[8],["x",1,2]]}',), ('{"items":[{"zpid":9,"a":"0.5","llm_b":"no"},{"a":1}]}',), ("broken",), (None,)]
    got = incremental.decode_flags(spark.createDataFrame(rows, "r string"), "r", ["llm_a", "llm_b"]).collect()
    assert sorted((r.zpid, r.llm_a, r.llm_b) for r in got) == [(7, 1.0, 0.0), (9, 0.5, 0.0)]


def test_failed_batches_are_halved():
    def provider(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        return [p.upper() for p in prompts]

    assert remote.ask(provider, ["a", "bad", "c"]) == [("A", "ok"), (None, "failed"), ("C", "ok")]
    assert remote.ask(provider, []) == []


def test_enrich(spark):
    x = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, p string")
    got = remote.enrich(x, "id", "p", lambda ps: [p + "!" for p in ps], size=2).collect()
    assert sorted((r.id, r.reply, r.status) for r in got) == [(i, f"p{i}!", "ok") for i in range(5)]


def test_retries(monkeypatch):
    import io
    import urllib.error

    calls, waits = [], []

    def opened(request, timeout):
        calls.append(request)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return io.BytesIO(b'{"ok": 1}')

    monkeypatch.setattr(remote.urllib.request, "urlopen", opened)
    assert remote.post_json("http://x", {}, sleep=waits.append) == {"ok": 1} and waits == [1, 2]
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(RuntimeError):
        remote.bearer("NO_SUCH_KEY")


def test_scans(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "0.csv").write_text("id,v\n1,NaN\n2,\n3,4.5\n")
    (tmp_path / "a" / "1.csv").write_text("id,v\n4,oops\n5,1\n")
    got = scans.read_chunks(spark, f"{at}/a", "id long, v double").collect()
    assert sorted((r.id, r.chunk_file) for r in got) == [(1, "0.csv"), (2, "0.csv"), (3, "0.csv"), (5, "1.csv")]
    with pytest.raises(Exception):
        scans.read_csv(spark, f"{at}/a", "id long, v double").collect()
    with pytest.raises(FileNotFoundError):
        scans.require(spark, f"{at}/a", f"{at}/b")
    assert scans.keep_best(spark, {"mae": 2.0}, f"{at}/best", "mae")
    assert not scans.keep_best(spark, {"mae": 3.0}, f"{at}/best", "mae")
    assert scans.keep_best(spark, {"mae": 1.0, "n": 2}, f"{at}/best", "mae")
    assert scans.read_record(spark, f"{at}/best") == json.loads('{"mae": 1.0, "n": 2}')
    assert scans.cache_path("c", "train", "GPT-4.1 nano", "v2") == "c/train_gpt_4_1_nano_v2"


def test_images_that_cannot_be_read_are_black(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"no picture")
    read = scans.read_images(spark, f"file://{tmp_path}", side=4)
    if importlib.util.find_spec("PIL") is None:  # a missing decoder is no black picture
        with pytest.raises(Exception, match="No module named 'PIL'"):
            read.collect()
        return
    r = read.first()
    assert r.ok == 0 and bytes(r.pixels) == bytes(48)


def test_chunks_are_written_once(spark, tmp_path):
    x = spark.range(10).withColumnRenamed("id", "k")
    assert scans.write_chunks(x.where("k < 4"), f"file://{tmp_path}/c", "k") == 4
    assert scans.write_chunks(x, f"file://{tmp_path}/c", "k") == 6
    assert scans.write_chunks(x, f"file://{tmp_path}/c", "k") == 0


def test_stream_resumes(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    x = spark.createDataFrame([("2024-01-01 00:00:00", 1, "a", 1.0), ("2024-01-01 00:20:00", 1, "a", 2.0)], "t string, user_id long, event_type string, value double")
    x = x.select(F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    x.write.parquet(f"{tmp_path}/in")
    run = lambda: streaming.run_to_end(spark, f"{tmp_path}/in", schema, lambda s: streaming.windowed_counts(s, "1 hour", "1 day"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [(r.n, r.total) for r in run().collect()] == [(2, 3.0)]
    x.write.mode("append").parquet(f"{tmp_path}/in")
    assert [(r.n, r.total) for r in run().collect()] == [(4, 6.0)]
    assert streaming.sessions(x, "10 minutes", "1 day").count() == 2


def test_best_choice_stays_within_the_budget(spark):
    rows = [(0.0, 1.0, 20.0), (1.0, 9.0, 20.5), (2.0, 2.00001, 20.2), (3.0, 2.0, 20.1)]
    x = spark.createDataFrame(rows, "choice double, roi_mean double, wmape double")
    assert learn.best_within(x, 0.0, 0.25).first().choice == 3.0
    tied = spark.createDataFrame([(0.0, 1.0, 20.0, 5.0), (1.0, 2.0, 20.1, 9.0), (2.0, 2.00001, 20.1, 8.0)], "choice double, roi_mean double, wmape double, q1_mape double")
    assert learn.best_within(tied, 0.0, 0.25).first().choice == 2.0
    assert [r.choice for r in learn.top_within(x, 0.0, 0.5, 2).collect()] == [1.0, 2.0]
    assert learn.pick_strategy({"b": 1.0, "r": 2.0, "f": 2.0}, "b", "r", "f") == "f"
    assert learn.pick_strategy({"b": 1.0, "r": 1.0, "f": 0.5}, "b", "r", "f") == "b"


def test_fuse_fills_gaps_with_training_medians(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    part = spark.createDataFrame([(1, 5.0), (2, 9.0)], "k long, v double")
    got = learn.fuse(base, "k", [part], base.where("k = 1")).orderBy("k").collect()
    assert [r.v for r in got] == [5.0, 9.0, 5.0]


def test_sparse_svd_keeps_distances(spark):
    import numpy as np

    rows = [(i, f"t{j}", float((i * 7 + j * 3) % 5 + 1)) for i in range(8) for j in range(4) if (i + j) % 3]
    got = {r.id: r.scores for r in learn.term_svd(spark.createDataFrame(rows, "id long, term string, weight double"), "id", 4).collect()}
    dense = np.zeros((8, 4))
    for i, t, w in rows:
        dense[i, int(t[1:])] = w
    g = np.array([got[i] for i in range(8)])
    assert np.allclose(g @ g.T, dense @ dense.T, atol=1e-6)


def test_final_chain(spark):
    from larkspur.operators import calibrate

    x = spark.createDataFrame([(1.0,), (2.0,)], "p double")
    got = calibrate.finalise(x, "p", "o", calibrate.Debias("linear", 1.0, 2.0)).collect()
    assert [r.o for r in got] == [3.0, 5.0]
    got = calibrate.finalise(x, "p", "o", scale=0.5).first()
    assert got.o == pytest.approx(math.log1p(0.5 * math.expm1(1.0)))


def test_nearest_of_many_rows_at_one_place(spark):
    """30,000 rows at one place (and others without coordinates, which lie there too) meet as one place, not as 900 million pairs."""
    import time

    x = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, 10.0).alias("lat"), F.when(F.col("id") % 3 > 0, 20.0).alias("lon"), F.col("id").cast("double").alias("y"))
    began = time.time()
    got = {r.id: r.knn for r in knn.mean_target(x, x, 4, exclude_self=True).where("id < 6").collect()}
    folds = {r.id: (r.knn, r.knn_train) for r in knn.fold_safe(x.withColumn("fold", (F.col("id") % 2).cast("int")), "fold", 2, 4).where("id < 6").collect()}
    assert time.time() - began < 60
    want = {i: sum(j for j in range(5) if j != i) / 4 if i < 4 else 1.5 for i in range(6)}
    assert got == want
    assert folds == {i: ((1 + 3 + 5 + 7) / 4 if i % 2 == 0 else (0 + 2 + 4 + 6) / 4, want[i]) for i in range(6)}


def test_nearest_without_k_rows_in_reach(spark):
    few = spark.createDataFrame([(i, float(i), 170.0 * (-1) ** i, float(i)) for i in range(3)], "id long, lat double, lon double, y double")
    got = {r.id: r.knn for r in knn.mean_target(few, few, 20, exclude_self=True).collect()}
    assert got == {0: 1.5, 1: 1.0, 2: 0.5}


def test_fold_safe_fills_by_each_folds_reference(spark):
    """All folds are searched in the same jobs, and equal a search of their own, with medians of their own."""
    rows = [(i, None if i % 5 == 0 else (i * 7 % 40) / 10, None if i % 5 == 0 else (i * 11 % 30) / 10, float(i * i % 17), i % 3) for i in range(90)]
    x = spark.createDataFrame(rows, "id long, lat double, lon double, y double, fold int")
    got = {r.id: (r.knn, r.knn_train) for r in knn.fold_safe(x, "fold", 3, 4).collect()}
    assert len(got) == 90
    for i in range(3):
        for r in knn.mean_target(x.where(x.fold == i), x.where(x.fold != i), 4).collect():
            assert abs(got[r.id][0] - r.knn) < 1e-9


def test_places_of_many_rows_settle_in_their_own_cell(spark, monkeypatch):
    """Copies at a place are its neighbours, so the cells around are not searched; lone rows still find what is near."""
    spots = [(i * 7 % 12 + 0.25, i * 5 % 9 + 0.5) for i in range(36)]
    rows = [(c * 36 + i, *spots[i]) for c in range(18) for i in range(36)] + [(1000 + j, 0.3 + j, 0.4 + j) for j in range(6)] + [(2000, None, None)]
    rows = [(i, lat, lon, float(i * i % 101), i % 7 % 3) for i, lat, lon in rows]
    best, met = knn._best, []
    monkeypatch.setattr(knn, "_best", lambda pairs, most: met.append(pairs.count()) or best(pairs, most))
    x = spark.createDataFrame(rows, "id long, lat double, lon double, y double, fold int")
    got = {r.id: (r.knn, r.knn_train) for r in knn.fold_safe(x, "fold", 3, 4).collect()}
    assert len(got) == len(rows)
    assert met[0] < 2 * 4 * len(spots)  # pairs of places in four groups; about nine a place if the cells around are met at once

    def middle(v):
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    def near(row, group):
        reference = [r for r in rows if r[4] != group]
        known = [r for r in reference if r[1] is not None]
        fill = {True: (middle(sorted(r[1] for r in known)), middle(sorted(r[2] for r in known)))}
        at = lambda r: fill.get(r[1] is None, r[1:3])
        (p, q), each = at(row), []
        for r in reference:
            if r[0] != row[0]:
                a, b = at(r)
                h = math.sin(math.radians(a - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(a)) * math.sin(math.radians(b - q) / 2) ** 2
                each.append((round(2 * 6371 * math.asin(math.sqrt(min(1, h))), 9), r[0], r[3]))
        return sum(y for *_, y in sorted(each)[:4]) / 4

    for row in rows[::23] + rows[-7:]:
        assert abs(got[row[0]][0] - near(row, row[4])) < 1e-9 and abs(got[row[0]][1] - near(row, -1)) < 1e-9


def test_places_times_cells_are_not_broadcast(spark, monkeypatch):
    """Spark's size of the places leaves out the cells around each, so it would send them whole to one task of the reference."""
    best, plans = knn._best, []
    monkeypatch.setattr(knn, "_best", lambda pairs, most: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or best(pairs, most))
    x = spark.createDataFrame([(i, i * 7 % 40 / 10, i * 11 % 30 / 10, float(i)) for i in range(60)], "id long, lat double, lon double, y double")
    assert knn.mean_target(x, x, 4, exclude_self=True).count() == 60
    assert plans and not any("Broadcast" in p for p in plans)


def test_vocabulary_counts_no_pair_of_rare_words(spark, monkeypatch):
    """Terms are those of plain counts, by words with marks too; pairs with a word that is too rare are not counted."""
    import random
    from collections import Counter

    from larkspur.operators import texts as ops

    rng = random.Random(4)
    words = ["the", "café", "Σας", "İzmir", "a_1", "naïve", "x", *[f"w{i}" for i in range(60)]]
    rows = [(i, None if i == 7 else " ".join(rng.choice(words[: 8 + i % 59]) for _ in range(rng.randrange(60)))) for i in range(80)]
    x = spark.createDataFrame(rows, "id long, t string")
    plain = {r.id: list(r.w) for r in x.select("id", ops.tokens(F.col("t")).alias("w")).collect()}
    assert plain == {i: ops.words_of(t) for i, t in rows}
    grams = {i: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for i, w in plain.items()}
    total, df = (Counter(t for g in grams.values() for t in f(g)) for f in (list, set))
    want = sorted((t for t in total if 3 <= df[t] <= 0.98 * 80), key=lambda t: (-total[t], t))
    sent, counted = [], ops._counted
    monkeypatch.setattr(ops, "_counted", lambda *a: sent.append(counted(*a)) or sent[-1])
    for most in (12, 40, 5000):
        assert sorted(r.term for r in ops.vocabulary(x, "t", most=most).collect()) == sorted(want[:most])
    assert sent[1].count() < 150 < sum(" " in t for t in total)
    got = {(r.id, r.term) for r in ops.weigh(x, "id", "t", ops.vocabulary(x, "t", most=40)).collect()}
    assert got == {(i, t) for i, g in grams.items() for t in set(g) & set(want[:40])}
