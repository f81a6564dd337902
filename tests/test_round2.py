"""Cases found in review: exact rankings and counts, label types, CSV round trips, probes,
embedding lookups, TF-IDF features, pairing, local folders."""

import math

import pytest
from pyspark.sql import functions as F

from textaudit import lexicons as L
from textaudit.functions import text as TX
from textaudit.operators import compare as C
from textaudit.operators import features as FE
from textaudit.operators import metrics as M
from textaudit.operators import models as MD
from textaudit.operators import schema as SC
from textaudit.operators import significance as SG
from textaudit.operators import splits as SP
from textaudit.plans import setup as U
from textaudit.sources import files as FS
from textaudit.sources import sinks as SK

PREDS = "doc_id long, model string, y_true int, y_pred int, proba double"


def test_auc_of_scores_close_together(spark):
    rows = [(i, "m", int(i >= 300), 1, 0.5 + i * 1e-8) for i in range(600)]
    df = spark.createDataFrame(rows, PREDS)
    assert M.roc_auc(df).first()["roc_auc"] == 1.0
    assert M.curve_points(df).count() == 600


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_ranked_scores_match_a_plain_count(spark, ranges):
    import random

    r = random.Random(ranges)
    rows = [(i, r.choice("ab"), r.randint(0, 1), 0, r.choice([0.0, 0.1, 0.1 + 1e-12, r.random()])) for i in range(400)]
    got = M.ranked_scores(spark.createDataFrame(rows, PREDS), ranges=ranges).collect()
    for x in got:
        own = [t for t in rows if t[1] == x["model"]]
        assert x["pos_above"] == sum(t[2] == 1 for t in own if t[4] > x["score"])
        assert x["neg_above"] == sum(t[2] == 0 for t in own if t[4] > x["score"])


def test_distinct_counts_near_a_hundred(spark):
    df = spark.createDataFrame([(i % 98, i % 99, i % 101) for i in range(20_000)], "a int, b int, c int")
    assert [r["n_distinct"] for r in SC.column_profile(df).orderBy("ordinal").collect()] == [98, 99, 101]


def test_binary_probe_takes_every_form_of_zero_and_one(spark):
    df = spark.createDataFrame([(True, "1", 0.0, "True", "yes", 2), (False, "0.0", 1.0, "false", "no", 1), (None, None, None, None, None, None)],
                               "a boolean, b string, c double, d string, e string, f int")
    assert SC.binary_columns(df) == ["a", "b", "c", "d"]
    assert [r["is_binary"] for r in SC.column_profile(df).orderBy("ordinal").collect()] == [True, True, True, True, False, False]


def test_gold_label_comes_last_and_as_spelled(spark):
    frame = lambda *names: spark.createDataFrame([("a", "x")], ", ".join(f"`{n}` string" for n in names))
    two = spark.createDataFrame([("a", "x", "y")], "text string, gold_label string, Label string")
    assert SC.loose_resolve(two) == ("text", "Label")
    assert SC.loose_resolve(frame("text", "gold_label")) == ("text", "gold_label")
    other = spark.createDataFrame([("t", str(i), i) for i in range(60)], "text string, GOLD_LABEL string, k int").withColumn("k", F.col("k") % 3)
    assert SC.loose_resolve(other) == ("text", "k")


@pytest.mark.parametrize("kind,values", [("boolean", (True, False)), ("double", (0.0, 1.0)), ("string", ("a", "b")), ("int", (0, 1)), ("date", None)])
def test_stratified_split_of_any_label_type(spark, kind, values):
    import datetime

    values = values or (datetime.date(2024, 1, 1), datetime.date(2024, 1, 2))
    df = spark.createDataFrame([(i, values[i % 4 == 0]) for i in range(100)], f"doc_id long, label {kind}")
    n = {r["label"]: r["n"] for r in SP.stratified_holdout(df, "doc_id", "label", 0.1).where("held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 10 and sorted(n.values()) in ([2, 8], [3, 7])
    split = SP.train_val_test(df, "doc_id", "label", 0.1, 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 10, "val": 9, "train": 81}


TEXTS = ['he said "hi, there"', "line one\nline two", "a\\b\\", "", None, " spaced ", "comma, 'single'", '"', "é x"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, label int")
    SK.write_table(df, str(tmp_path / "t"), "csv")
    back = FS.read_csv(spark, str(tmp_path / "t"), "doc_id long, text string, label int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, label int")
    SK.write_splits(df, df.limit(3), df, str(tmp_path / "s"), fmt="csv")
    back = FS.read_splits(spark, str(tmp_path / "s"))
    assert {n: d.count() for n, d in back.items()} == {"train": 9, "val": 3, "test": 9}
    assert back["train"].columns == ["text", "label"] and back["test"].columns == ["doc_id", "text", "label"]
    assert {r["text"] for r in back["test"].collect()} == set(TEXTS)


def test_prediction_scan_raises_on_what_is_no_prediction(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pred,score\n1,0.5\nmaybe,0.4\n")
    with pytest.raises(Exception, match="not a prediction: maybe"):
        FS.read_predictions(spark, str(tmp_path / "p.csv")).collect()
    (tmp_path / "q.csv").write_text("pred,score\nTrue,x\n0.0,0.4\n")
    assert [tuple(r) for r in FS.read_predictions(spark, str(tmp_path / "q.csv")).collect()] == [(1, None), (0, 0.4)]


def test_swap_table():
    swap = L.gender_swap_map()
    assert swap["he"] == "she" and swap["her"] == "him" and swap["his"] == "hers" and swap["hers"] == "his" and swap["ms"] == "mr"


def test_word_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["x"])], "k int, t array<string>")
    got = {r["k"]: [tuple(c) for c in r["counts"]] for r in TX.with_counts(df, F.col("t")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("é", 1)], 2: [], 3: [("x", 1)]}
    assert "Exchange" not in TX.with_counts(df, F.col("t"))._jdf.queryExecution().toString()


def test_mean_pool_keeps_case_and_punctuation_and_drops_unknown_words(spark):
    docs = spark.createDataFrame([(1, "The the word, word zzz"), (2, "none"), (3, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([("the", [1.0, 0.0]), ("word", [0.0, 2.0]), ("The", [5.0, 4.0])], "vec_id string, embedding array<double>")
    got = {r["doc_id"]: r["vec"] for r in FE.mean_pool_vectors(docs, vectors).collect()}
    assert got == {1: [2.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_every_vector_can_be_met(spark):
    from textaudit.plans.features import _word_id

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id")
    words = spark.range(400_000).select(_word_id(e)(F.col("id").cast("string")).alias("vec_id")).distinct()
    assert e.join(words, "vec_id", "left_anti").count() == 0 < words.join(e, "vec_id", "left_anti").count()


def test_model_features_are_the_tfidf_weights(spark):
    texts = ["good fine day", "bad day day", "good good bad night", None, "fine night and day"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    from pyspark.ml import PipelineModel

    stages = MD.text_features(df, stop_words=["and"], min_df=1)
    vocabulary = next(s for s in stages if hasattr(s, "vocabulary")).vocabulary
    _, weights = FE.tfidf_terms(df, stop_words=["and"], min_df=1)
    want = {(r["doc_id"], r["term"]): r["weight"] for r in weights.collect()}
    for r in PipelineModel(stages).transform(df).select("doc_id", "features").collect():
        own = {(r["doc_id"], vocabulary[i]): round(float(v), 6) for i, v in enumerate(r["features"].toArray()) if v}
        assert own == {k: v for k, v in want.items() if k[0] == r["doc_id"]}
    assert (0, "good fine") in want and (4, "night day") in want


def test_one_shuffle_pairs_like_a_join(spark):
    import random

    r = random.Random(9)
    rows = [(r.randint(0, 30), m, r.randint(0, 1), r.randint(0, 1), r.choice([None, r.random()])) for m in ("a", "b", "ref") for _ in range(40)]
    df = spark.createDataFrame(rows, PREDS)
    got = SG.pair_with_reference(df, "ref")
    a, b = df.where("model != 'ref'"), df.where("model = 'ref'")
    want = a.alias("a").join(b.alias("b"), F.col("a.doc_id") == F.col("b.doc_id")).select(
        "a.model", "a.doc_id", "a.y_true", "a.y_pred", "a.proba", "b.y_pred", "b.proba")
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    n = {m: sum(t[1] == m for t in rows) for m in ("a", "b", "ref")}
    keys = {m: [t[0] for t in rows if t[1] == m] for m in n}
    for x in SG.alignment_check(df, "ref").collect():
        m = x["baseline"]
        assert x["only_baseline"] == sum(k not in keys["ref"] for k in keys[m]) and x["only_reference"] == sum(k not in keys[m] for k in keys["ref"])
        assert x["duplicate_keys"] == len({k for k in keys[m] if keys[m].count(k) > 1})


def test_summary_row_joins_metrics_and_tests(spark):
    df = U.predictions(spark, "/root/testdata/sf0.001")
    got = {r["baseline"]: r for r in C.paired_summary(df, U.REFERENCE).collect()}
    tests = {r["baseline"]: r for r in SG.paired_t_test(df, U.REFERENCE).collect()}
    metrics = {r["model"]: r for r in M.model_metrics(df).collect()}
    assert set(got) == set(tests)
    for m, r in got.items():
        assert r["paired_t_stat"] == tests[m]["t_stat"] and r["baseline_f1"] == metrics[m]["f1"] and r["reference_f1"] == metrics[U.REFERENCE]["f1"]


def test_large_lexicon_is_a_membership_test(spark):
    words = tuple(f"w{i}" for i in range(3000))
    model = MD.RuleModel("big", words, 0.0, 1.0)
    df = spark.createDataFrame([(["w1", "w2999", "x", "w1"],)], "t array<string>")
    p = df.select(model.hits(F.col("t")).alias("h"), model.proba(F.col("t")).alias("p")).first()
    assert p["h"] == 3 and p["p"] == pytest.approx(1 / (1 + math.exp(-0.75)), abs=1e-15)


def test_ids_are_refused_as_classes(spark, monkeypatch):
    monkeypatch.setattr(SP, "MAX_CLASSES", 50)
    df = spark.createDataFrame([(i, i) for i in range(100)], "doc_id long, label int")
    with pytest.raises(ValueError, match="not a class column"):
        SP.stratified_holdout(df, "doc_id", "label", 0.1)


def test_no_plan_gathers_a_limit_in_one_task(spark):
    from textaudit.plans.catalog import QUERIES

    for name in ("corpus_prepare", "stratified_split", "mean_pool", "attribution_topk", "minimal_splits"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "GlobalLimit" not in plan


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from textaudit import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("range_rows", [50, 1_000_000])
def test_ranges_follow_the_data_also_where_scores_crowd(spark, range_rows):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(i, "big" if i % 10 else None, r.randint(0, 1), 0, 0.5 + r.random() ** 40 * (1e-9 if i % 3 else 0.4)) for i in range(2000)]
    df = spark.createDataFrame(rows, PREDS)
    got = M.ranked_scores(df, range_rows=range_rows).collect()
    assert len(got) == len({(t[1], t[4]) for t in rows})
    for x in got[::37]:
        own = [t for t in rows if t[1] == x["model"]]
        assert x["pos_above"] == sum(t[2] == 1 for t in own if t[4] > x["score"])
    dealt = M.score_histogram(df).repartitionByRange(40, "model", F.col("score").desc()).withColumn("p", F.spark_partition_id())
    assert dealt.groupBy("p").count().agg(F.max("count")).first()[0] <= 3 * 50


def test_few_valued_columns_stop_counting(spark):
    df = spark.createDataFrame([(i, i % 3, str(i % 49), str(i % 50), None, "x" * 100 + str(i % 2)) for i in range(3000)],
                               "a int, b int, c string, d string, e string, f string").repartition(5)
    assert SC.few_valued(df, df.columns, 50) == {"a": None, "b": 3, "c": 49, "d": None, "e": 0, "f": 2}
    assert SC.few_valued(df.limit(0), ["a"], 50) == {"a": 0}
    assert SC.loose_resolve(df.withColumnRenamed("a", "text").select("text", "d", "b")) == ("text", "b")


def test_confusion_matrix_refuses_ids(spark):
    df = spark.createDataFrame([(i, "m", i, i, 0.5) for i in range(M.MAX_LABELS + 1)], PREDS)
    with pytest.raises(ValueError):
        M.confusion_matrix(df)
    assert M.confusion_matrix(df.limit(3)).count() == 9


def test_example_lines_round_trip(spark, tmp_path):
    from textaudit.sources import files as FS

    rows = [("biased", None, f"t{i}", i) for i in range(2500)] + [("category", "c1", None, 1), ("category", "c1", "same", 2), ("category", "c1", "same", 2), ("category", "c2", "é\n", 5)]
    df = spark.createDataFrame(rows, "bank string, category string, text string, n int")
    SK.write_example_lines(df.drop("x"), str(tmp_path / "b"), ["n"])
    got = FS.read_example_lines(spark, str(tmp_path / "b")).collect()
    assert sorted((r["ord"], r["text"]) for r in got if r["bank"] == "biased") == [(i, f"t{i}") for i in range(2500)]
    assert sorted((r["ord"], r["text"]) for r in got if r["category"] == "c1") == [(0, None), (1, "same"), (2, "same")]
    assert [tuple(r) for r in got if r["category"] == "c2"] == [("category", "c2", 0, "é\n")]
