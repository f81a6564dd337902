"""Steps that are cut before they grow: limits in batches, classes of words, gathered pieces,
terms added up in tasks, features computed once."""

import math

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from textaudit.functions import text as TX
from textaudit.operators import attribution as AT
from textaudit.operators import features as FE
from textaudit.operators import newton as NW
from textaudit.operators import ranks as RK
from textaudit.operators.models import RuleModel
from textaudit.plans import text as PT


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_equal_a_window_and_batches_are_limited(spark):
    rows = [(k, s, p) for p, (k, s) in enumerate([(1, .5), (1, None), (None, .2), (1, .9), (2, math.nan), (2, .1), (None, .7), (1, .5), (2, .3), (None, None), (1, -.1)])]
    for own in (rows, [r for r in rows if r[1] is None or not math.isnan(r[1])]):
        df = spark.createDataFrame(own, "k INT, s DOUBLE, p INT").coalesce(1)
        w = Window.partitionBy("k").orderBy(F.col("s").desc(), F.col("p"))
        want = df.withColumn("rank", F.row_number().over(w)).where("rank <= 2").collect()
        assert sorted(map(str, RK.first_rows(df, "k", [("s", True), ("p", False)], 2).collect())) == sorted(map(str, want))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 1, 1, None, None]), pa.array([.1, .2, .3, .3, None, .5]), pa.array([5, 4, 3, 2, 1, 0])], names=["k", "s", "p"])
    got = next(RK._first_in_batches("k", [("s", True), ("p", False)], 1)([batch]))
    assert got.to_pydict() == {"k": [2, 1, None], "s": [.2, .3, .5], "p": [4, 2, 0]}


def test_weights_of_attribution_topk_are_joined_without_a_shuffle_of_words(spark, tmp_path):
    spark.createDataFrame([(1, "The men of that age, the END"), (2, None)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = PT.attribution_topk(spark, str(tmp_path))
    assert "LocalTableScan" in plan_of(got) and "SortMergeJoin" not in plan_of(got)  # its size is known
    assert [(r["rank"], r["word"]) for r in got.where("doc_id = 1").orderBy("rank").collect()][0][0] == 1


def test_merged_rows_by_one_grouping(spark):
    rows = [(1, 3, "##d", .4), (1, 0, None, .9), (1, 1, "##x", .5), (1, 2, "ab", None), (1, 4, None, .2), (1, 5, "##", .3),
            (2, 0, "w", None), (None, 0, "##", 1.0), (None, 1, "z", 2.0), (3, 0, None, 1.0)]
    p = spark.createDataFrame(rows, "doc_id LONG, pos INT, piece STRING, score DOUBLE").repartition(3)
    merged = AT.merge_subwords(p)
    assert "Window" not in plan_of(merged)
    got = {(r["doc_id"], r["word_pos"], r["word"], r["score"]) for r in merged.collect()}
    # a word's score is the mean of the scores that are given
    assert got == {(1, 0, "x", .5), (1, 1, "abd", .3), (2, 1, "w", None), (None, 1, "z", 2.0)}


def test_pieces_are_cut_by_characters(spark):
    d = spark.createDataFrame([(1, "Äöüßxé aé中文 \U0001d400bcd"), (2, None), (3, "")], "doc_id LONG, text STRING").coalesce(1)
    got = {r["doc_id"]: [tuple(p) for p in r["p"]] for r in d.select("doc_id", PT._piece_structs().alias("p")).collect()}
    assert [p for p, _ in got[1]] == ["äöü", "##ßxé", "aé中", "##文", "\U0001d400bc", "##d"]
    assert [s for _, s in got[1]] == [((31 * p + 17 * j) % 19 - 9) / 10 for p in range(3) for j in range(2)]
    assert got[2] == got[3] == []


def test_occlusion_scores_few_words_a_document(spark):
    rule = RuleModel("r", ("the", "a"), -1.0, 5.0)
    words = [f"w{i:03d}" for i in range(300)] + ["the"] * 7 + ["a"] + ["w007"] * 3 + ["w123"] * 3
    counts = TX._counted(False)(pa.array([words, None, []], pa.list_(pa.string())))
    few = AT._least_words(["the", "a"], 10)(counts)
    assert [len(x) if x is not None else None for x in few.to_pylist()] == [14, None, 0]
    got = AT.occlusion_attribution(spark.createDataFrame([(1, " ".join(words))], "doc_id LONG, text STRING"), rule).orderBy("rank").collect()
    prob = lambda h, n: 1 / (1 + math.exp(1 - 5 * h / n))
    n, known = len(words), {"the": 7, "a": 1}
    want = sorted((-abs(round(round(prob(8, n), 6) - round(prob(8 - known.get(w, 0), n - words.count(w)), 6), 6)), w) for w in set(words))[:10]
    assert [r["word"] for r in got] == [w for _, w in want]
    assert all(abs(abs(r["delta"]) + d) < 2e-6 for r, (d, _) in zip(got, want))


def test_terms_are_added_up_in_the_task(spark):
    kind = pa.list_(pa.struct([("word", pa.string()), ("c", pa.int64())]))
    batches = [pa.RecordBatch.from_arrays([pa.array([[{"word": "a", "c": 2}, {"word": "b", "c": 1}], None, [{"word": "a", "c": 3}]], kind)], names=["counts"])] * 2
    got = sorted(zip(*[x for x in pa.Table.from_batches(FE._batch_terms(iter(batches))).to_pydict().values()]))
    assert got == [("a", 4, 10), ("b", 2, 2)]


def test_features_of_a_fit_are_computed_once(spark):
    from pyspark.ml.functions import array_to_vector
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def made(x):
        seen.add(1)
        return [float(x), 1.0]

    rows = spark.createDataFrame([(i, i % 2, i) for i in range(40)], "id INT, label INT, x INT").repartition(2)
    fit = NW.fit_linear(rows.select("label", array_to_vector(made("x")).alias("features")), "logistic")
    assert seen.value == 40 and len(fit.coefficients) == 2
