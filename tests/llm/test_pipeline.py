"""The pipeline's stages against each operator's own brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textaudit.llm import stages
from textaudit.llm.frames import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark):
    """Stage results over the documents and some planted ones, in order."""
    item = documents(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    base = documents(spark, SF).where("length(text) > 600 AND lang = 'en'").orderBy("doc_id").first()
    text = base["text"]
    rows = [(9001, text, "en", "p", 1), (9002, text, "en", "p", 1), (9003, "12 34 ###", "en", "p", 1), (9004, None, None, "p", None), (9005, "", "en", None, 0),
            (9006, f"thereof {item} thereafter ing the of and", "en", "p", 1), (9007, "the of and ther mail me at jo.doe@mail.example.com or +1 (516) 555-2642 ing the", None, "p", 1),
            (None, "the of and to nobody", "en", "p", 1)]
    docs = documents(spark, SF).select(*stages.COLUMNS).unionByName(spark.createDataFrame(rows, SCHEMA))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, SF), "test")
        out.append(docs)
    return item, base, [d.collect() for d in out]


def test_stage_list_and_columns(planted):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "personal data", "mixing sources to target weights"]
    for rows in planted[2][:-1]:
        assert list(rows[0].asDict()) == stages.COLUMNS


def test_language_rejects_only_texts_without_one(planted):
    before, after = planted[2][0], planted[2][1]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {9003, 9004, 9005}
    assert {r["doc_id"]: r["lang"] for r in after}[9007] == "en"


def test_one_of_each_group_stays(planted):
    _, base, (_, before, after, *_) = planted
    ids = [r["doc_id"] for r in after]
    assert len(ids) == len(set(ids)) and None in ids and base["doc_id"] in ids and 9001 not in ids and 9002 not in ids
    from test_simhash import grouped, reference

    own = {r["doc_id"]: reference(r["text"]) for r in before}
    root = grouped(set(own.values()), 2)
    first = {}
    for i in sorted((i for i in own if i is not None), reverse=True):
        first[root[own[i]]] = i
    assert {i for i in ids if i is not None} == set(first.values())


def test_passages_are_cut(planted):
    item, _, (_, _, before, after, *_) = planted
    texts = {r["doc_id"]: r["text"] for r in after}
    assert re.findall(r"\w+", item)[0].lower() not in re.findall(r"\w+", texts[9006].lower()) or item not in texts[9006]
    assert texts[9006].startswith("thereof") and item not in texts[9006] and len(after) == len(before)


def test_personal_data_is_replaced(planted):
    after = planted[2][4]
    texts = {r["doc_id"]: r for r in after}
    assert texts[9007]["text"] == "the of and ther mail me at <EMAIL> or <PHONE> ing the" and texts[9007]["n_chars"] == len(texts[9007]["text"])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in after)


def test_mixing_repeats_whole_documents(planted):
    before, after = planted[2][4], planted[2][5]
    known = {tuple(r) for r in before}
    assert after and all(tuple(r)[:-1] in known for r in after)


def test_run_and_registry(spark):
    import __spark_entry__ as entry

    assert {"pipeline"} | {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*stages.COLUMNS, "copy"] and got.agg(F.count("*")).first()[0] > 0


def test_clashing_and_extra_columns_and_nulls(spark):
    rows = [(i, f"the of and to in a is that for it number {i}", "en", "s", 9, "x", 1, "y") for i in range(8)] + [(None,) * 8, (8, "the", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", c5 string, c6 int, c7 string").toDF(*stages.COLUMNS, "TEXT", "Spans", "Score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == stages.COLUMNS and out.count() >= 8
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == [*stages.COLUMNS, "copy"]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_clashing_ids_are_judged_row_by_row(spark):
    say = lambda w: " ".join(f"{w}{i}x{i * i} {w[::-1]}{i}" for i in range(60))
    rows = [(3, say("alpha"), "en", "a", 1), (7, say("alpha"), "en", "b", 1), (7, say("beta"), "en", "c", 1), (9, say("gamma"), "en", "d", 1),
            (9, say("delta"), "en", "e", 1), (None, say("alpha"), "en", "f", 1), (None, say("omega"), "en", "g", 1), (3, say("alpha"), "en", "a", 1)]
    got = stages.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"].split("0")[0]) for r in got) == sorted(
        [("3", "alpha"), ("7", "beta"), ("9", "gamma"), ("9", "delta"), ("None", "omega")])


def test_run_leaves_only_its_result(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:").rsplit("/", 1)[0]
    before = {f for f in os.listdir(folder) if f.startswith("llm-")}
    got = corpus_pipeline.run(spark, SF)
    after = {f for f in os.listdir(folder) if f.startswith("llm-")} - before
    assert len(after) == 1 and got.count() > 0
