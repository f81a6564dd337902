"""Poisson replication."""

import math

import pytest
from pyspark.sql import functions as F

from textaudit.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy int"


def test_distribution_inverts(table):
    for rate in (0.0, 0.01, 1.0, 7.5, 900.0):
        cdf = table([(rate,)], "r double").select(mixing.distribution(F.col("r")).alias("c")).first()["c"]
        p, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(-rate + (k * math.log(rate) if rate else (0 if not k else -math.inf)) - math.lgamma(k + 1))
            p.append(total)
        assert cdf == pytest.approx(p, abs=1e-9) and cdf[-1] > 1 - 1e-9


def test_shares_and_determinism(table):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}", 9) for i in range(6000)]
    got = mixing.mix(table(rows, SCHEMA), {"hot": 2.0}, default=1.0, total=12_000).collect()
    n = {}
    for r in got:
        n[r["source"]] = n.get(r["source"], 0) + 1
    sources = {r[2] for r in rows}
    assert all(abs(n[s] - 12_000 * (2 if s == "hot" else 1) / (len(sources) + 1)) < 250 for s in sources)
    again = mixing.mix(table(rows[::-1], SCHEMA), {"hot": 2.0}, default=1.0, total=12_000).collect()
    assert sorted(got) == sorted(again)
    copies = {}
    for r in got:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    order = [r["doc_id"] for r in got]
    assert order != sorted(order) and abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.05


def test_edges(table):
    rows = [(None, None, None, 1), (None, None, None, 1), (1, "", "", 1), (2, "a" * 50_000, "x", 1), (2, "a" * 50_000, "x", 1)]
    got = mixing.mix(table(rows, SCHEMA), total=200).collect()
    assert {r["source"] for r in got} == {None, "", "x"}
    assert sum(r["source"] == "x" for r in got) % 2 == 0  # equal ids, equal numbers
    assert mixing.mix(table([], SCHEMA)).collect() == []
    assert mixing.mix(table(rows, SCHEMA), {"x": 0.0, "": 0.0}, total=100).where("source = 'x'").collect() == []


def test_joined_instead_of_broadcast(table, monkeypatch):
    rows = [(i, "t", f"s{i % 5}", 1) for i in range(300)]
    whole = sorted(mixing.mix(table(rows, SCHEMA)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(table(rows, SCHEMA)).collect()) == whole


def test_rows_without_an_id_are_drawn_one_by_one(table):
    rows = [(None, f"t{i}", "hot", 1) for i in range(4000)] + [(None, "same", "hot", 1)] * 3000 + [(i, "t", f"s{i % 9}", 1) for i in range(900)]
    got = mixing.mix(table(rows, SCHEMA), total=20_000).collect()
    hot = [r for r in got if r["source"] == "hot"]  # rate 2000 / 7000: one common number, 0.53, would drop them all
    assert abs(len(hot) - 2000) < 200 and abs(sum(r["text"] == "same" for r in hot) - 2000 * 3 / 7) < 150
    assert sorted(got, key=str) == sorted(mixing.mix(table(rows[::-1], SCHEMA), total=20_000).collect(), key=str)


def test_one_id_for_many_rows_is_shuffled(table):
    rows = [(7, "same", "a", 1)] * 6000 + [(7, f"t{i}", "a", 1) for i in range(2000)]
    mixed = mixing.mix(table(rows, SCHEMA), {}, total=24_000)
    sizes = [r["count"] for r in mixed.repartition(1).groupBy("text").count().collect()]
    assert sum(sizes) % 8000 == 0 and len(set(sizes) - {6000 * sum(sizes) // 8000}) == 1  # equal ids, equal numbers
    texts = [r["text"] for r in mixed.collect()]
    runs = sum(a != b for a, b in zip(texts, texts[1:])) / len(texts)
    assert runs > 0.3  # 7/16 when shuffled, 2000/8000 when equal rows are side by side


def test_large_rates_are_searched_from_the_mode(table):
    rates = (64.5, 200.0, 5_000.0, 500_000.25, 5e7)
    us = (1e-9, 0.01, 0.4, 0.5, 0.6, 0.99, 1 - 1e-9)
    frame = table([(r, u) for r in rates for u in us], "r double, u double").withColumn("top", mixing.at_mode(F.col("r")))
    for row in frame.select("r", "u", mixing.searched(F.col("u"), F.col("r"), F.col("top")).alias("k")).collect():
        r, u, k = row
        p = math.exp(-r + k * math.log(r) - math.lgamma(k + 1))
        c, j = 0.0, k
        while j >= 0 and p > 1e-18:
            c, p, j = c + p, p * j / r, j - 1
        assert c >= u - 1e-6 and c - math.exp(-r + k * math.log(r) - math.lgamma(k + 1)) < u + 1e-6


def test_a_stray_source_has_no_table(table):
    rows = [(i, "t", "big", 1) for i in range(100)] + [(1000, "t", "stray", 1)]
    got = mixing.mix(table(rows, SCHEMA), total=200_000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 100_000) < 2_500 for r in got) and len(got) == 2
    sources, *_ = mixing.rates(table(rows, SCHEMA), None, "source", 1.0, 1e10)
    assert sources.agg(F.max(F.coalesce(F.size("_cdf"), F.lit(0)))).first()[0] <= 200


def test_copies_of_one_document_are_dealt_in_blocks(spark, table):
    from textaudit.llm.frames import save

    rows = [(i, "t", "big", 1) for i in range(50)] + [(1000, "stray text", "stray", 1), (None, "other", None, 1)]
    mixed = mixing.mix(table(rows, SCHEMA), total=150_000)
    n = {r["source"]: (r["n"], r["low"], r["high"], r["d"]) for r in mixed.groupBy("source").agg(
        F.count("*").alias("n"), F.min("copy").alias("low"), F.max("copy").alias("high"), F.countDistinct("copy").alias("d")).collect()}
    assert all(abs(n[s][0] - 50_000) < 1500 for s in ("big", "stray", None))
    for s in ("stray", None):  # every copy once
        assert n[s] == (n[s][0], 1, n[s][0], n[s][0])
    drawn = table([(7, 40_000, 40_000.0)], "_h long, _k int, _rate double").withColumn("_same", F.lit(0))
    spread = save(mixing.repeated(drawn.repartition(1), 40_000.0).withColumn("task", F.spark_partition_id()), "test")
    assert spread.count() == 40_000 and spread.select("task").distinct().count() > 1


def test_statement_follows_rates_and_null_sources(table, tmp_path):
    import duckdb

    from textaudit.llm.queries import ORACLE

    rows = [(i, f"t{i}", "en", "big", 3) for i in range(3000)] + [(5000, "x", "en", "rare", 1), (5001, "y", None, None, None)]
    df = table(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(ORACLE["op10_mixing"]).fetchall()
    got = [tuple(r) for r in mixing.mix(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[-1] for r in got) > 200
