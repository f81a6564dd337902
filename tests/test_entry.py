import __spark_entry__ as E

from locations import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert set(df.columns) == {"model", "accuracy", "precision", "recall", "f1", "roc_auc"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_every_query_plans_on_smoke_data(spark):
    q = E.queries()
    skip = {"logreg_report", "svm_report", "linear_attribution"}
    for name, fn in q.items():
        if name in skip:
            continue
        df = fn(spark, SF_SMALL)
        assert df.columns, name
