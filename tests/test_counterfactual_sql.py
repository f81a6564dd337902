"""The rewrite operator against its SQL statement on sentences that exercise every rule."""

import duckdb
import pandas as pd

from textaudit.operators import counterfactual as CF
from textaudit.plans import text as PT

SENTENCES = [
    "The female secretary was very emotional today.",
    "Women should be nurses because they are compassionate.",
    "He needs to be more aggressive in meetings",
    "The meeting was during lunch.",
    "Men are naturally better engineers than women.",
    "She is too emotional to lead the business.",
    "The candidate gave a decisive presentation.",
    "Critical thinking is valuable across all professional domains.",
    "Her brother is the best teacher, HE said.",
    "nothing here",
    "",
]


def test_counterfactuals_match_sql(spark):
    pdf = pd.DataFrame({"doc_id": list(range(len(SENTENCES))), "text": SENTENCES})
    con = duckdb.connect()
    con.register("documents_df", pdf)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents_df")
    sql_rows = {(int(r[0]), int(r[1]), r[2]) for r in con.execute(
        "SELECT doc_id, rank, suggestion FROM (" + PT._cf_sql() + ")").fetchall()}
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id LONG, text STRING")
    spark_rows = {(r["doc_id"], r["rank"], r["suggestion"])
                  for r in CF.counterfactuals(df, weights=PT.QUERY_WEIGHTS).collect()}
    assert spark_rows == sql_rows
    assert len(spark_rows) >= 3 * len(SENTENCES) - 3
