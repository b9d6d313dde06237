import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Columns whose names the operators use inside.
CLASHING = ["key", "fp", "rep", "hits", "items", "gone", "k", "score", "n", "_d", "_f", "_l", "prefix", "component_id", "n_lines",
            "first_docs", "piece", "sequence_id", "line", "c", "node", "root", "y", "part", "x", "v"]


def frame(spark, rows, clashing=True):
    """documents(doc_id, text, lang, source, n_chars) from (doc_id, text[, lang]), in 3 partitions."""
    names = CLASHING if clashing else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in names)])
    data = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, *("clash" for _ in names)) for r in rows]
    return spark.createDataFrame(data, schema).repartition(3, "doc_id") if data else spark.createDataFrame([], schema)


#: Nulls, empty and blank texts, repeated rows, equal texts, one very long text.
AWKWARD = [(1, None, "en"), (2, "", None), (3, " \n\t \n", "en"), (4, "alpha beta gamma " * 30_000, "en"), (5, "One.", "fr"), (5, "One.", "fr"),
           (6, "One.", None), (None, "no id here, but words\nand lines", "en"), (None, None, None), (7, "Ünï ça 😀 中文 text\n\nwith lines", "xx"),
           (1 << 40, "the last one", "en"), (-3, "a negative id", "en")]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


def texts(sf, n=None):
    import duckdb
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    return dict(rows[:n] if n else rows)


def python_nodes(df):
    import re
    return re.findall(r"Python\w*|Pandas\w*|Arrow\w*", df._jdf.queryExecution().executedPlan().toString())
