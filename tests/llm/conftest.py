import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in each column, blanks, copies, a very long text, odd characters.
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", None, None, None), (None, "one two three four five", "en", "s", 23), (None, None, None, None, None),
    (4, "same text " * 40, "en", "s", 400), (5, "same text " * 40, "en", "s", 400), (5, "same text " * 40, "en", "s", 400), (6, "word%d " * 3 + " ".join(f"w{k}" for k in range(30_000)), "xx", "s", 1),
    (7, "Ünïcödé 日本語 🙂 ﬁ <|endoftext|> it's é x y", "de", "s", 9), (8, "x" * 50_000, "en", "s", 50_000), (-9, "All rights reserved.", "en", "s", 20),
]


VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
ODD_VECTORS = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (None, None, None)]
ODD_TURNS = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, None, None, None), (None, None, None, None), (2, 5, "", ""), (3, 1, "user", "y" * 100_000)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder like a table folder, whose documents are odd and carry columns that clash with results."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame(ODD, COLUMNS)
    for c in ("size", "score", "shard", "slot", "piece", "length", "fp", "kept", "start", "license", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{path}/documents.parquet")
    for name, rows, schema in (("embeddings", ODD_VECTORS, VECTORS), ("conversations", ODD_TURNS, TURNS)):
        df = spark.createDataFrame(rows, schema)
        for c in ("kept", "n_links", "component_id", "audit", "gone", "node", "tile"):
            df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
