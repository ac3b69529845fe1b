import pandas as pd
import pytest


@pytest.fixture(scope="session")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def edge_documents(spark):
    """Null id, null, empty, blank and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (1, "plain text of some words here", "en", 0.5), (1, "plain text of some words here", "en", 0.5), (2, None, "en", None), (3, "", None, 0.1), (4, " \t\n", "en", 0.1),
        (5, long, "en", 0.1), (None, "plain text of some words here", "en", 0.2), (None, None, None, None), (6, "é世\U0001f600 \x00 İ mixed", "fr", 0.3), (7, "1234 5678 +1 9 @", "en", 0.3),
    ]
    names = "doc_id bigint, text string, lang string, score double"
    df = spark.createDataFrame(rows, names)
    for clash in ("id", "n", "sig", "kept", "component_id", "start", "length", "offset", "row", "predicted", "lang_pred", "shard", "slot", "spans"):
        df = df.selectExpr("*", f"'x' AS {clash}")
    return df


@pytest.fixture(scope="session")
def edges(spark):
    return edge_documents(spark).cache()


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
