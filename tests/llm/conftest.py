import pytest
from pyspark.sql import functions as F

CLASHING = "row id score rank length kept version class key ids doc pos keep h1 h2 salt base spans digest content n_tokens e1 f_length lang_pred"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with every sort of null, empty, long, tied and repeated content, and clashing columns."""
    shared = "this very line stands in many documents of the set"
    prose = " ".join(f"word{i % 37} other{i % 11}" for i in range(60))
    texts = [
        (1, f"Alpha beta gamma delta epsilon zeta eta theta.\n{shared}\nthe end of it"),
        (2, f"{shared.upper()}  \nsomething else entirely here, in this one"),
        (3, f"x\n\t{shared}\r\n{shared}"),
        (4, None),
        (5, ""),
        (5, ""),
        (6, "   \n\t "),
        (7, prose),
        (8, prose + " tail"),
        (9, prose),
        (9, prose),
        (10, "mail me at a.b@c.example.org or +1 (743) 555-3824, 152.143.123.131; card 4785 3805 9239 1139!"),
        (11, "é à ü naïve Straße 漢字 😀 e\u0301"),
        (12, "long " * 30000 + "end"),
        (13, "<|endoftext|> and  two  spaces \n\n and\ttabs <|startoftext|>"),
        (14, "one two"),
        (15, "one two"),
        (None, prose),
        (None, None),
        (16, "12 345 !!"),
    ]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "de"))
    rows = rows.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("bigint"))
    return rows.withColumns({c: F.lit("clash") for c in CLASHING.split()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
