import pytest

#: Documents with each kind of oddity; columns beyond the tables' own have names that operators use.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, k1 string, score string, n string, start string, bucket string, f string, h string, ids string"


@pytest.fixture(scope="session")
def odd_rows():
    prose = " ".join(f"word{i * 7 % 1000} thé{i}" for i in range(3000))
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "Two Words",
        prose,  # long
        prose + " more",
        prose[:900],
        "same text here, again and again " * 20,
        "same text here, again and again " * 20,
        "!!! ??? ...",
        "aaaa" * 600,
        "\u00a0\u2028 é ü 漢字 \U0001f600",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
    ]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", "en", "s1", 5), (None, None, None, None, None), (100, prose[:900], "en", "s0", 1)]
    return [(*r, *["clash"] * 9) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
