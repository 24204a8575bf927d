import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents, and those that every operator must bear: null, empty, spaces, one word, very long, repeated."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
    odd = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, " \t\n ", "en", "src1", 4), (9004, "one", "en", None, 3), (9005, "ONE", "en", "src1", 3), (9006, long, "en", "src2", len(long)), (9007, long + " end", "en", "src2", len(long)), (9008, rows[0][1], "en", "src3", 1), (9009, "É é", "fr", "src3", 3), (9010, "é é", "fr", "src3", 3)]
    return rows + odd


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
