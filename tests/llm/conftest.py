import pytest
from pyspark import cloudpickle

from siltlog.llm import decontaminate, kdtree, naming, neardup, negatives, pii, repair, words

for module in (words, decontaminate, kdtree, naming, neardup, negatives, pii, repair):
    cloudpickle.register_pickle_by_value(module)

# Null, empty and repeated rows, and columns named like those the operators add.
EDGES = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n", None, "a"), (4, "one two", "en", "b"), (5, "one two", "en", "b"),
    (5, "one two", "en", "b"), (6, "Ünïcode wörds häve bytes beyond ascii", "de", "c"), (None, "no id here at all", "en", "c"),
    (7, "x" * 5000, "en", "a"), (8, "word " * 3000, "en", ""),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, 0, 0, 0.5, "y") for r in EDGES]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, shard int, key long, score double, `row` string"
    )


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
