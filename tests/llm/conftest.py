import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Nulls in every column, empty and blank texts, repeated rows, a long text, columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def spark():
    from tripleselect.llm.common import ship_package
    from tripleselect.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (2, None, None, None, None),
            (None, "no id here at all", "en", "s1", 3), (3, "", "de", "s2", 0), (4, " \n\t ", "de", None, 4),
            (5, LONG, "fr", "s3", len(LONG)), (6, "über straße\nüber straße\nein wort", "de", "s2", 30)]
    return spark.createDataFrame([r + (7, 9, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
