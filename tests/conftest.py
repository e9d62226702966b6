import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("LEXSPARK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lexspark.session import get_session
    return get_session("local[4]", shuffle_partitions=4, app="lexspark-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


# Golden mini corpus (FIXTURES.md section 3), after cleaning.
GOLDEN_ROWS = [
    ("dev", 1, 0, 0, "Котка", "котка", "Ncfsi"),
    ("dev", 1, 0, 1, "спи", "спя", "Vpitf-r3s"),
    ("dev", 1, 0, 2, ".", ".", "punct"),
    ("dev", 1, 1, 0, "Куче", "куче", "Ncnsi"),
    ("dev", 1, 1, 1, "лае", "лая", "Vpitf-r3s+1"),
    ("dev", 1, 1, 2, ".", ".", "punct"),
]
TOKEN_SCHEMA = "part string, doc_id bigint, sent_no int, word_no int, word string, lemma string, tag string"


@pytest.fixture(scope="session")
def golden_raw(spark):
    return spark.createDataFrame(GOLDEN_ROWS, TOKEN_SCHEMA)


@pytest.fixture(scope="session")
def golden(golden_raw):
    from lexspark.operators.clean import clean_for_train
    return clean_for_train(golden_raw)
