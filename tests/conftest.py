import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pactspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_pages(spark):
    import corpus

    from pactspark import schemas

    return spark.createDataFrame(corpus.pages(), schemas.PAGES)


@pytest.fixture(scope="session")
def reviewed(spark, corpus_pages):
    import corpus

    from pactspark.plans import review

    kinds = spark.createDataFrame([(v, k) for k, v in corpus.DOC_IDS.items()], "doc_id bigint, business_type string")
    return review.review(review.from_pages(corpus_pages, kinds), keep_tables=True)
