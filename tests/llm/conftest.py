import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          # names that operators use inside
          "fp bigint, key string, low string, slot int, shard string, rank int, score double, ids string, file string, base double, quality int")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark, tmp_path_factory):
    from lakeops.llm import common
    common.ship(spark)


@pytest.fixture
def frame(spark):
    """Documents of (doc_id, text[, lang]) with extra columns of clashing names, all null."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) + (None,) * 11 for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def edge(frame):
    """Nulls, empty texts, ties, repeated rows, a very long text."""
    long_text = " ".join(f"word{k % 977}" for k in range(40_000))
    return frame([(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (4, "Same text of five words", "en"), (5, "Same text of five words", "en"),
                  (5, "Same text of five words", "en"), (None, "no id here", None), (None, None, None), (6, long_text, "de"), (7, "ÀÉ 123 😀", "fr")])
