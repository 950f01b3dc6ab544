import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, class_id int"


@pytest.fixture
def docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""

    def make(rows):
        full = [(*r, *[None] * (7 - len(r))) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def words(seed: int, n: int) -> list[str]:
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
