import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, score string"


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, short, long, equal, near-equal and repeated texts; extra columns have the operators' own names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(70)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base.replace(base.split()[150], "other", 1), prose(120) + "\n" + passage + " " + prose(50), passage + "\n" + prose(90), prose(20_000), "é漢字🎉 " * 60 + passage, "ONE", "x" * 5000, "A b\x0bC\x1cd"]
    rows = [(i * 3, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3] if i % 4 else "c", len(t or ""), "k", i, "s") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, "en", "a", 1, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
