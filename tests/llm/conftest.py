import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, fp string, component_id string, ids string, n_tokens string, target string, spans string"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null ids, sources and languages, repeated rows, a long text, and columns that clash."""
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "Ünï çödé " * 5, "word " * 20_000, "x" * 30_000, "\0\x01 odd", "日本語 の 文"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}") for k, t in enumerate(texts)]
    rows += [(100 + k, prose(rng, 60), "en", "s1") for k in range(12)]
    rows += [rows[-1], rows[-1], (None, "no id here at all", "en", "s1"), (None, None, None, None), (7, "same id, other text", "en", None)]
    return spark.createDataFrame([(*r, None, 5, True, "c", "c", "c", "c", "c", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
