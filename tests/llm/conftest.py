import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textmaker import prose  # noqa: E402


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, secrets, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 45)
    rows = []
    for k in range(n):
        text = prose(rng, rng.choice([1, 3, 6, 25, 60, 150, 400]))
        if k % 10 == 3:
            text = rows[k - 2][1] or "x"
        elif k % 10 == 4:
            words = (rows[k - 3][1] or "x").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif k % 10 == 5:
            text = prose(rng, 12) + " " + passage + " " + prose(rng, 12)
        elif k % 10 == 6:
            text += f" password=hunter{k}hunter AKIA{'ABCDEFGHIJKLMNOP'} token = \"{'0123456789abcdef' * 2}\" Tokentoken:é{k}"
        elif k % 10 == 7:
            text = (prose(rng, 9) + "\n") * 6
        rows.append((k * 3 - 20, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", None]), len(text)))
    rows += [(500, None, "en", "a", None), (501, "", None, None, 0), (502, " \t\n", "en", "a", 3), (503, "ßé😀 " * 30, "de", "ç", 120), (503, "ßé😀 " * 30, "de", "ç", 120), (None, "no id here", "en", "a", 10)]
    rows.append((600, prose(rng, 20_000), "en", "a", None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves, as extra columns.
CLASHES = "id rid row k c g m p u sk size block shard key draws hash base spans cell fp h a b n sig node component _id _t cuts new kept target words".split()


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
