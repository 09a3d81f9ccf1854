import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, block int, rest string, score double, component string"


def edge_rows():
    """Null in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "délta", "ε", "x" * 300, "don't", "4.2", "|", "###"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = say(400), say(70)
    texts = [base, base, base + " more", None, "", " \t\n\r\x0b\x0c ", "one", "a b c", "a b c", say(3000), say(30) + " " + passage, say(80) + "\n" + passage + "\n" + passage, "the the " * 80, "line one here\nline one here\n\n \nline one here", "  nbsp word em space  ", "\x00 zero <s> ▁ 😀", passage]
    out = [(k, t, ["en", None, "fr"][k % 3], ["s", "t", None][k % 3], len(t or ""), 7, 1, "r", 0.5, "c") for k, t in enumerate(texts)]
    return [*out, out[0], out[3], (None, base, None, None, None, None, None, None, None, None), (None, None, "en", "s", 0, 1, 1, "", 0.0, "")]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
