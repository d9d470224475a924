import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt long, key string, maybe string"


def rows_of(texts):
    """Rows with further columns whose names clash with those that operators use inside."""
    return [(i, t, "en", "s", len(t or ""), i, "k", None) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and white-space texts, a very long text, ties and repeated rows, near copies, and a hot group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "on", "er", "Th", "é", "ñ", "x"]) for _ in range(rng.randint(1, 4)))
    base = " ".join(word() for _ in range(120))
    texts = [(0, None), (1, ""), (2, "  \t\n"), (3, "one"), (4, "one"), (5, "two words"), (6, "A b c d e"), (7, "a B C D E")]
    texts += [(10 + i, base) for i in range(40)]
    for i in range(40):
        words = base.split()
        for k in rng.sample(range(120), rng.randint(0, 4)):
            words[k] = word()
        texts.append((60 + i, " ".join(words)))
    texts += [(200 + i, " ".join(word() for _ in range(rng.randint(1, 90))) + "\n" + base[: rng.randint(0, 400)]) for i in range(60)]
    texts += [(300, "ab " * 30_000), (301, "z" * 50_000), (302, "ab " * 20_000), (303, "\0odd\x1c text  <|endoftext|> 　 end ")]
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), texts


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
