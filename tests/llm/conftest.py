import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, sid long, shard long, d int, k int, removed int, spans int, score string, digest int"


@pytest.fixture(scope="session")
def corpus():
    """Small documents with all that may go wrong: nulls, empty and long texts, ties, copies and
    near copies, repeated rows, one hot group, odd characters."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "Étude", "naïve", "ß", "x1", "don't", "42"]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    base, passage = prose(120), prose(90)
    rows = [(i, prose(r.randrange(1, 60)) + "\n" + prose(r.randrange(1, 30))) for i in range(40)]
    rows += [(100 + i, base) for i in range(30)]  # a hot group of copies
    for i in range(12):
        w = base.split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(20) + " " + passage + "\n" + prose(20)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two"), (405, "ONE  two\n"), (None, "no id at all"), (None, None)]
    rows += [(500, "same row twice " * 40), (500, "same row twice " * 40), (500, "other text, same id")]
    rows += [(600, prose(6000)), (601, "z" * 3000), (602, "a\x1cb\x85c d　e <|endoftext|> 'S \U0001f642")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6, "y", 7) for i, t in corpus], SCHEMA)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)
