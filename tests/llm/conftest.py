import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, n_words, text2): odd rows of every kind, near copies, repeated rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 8))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for i in range(60):
        w = words(rng.choice([1, 3, 5, 12, 13, 40, 120]))
        rows.append((i, " ".join(w)))
        if i % 3 == 0:  # near copies, close to the threshold on either side
            for step in (7, 15, 30):
                v = list(w)
                for j in range(rng.randrange(step), len(v), step):
                    v[j] = rng.choice(vocabulary)
                rows.append((100 + 3 * i + step, " ".join(v)))
    passage = " ".join(words(25))
    rows += [(500 + i, f"{' '.join(words(20))} {passage}\n{' '.join(words(9))}") for i in range(6)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (604, rows[5][1].upper()), (605, "\x0b".join(words(30))), (None, passage), (606, " ".join(words(4000)))]
    return rows


SCHEMA = "doc_id long, text string, n_words string, component_id long, _part int, slice string"


@pytest.fixture
def docs(spark, corpus):
    """The corpus with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", 5, 1, "s") for d, t in corpus], SCHEMA).repartition(5)


@pytest.fixture
def empty(docs):
    return docs.limit(0)
