import random

import pytest


def words(r, n, alphabet="abcdefghijklmnop"):
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """(frame, rows): copies, near copies, shared passages, blanks, nulls, a long text, repeated rows, columns with clashing names."""
    r = random.Random(3)
    rows: list[tuple[int, str | None]] = []
    base = [words(r, 120) for _ in range(12)]
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
    rows += [(1, " ".join(base[0])), (2, " ".join(base[0]).upper())]
    for k in range(6):
        near = list(base[1])
        for i in r.sample(range(120), k):
            near[i] = "changed"
        rows.append((200 + k, "  ".join(near)))
    passage = words(r, 60)
    for k in range(5):
        rows.append((300 + k, " ".join(words(r, 40) + passage + words(r, 30))))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "two words"), (406, " ".join(words(r, 4000))), (407, "é" * 50 + " ñandú ß")]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame([(i, t, "t", 1, "k", 0.5, 7) for i, t in rows], "doc_id long, text string, t string, id int, key string, score double, _cuts int")
    return frame, rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
