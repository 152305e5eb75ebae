import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, token string, node string, label string, n long, score double, ids string, start long")
PROSE = "the quick brown fox jumps over the lazy dog while seven bold wizards mix potent brews near a quiet river"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "t", "n", "l", 2, 0.5, "i", 3)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with further columns whose names operators use themselves."""
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts and keys, long and spaceless texts, repeated rows, near copies, personal data, licenses."""
    rnd = random.Random(5)
    words = PROSE.split()
    long = " ".join(rnd.choice(words) + rnd.choice(["", "s", "ed", ",", "."]) for _ in range(20_000))
    base = [rnd.choice(words) + str(k % 7) for k in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "x" * 30_000), (6, "é" * 5000 + " 漢字 \U0001f600"),
        (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base)), (9, " ".join(base)),
        (10, "one two three"), (11, "one two three"), (12, "one"), (None, "no id here"), (None, "no id here"),
        (13, "Mail a.b@c.org now, or call +1 (555) 123-4567 or see 10.0.0.1 4111 1111 1111 1111."),
        (14, "Licensed under the Apache License, Version 2.0.\nsecond line\nsecond line"),
        (15, PROSE, None, None), (16, PROSE, "en", None), (17, PROSE, None, "s2"), (18, (PROSE + "\n") * 40),
        (19, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end ' + PROSE), (20, "a\x00b\x1c c\x85d"),
        (-5, PROSE.upper() + " !!"), (2**62, PROSE * 3),
    ]
    return rows
