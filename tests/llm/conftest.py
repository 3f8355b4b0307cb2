import random

import pytest

SCHEMA = "doc_id long, text string, id string, key string, words string, lang string, source string, n_chars long"


def _text(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(vocabulary)}", f"W{rng.randrange(vocabulary)}.", "é" + str(rng.randrange(20))]) + rng.choice(["", "", "\n", "\t"]) for _ in range(n))


def make_rows():
    """Copies, near copies, shared passages, nulls, empty, odd and very long texts, and repeated rows."""
    rng = random.Random(7)
    rows = []
    base = [_text(rng, rng.choice([3, 8, 60, 120, 300])) for _ in range(40)]
    passage, benchmark = _text(rng, 50), _text(rng, 30)
    for i, t in enumerate(base):
        w = t.split()
        rows.append(t)
        if i % 3 == 0:
            rows.append(t)
        if i % 2 == 0 and len(w) > 50:
            for _ in range(3):
                v = list(w)
                for _ in range(rng.choice([1, 2, 4, 6])):
                    v[rng.randrange(len(v))] = f"new{rng.randrange(999)}"
                rows.append(" ".join(v))
        if i % 5 == 0:
            rows.append(f"{_text(rng, 20)} {passage} {_text(rng, 20)}")
        if i % 7 == 0:
            rows.append(f"{_text(rng, 40)} {benchmark} {_text(rng, 200)}")
    rows += [None, None, "", " \n\t ", "one", "one two", "ONE Two", "a b c d", "a b c d", "a b c d e", "x " * 300, "x y " * 100, "Ünïcödé ΣΑΣ 漢字 👍🏽 <|endoftext|> ▁ <s>", "word" * 5000, _text(rng, 20000), "Licensed under the Apache License, Version 2.0.\nMIT License mit license GNU General Public License v3"]
    rows.append("same line\nsame line\n\nsame line\n### $$$ <b>|</b>")
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    out.append(out[5])  # a repeated row
    out.append((out[6][0], "an id that repeats with another text"))
    out += [(None, "a null id"), (None, base[10])]
    return out, benchmark


@pytest.fixture(scope="session")
def rows():
    return make_rows()[0]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_items():
    b = make_rows()[1].split()
    return [(1, " ".join(b)), (2, " ".join(b[3:20])), (3, "a b c d"), (4, "one"), (5, ""), (6, None), (None, " ".join(b[5:25])), (2, " ".join(b[:14])), (10, "nothing of this kind stands anywhere in these texts at all my friend today")]
