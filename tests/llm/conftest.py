import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, component long, sequence_id long, offset string, lang_pred string, size int"
EXTRA = ("k", "s", 7, 8, "o", "l", 9)


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, repeated passages, odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    german = ["ßtr" + w + "ö" for w in words]
    base = "\n".join(sentence(rng, words, 12) for _ in range(9))
    passage = "\n".join(sentence(rng, words, 15) for _ in range(8))
    texts = [base, base, base + " extra", base.replace(base.split()[40], "changed", 1), base.upper(), "Intro line one\n" + passage + "\nthe end here", passage + "\nanother end\nand more"]
    texts += [None, "", " \n\t ", "one", "one two", "One TWO", "*** ### 123", "it's don't <|endoftext|> x<y Ünïcode É  z 中文 12² é İ", "a\n\nb\n\n\n", "x\x0by\x0cz\x1cw", "\\n \\| <s> </s>"]
    texts += [sentence(rng, words, 9000), "\n".join(sentence(rng, words, 6) for _ in range(400)), "w" * 30000]
    texts += [sentence(rng, german if i % 2 else words, rng.randint(1, 60)) for i in range(60)]
    rows = [(i, t, ("de" if t and "ß" in t else "en") if i % 7 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5], rows[30], (None, base, None, None, None, *EXTRA), (None, None, None, None, None, *[None] * len(EXTRA)), (500, "same id, first text here to count", "en", "s1", 1, *EXTRA), (500, "same id, another text", "en", "s1", 1, *EXTRA)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
