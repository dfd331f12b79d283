import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, label string, d0 long, key string, shard string"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and long texts, ties, repeated rows and columns with names that operators use."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    shared, base = line(60), [word().replace("é", "f") for _ in range(80)]
    near = list(base)
    near[40] = "changed"
    texts = [
        None, "", "   \n\t ", "One", "a b c d", "A B c D", "12 345 !!", line(30), line(12) + "\n" + shared + "\n" + line(9), line(7) + " " + shared, shared + "\n" + shared,
        " ".join(base), " ".join(near).upper(), "x" * 900, "ab " * 400, "\n".join(line(8) for _ in range(700)), "naïve   façade's ’quoted’ 日本語 <|endoftext|> tail", "tab\there\r\n\r\nand\x0bthere\x1cend", line(5),
    ]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), None, 7, 0.5, "z", 1, "k", None) for i, t in enumerate(texts)]
    return [*out, out[7], out[7], (7, "another text under an id that is taken already", None, None, None, None, None, None, None, None, None), (None, shared, "en", "s1", 3, 1, 1.0, "q", 2, "y", "w")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
