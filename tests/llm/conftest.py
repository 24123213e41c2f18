import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    stock = ["the", "of", "and", "harbour", "Lantern", "river", "stone", "quiet", "morning", "glass", "über", "été", "cañón", "walks", "slowly", "under", "old", "bridges", "seven", "birds"]
    return " ".join(rng.choice(stock) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def doc_rows():
    """Documents with every edge: nulls, empty and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        text = ".\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, "en", f"src{i % 5}" if i % 7 else None, len(text)))
    copy = rows[3][1]
    near = rows[4][1] + "\n" + prose(rng, 200)
    rows += [(100 + i, copy, "en", "src0", len(copy)) for i in range(4)]
    rows += [(110 + i, near + f" tail{i}", "en", "hot", len(near)) for i in range(4)]
    rows += [
        (200, None, None, None, None),
        (201, "", "en", "src1", 0),
        (202, " \t\n \r\n", "en", "src1", 6),
        (203, "one", "en", "src1", 3),
        (204, "two words", "en", "src1", 9),
        (205, prose(rng, 20000), "en", "hot", 1),
        (206, "A shared passage line\nA SHARED PASSAGE LINE \n\nshort\nshort", "en", "hot", 1),
        (207, "\x0b a shared passage line\x0c\nsomething of its own here", "en", "hot", 1),
        (None, "a shared passage line\nno id at all in this row", "en", "src2", 1),
        (208, "Repeated row of one document, twice.\nA shared passage line", "en", "src2", 1),
        (208, "Repeated row of one document, twice.\nA shared passage line", "en", "src2", 1),
        (209, "ΣΑΣ İstanbul ﬁne 日本語 🎉🎉 <|endoftext|> it's we'LL 12345 ½\x85\xa0x", "en", "src3", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "copies", "kept_text", "n_lines", "_owner", "row", "owner", "fp", "fingerprint_bits", "component_id", "n_words", "kept", "score", "n_tokens", "ids", "blob", "Source2", "_id", "_text", "text2"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
