import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"

# Columns that the operators use inside, as names of further columns.
CLASHING = ("key", "hash", "word", "n", "size", "label", "score", "component", "node", "row", "taken", "stack", "th", "_key2",
            "_drop", "_key", "_print", "_lines", "_row", "_of", "_text", "copies", "_copy", "part", "version", "edge", "before",
            "whole", "print", "fp", "bucket", "run", "id", "digest", "newest", "page", "fails", "first", "good")


def paragraph(seed: int, words: int = 60) -> str:
    import random
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 4)))
                    for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    shared = "This passage stands in many documents and is long enough to count."
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, None, None), (None, "no key at all", "en", "a", 13),
        (4, paragraph(1), "en", "a", 9), (4, paragraph(1), "en", "a", 9), (5, paragraph(1), "fr", "b", 9),
        (6, paragraph(1) + " tail", "en", None, 9), (7, paragraph(7, 6000), "en", "b", 9),
        (8, "x" * 50_000, "en", "b", 9), (9, "caf\u00e9 \U0001f600 na\u00efve\u00a0word ###", "de", "c", 9),
    ] + [(20 + i, f"{paragraph(100 + i)}\n  {shared.upper() if i % 2 else shared}\n{paragraph(200 + i)}", "en", "abc"[i % 3], 9)
         for i in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
