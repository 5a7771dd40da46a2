import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(seed: int, words: int) -> str:
    """Invented prose; equal seeds give equal texts."""
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = prose(9, 30_000)
    rows = [
        (1, prose(1, 80), "en", "src0", 5, "x", 0.5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "src1", 0, "x", 0.5),
        (4, "  \n\t ", "de", "src1", 5, "x", 0.5),
        (5, prose(1, 80), "en", "src0", 5, "x", 0.5),
        (6, prose(2, 60) + "\n" + prose(3, 60), "en", "src0", 5, None, 0.5),
        (6, prose(2, 60) + "\n" + prose(3, 60), "en", "src0", 5, None, 0.5),
        (None, prose(4, 40), "fr", "src2", 5, "x", 0.5),
        (7, long, "en", "src0", len(long), "x", 0.5),
        (8, "Grüße, мир! 数据 \U0001f600 " + prose(5, 30), "de", "src3", 5, "x", 0.5),
        (9, "Hi", "en", "src0", 2, "x", 0.5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")
