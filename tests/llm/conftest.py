import random

import pytest

COLUMNS = "doc_id long, text string, shard int, score double, rest string, h1 long"


@pytest.fixture(scope="session")
def documents(spark):
    """Copies, near copies, shared lines and passages, odd texts; nulls, ties, repeated rows, clashing names."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["Über", "naïve", "日本", "don't", "x.", "***"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([3, 40, 120, 300]))) for _ in range(25)]
    rows, ids = [], draw.sample(range(10_000), 110)
    for k in range(110):
        text = draw.choice(texts)
        if k % 4 == 1:
            parts = text.split(" ")
            parts[draw.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        if k % 3 == 0:
            text = f"{text}\n  Shared LINE here \n{text[:50]}\nAll rights reserved. Licensed under the Apache License, Version 2.0"
        if k % 10 == 7:
            text = f"{text} {texts[k % 25][:400]}"
        rows.append((ids[k], text.replace(" w1 ", " \t\n ")))
    long = " ".join(draw.choice(words) for _ in range(12_000))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t\n"), (20_003, long), (20_004, long + " end"), (20_005, "a\x1cb\x85c \x0b\x0c\r\n x\r\nx"), (20_006, "y" * 70_000)]
    rows += [rows[0], rows[0], (None, "no id at all"), (None, rows[1][1])]
    return spark.createDataFrame([(i, t, 1, 0.5, "r", 2) for i, t in rows], COLUMNS).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
