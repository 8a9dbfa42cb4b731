from __future__ import annotations

import random

import pytest


def _prose(rng: random.Random, n: int) -> str:
    parts = ["an", "er", "the", "ing", "tion", "ble", "or", "is", "ver", "lich", "ñez", "ô"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(11)
    passage = _prose(rng, 60)
    base = [_prose(rng, rng.randint(60, 200)) for _ in range(30)]
    rows: list[tuple] = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3]), (102, base[3].upper()), (103, base[5] + " more words")]
    rows += [(110 + i, _prose(rng, 40) + " " + passage + " " + _prose(rng, 40)) for i in range(5)]
    words = base[7].split(" ")
    for i in range(8):
        w = list(words)
        for k in rng.sample(range(len(w)), max(1, len(w) // 90)):
            w[k] = f"edit{i}{k}"
        rows.append((120 + i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "one two"), (204, "One TWO"), (205, "12 345"),
             (206, "a" * 700), (207, "ab c " * 200), (208, "don't  stop\n\n now 日本 語 x  y"),
             (209, "# $ % " * 40), (210, _prose(rng, 6000)), (None, "text without an id here now"),
             (None, None), (12, base[12]), (13, "same id, another text of its own")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    langs = ["en", "de", None, "fr"]
    rows = [(i, t, langs[k % 4], f"src{k % 7}" if k % 11 else None, 1, 1.0, "x", True)
            for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "score double, bucket string, kept boolean").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
