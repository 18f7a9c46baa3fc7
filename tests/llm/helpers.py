"""Fixtures and brute-force versions for the training-data operators."""

import random
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text[, source]) rows with extra columns whose names clash with names the operators use."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", 1.5) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, h long, stats string, score double")


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


def covered_bytes(texts, length):
    """For each text a mask of the bytes inside a string that starts at two places."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def rng(seed=1):
    return random.Random(seed)
