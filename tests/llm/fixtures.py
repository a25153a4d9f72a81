"""Small documents with what goes wrong: nulls, empty and very long texts, repeats, and columns that clash with names used inside."""

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node string, keep string, spans string, words string, block string"


def texts(n=260, seed=5):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 300)}" for _ in range(k)] for k in (6, 12, 25, 40, 60, 90)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases)) if r.random() < 0.7 else [f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = f"z{r.randint(0, 9)}"
        out.append(r.choice([" ", "\n", "  "]).join(w))
    out += [None, "", "  \t\n", "one", "A b", "a B", "x " * 3000, "é😀 ünï " * 40, "y" * 5000, "Released under the MIT License.", 'token = "abcdef0123456789"']
    return out


def rows(n=260):
    return [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 4}", None, "n", "k", "s", "w", "b") for i, t in enumerate(texts(n))] + [(None, "no id", "en", "src0", 5, "n", "k", "s", "w", "b")]


def frame(spark, n=260):
    return spark.createDataFrame(rows(n), CLASHING)


def empty(spark):
    return spark.createDataFrame([], CLASHING)


def known():
    return [(r[0], r[1]) for r in rows() if r[0] is not None]
