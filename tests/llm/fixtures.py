"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n long, h long, words string, k long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    long = sentence(rng, 30_000)
    texts = [
        (1, base), (2, base), (3, base.replace(base.split()[60], "changed")), (4, None), (5, ""), (6, "   \n\t "),
        (7, "!!! ??? ###"), (8, "one"), (9, "one"), (None, base), (None, None), (10, long), (11, long + " tail"),
        (12, sentence(rng, 300)), (12, "other text under the same id"), (13, "same\nsame\nsame"), (13, "same\nsame\nsame"),
    ]
    return [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, 1, 2, "w", 3) for k, (i, t) in enumerate(texts)]
