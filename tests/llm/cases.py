"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, sign string, key string, start string"


def edge_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(300)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        kind = i % 6
        if kind == 1:
            own = own + shared.split()
        if kind == 2 and texts:
            base = rng.choice(texts).split(" ")
            own = [w if rng.random() > 0.02 else rng.choice(words) for w in base]
        if kind == 3:
            own = ["Été\n"] + own + ["\nA line that is shared by many documents.  \n", "x\n\n"]
        texts.append(" ".join(own))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n \t"), (n + 3, "one two"), (n + 4, "ONE\vtwo"), (n + 5, "\n\n"), (n + 6, "...")]
    rows += [(n + 7, long), (n + 8, long.upper()), (n + 9, long + " tail"), (n + 10, texts[0]), (n + 10, texts[0])]
    rows += [(n + 11, "a  b   c    d "), (n + 12, "  x y\r\nz  "), (n + 13, "it's   they'll  12345 !!??\n\n\n.")]
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in rows]


def documents(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
