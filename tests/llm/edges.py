"""Small documents with every awkward case, as rows and as a table with clashing extra columns."""

import random

LETTERS = "abcdefgh"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empty, blank, short, very long, equal rows, near copies, null and repeated ids."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    far = words[:80] + prose(rng, 60).split()
    long = prose(rng, 6000)
    rows = [(k, prose(rng, rng.randint(60, 150))) for k in range(10, 16)]
    rows += [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "é ß 漢字 ünï"), (6, base), (7, base), (8, " ".join(near)), (9, " ".join(far))]
    rows += [(20, long), (21, "lead " + long), (None, base), (None, None), (30, "x" * 5000), (31, "ab " * 400), (32, base), (32, base), (33, base.upper())]
    return rows


def table(spark, rows, **extra):
    """Rows as documents with columns whose names operators use inside."""
    names = "doc_id long, text string, n long, words string, rank int, `a.b` string, score double, component string, k1 string, hits string"
    return spark.createDataFrame([(i, t, 1, "w", 2, "dot", 0.5, "c", "k", "h") for i, t in rows], names)


def by_row(df, *names):
    """Result rows as a sorted list of tuples."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
