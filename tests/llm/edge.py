"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators also use inside or as results.
CLASHING = "id long, digest string, n_words string, score string, kept string, ids string, offset string, routes string, n long"


def prose(seed: int, words: int, stock: int = 400) -> str:
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "n r s t l m x y".split()]
    return " ".join(rnd.choice(vocabulary[:stock]) + rnd.choice(["", "", "", ",", "."]) for _ in range(words))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    shared = prose(2, 60)
    edited = base.split()
    edited[50] = "changed"
    rows = [
        (1, base), (2, None), (3, ""), (4, base), (5, " ".join(edited)), (5, " ".join(edited)), (6, "one two"), (7, "ONE two"),
        (8, prose(3, 40) + "\n" + shared + "\n" + prose(4, 40)), (9, shared + " " + prose(5, 30)), (10, "same " * 100),
        (11, prose(6, 20_000)), (12, "   \n\t "), (13, "x" * 5000), (14, "ümlaut ÉTÉ 中文 😀 z y \x1c \x85"), (None, prose(7, 50)),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """``df`` with an extra text column for each clashing name."""
    from pyspark.sql import functions as F

    return df.withColumns({c.split()[0]: F.lit("0").cast(c.split()[1]) for c in CLASHING.split(", ")})
