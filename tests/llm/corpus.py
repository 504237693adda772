"""Small corpora with the awkward cases, and the given documents."""

from __future__ import annotations

import random

from tests.agreement import SF_DIR

#: Columns that the operators use inside, as columns of the caller.
CLASHES = "row string, id long, tk long, text_key string, h1 long, pos int, digit long, part int, batch int, fp long, n_words long, minima string, kept string, shard int, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASHES}"
N_CLASHES = CLASHES.count(",") + 1

WORDS = "alpha Beta gamma delta Über été niño zeta eta theta iota kappa lambda mu nu xi".split()


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared lines, nulls, ties."""
    rng = random.Random(seed)

    def line(k):
        return " ".join(rng.choice(WORDS) for _ in range(k))

    shared = [line(9) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if rng.random() < 0.3:
            lines.append("  " + rng.choice(shared).upper() + "\t")
        out.append((i, "\n".join(lines), rng.choice(["en", "de"]), rng.choice(["a", "b"])))
    for i in range(n, n + 8):
        out.append((i, out[rng.randrange(n)][1], "en", "a"))
    for i in range(n + 8, n + 16):
        words = out[rng.randrange(n)][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "de", None))
    out += [
        (1000, None, None, None),
        (1001, "", "en", "a"),
        (1002, " \t\n\n \x0b\x0c\r", "en", "a"),
        (1003, "é", None, "b"),
        (1004, "\x1c \x85    x", "en", "b"),
        (1005, "###  ***\n123 $$ 456", "en", "b"),
        (1006, "word " * 3000, "en", "a"),
        (1007, "a" * 5000, "en", "a"),
        (None, shared[0], "en", "a"),
        (None, None, "en", "a"),
        (7, out[7][1], "en", "a"),
        (8, "another text under an id that is taken " + shared[1], "en", "a"),
    ]
    return out


def frame(spark, data: list[tuple]):
    """The rows with all clashing columns, which hold nulls and junk."""
    full = [(*r, *(None for _ in range(N_CLASHES))) for r in data]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def documents(spark, sf_dir: str = SF_DIR):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(spark, sf_dir: str = SF_DIR) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]


def bag(found) -> list[tuple]:
    """Rows as a sorted list; None sorts first."""
    return sorted(map(tuple, found), key=lambda r: [(v is not None, str(type(v)), v) for v in r])
