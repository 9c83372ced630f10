import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
VOCABULARY = "the of and to in is on by as at it an or be we no so if up do go he my me us am".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(("", "ra", "til", "onde", "x")) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, extra=True):
        """(doc_id, text) rows as documents, with columns whose names clash with outputs."""
        clash = "n_words long, size string, kept string, score string, shard int, copies int, _rid string, _words int"
        full = [(i, t, "en", "src1", len(t or ""), *([1, "s", "k", "c", 7, 9, "r", 3] if extra else [])) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (", " + clash if extra else ""))

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages, repeated words, empty, null and long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 150)) for _ in range(12)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    rows += [(20 + i, base[i]) for i in range(4)]
    for i in range(6):
        w = base[i].split()
        w[len(w) // 2] = f"changed{i}"
        rows.append((30 + i, " ".join(w)))
    rows += [(40 + i, f"{prose(rng, 15)}\n{passage} {prose(rng, 15)}") for i in range(5)]
    rows += [(50, "of, " * 300), (51, "of, " * 120 + "end"), (52, ""), (53, None), (54, "one two three"), (55, "One TWO three"), (56, "  \n\t "), (57, "é" * 130 + "é" * 130), (58, prose(rng, 6000))]
    rows += [(60 + i, base[11] + " " + prose(rng, 3)) for i in range(3)]
    return rows
