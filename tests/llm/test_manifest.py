import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import manifest as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes, place, arity):
    """Root over ``nodes``, and the siblings on the way from ``place``, as (before, after)."""
    path = []
    while len(nodes) > 1:
        a = place - place % arity
        run = nodes[a : a + arity]
        path.append(("".join(run[: place - a]), "".join(run[place - a + 1 :])))
        nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        place //= arity
    return nodes[0], path


def brute(rows, arity, tampered=lambda r: r):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[1] is None else "1" + r[1], []).append(r)
    order = {g: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g, rs in groups.items()}
    names = sorted(groups, key=lambda g: g.encode())
    leaves = {g: [leaf(r) for r in order[g]] for g in names}
    subroots = [climbed(leaves[g], 0, arity)[0] for g in names]
    out = []
    for at, g in enumerate(names):
        root, top = climbed(subroots, at, arity)
        for i, r in enumerate(order[g]):
            path = climbed(leaves[g], i, arity)[1] + top
            now = leaf(tampered(r))
            for before, after in path:
                now = h(before + now + after)
            out.append((r[0], leaves[g][i], subroots[at], root, h("".join(b + a for b, a in path)), now, now == root))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(sizes):
    return [(1000 * k + i, s, "en" if i % 3 else None, i, None if i % 7 == 0 else f"Text {i} é") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("sizes, arity", [({"a": 1}, 16), ({"a": 300, "é": 16, None: 17, "b": 1, "z": 257}, 16), ({f"s{i}": 1 + i % 3 for i in range(40)}, 16), ({"x": 50, None: 9, "y": 28}, 3)])
def test_agrees_with_brute_force(spark, sizes, arity):
    rows = rows_of(sizes)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    changed = F.when(F.col("doc_id") % 5 == 0, M.row_digest([F.upper("text") if c == "text" else F.col(c) for c in M.FIELDS]))
    up = lambda r: r if r[0] % 5 or r[4] is None else (*r[:4], r[4].upper())
    assert shown(M.manifest(df, changed, arity=arity)) == brute(rows, arity, up)


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(7, "a", "en", 1, "same")] * 60 + [(None, "a", None, None, None)] * 20 + [(7, "a", "en", 1, t) for t in ("x", "", " ")] + [(None, None, None, None, "t")]
    df = spark.createDataFrame([(*r, "w", 1, "g") for r in rows], SCHEMA + ", leaf string, idx int, grp string").repartition(5)
    assert shown(M.manifest(df)) == brute(rows, 16)
    assert all(r["verified"] for r in M.manifest(df).collect())
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forests_add_up_in_any_order():
    n, rng = 700, random.Random(3)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    whole = M.Forest()
    for i, d in enumerate(leaves):
        whole.add("g", n, 0, i, d)
    want = sorted(whole.resolved())
    assert not list(whole.open()) and climbed([d.hex() for d in leaves], 0, 16)[0] == next(r[5] for r in want if r[4] == "root").hex()
    for _ in range(5):
        order = rng.sample(range(n), n)
        parts, done = [], []
        for k in range(0, n, 90):
            f = M.Forest()
            for i in order[k : k + 90]:
                f.add("g", n, 0, i, leaves[i])
            done += f.resolved()
            parts.append(list(f.open()))
        while len(parts) > 1:  # any two are added
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            f = M.Forest()
            for grp, size, level, idx, _, digest, _ in a + b:
                f.add(grp, size, level, idx, digest)
            done += f.resolved()
            parts.append(list(f.open()))
        assert parts == [[]] and sorted(done) == want


def test_forest_of_a_sorted_part_is_small():
    n, f = 100_000, M.Forest()
    for i in range(12_345, 54_321):
        f.add("g", n, 0, i, b"x" * 32)
    assert len(list(f.open())) <= 2 * 15 * 5


def test_query_on_the_table(spark):
    from tables import SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*M.FIELDS).collect()]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tampered = lambda r: (*r[:4], r[4].translate(low)) if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    assert shown(M.op13(spark, SMALL)) == brute(rows, 16, tampered)
