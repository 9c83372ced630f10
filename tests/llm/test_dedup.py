"""Suffix, window and near-duplicate removal against brute force."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import brute
from tables import SMALL
from plumbline.llm import components, hashing, queries, suffix_dedup, window_dedup
from plumbline.llm.components import connected_components
from plumbline.llm.near_dedup import drop_near_duplicates, label_near_duplicates
from plumbline.llm.suffix_dedup import later_windows, remove_repeated_bytes
from plumbline.llm.window_dedup import FingerprintIndex, remove_repeated_windows, remove_windows_of_history, repeated


def table(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("n_words", "n_removed", "kept_sha256")
NEAR = ("n_shingles", "component_id", "kept")


@pytest.fixture(scope="module")
def small_docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_queries_on_the_small_table(spark, small_docs):
    assert table(queries.QUERIES["op2_suffix_dedup"](spark, SMALL), *BYTES) == brute.suffix_dedup(small_docs)
    assert table(queries.QUERIES["op3_substring_dedup"](spark, SMALL), *WORDS) == brute.window_dedup(small_docs)
    assert table(queries.QUERIES["op8_near_dedup"](spark, SMALL), *NEAR) == brute.near_dedup(small_docs)


def test_bytes(frame, corpus):
    got = remove_repeated_bytes(frame(corpus))
    assert table(got, *BYTES) == brute.suffix_dedup(corpus)
    kept = {r["doc_id"]: bytes(r["kept_bytes"]) for r in got.collect()}
    assert kept[0] == dict(corpus)[0].encode() and kept[20] == b"" and kept[52] == b""


def test_words(frame, corpus):
    got = remove_repeated_windows(frame(corpus))
    assert table(got, *WORDS) == brute.window_dedup(corpus)
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()}[54] == "one two three"


def test_near(frame, corpus):
    assert table(label_near_duplicates(frame(corpus)), *NEAR) == brute.near_dedup(corpus)


def test_near_chain_and_blocks(frame):
    """A chain of texts links its ends; a family larger than a block is compared block by block."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    rows = []
    for i in range(40):
        words = words.copy()
        words[(i * 37) % 160] = f"n{i}"
        rows.append((i, " ".join(words)))
    want = brute.near_dedup(rows)
    assert {v[1] for v in want.values()} == {0}
    assert table(label_near_duplicates(frame(rows), block=7), *NEAR) == want


def test_drop_keeps_columns_and_one_of_each(frame, corpus):
    df = frame(corpus)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, v in brute.near_dedup(corpus).items() if v[2]}


@pytest.mark.parametrize("f,cols", [(remove_repeated_bytes, BYTES), (remove_repeated_windows, WORDS), (label_near_duplicates, NEAR)])
def test_empty_table(frame, f, cols):
    assert f(frame([])).collect() == []


def test_null_and_repeated_ids(frame):
    """Rows with null or repeated ids are documents of their own, in order of id, nulls last."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (None, None), (1, "short")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_removed"], r["n_bytes"]) for r in remove_repeated_bytes(frame(rows)).collect())
    n = len(text)
    assert got == [(1, 0, 5), (3, 0, n), (3, n, n), (99, 0, 0), (99, n, n)]
    assert sorted(r["n_removed"] for r in remove_repeated_windows(frame(rows)).collect()) == [0, 0, 60, 60, 60]
    near = label_near_duplicates(frame(rows)).collect()
    assert sum(r["kept"] for r in near) == 3 and {r["component_id"] for r in near if r["n_shingles"] == 56} == {3}
    assert drop_near_duplicates(frame(rows)).count() == 3


def test_common_prefixes_of_columns():
    """Marks of equal windows agree with a direct comparison, whatever the alignment and the group."""
    rng = np.random.default_rng(0)
    window, lead = 10, 6
    strings = [bytes(rng.integers(97, 99, rng.integers(window, lead + window + 1)).tolist()) for _ in range(200)]
    start = np.array([lead + window - len(s) if len(s) == lead + window else int(rng.integers(0, lead + window - len(s) + 1)) for s in strings])
    group = np.sort(rng.integers(0, 5, len(strings)))
    rank = rng.permutation(len(strings))
    length = np.array([len(s) for s in strings])
    marks = later_windows(group, start, length, np.frombuffer(b"".join(strings), np.uint8), rank, window, lead + window)
    for c in range(lead + 1):
        for i, s in enumerate(strings):
            at = c - start[i]
            inside = 0 <= at <= len(s) - window
            want = inside and any(
                rank[j] < rank[i] and group[j] == group[i] and 0 <= c - start[j] <= len(t) - window and t[c - start[j] : c - start[j] + window] == s[at : at + window]
                for j, t in enumerate(strings)
            )
            assert marks[c, i] == want


def test_index_finds_history_and_compacts(spark, frame):
    rng = random.Random(2)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(50))
    docs = frame([(i, f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(40))} {shared if i % 2 else ''}") for i in range(12)], extra=False)
    rows = docs.selectExpr("doc_id as _rid", "text")
    index = FingerprintIndex(spark, fanout=2)
    found = [{r["_rid"] for r in index.add(rows.filter(f"_rid % 3 = {k}")).select("_rid").collect()} for k in range(3) if not index.compact()]
    assert len(index.runs) == 2  # two merged, and the last
    assert set().union(*found) == {1, 3, 5, 7, 9, 11}
    index.drop()
    assert index.runs == []


def test_named_index_is_opened_again(spark, frame):
    """Batches that come one after the other, the index made anew for each, agree with brute force over all so far."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, twice, own = words(50), words(36), words(40)
    texts = [f"{words(20)} {shared}", words(60), f"{shared} {words(5)}", None, "", f"{own} {own}", f"{twice} {words(9)}", f"{words(3)} {twice}", shared, words(34), f"x {shared[:-1]}", shared]
    docs = list(enumerate(texts))
    whole = brute.window_dedup(docs)
    for at in range(0, len(docs), 3):
        index = FingerprintIndex(spark, name="history_of_a_test")
        assert len(index.runs) <= 1
        got = table(remove_windows_of_history(frame(docs[at : at + 3], extra=False), frame(docs[:at], extra=False), index), *WORDS)
        so_far = brute.window_dedup(docs[: at + 3])
        assert got == {i: so_far[i] for i, _ in docs[at : at + 3]}
    assert {i for i, v in so_far.items() if v[1]} == {i for i, v in whole.items() if v[1]} >= {0, 2, 5, 6, 7, 8, 11}
    again = FingerprintIndex(spark, name="history_of_a_test")
    assert table(remove_windows_of_history(frame(docs[9:], extra=False), frame(docs[:9], extra=False), again), *WORDS) == got  # a batch added once more
    again.drop()
    assert FingerprintIndex(spark, name="history_of_a_test").runs == []
    with pytest.raises(ValueError):
        FingerprintIndex(spark, name="no name")


@pytest.mark.parametrize("busy", [1, 2, 1000])
def test_components(spark, busy, monkeypatch):
    """Whatever share of the nodes is joined by broadcast."""
    monkeypatch.setattr(components, "BUSY", busy)
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (20, 22), (21, 22), (20, 21)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_a_busy_centre(spark):
    """Two stars of 1500 leaves whose centres are not the least of their nodes, and a chain between two leaves."""
    links = [(c, leaf) for c in (4000, 9000) for leaf in range(c - 1500, c)] + [(3000, 10000), (10000, 8000), (20000, 20001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert len(got) == 3005 and {v for k, v in got.items() if k < 20000} == {2500} and got[20001] == 20000


def thue_morse(n):
    """A word of two letters and its complement, which polynomial hashes modulo a power of two don't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_a_regular_build(frame, n):
    one, other = thue_morse(n)
    body = [f"w{i}" for i in range(61)]
    rows = [(1, " ".join(body[:30] + [one] + body[31:])), (2, " ".join(body[:30] + [other] + body[31:])), (3, one), (4, other), (5, one.upper()), (6, other * 2), (7, one + " " + other)]
    assert table(remove_repeated_windows(frame(rows)), *WORDS) == brute.window_dedup(rows)
    assert table(label_near_duplicates(frame(rows)), *NEAR) == brute.near_dedup(rows)


@pytest.mark.parametrize("group_rows", [0, 3])
def test_hot_anchors_are_split(frame, corpus, group_rows):
    """One phrase amid different words in many texts, and copies of all sorts, with anchors split into windows."""
    rng = random.Random(11)
    phrase, long = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(45))
    other = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    rows = corpus + [(100 + i, f"{other()} {phrase} {other()}") for i in range(12)] + [(200 + i, f"{other()} {long} {other()}") for i in range(12)]
    assert table(remove_repeated_bytes(frame(rows), group_rows=group_rows), *BYTES) == brute.suffix_dedup(rows)
    assert table(remove_repeated_windows(frame(rows), group_rows=group_rows), *WORDS) == brute.window_dedup(rows)


def test_windows_of_one_hash_are_told_apart_by_words():
    text = b"aa bb cc aa bb dd aa bb cc"
    begin, end = np.array([0, 9, 18]), np.array([8, 17, 26])
    marks = repeated(text, begin, end, np.arange(3), np.zeros(3, np.uint64), np.ones(3, np.int64))
    assert marks.tolist() == [True, False, True]
    assert repeated(text, begin, end, np.arange(3), np.zeros(3, np.uint64), np.array([1, 2, 1])).tolist() == [True, True, True]


@pytest.mark.parametrize("block", [1, 4, 400])
def test_large_families_of_any_shape(frame, block):
    """Families beyond the block's size: one cluster, a cluster with strays, chains, and members alike in part only."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, edited(base, 1)) for i in range(12)]  # links between nearly all
    rows += [(100 + i, edited(base, rng.choice([2, 4, 7]))) for i in range(14)]  # strays that some keys lead to
    chain = base[:60] + [f"c{k}" for k in range(60)]
    for i in range(12):  # each is like the one before it, and less and less like the first
        chain[60 + 5 * i : 65 + 5 * i] = [f"d{i}x{k}" for k in range(5)]
        rows.append((200 + i, " ".join(chain)))
    rows += [(300, rows[0][1]), (301, rows[-1][1]), (302, None), (303, "")]
    assert table(label_near_duplicates(frame(rows), block=block), *NEAR) == brute.near_dedup(rows)


def test_ids_of_a_batch_are_checked(spark, frame):
    index = FingerprintIndex(spark, name="checked_ids_of_a_test")
    history = frame([(1, "a b"), (2, "c")], extra=False)
    for bad in ([(3, "x"), (None, "y")], [(3, "x"), (3, "y")], [(2, "x")]):
        with pytest.raises(ValueError):
            remove_windows_of_history(frame(bad, extra=False), history, index)
    assert index.runs == []


def test_index_is_opened_with_another_number_of_partitions(spark, frame):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(45)
    docs = [(i, f"{words(10)} {shared if i % 2 else words(40)}") for i in range(9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for at, parts in ((0, before), (3, "7"), (6, "2")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            index = FingerprintIndex(spark, name="other_buckets_of_a_test")
            got = table(remove_windows_of_history(frame(docs[at : at + 3], extra=False), frame(docs[:at], extra=False), index), *WORDS)
            so_far = brute.window_dedup(docs[: at + 3])
            assert got == {i: so_far[i] for i, _ in docs[at : at + 3]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        FingerprintIndex(spark, name="other_buckets_of_a_test").drop()


def test_many_hot_anchors_are_joined_by_salt(spark):
    rows = spark.range(4000).selectExpr("id % 40 as h", "id as _rid").union(spark.range(5).selectExpr("id + 100 as h", "id as _rid"))
    for most in (1000, 3):
        got = {tuple(r) for r in hashing.marked_hot(rows, 50, most).select("h", "_rid", "hot").collect()}
        assert len(got) == 4005 and {h for h, _, hot in got if hot} == set(range(40)) and {h for h, _, hot in got if not hot} == set(range(100, 105))


def test_recall_just_above_the_threshold(frame):
    """Three hundred pairs of 85 to 90 % similarity and as many of 75 to 84: all of the first, none of the others."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows, near = [], 0
    while len(rows) < 1200:
        base = [word() for _ in range(rng.randint(150, 300))]
        other = list(base)
        for at in rng.sample(range(0, len(base), 6), rng.randint(2, 7)):
            other[at] = word()
        x, y = brute.shingles(" ".join(base)), brute.shingles(" ".join(other))
        share = 100 * len(x & y) / len(x | y)
        wanted = 85 <= share < 90 if near < 300 else 75 <= share < 85
        if wanted:
            near += near < 300
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in label_near_duplicates(frame(rows)).collect()}
    found = sum(got[i] == got[i + 1] for i in range(0, 600, 2))
    assert found >= 299 and all(got[i] == i for i in range(600, 1200))
    assert {i: c for i, c in got.items() if i < 600 and c not in (i, i - 1)} == {}


def test_few_links_need_no_busy_nodes(spark):
    """A round over few links broadcasts nothing; its plan is held by the driver."""
    from plumbline.llm.components import _with_least

    links = spark.createDataFrame([(i, i % 5) for i in range(5, 60)], "u long, v long")
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    few, many = (_with_least(links, least, n) for n in (55, 50_000_000))
    assert "Union" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.select("u", "v", "m").collect())) == sorted(map(tuple, many.select("u", "v", "m").collect()))


def test_rounds_broadcast_nothing(spark):
    """The driver would hold each round's broadcasts, whatever the number of links."""
    from plumbline.llm.components import _with_least

    links = spark.createDataFrame([(i, i % 5) for i in range(5, 60)], "u long, v long")
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    for n in (55, 50_000_000):
        assert "Broadcast" not in _with_least(links, least, n)._jdf.queryExecution().executedPlan().toString()


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Only the links themselves are written, so that the components of components cost no round."""
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: written.append(name) or f(df, name))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(5, 1), (1, 7), (9, 2), (2, 2)], "u long, v long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2} and written == ["links"]
    assert {r["component"] for r in connected_components(spark.createDataFrame([(5, 1), (5, 2), (9, 5)], "u long, v long")).collect()} == {1} and len(written) > 2


def test_bytes_of_hot_anchors_come_in_slices():
    """Neither the strings of a batch nor the windows of its hot anchors are held or sent at once, and none is lost."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)) for _ in range(2)]
    found = pa.Table.from_batches(suffix_dedup.byte_anchors(100, 24)([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([t.decode() for t in texts])], ["_rid", "text"])]))
    per_row = [found.filter(pc.equal(found.column("_rid"), r)).combine_chunks() for r in (1, 2)]
    fields = [[t.column("h").to_numpy() for t in per_row], [np.where(a < 0, ~a, a) for t in per_row for a in [t.column("at").to_numpy()]], [np.ones(t.num_rows, bool) for t in per_row]]
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate(f)) for f in fields], ["h", "at", "hot"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [t.num_rows for t in per_row]), pa.int32()), structs)
    codec = pa.Codec("zstd")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), lists, pa.array([len(t) for t in texts]), pa.array([codec.compress(t, asbytes=True) for t in texts])], ["_rid", "found", "size", "packed"])
    strings = list(suffix_dedup.strings_at(100)([batch]))
    assert sum(b.num_rows for b in strings) == found.num_rows > 150_000
    windows = {}
    for b in strings:
        assert b.nbytes < 40 << 20
        for out in suffix_dedup._split(100, 24)([b]):
            assert out.nbytes < 40 << 20
            for r, at, piece in zip(*(out.column(c).to_pylist() for c in ("_rid", "at", "piece"))):
                assert texts[r - 1][(x := at >> 14) : x + 100] == piece
                windows[r, x] = windows.get((r, x), 0) + 1
    assert len(windows) == sum(len(t) - 99 for t in texts) and set(windows.values()) == {1}


def test_slices_of_a_few_rows(frame, corpus, monkeypatch):
    """However strings, stretches and windows are cut, results are the same."""
    for f in (suffix_dedup.strings_at, suffix_dedup._windows, window_dedup.stretches_of, window_dedup._windows):
        monkeypatch.setattr(f, "__defaults__", (5,))
    rng = random.Random(12)
    phrase, long = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(45))
    other = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    rows = corpus + [(100 + i, f"{other()} {phrase} {other()}") for i in range(8)] + [(200 + i, f"{other()} {long} {other()}") for i in range(8)]
    assert table(remove_repeated_bytes(frame(rows), group_rows=3), *BYTES) == brute.suffix_dedup(rows)
    assert table(remove_repeated_windows(frame(rows), group_rows=3), *WORDS) == brute.window_dedup(rows)


def test_an_index_without_a_name_needs_no_warehouse(spark, frame, corpus, monkeypatch):
    """Its runs lie in the folder for intermediate tables while they are used, and are gone after it."""
    monkeypatch.setattr(window_dedup, "check_warehouse", lambda spark: pytest.fail("the warehouse is asked for"))
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    before = set(warehouse.glob("plumbline_run_*"))
    index = FingerprintIndex(spark)
    index.add(frame(corpus, extra=False).selectExpr("doc_id as _rid", "text"))
    paths = [Path(p.removeprefix("file://")) for p in index.paths.values()]
    assert len(paths) == len(index.runs) == 1 and list(paths[0].glob("*.parquet")) and set(warehouse.glob("plumbline_run_*")) == before
    index.drop()
    assert not paths[0].exists() and not index.paths
    assert table(remove_repeated_windows(frame(corpus)), *WORDS) == brute.window_dedup(corpus)


def test_groups_are_cut_by_bytes():
    """Long words: a table of stretches is cut by its bytes, between keys, with no row lost."""
    pieces = [bytes([97 + i % 26]) * 50_000 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([i // 3 for i in range(400)]), pa.array(pieces, pa.binary())], ["h", "piece"])
    tables = list(hashing.whole_groups(iter([batch]), ["h"], size=1 << 20))
    assert [p for t in tables for p in t.column("piece").to_pylist()] == pieces
    assert max(t.nbytes for t in tables) < 2 << 20
    keys = [set(t.column("h").to_pylist()) for t in tables]
    assert sum(map(len, keys)) == len(set().union(*keys))
