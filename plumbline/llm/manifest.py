"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

A row's digest is a leaf. Leaves of a group are numbered in order, every run of ``ARITY`` consecutive nodes
becomes their parent, and so on to the group's subroot; the subroots are the leaves of a last tree.

A forest is a set of unresolved nodes, keyed by group, level and index. As the number of a group's leaves is
known, so is the arity of every run, and a forest can turn a run into its parent as soon as it is complete.
Forests over disjoint leaves are added by uniting their nodes and resolving what became complete, which is
associative and has the empty forest as its unit. Tasks build the forests of the leaves they read, and a tree
of groups adds neighbours up. Of leaves in order, a forest has fewer than two open runs a level, so nothing
in the tree grows with the table but its logarithm and the number of its parts.

Resolved runs are kept as rows. From the top down each is given the runs above it, once for each parent of
a run of leaves, and the proofs of a run's rows are made in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import crc_bucket, documents, materialize, n_partitions, small

ARITY = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Parts that meet in a task of the tree of additions.
FAN = 32
SIZE = 32  # bytes of a digest

_NODE = "grp string, n long, level int, idx long, kind string, blob binary, part long"
_ARROW = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("kind", pa.string()), ("blob", pa.binary()), ("part", pa.int64())])


def _none() -> Column:
    """No runs above."""
    return F.array().cast("array<binary>")


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 in hexadecimal of the fields: ``-`` for a null, else the UTF-8 length, a colon and the value."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


def combined(children: bytes) -> bytes:
    """The digest of a run, from its children's digests end to end."""
    return hashlib.sha256(children.hex().encode()).digest()


def at_level(n: int, level: int, arity: int = ARITY) -> int:
    """How many nodes ``n`` leaves have on a level."""
    for _ in range(level):
        n = -(-n // arity)
    return n


class Forest:
    """Unresolved nodes of trees with known numbers of leaves."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.runs, self.done = arity, {}, []

    def add(self, grp: str, n: int, level: int, idx: int, digest: bytes, part: int = 0) -> None:
        """Put in a node; runs that are complete now are resolved, upwards as far as it goes."""
        while (here := at_level(n, level, self.arity)) > 1:
            run = idx // self.arity
            held, _ = self.runs.get((grp, n, level, run), ({}, 0))
            held[idx % self.arity] = digest
            self.runs[grp, n, level, run] = held, part
            if len(held) < min(self.arity, here - run * self.arity):
                return
            del self.runs[grp, n, level, run]
            children = b"".join(held[i] for i in sorted(held))
            self.done.append((grp, n, level, run, "run", children, part))
            level, idx, digest = level + 1, run, combined(children)
        self.done.append((grp, n, level, 0, "root", digest, part))

    def resolved(self) -> list[tuple]:
        """Runs and roots since the last call."""
        out, self.done = self.done, []
        return out

    def open(self) -> Iterator[tuple]:
        """The nodes that wait for siblings."""
        for (grp, n, level, run), (held, part) in self.runs.items():
            for i, digest in held.items():
                yield grp, n, level, run * self.arity + i, "open", digest, part


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (grp, ..) with their index ``idx`` in their group's order, the group's size ``n``, and ``part``, the sorted part they were in.

    Rows are sorted in ranges over all groups and written once, so a large group lies in many parts; the
    indexes at which a group goes on in a part come from counts by part and group.
    """
    by = [F.col("grp"), *order]
    parts = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n_partitions(rows.sparkSession), *by, "_tie").sortWithinPartitions(*by)
    parts = materialize(parts.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("_at", 33)), name)
    counts = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("grp")
    counts = counts.withColumns({"n": F.sum("_c").over(whole), "_before": F.sum("_c").over(whole.orderBy("part")) - F.col("_c")})
    out = parts.join(counts.drop("_c"), ["grp", "part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
    return out.drop("_at", "_first", "_before")


def forest(leaves: DataFrame, name: str, arity: int = ARITY) -> DataFrame:
    """Resolved rows of the trees over ``leaves`` (grp, n, idx, part, digest): (grp, n, level, idx, kind, blob).

    A ``run`` has its children's digests end to end, a ``root`` its own. A group of one leaf has a root only.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(arity)
        for b in batches:
            for grp, n, idx, part, digest in zip(*(c.to_pylist() for c in b.columns)):
                own.add(grp, n, 0, idx, digest, part)
            yield _batch(own.resolved())
        yield _batch(list(own.open()))

    def add(t: pa.Table) -> pa.Table:
        own = Forest(arity)
        for grp, n, level, idx, _, digest, part in zip(*(c.to_pylist() for c in t.sort_by([("level", "ascending"), ("idx", "ascending")]).columns)):
            own.add(grp, n, level, idx, digest, part)
        return pa.Table.from_batches([_batch(own.resolved()), _batch(list(own.open()))])

    tied = leaves.select("grp", "n", "idx", "part", "digest").sortWithinPartitions("grp", "idx")
    found = materialize(tied.mapInArrow(build, _NODE), name)
    every, waiting = found.filter("kind <> 'open'"), found.filter("kind = 'open'")
    while not waiting.isEmpty():  # ends when all parts are one, after some three rounds
        near = waiting.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        found = materialize(near.groupBy("grp", "part").applyInArrow(add, _NODE), name)
        every, waiting = every.union(found.filter("kind <> 'open'")), found.filter("kind = 'open'")
    return every.drop("part")


def above(runs: DataFrame, lowest: int, arity: int = ARITY) -> DataFrame:
    """(grp, idx, path): for the runs of level ``lowest`` the children of the run itself and of those above it in its tree.

    Levels are joined from the top down; a level has a sixteenth of the rows of the one below.
    """
    known = runs.limit(0).select("grp", "idx", F.array("blob").alias("path"))
    for level in range(runs.agg(F.max("level")).first()[0] or 0, lowest - 1, -1):
        here = runs.filter(F.col("level") == level).select("grp", "idx", "blob", F.floor(F.col("idx") / arity).alias("_up"))
        here = here.join(known.withColumnsRenamed({"idx": "_up", "path": "_over"}), ["grp", "_up"], "left")
        known = here.select("grp", "idx", F.concat(F.array("blob"), F.coalesce("_over", _none())).alias("path"))
    return known


def _proved(members: DataFrame, key: str, arity: int) -> DataFrame:
    """A row for each member of the runs: the proof's digest, and the root folded from the member's ``found`` leaf."""
    schema = f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for idx, held, path, over, at, subroot, root in zip(*(c.to_pylist() for c in b.columns)):
                own = [b"".join(m["leaf"] for m in held)] if len(held) > 1 or path else []  # a group's only leaf is no run
                for i, m in enumerate(held):
                    digest, siblings = m["found"], []
                    for place, chain in ((idx * arity + i, own + path), (at, over)):
                        for children in chain:
                            p = place % arity * SIZE
                            before, after = children[:p], children[p + SIZE :]
                            siblings += [before.hex(), after.hex()]
                            digest, place = combined(before + digest + after), place // arity
                    proof = hashlib.sha256("".join(siblings).encode()).hexdigest()
                    out.append((m["key"], m["leaf"].hex(), subroot.hex(), root.hex(), proof, digest.hex()))
            if out:
                columns = list(zip(*out))
                kinds = [b.schema.field("held").type.value_type.field("key").type, *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return members.select("idx", "held", "path", "over", "at", "subroot", "root").mapInArrow(run, schema)


def manifest(rows: DataFrame, found: Column | None = None, fields: list[str] = FIELDS, group: str = "source", key: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of ``rows`` and a check of each row.

    Leaves are digests of ``fields``; they ascend by ``key`` in their ``group`` (null keys first, rows of one key by
    their digests), groups ascend by their UTF-8 bytes, null first. ``found`` is the digest that a copy of the row has now
    (the leaf itself by default); ``folded_root`` is what it leads to with the siblings of the manifest, and a row is
    verified if that is the root. ``proof_sha256`` is the digest of all siblings from the leaf up, of nothing where a
    table has one row. Repeated rows are separate leaves, other columns don't count, and an empty table gives no row.
    """
    leaf = F.unhex(row_digest([F.col(c) for c in fields]))
    grp = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    kept = rows.select(grp.alias("grp"), F.col(key).alias("key"), leaf.alias("digest"), (F.lit(None).cast("binary") if found is None else F.unhex(found)).alias("found"))
    leaves = numbered(kept, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("found")], "manifest-rows")
    leaves = materialize(leaves.sortWithinPartitions("grp", "idx"), "manifest-leaves")
    nodes = forest(leaves, "manifest-nodes", arity)

    tops = nodes.filter("kind = 'root'").select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("blob").alias("digest"))
    tops = materialize(numbered(tops, [F.col("member")], "manifest-tops"), "manifest-tops")
    last = forest(tops, "manifest-last", arity)
    root = last.filter("kind = 'root'").first()
    root = F.lit(None).cast("binary") if root is None else F.lit(root["blob"])
    over = above(last.filter("kind = 'run'"), 0, arity).select(F.col("idx").alias("_run"), F.col("path").alias("over"))
    groups = tops.withColumn("_run", F.floor(F.col("idx") / arity)).join(over, "_run", "left")
    groups = groups.select(F.col("member").alias("grp"), F.col("idx").alias("at"), F.col("digest").alias("subroot"), root.alias("root"), F.coalesce("over", _none()).alias("over"))

    one = F.struct("idx", "key", F.col("digest").alias("leaf"), F.coalesce("found", "digest").alias("found"))
    members = leaves.groupBy("grp", F.floor(F.col("idx") / arity).alias("idx")).agg(F.array_sort(F.collect_list(one)).alias("held"))
    # the runs above a run of leaves are those of its parent, which sixteen of them share
    paths = above(nodes.filter("kind = 'run'"), 1, arity).withColumnRenamed("idx", "_up")
    members = members.withColumn("_up", F.floor(F.col("idx") / arity)).join(paths, ["grp", "_up"], "left").join(small(groups, tops.count()), "grp")
    members = members.withColumn("path", F.coalesce("path", _none()))
    out = _proved(members, rows.schema[key].dataType.simpleString(), arity)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(F.col("text"), upper, upper.lower())
    tampered = F.when(crc_bucket("doc_id", 5) == 0, row_digest([lowered if c == "text" else F.col(c) for c in FIELDS]))
    return manifest(docs, found=tampered)
