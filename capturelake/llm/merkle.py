"""A Merkle manifest of a corpus: roots, and a proof for each row, by fractal traversal of aligned blocks.

Rows become leaves: SHA-256 over their fields, each with its length. The leaves of a group (a source) stand in order, and every
``ARITY`` consecutive nodes of a level become one node of the next, until one is left, the group's root. The roots
of the groups, in order, make a tree of the same kind.

A group's leaves are cut into aligned blocks of ``BLOCK``, a power of the arity, so that a block is a whole subtree and
a task needs nothing from its neighbours. Within a block, proofs come by fractal traversal: the levels are cut
into stacked subtrees; an *existing* one in each stack has the siblings of the current leaf's path, and a *desired* one
takes in one leaf with each proof, so that it is whole when the path moves into it. Only these subtrees are
held, never the block's tree. The blocks' roots are the leaves of an upper level, which is cut into blocks in the same way;
its proofs are appended to those of the blocks below.

No task has more than a block, a range of rows or one row for each range; the driver has only whether another level is left. Leaves are placed
by ranges of (group, order), so a group with a third of all rows lies in many ranges.

Nulls and odd input: a null field counts as ``-``; null groups and null orders come first. Rows that tie in order stand
by their leaves; equal rows are each a leaf of their own. Texts of any length are hashed where they are read, only hashes move.
Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import bounded_batches, written
from capturelake.llm.joins import join_small

#: Children of a node, levels of a stacked subtree, levels and leaves of a block.
ARITY, STACK, LEVELS = 3, 2, 6
BLOCK = ARITY**LEVELS
#: A proof: for each level from the leaf up, the digests left and right of the path, each joined to one text.
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields: each is ``-`` if null, else its length in bytes, a colon and its value."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c), F.lit(":"), c))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256)


class Subtree:
    """The levels ``low`` to ``high`` below one node of level ``high``, built leaf by leaf; ``kept`` has their digests."""

    def __init__(self, leaves: list[str], low: int, high: int, index: int):
        self.leaves, self.low, self.high, self.index = leaves, low, high, index
        self.at, self.end = index * ARITY**high, min(len(leaves), (index + 1) * ARITY**high)
        self.kept: list[list[str]] = [[] for _ in range(high - low)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root = None

    def advance(self) -> None:
        """Take in one leaf; the last one closes the runs that are short."""
        if self.at >= self.end:
            return
        self._add(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level, run in enumerate(self.open):
                if run:
                    self._close(level)

    def _add(self, level: int, node: str) -> None:
        if level == self.high:
            self.root = node
            return
        if level >= self.low:
            self.kept[level - self.low].append(node)
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._add(level + 1, digest(run))

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.advance()
        return self

    def run(self, level: int, index: int) -> list[str]:
        """The run of siblings with node ``index`` of ``level``."""
        first = index // ARITY * ARITY - self.index * ARITY ** (self.high - level)
        return self.kept[level - self.low][first : first + ARITY]


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    k = 0
    while ARITY**k < n:
        k += 1
    return k


def block_root(leaves: list[str], levels: int) -> str:
    return Subtree(leaves, levels, levels, 0).whole().root


def successive_paths(leaves: list[str], levels: int, stack: int = STACK) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf, from the first to the last, by fractal traversal."""
    cuts = [(low, min(low + stack, levels)) for low in range(0, levels, stack)]
    existing = [Subtree(leaves, low, high, 0).whole() for low, high in cuts]
    desired = [Subtree(leaves, low, high, 1) for low, high in cuts]
    for i in range(len(leaves)):
        path = []
        for (low, high), tree in zip(cuts, existing, strict=True):
            for level in range(low, high):
                at = i // ARITY**level
                run, own = tree.run(level, at), at % ARITY
                path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield path
        for s, (low, high) in enumerate(cuts):
            desired[s].advance()
            if (i + 1) % ARITY**high == 0:
                existing[s] = desired[s]
                desired[s] = Subtree(leaves, low, high, existing[s].index + 1)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group, from 0, and ``n``, the group's rows.

    Rows are dealt out by range; a window sees a range, or one row for each range of a group. Rows that tie in ``order`` must be interchangeable."""
    tie = F.monotonically_increasing_id()  # ties may be a third of all rows: they are cut apart too
    dealt = written(rows.withColumn("_tie", tie).repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id()), "placed")
    counts = dealt.groupBy("_part", group).agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(group)
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("n"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_tie")))
    out = own.join(counts, (own["_part"] == counts["_p"]) & own[group].eqNullSafe(counts["_g"]))
    return out.withColumn("pos", F.col("_own") - 1 + F.col("_before")).drop("_tie", "_part", "_own", "_p", "_g", "_before")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each block of ``nodes`` (grp, pos, n, digest and ``carried``), with its members in order and its root."""
    member = F.struct("pos", "digest", *carried)
    rows = nodes.groupBy("grp", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    schema = T.StructType([*rows.schema.fields, T.StructField("root", T.StringType())])
    at, size = rows.columns.index("members"), rows.columns.index("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = (m.field("digest").to_pylist() for m in (s.values for s in b.column(at)))
            roots = [block_root(d, LEVELS if n > BLOCK else levels_of(n)) for d, n in zip(digests, b.column(size).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], names=[*b.schema.names, "root"])

    return written(rows.mapInArrow(run, schema), "blocks")


def _paths(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, pos, path, apex, digest, carried...) of the members of ``blocks``, which have ``above`` and ``apex``, those of the upper levels."""
    kinds = {f.name: f for f in blocks.schema["members"].dataType.elementType.fields}
    carried = ["digest", *carried]
    out = blocks.select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast(PATH).alias("path"), "apex").schema
    for c in carried:
        out = out.add(c, kinds[c].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for b in batches:
            for i in range(b.num_rows):
                row, members = b.slice(i, 1), b.column(b.schema.get_field_index("members"))[i].values
                n, above = (row.column(row.schema.get_field_index(c)).to_pylist()[0] for c in ("n", "above"))
                tail = [(s["left"], s["right"]) for s in above]
                found = successive_paths(members.field("digest").to_pylist(), LEVELS if n > BLOCK else levels_of(n))
                for begin in range(0, len(members), 128):
                    part = members.slice(begin, 128)
                    paths = pa.array([[dict(zip(("left", "right"), s, strict=True)) for s in (*next(found), *tail)] for _ in range(len(part))], kind)
                    same = [row.column(row.schema.get_field_index(c)).take(pa.array([0] * len(part))) for c in ("grp", "apex")]
                    yield pa.RecordBatch.from_arrays([same[0], part.field("pos"), paths, same[1], *(part.field(c) for c in carried)], names=out.names)

    return blocks.mapInArrow(run, out)


def proofs(nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The proofs of ``nodes`` (grp, pos, n, digest, ``carried``) in their group's tree: (grp, pos, path, apex, digest, carried...), and the groups' (grp, apex)."""
    bounded_batches(nodes.sparkSession)
    levels = [_blocks(nodes, carried)]
    while True:  # one round for each factor of BLOCK in the largest group
        last = levels[-1]
        upper = last.where(F.col("n") > BLOCK).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
        if upper.isEmpty():
            break
        levels.append(_blocks(upper, []))
    alone = [b.where(F.col("n") <= BLOCK).select("grp", F.col("root").alias("apex")) for b in levels]
    apexes = alone[0]
    for more in alone[1:]:
        apexes = apexes.unionByName(more)
    above = None
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k]
        if above is None:
            blocks = blocks.withColumns({"above": F.array().cast(PATH), "apex": F.col("root")})
        else:
            up = above.select(F.col("grp").alias("_g"), F.col("pos").alias("_b"), F.col("path").alias("above"), "apex")
            blocks = blocks.join(up, blocks["grp"].eqNullSafe(up["_g"]) & (blocks["block"] == up["_b"]), "left").drop("_g", "_b")
            blocks = blocks.withColumns({"above": F.coalesce("above", F.array().cast(PATH)), "apex": F.coalesce("apex", "root")})
        above = _paths(blocks, carried if k == 0 else [])
        if k:
            above = written(above, "upper-proofs")
    return above, written(apexes, "apexes")


def inclusion_proofs(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``order``, leaf, subroot, root, path (see ``PATH``) from the leaf to the root, and changed_leaf:
    the digest with ``changed`` in place of ``text``, null where that makes no difference or ``changed`` isn't given."""
    other = F.lit(None).cast("string") if changed is None else F.when(changed != F.col(text), leaf_digest([changed if f == text else F.col(f) for f in fields]))
    slim = docs.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), other.alias("other"))
    nodes = placed(written(slim, "leaves"), "grp", ["id", "digest", "other"])
    own, subroots = proofs(nodes, ["id", "other"])
    top = placed(subroots.select(F.lit(0).alias("all"), "grp", F.col("apex").alias("digest")), "all", ["grp"])
    tops, _ = proofs(top.withColumnsRenamed({"grp": "name", "all": "grp"}), ["name"])
    tops = written(tops.select("name", F.col("path").alias("top"), F.col("apex").alias("root")), "top-proofs")
    out = join_small(own.withColumnRenamed("digest", "leaf"), tops.withColumnRenamed("name", "grp"), "grp")
    return out.select(F.col("id").alias(order), "leaf", F.col("apex").alias("subroot"), "root", F.concat("path", "top").alias("path"), F.col("other").alias("changed_leaf"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of a proof's siblings from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: each row's proof, folded over the row as it is or, for ids
    with an even crc32, over the row without the line breaks of its text. Null ids are never tampered with."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = inclusion_proofs(docs, tampered)
    root = folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
