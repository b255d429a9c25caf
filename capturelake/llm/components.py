"""Connected components of a graph that no machine can hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import release_memory, written

#: Nodes that a task connects at once.
NODES = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` connect, fewer of them.

    All edges of a node ``a`` meet in one task with those of other nodes; the task connects
    them in memory and returns one edge, to the least node it has found, for each. So hubs belong on the other side, ``b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            path = []
            while (up := above.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for p in path:
                above[p] = x
            return x

        def flush(kind):
            nodes = [x for x in above if top(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([above[x] for x in nodes], kind)], names=["a", "b"])
            above.clear()

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a < b:
                    above[b] = a
                elif b < a:
                    above[a] = b
            if len(above) > NODES:
                yield from flush(kind)
        if above:
            yield from flush(kind)
        release_memory()

    own = edges.select("a", "b")
    return own.repartition("a").mapInArrow(run, own.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label: the least node it reaches.

    Edges are contracted within tasks first. Then each round every node takes the least label of its neighbours and itself, then
    the label of its label, so that rounds grow with the logarithm of the longest
    path in practice. Labels are written in the shared folder each round. A
    minimum is computed before rows are shuffled, and a join on a hub's key can be
    split, so a hub of many edges is no bottleneck.
    """
    few = written(contracted(edges), "few")
    both = written(few.union(few.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        new = labels.select("node", "label").union(near).groupBy("node").agg(F.min("label").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        jumped = new.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"))
        jumped = written(jumped, "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
