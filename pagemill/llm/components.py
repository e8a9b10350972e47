"""Connected components over a table of links, without the driver or a single task holding a large one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import cut, discard, heavy_join, least_members

#: Links that are so few that one task ends the rounds with them.
LAST = 1 << 16


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [batch.select(["a", "b"]) for batch in batches]
    if links:
        up, node = least_members(*(np.concatenate([x.column(c).to_numpy() for x in links]) for c in "ab"))
        up, node = (np.concatenate([x, np.unique(up)]) for x in (up, node))  # those that are pointed at point at themselves
        yield pa.record_batch([pa.array(node), pa.array(up)], names=["node", "up"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the least node that it is connected to.

    Each round every node points at the one of least hash among itself and its neighbours, by a hash of
    that round's own, and links go on between the nodes that are pointed at: links within a group
    vanish, equal ones become one, and a chain halves. So a round joins only what the ones before have
    left, and all rounds together some few times the links, however many rounds there are; at most ``LAST`` links
    are left to one task. What nodes point at is then followed backwards, from the last round to the first. Each
    round's tables are written to the shared folder, so that a lost executor costs one round at most, and
    deleted when nothing reads them any more. Nodes of many links, such as the least one of a large group, are
    joined by broadcast, and hashes are taken before they are shuffled, so the links of a node are never in one task
    unless they are that few. The result is a written table: callers read it several times, and a lazy one would
    be planned and joined again in each place.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(links.where("a <> b").select(least.alias("a"), most.alias("b")).distinct(), "edges")
    steps = []
    while n := edges.count():
        if n <= LAST:
            steps.append(cut(edges.coalesce(1).mapInArrow(_last, "node long, up long"), "labels"))
            break
        if len(steps) == most_rounds:
            raise RuntimeError(f"no end after {most_rounds} rounds")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("node"))
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        to = F.least(F.min(rank("b")), F.min(rank("a")))["node"]
        up = cut(ends.groupBy(F.col("a").alias("node")).agg(to.alias("up"), F.count("*").alias("degree")), "labels")
        first, second = (up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}"), "degree") for x in "ab")
        placed = heavy_join(edges, first, ["a"], "degree", 2 * n).select("up_a", "b")
        placed = heavy_join(placed, second, ["b"], "degree", 2 * n).select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        after = cut(placed.where("a <> b").select(least.alias("a"), most.alias("b")).distinct(), "edges")
        discard(edges)
        edges = after
        steps.append(up)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    discard(edges)
    if n and len(steps) == 1:  # one task has seen all links, and points at the least nodes
        out = steps[0].withColumnRenamed("up", "label")
        out._cut_path = steps[0]._cut_path
        return out
    roots = None
    for up in reversed(steps):
        on = up.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n"))  # a node of the next round, or one that is done
        on = on.withColumn("root", F.col("node")) if roots is None else on.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        on = cut(on.select(F.col("node").alias("up"), "root", "n"), "roots")
        found = cut(heavy_join(up.select("node", "up"), on, ["up"], "n", up.count()).select("node", "root"), "roots")
        discard(*filter(None, (roots, on, up)))
        roots = found
    names = cut(roots.groupBy("root").agg(F.min("node").alias("label"), F.count("*").alias("n")), "labels")
    out = cut(heavy_join(roots, names, ["root"], "n", roots.count()).select("node", "label"), "components")
    discard(roots, names)
    return out
