"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavestrata.llm.store import dropped, written
from wavestrata.llm.textkit import tidy

_LINKS = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as links of each node to the least node of its component in the task."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy()))
    for s in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in (a, b)], ["a", "b"])


def _with_least(links: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """links with the column least of their node.

    least is a table of its own with one row a node: Spark sends it to all tasks if its size allows that, and
    otherwise can split the rows of a node with very many links.
    """
    return links.join(written(least, "least").withColumnRenamed("node", node), node)


def _settled(links: DataFrame) -> bool:
    """Whether every node with a link has one only, to a node without any."""
    end = lambda c, leads: F.struct(F.col(c).alias("node"), F.lit(leads).alias("leads"), F.lit(not leads).alias("led"))
    nodes = links.select(F.inline(F.array(end("a", True), end("b", False)))).groupBy("node").agg(F.count_if("leads").alias("n"), F.bool_or("led").alias("led"))
    return not nodes.agg(F.count_if((F.col("n") > 1) | ((F.col("n") == 1) & F.col("led")))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, component being its least node.

    links has columns a and b; none may be null. Without links the result is empty. Tasks of about _LINKS links first link each node to the least
    one of its component within the task. Each round then computes the least neighbour of each node with map-side
    aggregation and writes the new links to the shared folder, until all links lead straight to the least nodes. The number of rounds
    grows with the logarithm of the longest path.
    """
    given = written(links.select("a", "b").where("a <> b"), "given")  # so that no task needs Python workers for two steps at once
    tasks = -(-given.count() // _LINKS) or 1
    links = written(given.coalesce(tasks).mapInArrow(tidy(_contract), "a long, b long").distinct(), "links")
    dropped(given)
    while not _settled(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = _with_least(both, "a", least).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        linked = _with_least(large, "a", least)
        small = linked.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        old, links = links, written(small, "links")
        dropped(old, large)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
