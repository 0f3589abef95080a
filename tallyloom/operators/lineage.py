"""Graphs of flows: edges, clusters, layers, chains and provenance. Loops end in written checkpoints."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.shared import settled, shared_dir

from .quality import fuzzy_match, plain_name


def match_edges(outputs: DataFrame, inputs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(flow, output, to_flow, how) for outputs that are inputs of other flows: by fingerprint (where both sides have such a
    column), by equal name, by normalised name, by likeness.

    Each later way is tried for the outputs that the earlier ones left over; null fingerprints match nothing. What one way
    found and what it left is written before the next, so that each is planned and made once, and both sides of a join are
    shuffled: their files say little about the rows that a broadcast would bring to the driver.
    """
    more = ["fingerprint"] if "fingerprint" in outputs.columns and "fingerprint" in inputs.columns else []
    left = settled(outputs.select("flow", "name", *more).distinct())
    i = settled(inputs.select(F.col("flow").alias("to_flow"), F.col("name").alias("in_name"), *[F.col(c).alias("in_" + c) for c in more]).distinct())
    near = i.hint("merge")
    found = []

    def settle(pairs: DataFrame, how: str) -> None:
        """Keep the edges of one way and leave its outputs out of the next."""
        nonlocal left
        one = settled(pairs.filter("flow <> to_flow").select("flow", F.col("name").alias("output"), "to_flow", F.lit(how).alias("how")).distinct())
        found.append(one)
        done = one.select(F.col("flow").alias("\0f"), F.col("output").alias("\0n")).distinct().hint("merge")
        left = settled(left.join(done, F.col("flow").eqNullSafe(F.col("\0f")) & F.col("name").eqNullSafe(F.col("\0n")), "left_anti"))

    if more:
        settle(left.join(near, F.col("fingerprint") == F.col("in_fingerprint")), "fingerprint")
    settle(left.join(near, F.col("name") == F.col("in_name")), "exact")
    settle(left.join(near, plain_name(F.col("name")) == plain_name(F.col("in_name"))), "name")
    if not left.isEmpty():
        alike = fuzzy_match(left, "name", i, "in_name", threshold).hint("merge")
        settle(left.join(alike, F.col("name") == F.col("left")).join(near, F.col("right") == F.col("in_name")), "fuzzy")
    return reduce(DataFrame.unionByName, found)


def clusters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cluster) for (a, b) pairs of links: the smallest linked node; a node without links is its own cluster.

    Every round takes the least label among neighbours and then the label's own label, so that paths halve.
    """
    edges = settled(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct())
    labels = settled(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "cluster", F.least("cluster", "m").alias("new"))
        up = labels.select(F.col("node").alias("n2"), F.col("cluster").alias("c2"))
        moved = settled(step.join(up, F.col("new") == F.col("n2"), "left").select("node", "cluster", F.least("new", "c2").alias("new")))
        changed = moved.filter("new <> cluster").limit(1).count()
        labels = moved.select("node", F.col("new").alias("cluster"))
        if not changed:
            return labels


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of a graph of (src, dst): layer 0 has no inputs, each further one only inputs of lower layers. A cycle is an error.

    Linear chains are contracted first, by doubling (see chains()), to one edge as long as the chain; rounds then take the
    nodes without open inputs from the rest, and places along the chains are added back. A round is a layer of the
    contracted graph, so a chain of any length takes one; a cycle is what is left when no node is ready.
    """
    given = settled(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    spark, path = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/layers/{uuid.uuid4().hex}"
    places = settled(chains(given))
    inner = places.filter("place > 0").select("node", "head", "place")
    at = lambda end: given.join(inner.withColumnRenamed("node", end), end, "left")
    # An edge into the inside of a chain is the chain's own.
    outer = at("src").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    left = settled(outer.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("place", F.lit(0)) + 1).alias("far")).groupBy("src", "dst").agg(F.max("far").alias("far")))
    every = given.select(F.col("src").alias("node")).union(given.select("dst")).distinct()
    nodes = settled(every.join(inner.select("node"), "node", "left_anti").withColumn("layer", F.lit(0).cast("long")))
    nodes.limit(0).write.mode("append").parquet(path)
    while not nodes.isEmpty():
        waiting = left.select(F.col("dst").alias("node")).distinct()
        ready = settled(nodes.join(waiting, "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the edges have a cycle")
        ready.write.mode("append").parquet(path)
        reached = left.join(ready.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("layer") + F.col("far")).alias("reached"))
        nodes = settled(nodes.join(waiting, "node", "left_semi").join(reached, "node", "left").select("node", F.greatest("layer", F.coalesce("reached", F.lit(0))).alias("layer")))
        left = settled(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
    heads = spark.read.schema(nodes.schema).parquet(path)
    inside = inner.join(heads.withColumnRenamed("node", "head"), "head").select("node", (F.col("layer") + F.col("place")).alias("layer"))
    return heads.unionByName(inside).withColumn("layer", F.col("layer").cast("int"))


def chains(edges: DataFrame) -> DataFrame:
    """(head, node, place) of linear chains: runs of nodes joined by edges that are the only way out and the only way in.

    Every round each node takes over the way its own furthest node knows, so that ways double. Rings have no head and no rows.
    """
    e = edges.select("src", "dst").distinct()
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    ins = e.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    single = settled(e.join(outs, "src").join(ins, "dst").filter("o = 1 and i = 1").select("src", "dst"))
    ways = single.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("place"))
    for _ in range(single.count().bit_length()):
        further = ways.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        moved = settled(ways.join(further, "head", "left").select("node", F.coalesce("far", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("far").isNotNull().alias("moved")))
        ways = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    heads = single.join(single.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("head"), F.col("src").alias("node"), F.lit(0).cast("long").alias("place"))
    return heads.unionByName(ways.join(ways.select(F.col("node").alias("head")), "head", "left_anti"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    name = nodes.columns[0]
    ends = edges.select(F.col("src").alias(name)).union(edges.select("dst"))
    return nodes.join(ends, name, "left_anti")


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """(node, role): sources are never a target, sinks never a source."""
    a, b = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    return a.join(b, "node", "left_anti").withColumn("role", F.lit("source")).unionByName(b.join(a, "node", "left_anti").withColumn("role", F.lit("sink")))


def provenance(df: DataFrame, key: str, source: str = "Table Names") -> DataFrame:
    """Which sources contribute each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"))
