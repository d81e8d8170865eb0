"""Networks and clusters of sequences: linkage, minimum trees, tandem and chimera merging, greedy clusters.

Edges come from pairs that share k-mers. Components are found by star rounds over edges with partial
aggregation; each round is written to the shared folder, so that lineage stays short and a lost
executor costs one round. Order-dependent merging depends only on its own component, so components
are scanned one by one from sorted partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import written


def components(edges: DataFrame, a: str = "id_a", b: str = "id_b", most_rounds: int = 100) -> DataFrame:
    """(node, component): the least node of each node's component; nodes without an edge are not listed."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        hop = labels.select(F.col("u").alias("label"), F.col("label").alias("beyond"))  # pointer jump: the label's own label
        step = labels.join(near, "u").join(hop, "label", "left").select("u", F.least("label", "other", F.coalesce("beyond", "label")).alias("next"), F.col("label").alias("old"))
        step = written(step, "labels")
        changed = step.where("next <> old").limit(1).count()
        labels = step.select("u", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def linked(nodes: DataFrame, edges: DataFrame, key: str = "rowid") -> DataFrame:
    """(key, component) of all nodes; those without an edge are their own component."""
    return nodes.select(key).join(components(edges).withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def minimum_tree(edges: DataFrame, weight: str = "distance", most_rounds: int = 40) -> DataFrame:
    """(id_a, id_b, weight): a minimum spanning forest by Boruvka's rounds; ties by weight, then ids."""
    rest = written(edges.select("id_a", "id_b", weight).withColumns({"ca": F.col("id_a"), "cb": F.col("id_b")}), "tree")
    chosen = None
    for _ in range(most_rounds):
        open_ = rest.where("ca <> cb")
        if not open_.limit(1).count():
            break
        order = F.struct(F.col(weight).alias("w"), F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"), "id_a", "id_b", "ca", "cb")
        sides = open_.select(F.col("ca").alias("c"), order.alias("e")).unionByName(open_.select(F.col("cb").alias("c"), order.alias("e")))
        best = written(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "tree")
        chosen = best if chosen is None else chosen.unionByName(best)
        label = components(best, "ca", "cb")
        for side in ("ca", "cb"):
            rest = rest.join(label.select(F.col("node").alias(side), F.col("component").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
        rest = written(rest, "tree")
    if chosen is None:
        return rest.select("id_a", "id_b", weight).limit(0)
    return chosen.select("id_a", "id_b", F.col("w").alias(weight)).distinct()


def scanned(df: DataFrame, component: str, fn, columns: list[str], schema: str) -> DataFrame:
    """fn(list of rows of a component) -> rows, over sorted partitions."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches):
        held: list = []
        now = object()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != now and held:
                    out += fn(held)
                    held = []
                now = row[0]
                held.append(row[1:])
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fn(held), columns=names)

    return df.select(component, *columns).repartition(component).sortWithinPartitions(component, *columns).mapInPandas(scan, schema)


def greedy_clusters(nodes: DataFrame, edges: DataFrame, order: str = "cnt", key: str = "rowid") -> DataFrame:
    """(key, cluster): from the largest to the smallest, a node joins the first (largest, then least id) centre it has an edge to, or becomes one."""
    edges = written(edges.select("id_a", "id_b"), "edges", drop_shuffles=True)  # read three times
    part = linked(nodes, edges, key)
    arcs = edges.select(F.col("id_a").alias(key), F.col("id_b").alias("other")).unionByName(edges.select(F.col("id_b").alias(key), F.col("id_a").alias("other")))
    near = arcs.groupBy(key).agg(F.collect_set("other").alias("near"))  # neighbours of one node
    rows = nodes.select(key, F.col(order).cast("double").alias("_o")).join(part, key).join(near, key, "left").select("component", (-F.col("_o")).alias("o"), F.col(key).alias("k"), "near")

    def first_fit(held):
        centre_rank: dict = {}
        out = []
        for _, k, near in held:
            centres = [centre_rank[x] for x in (near if near is not None else ()) if x in centre_rank]
            if centres:
                out.append((k, min(centres)[1]))
            else:
                centre_rank[k] = (len(centre_rank), k)
                out.append((k, k))
        return out

    return scanned(rows.withColumn("near", F.coalesce("near", F.array().cast("array<bigint>"))), "component", first_fit, ["o", "k", "near"], f"{key} bigint, cluster bigint")


def tandems_collapsed(nodes: DataFrame, edges: DataFrame, factor: float = 2.0, key: str = "rowid") -> DataFrame:
    """(key, into): each node tied to its most abundant neighbour that is at least factor times as abundant (least id on ties), followed to the end."""
    edges = written(edges.select("id_a", "id_b"), "edges", drop_shuffles=True)
    size = nodes.select(F.col(key).alias("n"), "cnt")
    arcs = edges.select(F.col("id_a").alias("s"), F.col("id_b").alias("t")).unionByName(edges.select(F.col("id_b").alias("s"), F.col("id_a").alias("t")))
    both = arcs.join(size.withColumnsRenamed({"n": "s", "cnt": "cs"}), "s").join(size.withColumnsRenamed({"n": "t", "cnt": "ct"}), "t").where(F.col("ct") >= factor * F.col("cs"))
    up = both.groupBy("s").agg(F.min(F.struct((-F.col("ct")).alias("c"), "t")).alias("b")).select("s", "b.t")
    tied = written(nodes.select(F.col(key).alias("s")).join(up, "s", "left").select("s", F.coalesce("t", "s").alias("t")), "tandem")
    while True:
        step = written(tied.join(tied.select(F.col("s").alias("t"), F.col("t").alias("further")), "t").select("s", F.col("further").alias("t"), (F.col("further") != F.col("t")).alias("moved")), "tandem")
        tied = step.select("s", "t")
        if not step.where("moved").limit(1).count():
            return tied.select(F.col("s").alias(key), F.col("t").alias("into"))


def chimeras(nodes: DataFrame, size: int = 30, ratio: float = 2.0, key: str = "rowid") -> DataFrame:
    """(key, front_parent, back_parent): nodes whose first and last letters are those of two different, more abundant nodes that don't share both."""
    ends = nodes.where(F.length("seq") >= 2 * size).select(F.col(key).alias("n"), "cnt", F.substring("seq", 1, size).alias("f"), F.expr(f"right(seq, {size})").alias("b"))
    tops = lambda side: ends.groupBy(side).agg(F.max(F.struct("cnt", (-F.col("n")).alias("o"))).alias(f"top_{side}"))
    both = ends.join(tops("f"), "f").join(tops("b"), "b")
    p, q = F.col("top_f"), F.col("top_b")
    hit = both.where((p["cnt"] >= ratio * F.col("cnt")) & (q["cnt"] >= ratio * F.col("cnt")) & (p["o"] != q["o"]))
    return hit.select(F.col("n").alias(key), (-p["o"]).alias("front_parent"), (-q["o"]).alias("back_parent"))


def nearest_events(pairs: DataFrame, best_only: bool = True) -> DataFrame:
    """Edges of a haplotype network: pairs with events = mismatches and indels; for each node only those of fewest events, ties included."""
    edges = pairs.withColumn("events", F.col("mismatches") + F.col("small_indels") + F.col("large_indels"))
    if not best_only:
        return edges
    sides = edges.select(F.col("id_a").alias("n"), "events").unionByName(edges.select(F.col("id_b").alias("n"), "events"))
    least = sides.groupBy("n").agg(F.min("events").alias("least"))
    a, b = (least.withColumnsRenamed({"n": s, "least": f"least_{s}"}) for s in ("id_a", "id_b"))
    return edges.join(a, "id_a").join(b, "id_b").where((F.col("events") == F.col("least_id_a")) | (F.col("events") == F.col("least_id_b"))).drop("least_id_a", "least_id_b")


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
