"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

# Links of a task in the mean, and tasks of a step at least, as far as the session has partitions.
LINKS = 50_000
TASKS = 8


class Forest:
    """Union-find over the items one task meets; ``join`` tells whether two parts were separate."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternates the large-star and small-star steps until nothing changes: each ties all neighbours
    of a node to the smallest one known. The number of links never grows, minima are combined
    before the shuffle, and a node with very many links is a skewed join key that adaptive
    execution splits. Every round is written to the checkpoint folder.

    Links are few against the texts they come from, and a round has half a dozen shuffles, in each of
    which every task leaves files. So tasks that write are as many as the links need, not as the
    session has partitions.
    """
    pairs = pin(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            break
        before = state
        tasks = max(TASKS, -(-state[0] // LINKS))  # no step makes more links than it was given
        pairs = pairs.coalesce(tasks)
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("hi"), F.col("m").alias("lo")),
                        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                    )
                ).alias("x")
            )
            .select("x.hi", "x.lo")
            .where(F.col("hi") != F.col("lo"))
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        pairs = pin(small)
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
