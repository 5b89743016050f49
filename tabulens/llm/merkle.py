"""Merkle manifest of a table: one root for all rows, one proof for each.

Each row is a leaf, the SHA-256 of its fields. The leaves of a source, by id, form a tree of fan-in
FAN; the roots of these trees, by source, form the tree above them. With its proof - the digests
beside its way up - anybody can fold a row up to the root and see whether it was changed.

``build`` makes the tree level by level and writes it as node rows: id, parent, the digests of the
siblings left and right of the node. ``climb`` is a recursive query of Spark SQL over these rows. It
goes up from every leaf: each step joins the node that a row stands at, folds its digests with the
siblings, appends these to the proof and moves on to the parent, until the root. The leaves of one
run (up to FAN neighbours) share all of their way up, so a row of the recursion is a run that
holds the folded digests of its leaves; a row per leaf would shuffle the same siblings FAN times.

What is shuffled: digests and ids, never texts. Positions inside a source come from one range
shuffle that also splits a hot source. Many runs stand below the same node near the root; such a
node has as many copies as it has 1/COPIES shares of all runs, and the runs are dealt to these, so
no join key holds more than about 1/COPIES of the rows at any level. Levels and leaves are written
to the checkpoint folder. The driver sees the number of levels and the root.

Defined cases: a null field is "-"; repeated rows are leaves of their own (neighbours, by digest);
null ids come first in their source and are never altered; the null source comes first; an empty
text is a text of 0 bytes; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.operators.ordinal import with_ordinal
from tabulens.session import pin

from .lookup import look_up
from .store import Store, setting

FAN = 16
COPIES = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
WITH RECURSIVE climb(tree, run, salt, at, copy, folds, siblings, subroot) AS (
    SELECT tree, run, salt, at, copy, folds, siblings, subroot FROM {runs}
    UNION ALL
    SELECT c.tree, c.run, c.salt, n.parent, pmod(c.salt, n.parent_copies),
        transform(c.folds, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256))),
        concat(c.siblings, n.before, n.after),
        coalesce(c.subroot, n.subroot)
    FROM climb c JOIN {nodes} n ON c.at = n.id AND c.copy = n.copy
)
SELECT tree, run, folds, siblings, subroot FROM climb WHERE at = {root}
"""


@dataclass
class Manifest:
    """``runs`` (tree, run, leaves, ...) and ``nodes`` (id, parent, before, after, ...) of a table."""

    runs: DataFrame
    nodes: DataFrame
    root_id: str
    root: str


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def encoded(value: Column) -> Column:
    """A field as it enters the digest: its number of bytes and its text, "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def altered(id_col: str) -> Column:
    """Whether a row belongs to the fifth that is altered on trial."""
    return F.coalesce(F.crc32(_name(id_col).cast("string")) % 5 == 0, F.lit(False))


def _node(tree: Column, level: int, pos: Column) -> Column:
    return F.concat(tree, F.lit(f"/{level}/"), pos.cast("string"))


def _copies(weight: Column, total: int) -> Column:
    share = F.ceil(weight * COPIES / max(total, 1))
    return F.least(weight, share, F.lit(COPIES)).cast("long")


def _above(level: DataFrame) -> DataFrame:
    """(tree, pos, n, weight, kids) of the nodes above those of a level.

    ``kids`` are the nodes of a run in their order, FAN at most.
    """
    return (
        level.groupBy("tree", F.expr(f"pos div {FAN}").alias("up"))
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash", "weight", "subroot"))).alias("kids"),
            F.any_value("n").alias("below"),
            F.sum("weight").alias("weight"),
        )
        .select(
            "tree",
            F.col("up").alias("pos"),
            F.ceil(F.col("below") / FAN).cast("long").alias("n"),
            "weight",
            "kids",
            F.sha2(F.concat_ws("", "kids.hash"), 256).alias("hash"),
            F.lit(None).cast("string").alias("subroot"),
        )
    )


def _links(above: DataFrame, number: int, total: int) -> DataFrame:
    """Node rows of the kids at level ``number`` below ``above``, in as many copies as they need."""
    kids = above.select(
        "tree",
        F.col("pos").alias("up"),
        F.col("weight").alias("up_weight"),
        F.col("kids.hash").alias("hashes"),
        F.posexplode("kids").alias("place", "kid"),
    )
    rows = kids.select(
        _node(F.col("tree"), number, F.col("kid.pos")).alias("id"),
        _node(F.col("tree"), number + 1, F.col("up")).alias("parent"),
        _copies(F.col("up_weight"), total).alias("parent_copies"),
        F.unhex(F.concat_ws("", F.slice("hashes", F.lit(1), F.col("place")))).alias("before"),
        F.unhex(F.concat_ws("", F.slice("hashes", F.col("place") + 2, F.lit(FAN)))).alias("after"),
        F.col("kid.subroot").alias("subroot"),
        F.explode(
            F.sequence(F.lit(0).cast("long"), _copies(F.col("kid.weight"), total) - 1)
        ).alias("copy"),
    )
    return rows


def build(
    df: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> Manifest | None:
    """The manifest of a table; None if it has no rows.

    The leaves carry the digest of the row and that of the row with its text lower-cased, where
    ``altered`` says so.
    """
    spark = df.sparkSession
    store = Store(spark, "merkle")
    lowered = F.translate(_name(text_col), UPPER, UPPER.lower())
    changed = [lowered if f == text_col else _name(f) for f in fields]
    # texts are read once: what goes on are digests
    leaves = store.keep(
        df.select(
            _name(id_col).alias("id"),
            # null first, as "-" is smaller than "="
            F.coalesce(F.concat(F.lit("="), _name(source_col).cast("string")), F.lit("-")).alias(
                "tree"
            ),
            leaf_hash([_name(f) for f in fields]).alias("leaf"),
            F.when(altered(id_col), leaf_hash(changed)).alias("changed"),
        ),
        "leaves",
    )
    placed = with_ordinal(leaves, ["tree", "id", "leaf"])
    trees = store.keep(
        placed.groupBy("tree").agg(F.min("_rid").alias("first"), F.count("*").alias("leaves_in")),
        "trees",
    )
    most = trees.agg(F.max("leaves_in").alias("n"), F.count("*").alias("m")).first()
    if not most.m:
        return None
    in_tree = look_up(placed, trees, "tree", F.octet_length("tree") + 16, F.col("_rid"))
    pos = F.col("_rid") - F.col("first")
    runs = store.keep(
        in_tree.groupBy("tree", F.floor(pos / FAN).alias("run"))
        .agg(
            F.any_value("leaves_in").alias("leaves_in"),
            F.sort_array(
                F.collect_list(F.struct(pos.alias("pos"), "id", "leaf", "changed"))
            ).alias("leaves"),
        )
        .withColumn(
            "hash",
            F.when(F.col("leaves_in") == 1, F.col("leaves.leaf")[0]).otherwise(
                F.sha2(F.concat_ws("", "leaves.leaf"), 256)
            ),
        ),
        "runs",
    )
    total = runs.count()

    def grow(level: DataFrame, number: int, nodes: int, label: str) -> tuple[DataFrame, list]:
        """Tops (n = 1) of the trees whose level ``number`` is given, and node rows of all others."""
        links, tops = [], [level.where("n = 1").withColumn("number", F.lit(number))]
        while nodes > 1:
            above = store.keep(_above(level.where("n > 1")), f"{label}-{number}")
            links.append(_links(above, number, total))
            level, number, nodes = above.drop("kids"), number + 1, -(-nodes // FAN)
            tops.append(level.where("n = 1").withColumn("number", F.lit(number)))
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out, links

    first = runs.select(
        "tree",
        F.col("run").alias("pos"),
        F.ceil(F.col("leaves_in") / FAN).cast("long").alias("n"),
        F.lit(1).cast("long").alias("weight"),
        "hash",
        F.lit(None).cast("string").alias("subroot"),
    )
    tops, links = grow(first, 1, -(-most.n // FAN), "level")
    tops = store.keep(tops, "tops")
    if most.m == 1:
        root = tops.first()
        root_id, root_hash = f"{root.tree}/{root.number}/0", root.hash
    else:
        # the tree above: its lowest level are the subroots, under the ids they have in their trees
        seconds = with_ordinal(tops, ["tree"], "pos_above")
        lowest = seconds.select(
            F.lit("").alias("tree"),
            F.col("pos_above").alias("pos"),
            F.lit(most.m).cast("long").alias("n"),
            "weight",
            "hash",
            F.col("hash").alias("subroot"),
        )
        upper, more = grow(lowest, 0, most.m, "upper")
        names = seconds.select(
            F.concat(F.lit("/0/"), F.col("pos_above").cast("string")).alias("id"),
            F.concat("tree", F.lit("/"), "number", F.lit("/0")).alias("own"),
        )
        more[0] = more[0].join(names, "id").drop("id").withColumnRenamed("own", "id")
        links += more
        root = upper.first()
        root_id, root_hash = f"/{root.number}/0", root.hash
    rows = None
    for own in links:
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        rows = _links(_above(first.where("false")), 1, total)
    return Manifest(runs, store.keep(rows, "nodes"), root_id, root_hash)


def climb(manifest: Manifest) -> DataFrame:
    """(tree, run, folds, siblings, subroot) of every run, as it arrives at the root.

    ``folds`` are the roots that the leaves of the run fold to: first that of all its unchanged
    leaves, which is one, then those of the changed leaves in their order. ``siblings`` are the
    digests beside the way from the run to the root. Digests travel as bytes, half of their text.
    """
    spark = manifest.runs.sparkSession
    first = """transform(
        filter(transform(leaves, (x, i) -> struct(x.changed AS own, i AS i)), x -> x.own IS NOT NULL),
        x -> CASE WHEN leaves_in = 1 THEN unhex(x.own) ELSE unhex(sha2(concat(
            concat_ws('', slice(leaves.leaf, 1, x.i)), x.own,
            concat_ws('', slice(leaves.leaf, x.i + 2, size(leaves)))), 256)) END)"""
    start = manifest.runs.select(
        "tree",
        "run",
        F.abs(F.xxhash64("tree", "run") % (COPIES * 1000)).alias("salt"),
        _node(F.col("tree"), 1, F.col("run")).alias("at"),
        # a first node stands above one run, so it has one copy
        F.lit(0).cast("long").alias("copy"),
        F.concat(F.array(F.unhex("hash")), F.expr(first)).alias("folds"),
        F.unhex(F.lit("")).alias("siblings"),
        F.lit(None).cast("string").alias("subroot"),
    )
    with setting(spark, ROW_LIMIT, "-1"):  # as many rows as there are runs
        return pin(spark.sql(CLIMB, runs=start, nodes=manifest.nodes, root=manifest.root_id))


def prove(df: DataFrame, **names) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of a table."""
    manifest = build(df, **names)
    id_col = names.get("id_col", "doc_id")
    kind = df.schema[id_col].dataType.simpleString()
    if manifest is None:
        schema = (
            f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean"
        )
        return df.sparkSession.createDataFrame([], schema)
    rows = (
        climb(manifest)
        .join(manifest.runs.select("tree", "run", "leaves"), ["tree", "run"])
        .select(
            F.posexplode("leaves").alias("place", "own"),
            "folds",
            F.lower(F.hex("siblings")).alias("above"),
            F.coalesce("subroot", F.lit(manifest.root)).alias("subroot"),
            F.col("leaves.leaf").alias("hashes"),
            F.col("leaves.changed").alias("changes"),
        )
    )
    beside = F.concat(
        F.concat_ws("", F.slice("hashes", F.lit(1), F.col("place"))),
        F.concat_ws("", F.slice("hashes", F.col("place") + 2, F.lit(FAN))),
        "above",
    )
    changed_up_to = F.size(
        F.filter(F.slice("changes", F.lit(1), F.col("place") + 1), lambda c: c.isNotNull())
    )
    which = F.when(F.col("own.changed").isNull(), 0).otherwise(changed_up_to)
    folded = F.lower(F.hex(F.get("folds", which)))
    return rows.select(
        F.col("own.id").alias("id"),
        F.col("own.leaf").alias("leaf"),
        "subroot",
        F.lit(manifest.root).alias("root"),
        F.sha2(beside, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == manifest.root).alias("verified"),
    )
