"""A Merkle manifest of a table: a tree for each source, and one over the sources.

Leaves get their places by a range sort and partition totals, so no source is
ever gathered.  Each aligned block of 243 nodes keeps every level as one hex
string, of 64 characters a node: parents are hashes of fixed-width substrings
of three nodes, and what flanks a node within its substring are its siblings.
The roots of blocks are the nodes of the next round, until one is left.

Down again, a block takes the siblings of its root from the block above, once
for all its nodes, and each node adds its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: Nodes that one hash takes, levels of a block, nodes of a block, and characters of a digest.
ARITY, LEVELS, HEX = 3, 5, 64
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as its length in UTF-8 bytes, a colon and the value, or as ``-`` if it is null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows, written once, with ``at``: their places in the order, from 0. Equal rows may stand in any order among themselves."""
    # rows that are equal in the whole order spread over partitions by where they were read
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(parts, *order, "spread").sortWithinPartitions(*order, "spread").drop("spread")
    placed = materialize(ranged.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    totals = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("own")).drop("part", "own", "base")


def _parents(level: Column) -> Column:
    """The level above, as one string."""
    wide = ARITY * HEX
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / wide).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * wide + 1, F.lit(wide)))), "")


def _blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """g, n, b, height, nodes (pos, digest, payload), levels (strings), top: one row for each aligned block of nodes (g, n of the group, pos, digest)."""
    b = F.floor(F.col("pos") / BLOCK)
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *payload)))
    found = nodes.groupBy("g", "n", b.alias("b")).agg(members.alias("nodes"))
    # a group of one node is its own root; in a group of several blocks each is lifted all its levels
    height = sum(((F.col("n") > ARITY**k).cast("int") for k in range(1, LEVELS)), (F.col("n") > 1).cast("int"))
    found = found.withColumns({"height": height, "level0": F.array_join("nodes.digest", "")})
    for k in range(LEVELS):
        found = found.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"level{k}"))))
    levels = F.array(*[F.col(f"level{k}") for k in range(LEVELS + 1)])
    top = F.element_at(levels, F.col("height") + 1)
    return materialize(found.select("g", "n", "b", "height", "nodes", levels.alias("levels"), top.alias("top")))


def climb(nodes: DataFrame, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks, lowest first, and (g, digest) of each group's root. nodes: g, n, pos, digest, payload."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, *(payload if not rounds else ())))
        tops = rounds[-1].select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("b").alias("pos"), F.col("top").alias("digest"))
        if (tops.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, tops.select("g", "digest")
        nodes = tops


def _path(height: Column, levels: Column, i: Column) -> Column:
    """(left, right) of a block's i-th node at each level: what flanks it among those that are hashed together."""

    def flanks(k: Column) -> Column:
        step = F.element_at(F.array(*[F.lit(ARITY**j) for j in range(LEVELS + 1)]), k + 1)
        own = F.pmod(F.floor(i / step), F.lit(ARITY)).cast("int")
        start = (F.floor(i / (step * ARITY)) * (ARITY * HEX)).cast("int") + 1
        level = F.element_at(levels, k + 1)
        left = F.substring(level, start, own * HEX)
        right = F.substring(level, start + (own + 1) * HEX, (ARITY - 1 - own) * HEX)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height), flanks)


def descend(rounds: list[DataFrame], above: DataFrame, *kept: str) -> DataFrame:
    """g, pos, digest, payload, path, kept: the siblings of every node up to the end of ``above`` (g, path, kept), which has a row for each group."""
    paths = above.withColumn("b", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        joined = blocks.join(paths, ["g", "b"])
        own = F.transform("nodes", lambda m, i: F.struct(m.alias("node"), F.concat(_path(F.col("height"), F.col("levels"), i), F.col("path")).alias("path")))
        nodes = joined.select("g", *kept, F.explode(own).alias("m")).select("g", *kept, "m.node.*", "m.path")
        paths = nodes.withColumnRenamed("pos", "b")
    return nodes


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, p: digest(p.left, node, p.right))


def manifest(docs: DataFrame, received: Column | None = None, text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs`` (FIELDS, others).

    A row is a leaf of its source's tree, by doc_id (null first; rows of one
    id by their hashes).  While a level has several nodes, each three
    consecutive ones are hashed to one, the last run being what is left, even
    one; what remains is the source's root, and the roots of sources (null
    first, then by bytes) make the upper tree in the same way.
    ``proof_sha256`` is the hash of all siblings up to the root.
    ``received`` is the text that a reader got; its leaf is folded with the
    original siblings, and ``verified`` says whether that gives the root.
    Repeated rows are leaves each; an empty table gives no rows.
    """
    own = leaf(*map(F.col, FIELDS))
    seen = own if received is None else leaf(*[received if f == text else F.col(f) for f in FIELDS])
    rows = docs.select("source", "doc_id", own.alias("digest"), seen.alias("seen"))
    leaves = numbered(rows, "source", "doc_id", "digest")
    groups = leaves.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    sources = materialize(numbered(groups, "start").withColumnRenamed("at", "g"))
    placed = leaves.join(small(sources.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    nodes = placed.select("g", "n", (F.col("at") - F.col("start")).alias("pos"), "digest", "doc_id", "seen")
    rounds, subroots = climb(nodes, "doc_id", "seen")
    total = sources.count()
    upper, top = climb(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(total).cast("long").alias("n"), F.col("g").alias("pos"), "digest"))
    # one row, or none of an empty table
    root = (top.first() or [None, None])[1]
    none = F.array().cast("array<struct<left: string, right: string>>")
    over = descend(upper, top.select("g", none.alias("path")))
    over = over.select(F.col("pos").alias("g"), F.col("digest").alias("subroot"), "path")
    found = descend(rounds, over, "subroot").withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p.left, p.right)), "")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
