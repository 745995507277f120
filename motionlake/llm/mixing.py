"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents gets
on average.  The whole part is certain; the fraction is rounded by pairing two
documents and moving probability from one to the other, at random and fairly,
until one is integral.  Documents are paired with others of the same source
and about the same size, so words stay near the target.  Pairing runs within
small groups; each group leaves at most one fractional document, and these
residuals meet in the next level of a reduction tree, down to one a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, small, uniform

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
#: Documents that one fold pairs up.
GROUP = 128
#: Equal rows that one task numbers.
ALIKE = 100_000
#: Size classes a natural logarithm; classes bound the differences of paired sizes.
CLASSES = 8
_EDGE = 1e-9


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source_key, source_size, target: shares of all words by weight, none above ``most`` times its source's size.

    The table that the windows order has one row a source, not one a document.
    Sources that reach their limit are those with the least limit to weight;
    going through them in that order, the first whose equal share of what is
    left stays within its limit ends the search.
    """
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    per = per.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.col("weights"))
    within = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.first(within, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return per.select("source_key", "source_size", target.alias("target"))


def _fold(groups: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """For each group: done, an array of (row, up), and rest, its one fractional document or null."""
    item = "struct<size: bigint, uid: bigint, row: bigint, p: double>"
    done = "array<struct<row: bigint, up: int>>"
    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("done"))

    def final(doc: Column, up: int) -> Column:
        return F.array(F.struct(doc.row.alias("row"), F.lit(up).alias("up")))

    def state(doc: Column, p: Column, out: Column) -> Column:
        return F.struct(F.struct(doc["size"].alias("size"), doc.uid.alias("uid"), doc.row.alias("row"), p.alias("p")).alias("rest"), out.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        y, out = acc.rest, acc.done
        to_x, to_y = F.least(1 - x.p, y.p), F.least(1 - y.p, x.p)
        give_x = uniform(y.uid, x.uid, F.lit(level), F.lit(seed)) * (to_x + to_y) < to_y
        into_x = F.when(1 - x.p <= y.p, state(y, x.p + y.p - 1, F.concat(out, final(x, 1)))).otherwise(state(x, x.p + y.p, F.concat(out, final(y, 0))))
        into_y = F.when(1 - y.p <= x.p, state(x, x.p + y.p - 1, F.concat(out, final(y, 1)))).otherwise(state(y, x.p + y.p, F.concat(out, final(x, 0))))
        return F.when(y.isNull(), state(x, x.p, out)).when(give_x, into_x).otherwise(into_y)

    items = F.sort_array(F.collect_list(F.struct("size", "uid", "row", "p")), asc=False)
    folded = groups.groupBy(*keys).agg(items.alias("items")).withColumn("acc", F.aggregate("items", start, step))
    return folded.select(*keys, "acc.rest", "acc.done")


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with uid, a hash of a row and of its number among equal rows.

    Equal rows are counted, which combines before the shuffle, and spelt out
    again; many of them are spelt out by several tasks.
    """
    cols = sizes.columns
    same = sizes.groupBy(*cols).agg(F.count("*").alias("n"))
    few = same.where(F.col("n") <= ALIKE).withColumn("chunk", F.lit(0).cast("long"))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = same.where(F.col("n") > ALIKE).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE)))).repartition(parts, "doc_id", "chunk")
    first = F.col("chunk") * ALIKE
    spelt = few.union(many).withColumn("nth", F.explode(F.sequence(first + 1, F.least(first + ALIKE, F.col("n")))))
    return spelt.select(*cols, F.xxhash64("doc_id", "source_key", "size", "nth").alias("uid"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for each row of ``docs`` (doc_id, text, source, others).

    ``key`` names a column that numbers the rows (long, unique), which is
    returned too.  Null texts have size 0; a null source is a source of its
    own, the last.  Documents without words are taken once for each whole copy
    and add nothing.  Equal rows are numbered, so each is rounded on its own.
    Draws are hashes, so a rerun gives the same mix.  An empty table gives none.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"), count_words(F.col("text")).alias("size"),
        *([F.col(key).alias("row")] if key else []),
    )
    if key:
        rows = sizes.withColumn("uid", F.xxhash64("doc_id", "source_key", "size", "row"))
    else:
        rows = _numbered(sizes).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows)
    wanted = materialize(targets(rows, weights))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.drop("source").join(small(wanted), "source_key").withColumn("whole", F.floor(share + _EDGE)).withColumn("p", share - F.col("whole"))
    klass = F.floor(F.log(F.col("size").cast("double")) * CLASSES).cast("int")
    open_ = rows.where((F.col("p") > _EDGE) & (F.col("size") > 0)).select("source_key", klass.alias("klass"), "uid", "row", "size", "p")
    each = open_.groupBy("source_key", "klass").agg(F.count("*").alias("n"))
    most = each.agg(F.max("n")).first()[0] or 0
    groups = F.ceil(F.col("n") / GROUP)
    level_rows = open_.join(small(each), ["source_key", "klass"]).withColumn("sub", F.pmod(F.xxhash64("uid", F.lit(seed)), groups)).drop("n")
    ups, level, subs = [], 0, -(-most // GROUP)
    while True:
        last = subs <= 1 and level > 0
        if last:
            level_rows = level_rows.withColumn("klass", F.lit(0))
        folded = materialize(_fold(level_rows, ["source_key", "klass", "sub"], level, seed))
        ups.append(folded.select(F.inline("done")))
        left = folded.where("rest is not null").select("source_key", "klass", F.floor(F.col("sub") / GROUP).alias("sub"), "rest.uid", "rest.row", "rest.size", "rest.p")
        if last:
            ups.append(left.select("row", (uniform(F.col("uid"), F.lit(-1), F.lit(seed)) < F.col("p")).cast("int").alias("up")))
            break
        level_rows, level, subs = left, level + 1, -(-subs // GROUP)
    up = ups[0]
    for more in ups[1:]:
        up = up.union(more)
    copies = F.col("whole") + F.coalesce(F.col("up"), F.lit(0))
    return rows.join(up, "row", "left").select(
        "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *([F.col("row").alias(key)] if key else [])
    )
