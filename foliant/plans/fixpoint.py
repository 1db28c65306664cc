"""Closures of graphs in few rounds; every round is written out, so a lost executor costs one.

A node is one struct of its keys and its name. Structs with NULL fields are equal like any others, and a join on one
column can use how a table was dealt before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.session import scratch_path, staged

PLAIN_ROUNDS = 8  # rounds along single edges before long chains are given shortcuts


def dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt by a column once and for all: written in buckets, so that a join on it moves only the other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "dealt")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows them
    return out


def _node(df: DataFrame, keys: list[str], name: str, kind: T.StructType) -> Column:
    """Keys and name as one value of type ``kind``; NULL without a name."""
    whole = F.struct(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip([*keys, name], kind.fields, strict=True)])
    return F.when(F.col(name).isNotNull(), whole)


def _kind(df: DataFrame, keys: list[str], names: list[str]) -> T.StructType:
    kinds = {df.schema[n].dataType for n in names}
    name = kinds.pop() if len(kinds) == 1 else T.LongType()
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("node", name)])


def _follow(links: DataFrame, keys: list[str]) -> DataFrame:
    """``node, at, hops, sound, done, missing`` for ``node, to, sound``; not done: in or before a circle.

    After ``k`` rounds a node has gone ``2 ** k`` hops. If its way ends at all, every node farther than that from the end
    is still going, so with at most ``2 ** k`` of them going inside equal keys one more round is the last.

    A round moves the nodes that are still going and no others: what has arrived is written once, in buckets, and asked there.
    """
    first = links.select(
        "node", F.coalesce("to", "node").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.coalesce(F.col("to").isNull() | F.col("sound"), F.lit(False)).alias("sound"), F.col("to").isNull().alias("done"), F.lit(False).alias("missing"),
    )
    columns = first.columns
    now = dealt(first, "node")
    parts, gone_so_far, last = [now], 1, False
    while not last:
        still = now.where("NOT done").groupBy(*[F.col(f"node.{k}").alias(k) for k in keys]).count().agg(F.max("count")).first()[0]
        if not still:
            break
        gone_so_far, last = 2 * gone_so_far, still <= gone_so_far
        step = now.where("NOT done")
        # every node is done in one of the parts or going in the last one
        for n, part in enumerate(parts):
            known = part if part is now else part.where("done")
            step = step.join(known.select(*[F.col(c).alias(f"t{n}_{c}") for c in columns]), F.col("at") == F.col(f"t{n}_node"), "left")
        met = {c: F.coalesce(*[F.col(f"t{n}_{c}") for n in range(len(parts))]) for c in columns}
        gone = met["node"].isNull()
        moved = step.select(
            "node", F.coalesce(met["at"], F.col("at")).alias("at"), (F.col("hops") + F.coalesce(met["hops"], F.lit(0))).alias("hops"),
            (F.col("sound") & F.coalesce(met["sound"], F.lit(True))).alias("sound"), (gone | met["done"]).alias("done"),
            (gone | met["missing"]).alias("missing"),
        )
        now = dealt(moved, "node")
        parts.append(now)
    out = now
    for part in parts[:-1]:
        out = out.unionByName(part.where("done"))
    return out


def follow(links: DataFrame, keys: list[str], sound: Column | None = None) -> DataFrame:
    """Where each node's chain of links ends: ``keys + [node, origin, hops, sound, lost]``.

    ``links``: ``keys + [node, to]``, ``to`` NULL at an end; one row per node. ``sound`` is a condition on each link
    (over the row it leaves); an origin's own is not asked. By pointer doubling with the conditions joined by AND, so
    rounds grow with the logarithm of the longest chain. A chain that runs in a circle or to a node that is not there
    has no origin; ``lost`` says ``cycle`` or ``missing``.
    """
    kind = _kind(links, keys, ["node", "to"])
    condition = F.lit(True) if sound is None else sound
    now = _follow(links.select(_node(links, keys, "node", kind).alias("node"), _node(links, keys, "to", kind).alias("to"), condition.alias("sound")), keys)
    lost = F.when(F.col("missing"), "missing").when(~F.col("done"), "cycle")
    return now.select(
        *[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.node").alias("node"), F.when(lost.isNull(), F.col("at.node")).alias("origin"),
        F.when(lost.isNull(), F.col("hops")).alias("hops"), "sound", lost.alias("lost"),
    )


def _shortcuts(edges: DataFrame, keep: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(src, dst, len)`` that pass over chains, and ``node, anchor, steps`` of the nodes inside these.

    Inside a chain are nodes with one edge in and one out that are not in ``keep``. Each finds the node before its chain by
    pointer doubling. Circles that nothing leads into have none; they are left out.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n"), F.min("src").alias("before"))
    out = edges.groupBy(F.col("src").alias("from")).agg(F.countDistinct("dst").alias("m"))
    inner = into.where("n = 1 AND before <> node").join(out.where("m = 1"), F.col("node") == F.col("from")).select("node", "before")
    inner = dealt(inner.join(keep.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti"), "node")
    # a chain is followed back to its first inner node, one hop from what stands before it
    first = inner.join(inner.select(F.col("node").alias("b")), F.col("before") == F.col("b"), "left")
    ends = _follow(first.select("node", F.when(F.col("b").isNotNull(), F.col("before")).alias("to"), F.lit(True).alias("sound")), keys).where("done")
    head = inner.select(F.col("node").alias("h"), F.col("before").alias("anchor"))
    chains = dealt(ends.join(head, F.col("at") == F.col("h")).select("node", "anchor", (F.col("hops") + 1).alias("steps")), "node")
    over = chains.withColumnRenamed("node", "c")
    short = (
        edges.join(inner.select(F.col("node").alias("i")), F.col("dst") == F.col("i"), "left_anti")
        .join(over, F.col("src") == F.col("c"), "left")
        .select(F.coalesce("anchor", "src").alias("src"), "dst", (F.coalesce("steps", F.lit(0)) + 1).alias("len"))
    )
    # what leaves a circle that nothing leads into stays an edge of a node that is never reached
    return dealt(short.distinct(), "src"), chains


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str], depth: str | None = None) -> DataFrame:
    """All nodes reachable from ``seeds`` along ``edges(src, dst)`` inside equal ``keys``.

    ``seeds`` has columns ``keys + [node]``. Edges are shuffled once; each round moves only the new frontier to them, and appends
    it to the one table of what was visited. After a few rounds, chains in what is left become single edges, so
    that a long chain takes rounds by the logarithm of its length. With ``depth`` the least number of edges is kept per node.
    """
    spark, kind = edges.sparkSession, _kind(edges, keys, ["src", "dst"])
    ends = [_node(edges, keys, c, kind).alias(c) for c in ("src", "dst")]
    steps = dealt(edges.select(*ends, F.lit(1).cast("bigint").alias("len")), "src")
    start = seeds.select(_node(seeds, keys, "node", kind).alias("node")).where("node IS NOT NULL").distinct().withColumn("d", F.lit(0).cast("bigint"))
    path, schema = scratch_path(spark, "visited"), start.schema
    chains = None

    def append(rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(path)
        return spark.read.schema(schema).parquet(path)

    frontier = staged(start, "frontier")
    visited = append(frontier)
    rounds = 0
    while True:
        if rounds == PLAIN_ROUNDS:
            steps, chains = _shortcuts(steps.drop("len"), frontier, keys)
        rounds += 1
        further = F.col("d") + F.col("len") if depth else F.lit(0).cast("bigint")
        at = frontier.withColumnRenamed("node", "at")
        found = steps.join(at, F.col("src") == F.col("at")).groupBy(F.col("dst").alias("node")).agg(F.min(further).alias("d"))
        seen = visited.select(F.col("node").alias("v"), F.col("d").alias("v_d"))
        frontier = staged(found.join(seen, (F.col("node") == F.col("v")) & (F.col("v_d") <= F.col("d")), "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = append(frontier)
    if chains is not None:
        inside = chains.join(visited.select(F.col("node").alias("at"), "d"), F.col("anchor") == F.col("at"))
        visited = visited.unionByName(inside.select("node", (F.col("d") + (F.col("steps") if depth else 0)).alias("d")))
    if depth or chains is not None:
        visited = visited.groupBy("node").agg(F.min("d").alias("d"))
    named = [F.col(f"node.{k}").alias(k) for k in [*keys, "node"]]
    return visited.select(*named, F.col("d").cast("int").alias(depth)) if depth else visited.select(*named)
