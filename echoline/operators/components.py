"""Connected components by iterated least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.session import stored

#: Rows of a task where pairs become distinct: it holds all of its own. Tasks at most: a shuffle into more than 200 holds what each of its writers has read.
ROWS, MOST = 1 << 18, 200


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as the rows ask for, so that a task's memory doesn't grow with them until there are ``MOST``; at least one for each core."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST, -(-rows.count() // ROWS)))


def stars(members: DataFrame, group: str, node: str, tasks: int) -> DataFrame:
    """Edges (a, b), a < b, from the least node of a group to its others: as many as members, and the components of all pairs."""
    dealt = members.filter(F.col(group).isNotNull() & F.col(node).isNotNull()).select(group, F.col(node).alias("b")).repartition(tasks, group)
    return dealt.withColumn("a", F.min("b").over(Window.partitionBy(group))).filter("a < b").select("a", "b")


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, root) of undirected edges (a, b): root is the least node that is reachable.

    Edges may be repeated and lie in any direction; they become distinct once, in ``tasks`` tasks if given, and then go both ways. Each round
    takes the least root among neighbours and then that root's own root, and is stored in the shared folder, so that the plan does not grow.
    """
    ways = edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    one = stored((ways.repartition(tasks, "a", "b") if tasks else ways).distinct(), "links")
    links = one.toDF("node", "other").union(one.select("b", "a"))
    now = stored(links.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "roots")
    while True:
        near = links.join(now.toDF("other", "r"), "other").groupBy("node").agg(F.min("r").alias("r"))
        new = now.join(near, "node").select("node", "root", F.least("root", "r").alias("r"))
        jump = now.toDF("r", "rr")
        new = stored(new.join(jump, "r").select("node", F.col("root").alias("was"), F.col("rr").alias("root")), "roots")
        moved = not new.filter("was <> root").isEmpty()
        now = new.select("node", "root")
        if not moved:
            return now
