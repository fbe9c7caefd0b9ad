"""Groups of duplicate reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .components import components


def duplicate_groups(edges: DataFrame, incomplete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (bug_id, group) and sizes (group, size, n_members) from duplicate links (src, dst), one row per statement.

    Incomplete reports (bug_id) join what they link, but are no members; a group is named by the least of all it joins.
    size counts statements: edges + 1 - incomplete members, as the stored lists had it; n_members counts reports.
    """
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    nodes = edges.select(F.col("src").alias("bug_id")).unionByName(edges.select(F.col("dst").alias("bug_id"))).distinct()
    rooted = nodes.join(found, nodes["bug_id"] == found["node"], "left").select("bug_id", F.coalesce("root", "bug_id").alias("group"))
    bad = incomplete.select("bug_id").distinct().withColumn("__bad", F.lit(True))
    marked = rooted.join(bad, "bug_id", "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
    members = marked.filter(~F.col("__bad")).select("bug_id", "group")
    statements = edges.join(rooted, edges["src"] == rooted["bug_id"]).groupBy("group").agg(F.count(F.lit(1)).alias("e"))
    sizes = marked.groupBy("group").agg(F.count_if("__bad").alias("i"), F.count_if(~F.col("__bad")).alias("n_members"))
    sizes = sizes.join(statements, "group").filter("n_members > 0").select("group", (F.col("e") + 1 - F.col("i")).alias("size"), "n_members")
    return members, sizes


@dataclass
class GroupStore:
    """Duplicate groups that links are added to: nodes (bug_id, group), links (group, e: statements), bad (bug_id)."""

    nodes: DataFrame
    links: DataFrame
    bad: DataFrame
    #: Nodes whose group another one took in at the last addition, and nodes that came with it.
    moved: int = 0
    added: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> GroupStore:
        rows = lambda schema: checkpointed(spark.createDataFrame([], schema))
        return GroupStore(rows("bug_id long, group long"), rows("group long, e long"), rows("bug_id long"))

    def with_links(self, edges: DataFrame, incomplete: DataFrame | None = None) -> GroupStore:
        """The store after more links (src, dst; one row per statement) and more incomplete reports.

        New links meet the stored groups of their ends, and only these groups are joined: the components are those of the
        links between groups, at most as many as there are new links, and only nodes of groups that another one takes in
        get another name. A group's name stays the least of all it joins.
        """
        edges = checkpointed(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
        ends = edges.select(F.explode(F.array("src", "dst")).alias("bug_id")).distinct().join(self.nodes, "bug_id", "left")
        ends = checkpointed(ends.select("bug_id", F.col("group").isNull().alias("new"), F.coalesce("group", "bug_id").alias("old")))
        of = lambda c, name: ends.select(F.col("bug_id").alias(c), F.col("old").alias(name))
        between = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst")
        names = checkpointed(components(between.select("a", "b")).select(F.col("node").alias("group"), F.col("root").alias("to")))
        renamed = lambda df: df.join(names, "group", "left").withColumn("group", F.coalesce("to", "group")).drop("to")
        fresh = ends.filter("new").select("bug_id", F.col("old").alias("group"))
        statements = renamed(between.groupBy(F.col("a").alias("group")).agg(F.count(F.lit(1)).alias("e")))
        links = renamed(self.links).unionByName(statements).groupBy("group").agg(F.sum("e").alias("e"))
        bad = self.bad if incomplete is None else self.bad.unionByName(incomplete.select(F.col("bug_id").cast("long").alias("bug_id"))).distinct()
        moved = self.nodes.join(names, "group", "left_semi").count()
        nodes = checkpointed(renamed(self.nodes.unionByName(fresh)).select("bug_id", "group"))
        return GroupStore(nodes, checkpointed(links), checkpointed(bad), moved, fresh.count())

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """Members and sizes, as `duplicate_groups` of all links so far."""
        marked = self.nodes.join(self.bad.withColumn("__bad", F.lit(True)), "bug_id", "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
        sizes = marked.groupBy("group").agg(F.count_if("__bad").alias("i"), F.count_if(~F.col("__bad")).alias("n_members")).join(self.links, "group")
        return marked.filter(~F.col("__bad")).select("bug_id", "group"), sizes.filter("n_members > 0").select("group", (F.col("e") + 1 - F.col("i")).alias("size"), "n_members")


def star_groups(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and sizes where each origin (src) with its targets (dst) is a group; a report in several is in that of the largest origin."""
    full = edges.select(F.col("src").alias("group"), F.col("dst").alias("bug_id")).unionByName(edges.select(F.col("src").alias("group"), F.col("src").alias("bug_id"))).distinct()
    members = full.groupBy("bug_id").agg(F.max("group").alias("group"))
    sizes = full.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    return members, sizes


def groups_between(sizes: DataFrame, least: int, most: int) -> DataFrame:
    """Groups whose size lies strictly between the two."""
    return sizes.filter((F.col("size") > least) & (F.col("size") < most))


def members_of(members: DataFrame, group: int) -> DataFrame:
    return members.filter(F.col("group") == group).select("bug_id")


def group_of(members: DataFrame, bug_id: int) -> DataFrame:
    return members.filter(F.col("bug_id") == bug_id).select("group")


def group_spans(members: DataFrame, basic: DataFrame) -> DataFrame:
    """group, span (of ts, sentinel -1000 - 9999999999 without any report), n_products."""
    rows = members.join(basic.select("bug_id", "ts", "product"), "bug_id", "left")
    return rows.groupBy("group").agg(F.coalesce(F.max("ts") - F.min("ts"), F.lit(-1000 - 9999999999)).alias("span"), F.countDistinct("product").alias("n_products"))


def hits(found: DataFrame, members: DataFrame, query: str = "query_id", remove_self: bool = True) -> DataFrame:
    """query, bug_id, hit: whether what was found (query_id is a report itself) is in the query's group."""
    own = members.select(F.col("bug_id").alias(query), F.col("group").alias("__own"))
    theirs = members.select("bug_id", F.col("group").alias("__theirs"))
    rows = found.join(own, query, "left").join(theirs, "bug_id", "left")
    if remove_self:
        rows = rows.filter(F.col(query) != F.col("bug_id"))
    same = (F.col(query) == F.col("bug_id")) | F.coalesce(F.col("__own") == F.col("__theirs"), F.lit(False))
    return rows.select(query, "bug_id", same.alias("hit"))


def product_counts(basic: DataFrame, least: int = 100, prefix: str = "<option>", suffix: str = "</option>") -> DataFrame:
    """product, n, line for products with at least so many reports, the largest first, ties by name."""
    rows = basic.filter(F.col("product").isNotNull()).groupBy("product").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return rows.withColumn("line", F.concat(F.lit(prefix), "product", F.lit(suffix), F.lit(" <!--"), F.col("n").cast("string"), F.lit("-->"))).orderBy(F.desc("n"), "product")
