"""Navigation and queries over node tables.

A node table has doc_id, node_id (preorder), parent_id, ord, depth, last_desc and the content columns.
Descendants of a node are the interval (node_id, last_desc] of its document, so "deep" steps are
equi-joins on doc_id and a bin of node ids with an interval condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "doc_id"


def _context(ctx: DataFrame) -> DataFrame:
    return ctx.select(F.col(KEY).alias("_d"), F.col("node_id").alias("ctx_id"), F.col("last_desc").alias("_l"), F.col("parent_id").alias("_p"), F.col("ord").alias("_o"))


def _step(nodes: DataFrame, ctx: DataFrame, condition: Column) -> DataFrame:
    """Nodes in relation to context nodes, each with ctx_id."""
    return nodes.join(_context(ctx), (nodes[KEY] == F.col("_d")) & condition).drop("_d", "_l", "_p", "_o")


def filter_deep(nodes: DataFrame, predicate: Column, ctx: DataFrame | None = None) -> DataFrame:
    """All matching descendants: of whole documents, or of each context node (with ctx_id)."""
    hits = nodes.where(predicate)
    return hits.where("node_id > 0") if ctx is None else descendants(hits, ctx)


BIN = 4096  # node ids of a bin; a join of intervals and points meets only within bins, so a large document spreads over tasks


def _bins(first: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def descendants(nodes: DataFrame, ctx: DataFrame, width: int = BIN) -> DataFrame:
    inner = nodes.withColumn("_b", F.floor(F.col("node_id") / width))
    outer = _context(ctx).where("_l > ctx_id").withColumn("_b", _bins(F.col("ctx_id") + 1, F.col("_l"), width))
    return inner.join(outer, (inner[KEY] == F.col("_d")) & (inner["_b"] == outer["_b"]) & (inner["node_id"] > F.col("ctx_id")) & (inner["node_id"] <= F.col("_l"))).drop("_d", "_l", "_p", "_o", "_b")


def ancestors(nodes: DataFrame, ctx: DataFrame, width: int = BIN) -> DataFrame:
    outer = nodes.where("last_desc > node_id").withColumn("_b", _bins(F.col("node_id") + 1, F.col("last_desc"), width))
    inner = _context(ctx).withColumn("_b", F.floor(F.col("ctx_id") / width))
    return outer.join(inner, (outer[KEY] == F.col("_d")) & (outer["_b"] == inner["_b"]) & (outer["node_id"] < F.col("ctx_id")) & (outer["last_desc"] >= F.col("ctx_id"))).drop("_d", "_l", "_p", "_o", "_b")


def following(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    return _step(nodes, ctx, nodes["node_id"] > F.col("_l"))


def preceding(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    return _step(nodes, ctx, nodes["last_desc"] < F.col("ctx_id"))


def children(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    return _step(nodes, ctx, (nodes["parent_id"] == F.col("ctx_id")) & (nodes["ord"] >= 0))


def child_at(nodes: DataFrame, ctx: DataFrame, place: int) -> DataFrame:
    """The child at a place, counted from the end if negative."""
    if place >= 0:
        return children(nodes, ctx).where(F.col("ord") == place)
    count = F.max("ord").over(Window.partitionBy(KEY, "ctx_id"))
    return children(nodes, ctx).withColumn("_n", count).where(F.col("ord") == F.col("_n") + 1 + place).drop("_n")


def parent(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    return _step(nodes, ctx, nodes["node_id"] == F.col("_p"))


def find_deep(nodes: DataFrame, predicate: Column, ctx: DataFrame | None = None) -> DataFrame:
    """The first matching descendant in document order, per document or per context node."""
    hits = filter_deep(nodes, predicate, ctx)
    keys = [KEY] if ctx is None else [KEY, "ctx_id"]
    rest = [c for c in hits.columns if c not in keys]
    first = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), "node_id").alias("_r"))
    return first.select(*keys, "_r.*").select(*hits.columns)


def siblings(nodes: DataFrame) -> DataFrame:
    """Each node with prev_sibling and next_sibling (node ids, null at the ends and for nodes without a place)."""
    w = Window.partitionBy(KEY, "parent_id", F.col("ord") >= 0).orderBy("ord")
    placed = F.col("ord") >= 0
    return nodes.withColumns({"prev_sibling": F.when(placed, F.lag("node_id").over(w)), "next_sibling": F.when(placed, F.lead("node_id").over(w))})


def child_count(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, length) of every node, 0 for those without children."""
    counts = nodes.where("ord >= 0 AND parent_id >= 0").groupBy(KEY, F.col("parent_id").alias("node_id")).agg(F.count("*").alias("length"))
    return nodes.select(KEY, "node_id").join(counts, [KEY, "node_id"], "left").fillna(0, ["length"])


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = '#element' AND depth = 1")


def doctype(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = '#doctypeDecl'")


def document(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = '#document'")


def child_array(nodes: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, node_id, children): ordered arrays of structs for shallow work with F.filter, F.transform, F.exists and so on."""
    item = F.struct("ord", *fields)
    return nodes.where("ord >= 0 AND parent_id >= 0").groupBy(KEY, F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(item)).alias("children"))


def id_index(nodes: DataFrame, docs: DataFrame, attdef: DataFrame) -> DataFrame:
    """(doc_id, value, node_id) of every ID-typed attribute."""
    from .dtd import first_attdefs

    ids = first_attdefs(attdef).where("type = 'ID'").select("dtd_id", F.col("element").alias("_e"), F.col("name").alias("_a"))
    elements = nodes.where("kind = '#element'").join(docs.select(KEY, "dtd_id"), KEY)
    typed = elements.join(ids, (elements["dtd_id"] == ids["dtd_id"]) & (elements["name"] == F.col("_e")))
    return typed.select(KEY, F.try_element_at("attrs", F.col("_a")).alias("value"), "node_id").where("value IS NOT NULL")


def find_by_id(nodes: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements whose ID is (doc_id, value) of wanted; the first if an ID stands twice."""
    hit = ids.join(wanted.select(KEY, "value"), [KEY, "value"], "left_semi").groupBy(KEY, "value").agg(F.min("node_id").alias("node_id"))
    return nodes.join(hit, [KEY, "node_id"])
