"""Edits of node tables.  An edit moves or drops rows and leaves gaps; reindex() numbers the touched documents anew.

Each edit takes targets (doc_id, node_id) and returns the new node table.  Nodes keep a provisional
position (parent_id, ord); node_id, ord, depth and last_desc are final after reindex().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import name_classes
from ..sources.xml import NODE
from .groups import by_documents, sound_unions

ROW = ["doc_id", *NODE.names]
LEAVES = ("#text", "#comment", "#pi", "#attdef", "#entityDecl", "#notationDecl")


def _inner(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1] and so on."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sum of the values before each one in its run of equal groups."""
    total = np.cumsum(values) - values
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return total - np.repeat(total[first], np.diff(np.append(first, len(values))))


def _renumber(table: pa.Table, document: np.ndarray) -> pa.Table:
    """Whole documents with new numbers, all documents of the table at once, a step per level of depth."""
    node, up, place = (table.column(c).to_numpy().astype(np.int64) for c in ("node_id", "parent_id", "ord"))
    n, base = len(node), 1 << 31
    by_id = np.lexsort((node, document))
    keys, wanted = ((document << 33) + x + base for x in (node, up))
    at = np.minimum(np.searchsorted(keys[by_id], wanted), n - 1)
    parent = np.where(keys[by_id[at]] == wanted, by_id[at], n)  # n: none
    parent[up == -1] = n + 1 + document[up == -1]  # tops come behind, document by document
    order = np.lexsort((node, place, parent))
    owner = parent[order]
    begin, end = (np.searchsorted(owner, np.arange(n), side) for side in ("left", "right"))
    level = order[np.searchsorted(owner, n + 1) :]
    levels = []
    while len(level):  # rows whose parent is not there are in no level
        levels.append(level)
        level = order[_inner(begin[level], end[level] - begin[level])]
    size = np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    new, depth, spot = np.full(n + 1, -1), np.full(n, -1), np.zeros(n, np.int64)
    for d, level in enumerate(levels):
        new[level] = _before(size[level], parent[level]) + (new[parent[level]] + 1 if d else 0)
        depth[level] = d
        spot[level] = np.where(place[level] >= 0, _before((place[level] >= 0).astype(np.int64), parent[level]), -1)
    kept = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    kept = kept[np.lexsort((new[kept], document[kept]))]
    tops = depth[kept] == 0
    above = np.where(tops, -1, new[np.where(tops, 0, parent[kept])])
    element = pc.equal(table.column("kind"), "#element").to_numpy()
    inner = kept[~tops]
    inner = inner[element[inner] & element[parent[inner]]]
    inner = inner[np.lexsort((new[inner], new[parent[inner]], document[inner]))]  # children in order, parent by parent
    row = np.empty(n, np.int64)
    row[kept] = np.arange(len(kept))
    count = np.bincount(row[parent[inner]], minlength=len(kept))
    names = table.column("name").take(pa.array(inner)).combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), names)
    image = pc.if_else(pa.array(count > 0), pc.binary_join_element_wise(" ", pc.binary_join(lists, " "), ""), "")
    out = table.take(pa.array(kept))
    made = {"node_id": new[kept], "parent_id": above, "ord": spot[kept], "depth": depth[kept], "last_desc": new[kept] + size[kept] - 1}
    for name, values in made.items():
        out = out.set_column(out.column_names.index(name), name, pa.array(values, pa.int32()))
    return out.set_column(out.column_names.index("child_names"), "child_names", pc.if_else(pa.array(element[kept]), image, pa.scalar(None, pa.string())))


def reindex(nodes: DataFrame) -> DataFrame:
    """Preorder numbers, dense places, depths, subtree ends and child images from (parent_id, ord); rows cut off
    from their document's root are dropped."""
    return by_documents(nodes.select(*ROW), T.StructType([nodes.schema["doc_id"], *NODE.fields]), _renumber)


def reindex_sql(nodes: DataFrame) -> DataFrame:
    """reindex() of node ids and subtree ends as windows over paths, for shallow documents: no Python."""
    spark = nodes.sparkSession
    rows = nodes.select("doc_id", "node_id", "parent_id", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ord")).alias("_o"))
    rows.createOrReplaceTempView("_reindex_rows")
    paths = spark.sql(
        "WITH RECURSIVE p AS (SELECT doc_id, node_id, array(_o) AS path FROM _reindex_rows WHERE parent_id = -1 UNION ALL "
        "SELECT r.doc_id, r.node_id, array_append(p.path, r._o) FROM _reindex_rows r JOIN p ON r.doc_id = p.doc_id AND r.parent_id = p.node_id) SELECT * FROM p"
    )
    numbered = paths.withColumn("new_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)
    up = numbered.select("doc_id", F.col("node_id"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"), F.col("new_id").alias("_n"))
    ends = up.groupBy("doc_id", "path").agg(F.max("_n").alias("new_last"))
    return numbered.join(ends, ["doc_id", "path"]).select("doc_id", "node_id", "new_id", "new_last")


def remove(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the subtrees of the targets; a target that is not there is no error."""
    gone = nodes.join(targets.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"))
    keep = nodes.join(gone, (F.col("doc_id") == F.col("_d")) & F.col("node_id").between(F.col("_a"), F.col("_z")), "left_anti")
    return reindex(keep)


def _insert(nodes: DataFrame, new: DataFrame, shift: Column) -> DataFrame:
    """new: rows of subtrees with node ids of their own, negative, tops with parent_id and ord set; leaves take no children."""
    leaf = nodes.where(F.col("kind").isin(*LEAVES)).select("doc_id", F.col("node_id").alias("parent_id"))
    fit = new.join(leaf, ["doc_id", "parent_id"], "left_anti")
    return reindex(sound_unions(nodes.withColumn("ord", shift).select(*ROW).unionByName(fit.select(*ROW))))


def fragment(spark, rows: list[tuple], doc_id) -> DataFrame:
    """Rows of new nodes for one document: (id, parent, ord, kind, name, text, section, target, attrs).

    ids are any negative numbers under -1; parent is such an id or a node of the document."""
    full = [(doc_id, i, p, o, 0, i, kind, name, text, section, target, attrs, list(attrs) if attrs is not None else None, None, None, None) for i, p, o, kind, name, text, section, target, attrs in rows]
    return spark.createDataFrame(full, T.StructType([T.StructField("doc_id", T.LongType()), *NODE.fields]))


# What a new node of each kind must have, and may have beside it.
_FIELDS = {
    "#element": ("name", "attrs"), "#text": ("text", "section"), "#comment": ("text",), "#pi": ("target", "text"), "#document": ("",), "#doctypeDecl": ("name",), "#extSubset": ("",),
    "#elemDecl": ("name",), "#attlistDecl": ("name",), "#attdef": ("name",), "#entityDecl": ("name",), "#notationDecl": ("name",),
}


def node(kind: str, number: int, parent: int, place: int = 0, *, name: str | None = None, text: str | None = None, section: bool | None = None, target: str | None = None, attrs: dict | None = None) -> tuple:
    """A row for fragment(); ValueError if the kind is not known, a field is missing, strange to it or not legal in it."""
    fields = {k: v for k, v in (("name", name), ("text", text), ("section", section), ("target", target), ("attrs", attrs)) if v is not None}
    if kind not in _FIELDS:
        raise ValueError(f"{kind} is no kind of node")
    strange, first = set(fields) - set(_FIELDS[kind]), _FIELDS[kind][0]
    if strange:
        raise ValueError(f"{kind} has no {', '.join(sorted(strange))}")
    if first and first not in fields:
        raise ValueError(f"{kind} needs a {first}")
    start, inner = name_classes(java=False)
    for given in (name, target, *(attrs or {})):
        if given is not None and not re.fullmatch(f"[{start}][{inner}]*", given):
            raise ValueError(f"{given!r} is not a name")
    for given in (text, *(attrs or {}).values()):
        if given is not None and not re.fullmatch("[\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]*", given):
            raise ValueError("text has an illegal character")
    body = text or ""
    if kind == "#text" and (("]]>" in body) if section else not body):
        raise ValueError("a section may not hold ]]>, and other text may not be empty")
    if kind == "#comment" and ("--" in body or body.endswith("-")):
        raise ValueError("a comment may not hold -- or end with -")
    if kind == "#pi" and ("?>" in body or target.lower() == "xml"):
        raise ValueError("an instruction may not hold ?> or have the target xml")
    if kind == "#text":
        section = bool(section)
    return number, parent, place, kind, name, text, section, target, (attrs or {}) if kind == "#element" else None


def push(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Append: the tops' places count on from the last child."""
    ends = nodes.where("ord >= 0").groupBy("doc_id", "parent_id").agg(F.max("ord").alias("_m"))
    moved = new.join(ends, ["doc_id", "parent_id"], "left").withColumn("ord", F.when(F.col("parent_id") >= 0, F.col("ord") + F.coalesce(F.col("_m") + 1, F.lit(0))).otherwise(F.col("ord")))
    return _insert(nodes, moved, F.col("ord"))


def unshift(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Prepend: old children move behind the new tops."""
    tops = new.where("parent_id >= 0").groupBy("doc_id", "parent_id").agg(F.count("*").cast("int").alias("_n"))
    moved = nodes.join(tops, ["doc_id", "parent_id"], "left")
    return _insert(moved, new, F.when(F.col("ord") >= 0, F.col("ord") + F.coalesce("_n", F.lit(0))).otherwise(F.col("ord")))


def splice(nodes: DataFrame, at: DataFrame, new: DataFrame) -> DataFrame:
    """at: (doc_id, parent_id, start, count): that many children from start are replaced by the tops of new under the parent."""
    hit = nodes.join(at.select("doc_id", "parent_id", "start", "count"), ["doc_id", "parent_id"]).where("ord >= start AND ord < start + count").select("doc_id", "node_id")
    gone = nodes.join(hit, ["doc_id", "node_id"], "left_semi").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"))
    keep = nodes.join(gone, (F.col("doc_id") == F.col("_d")) & F.col("node_id").between(F.col("_a"), F.col("_z")), "left_anti")
    tops = new.where("parent_id >= 0").groupBy("doc_id", "parent_id").agg(F.count("*").cast("int").alias("_n"))
    moved = keep.join(at.select("doc_id", "parent_id", "start"), ["doc_id", "parent_id"], "left").join(tops, ["doc_id", "parent_id"], "left")
    shifted = F.when((F.col("ord") >= F.col("start")) & (F.col("ord") >= 0), F.col("ord") + F.coalesce("_n", F.lit(0))).otherwise(F.col("ord"))
    placed = new.join(at.select("doc_id", "parent_id", "start"), ["doc_id", "parent_id"], "left").withColumn("ord", F.col("ord") + F.coalesce("start", F.lit(0)))
    return _insert(moved, placed, shifted)


def pop(nodes: DataFrame, parents: DataFrame, first: bool = False) -> DataFrame:
    """Without the last (or first) child of each parent (doc_id, node_id)."""
    inner = nodes.where("ord >= 0").join(parents.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    pick = (F.min_by if first else F.max_by)("node_id", "ord")
    return remove(nodes, inner.groupBy("doc_id", "parent_id").agg(pick.alias("node_id")))


def shift(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    return pop(nodes, parents, first=True)


def replace_child(nodes: DataFrame, at: DataFrame, new: DataFrame) -> DataFrame:
    """at: (doc_id, parent_id, ord): that child is replaced by the tops of new."""
    return splice(nodes, at.select("doc_id", "parent_id", F.col("ord").alias("start"), F.lit(1).alias("count")), new)


def truncate(nodes: DataFrame, parents: DataFrame, length: int) -> DataFrame:
    """At most length children of each parent; a larger length changes nothing."""
    return remove(nodes, nodes.where(F.col("ord") >= length).join(parents.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi"))


def clone(nodes: DataFrame, targets: DataFrame, new_doc_id: Column) -> DataFrame:
    """Deep copies of the targets' subtrees as documents of their own; new_doc_id is an expression on the target's row."""
    top = nodes.join(targets.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"), F.col("depth").alias("_h"), new_doc_id.alias("_new"))
    rows = nodes.join(top, (F.col("doc_id") == F.col("_d")) & F.col("node_id").between(F.col("_a"), F.col("_z")))
    own = F.col("node_id") == F.col("_a")
    made = {"doc_id": F.col("_new"), "parent_id": F.when(own, -1).otherwise(F.col("parent_id") - F.col("_a")), "ord": F.when(own, 0).otherwise(F.col("ord")), "depth": F.col("depth") - F.col("_h"), "last_desc": F.col("last_desc") - F.col("_a"), "node_id": F.col("node_id") - F.col("_a")}
    return rows.select(*[made[c].cast(NODE[c].dataType).alias(c) if c in made and c != "doc_id" else (made[c].alias(c) if c in made else F.col(c)) for c in ROW])


def set_root(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The document's root element replaced by the tops of new (parent_id 0), or put last where there is none."""
    at = nodes.where("parent_id = 0").groupBy("doc_id").agg(F.min(F.when(F.col("kind") == "#element", F.col("ord"))).alias("_r"), F.max("ord").alias("_m"))
    where = at.select("doc_id", F.lit(0).alias("parent_id"), F.coalesce("_r", F.col("_m") + 1).alias("start"), F.when(F.col("_r").isNotNull(), 1).otherwise(0).alias("count"))
    return splice(nodes, where.join(new.select("doc_id").distinct(), "doc_id", "left_semi"), new)


def set_doctype(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The document type replaced by the tops of new (parent_id 0), or put before the root element."""
    at = nodes.where("parent_id = 0").groupBy("doc_id").agg(F.min(F.when(F.col("kind") == "#doctypeDecl", F.col("ord"))).alias("_t"), F.min(F.when(F.col("kind") == "#element", F.col("ord"))).alias("_r"))
    where = at.select("doc_id", F.lit(0).alias("parent_id"), F.coalesce("_t", "_r", F.lit(0)).alias("start"), F.when(F.col("_t").isNotNull(), 1).otherwise(0).alias("count"))
    return splice(nodes, where.join(new.select("doc_id").distinct(), "doc_id", "left_semi"), new)


def update(nodes: DataFrame, predicate: Column, **values: Column) -> DataFrame:
    """Properties set where the predicate holds: name, text, target, section, attrs."""
    return nodes.withColumns({k: F.when(predicate, v).otherwise(F.col(k)) for k, v in values.items()})
