"""XML documents in a DataFrame column become a node table and document type tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.encoding import DecodeProblem, decode_bytes
from ..plans.content_model import rows as model_rows
from ..session import held
from .parser import Options, Parser

BATCH_NODES = 20_000  # nodes of documents that leave a task together; one larger document goes alone
RESOURCE_BYTES = 64 << 20  # resources are sent to every executor up to this size in all
TYPE_BYTES = 1 << 20  # so are declarations of all document types, as JSON; more are joined by shuffles

_text, _int, _flag, _texts = T.StringType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE = _struct(node_id=_int, parent_id=_int, ord=_int, depth=_int, last_desc=_int, kind=_text, name=_text, text=_text, section=_flag, target=_text, attrs=T.MapType(_text, _text), specified=_texts, child_names=_text, any_content=_flag, char_ref_ws=_flag)
ERROR = _struct(code=_text, line=_int, column=_int, context=_text, message=_text)
DOC = _struct(encoding=_text, version=_text, standalone=_flag, doctype_name=_text, public_id=_text, system_id=_text, dtd_id=_text, error=ERROR)
TABLES = {
    "elem_decl": _struct(decl_ord=_int, name=_text, mixed=_flag, content=_text, pattern=_text, allowed=_texts, spec=_text, ambiguous=_flag, partial=_text),
    "attdef": _struct(decl_ord=_int, element=_text, name=_text, type=_text, enumeration=_texts, default_value=_text, fixed=_flag, required=_flag),
    "entity": _struct(decl_ord=_int, name=_text, type=_text, value=_text, public_id=_text, system_id=_text, path=_text, notation_name=_text, external_origin=_flag),
    "notation": _struct(decl_ord=_int, name=_text, public_id=_text, system_id=_text),
    "content_spec": _struct(decl_ord=_int, element=_text, spec_id=_int, parent_id=_int, ord=_int, type=_text, name=_text, qualifier=_text),
}


def load_resources(resources: DataFrame | dict | None) -> dict[str, tuple[bytes | str, str | None]]:
    """External entities by path, from a dict or a DataFrame (path, content, encoding), checked against RESOURCE_BYTES."""
    if resources is None:
        return {}
    if isinstance(resources, dict):
        return {k: v if isinstance(v, tuple) else (v, None) for k, v in resources.items()}
    size = resources.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if size > RESOURCE_BYTES:
        raise ValueError(f"resources hold {size} bytes; at most {RESOURCE_BYTES} are sent to executors")
    label = F.col("encoding") if "encoding" in resources.columns else F.lit(None).cast("string")
    return {r[0]: (bytes(r[1]) if isinstance(r[1], (bytes, bytearray)) else r[1], r[2]) for r in resources.select("path", "content", label).collect()}


def _node_arrays(docs: list[list[list]]) -> pa.Array:
    flat = [n for nodes in docs for n in nodes]
    ends = [0]
    for nodes in docs:
        ends.append(ends[-1] + len(nodes))
    column = list(zip(*flat, strict=True)) if flat else [()] * 15
    arrays = [pa.array(column[k], pa.int32()) for k in range(5)]
    arrays += [pa.array(column[5], pa.string()), pa.array(column[6], pa.string()), pa.array(column[7], pa.string()), pa.array(column[8], pa.bool_()), pa.array(column[9], pa.string())]
    places, keys, values = [0], [], []
    for attrs in column[10]:
        if attrs:
            keys += attrs
            values += attrs.values()
        places.append(len(keys))
    empty = pa.array([a is None for a in column[10]], pa.bool_())
    arrays.append(pa.MapArray.from_arrays(pa.array(places, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())))
    if len(column[10]):
        arrays[-1] = pa.MapArray.from_buffers(arrays[-1].type, len(arrays[-1]), [pa.compute.invert(empty).buffers()[1], arrays[-1].buffers()[1]], children=[pa.StructArray.from_arrays([arrays[-1].keys, arrays[-1].items], fields=[pa.field("key", pa.string(), False), pa.field("value", pa.string())])])
    arrays.append(pa.array(column[11], pa.list_(pa.string())))
    arrays.append(pa.array(column[12], pa.string()))
    element = [k == "#element" for k in column[5]]
    arrays.append(pa.array([x if e else None for x, e in zip(column[13], element, strict=True)], pa.bool_()))
    arrays.append(pa.array([None if e else x for x, e in zip(column[13], element, strict=True)], pa.bool_()))
    struct = pa.StructArray.from_arrays(arrays, fields=[pa.field(f.name, a.type) for f, a in zip(NODE, arrays, strict=True)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def _dtd_rows(dtd) -> dict[str, list[dict]]:
    pick = {k: [f.name for f in s] for k, s in TABLES.items()}
    out = {"elem_decl": dtd.elements, "attdef": dtd.attdefs, "entity": dtd.entities, "notation": dtd.notations}
    out = {k: [{c: r[c] for c in pick[k]} for r in v] for k, v in out.items()}
    out["content_spec"] = [dict(zip(pick["content_spec"], (e["decl_ord"], e["name"], *row), strict=True)) for e in dtd.elements if e["model"] for row in model_rows(e["model"])]
    return out


class XmlTables:
    """The tables of parsed documents; each is a lazy DataFrame over the same parse.

    Where several of them are used, ``kept()`` writes the parse to the checkpoint folder first, and the document types
    when one of their tables is used."""

    def __init__(self, parsed: DataFrame, doc_id: str, is_kept: bool = False) -> None:
        self.parsed, self.doc_id, self.is_kept = parsed, doc_id, is_kept
        self._kept_types: tuple[DataFrame, bool] | None = None

    def kept(self) -> XmlTables:
        return XmlTables(held(self.parsed), self.doc_id, True)

    def _types(self) -> tuple[DataFrame, bool]:
        """(dtd_id, dtd), a row per document type, and whether they are known to be few: most documents may have one
        and the same, so a join by dtd_id would put their nodes into one task; few types are broadcast instead."""
        rows = self.parsed.where("dtd IS NOT NULL").select(F.col("doc.dtd_id").alias("dtd_id"), "dtd").dropDuplicates(["dtd_id"])
        if not self.is_kept:
            return rows, False
        if self._kept_types is None:
            rows = held(rows)
            few = (rows.agg(F.sum(F.octet_length(F.to_json("dtd")))).first()[0] or 0) <= TYPE_BYTES
            # Few types lie in one partition, so that no rule about declarations needs an exchange, which adaptive execution plans anew.
            self._kept_types = (F.broadcast(rows.coalesce(1)) if few else rows), few
        return self._kept_types

    @property
    def few_types(self) -> bool:
        return self._types()[1]

    @property
    def nodes(self) -> DataFrame:
        return self.parsed.select(F.col(self.doc_id), F.inline("nodes"))

    @property
    def docs(self) -> DataFrame:
        return self.parsed.select(F.col(self.doc_id), "doc.*")

    @property
    def errors(self) -> DataFrame:
        return self.parsed.where("doc.error IS NOT NULL").select(F.col(self.doc_id), "doc.error.*")

    def table(self, name: str) -> DataFrame:
        """One of TABLES, a row per declaration of each distinct document type."""
        return self._types()[0].select("dtd_id", F.inline(f"dtd.{name}"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def parse_xml(
    df: DataFrame,
    content: str | Column = "content",
    doc_id: str = "doc_id",
    *,
    encoding: str | Column | None = None,
    path: str | Column | None = None,
    resources: DataFrame | dict | None = None,
    options: Options = Options(),  # noqa: B008
    kinds: Iterable[str] | None = None,
    names: Iterable[str] | None = None,
    fail_fast: bool = False,
) -> XmlTables:
    """Parse a STRING or BINARY column of whole documents.

    A malformed document gives an error row instead of nodes, unless fail_fast.  kinds and names keep the
    emitted nodes to those kinds and element names.  Null content is the error NO_CONTENT.  Nothing is
    fetched: external entities come from ``resources`` alone."""
    given = load_resources(resources)
    want_kinds, want_names = (None if x is None else frozenset(x) for x in (kinds, names))
    body = F.col(content) if isinstance(content, str) else content
    label = encoding if isinstance(encoding, Column) else F.lit(encoding).cast("string")
    base = path if isinstance(path, Column) else F.lit(path if path is not None else options.path)
    dtd_type = _struct(**{k: T.ArrayType(v) for k, v in TABLES.items()})
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), T.StructField("doc", DOC), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("dtd", dtd_type)])
    doc_arrow, dtd_arrow = to_arrow_type(DOC), to_arrow_type(dtd_type)

    def wanted(n: list) -> bool:
        return (want_kinds is None or n[5] in want_kinds) and (want_names is None or n[5] != "#element" or n[6] in want_names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, sent = Parser(options, given), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                docs, nodes, dtds = [], [], []
                done = size = 0

                def made() -> pa.RecordBatch:
                    return pa.record_batch([batch.column(0).slice(done, len(docs)), pa.array(docs, doc_arrow), _node_arrays(nodes), pa.array(dtds, dtd_arrow)], names=schema.names)  # noqa: B023

                for raw, name, where in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    codec = None
                    try:
                        if raw is None:
                            raise DecodeProblem("no content")
                        if isinstance(raw, bytes):
                            raw, codec = decode_bytes(raw, name, options.swapped_utf16)
                        elif "\r" in raw:
                            raw = re.sub("\r\n?", "\n", raw)
                        got = parser.parse(raw, where)
                    except DecodeProblem as problem:
                        code = "NO_CONTENT" if raw is None else "DECODE"
                        got = {"error": {"code": code, "line": None, "column": None, "context": None, "message": str(problem)}, "dtd": None, "nodes": [], "encoding": None, "standalone": None, "version": None}
                    if got["error"] and fail_fast:
                        raise ValueError(f"{got['error']['code']} at {got['error']['line']}:{got['error']['column']}: {got['error']['message']}")
                    dtd = got["dtd"]
                    docs.append({"encoding": got["encoding"] or codec, "version": got["version"], "standalone": got["standalone"], "doctype_name": dtd and dtd.name, "public_id": dtd and dtd.public_id, "system_id": dtd and dtd.system_id, "dtd_id": dtd and dtd.id, "error": got["error"]})
                    nodes.append(got["nodes"] if want_kinds is None and want_names is None else [n for n in got["nodes"] if wanted(n)])
                    fresh = dtd is not None and dtd.id not in sent
                    dtds.append(_dtd_rows(dtd) if fresh else None)
                    if fresh:
                        sent.add(dtd.id)
                    size += len(nodes[-1])
                    if size >= BATCH_NODES:
                        yield made()
                        done, size = done + len(docs), 0
                        docs, nodes, dtds = [], [], []
                if docs:
                    yield made()

    return XmlTables(df.select(F.col(doc_id), body.alias("c"), label.alias("e"), base.alias("p")).mapInArrow(work, schema), doc_id)


def parse_dtd(resources: DataFrame, content: str | Column = "content", doc_id: str = "path", **options) -> XmlTables:
    """Parse external subsets that stand alone; their tables are those of parse_xml."""
    return parse_xml(resources, content, doc_id, options=replace(options.pop("options", Options()), root="extSubset"), **options)


def read_xml(spark: SparkSession, path: str, **options) -> XmlTables:
    """Parse the files at a path or glob; doc_id and base path are each file's path."""
    files = spark.read.format("binaryFile").load(path)
    return parse_xml(files.select(F.col("path").alias("doc_id"), "content"), path=F.col("doc_id"), **options)
