"""SQL access: a table function and a data source over the same parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .parser import Options, Parser
from .xml import NODE

_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE)


def _values(nodes: list[list]) -> Iterator[tuple]:
    for n in nodes:
        element = n[5] == "#element"
        yield (*n[:10], n[10], n[11], n[12], n[13] if element else None, None if element else n[13])


def _nodes(parsed: dict) -> list[list]:
    error = parsed["error"]
    return parsed["nodes"] if error is None else [_error(error["code"], f"{error['line']}:{error['column']}: {error['message']}")]


def _error(code: str, message: str) -> list:
    return [0, -1, 0, 0, 0, "#error", code, message, *[None] * 7]


@F.udtf(returnType=_DDL)
class XmlNodes:
    """xml_nodes(content): the nodes of one document; of a malformed one a row of kind #error with the code as name."""

    def __init__(self) -> None:
        self.parser = Parser(Options())

    def eval(self, content: str) -> Iterator[tuple]:
        if content is not None:
            yield from _values(_nodes(self.parser.parse(re.sub("\r\n?", "\n", content))))


def register(spark: SparkSession) -> None:
    """Make LATERAL xml_nodes(column) and format("xmlnodes") known to the session."""
    spark.udtf.register("xml_nodes", XmlNodes)
    spark.dataSource.register(XmlNodesSource)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class XmlNodesSource(DataSource):
    """format("xmlnodes").load(glob): node rows of files on a file system that every executor mounts.

    For other stores use sources.xml.read_xml, which reads through Spark's own file sources."""

    @classmethod
    def name(cls) -> str:
        return "xmlnodes"

    def schema(self) -> str:
        return "path string, " + _DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), self.options.get("encoding"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, encoding: str | None) -> None:
        self.path, self.encoding = path, encoding

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        from ..functions.encoding import DecodeProblem, decode_bytes

        try:
            with open(partition.path, "rb") as f:
                text, _ = decode_bytes(f.read(), self.encoding)
            nodes = _nodes(Parser(Options(path=partition.path)).parse(text))
        except DecodeProblem as problem:
            nodes = [_error("DECODE", str(problem))]
        for row in _values(nodes):
            yield (partition.path, *row)
