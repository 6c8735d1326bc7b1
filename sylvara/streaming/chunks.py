"""Documents that arrive as a stream: whole, or in chunks of bytes.

Chunks are rows (doc_id, seq, data BINARY, is_last BOOLEAN).  A document is parsed when all its chunks up
to the last are there, in any order; what is split between chunks (characters, line ends) is whole by then.
A document that stays incomplete for the timeout is an error row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.encoding import DecodeProblem, decode_bytes
from ..sources.parser import Options, Parser
from ..sources.xml import XmlTables, parse_xml

def assemble(chunks: DataFrame, encoding: str | None = None, timeout_ms: int = 600_000) -> DataFrame:
    """(doc_id, text, encoding, problem) of each completed document; state is the chunks of open documents only.

    Any type of doc_id will do.  A trigger writes the state of the documents that it has chunks of anew, so chunks of
    one document had better arrive a few to a trigger."""
    output = f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, text string, encoding string, problem string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, last = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "text": [None], "encoding": [None], "problem": ["input ended abruptly"]})
            return
        seen = set(seqs)
        for pdf in batches:
            for seq, data, end in zip(pdf["seq"], pdf["data"], pdf["is_last"], strict=True):
                if int(seq) not in seen:  # a chunk that is delivered twice counts once
                    seen.add(int(seq))
                    seqs.append(int(seq))
                    parts.append(bytes(data))
                if end:
                    last = int(seq)
        if last >= 0 and len(seqs) == last + 1:
            whole = b"".join(x for _, x in sorted(zip(seqs, parts, strict=True)))
            if state.exists:
                state.remove()
            try:
                row = (*decode_bytes(whole, encoding), None)
            except DecodeProblem as problem:
                row = (None, None, str(problem))
            yield pd.DataFrame([(key[0], *row)], columns=["doc_id", "text", "encoding", "problem"])
            return
        state.update((seqs, parts, last))
        state.setTimeoutDuration(timeout_ms)

    return chunks.groupBy("doc_id").applyInPandasWithState(step, output, "seqs array<long>, parts array<binary>, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def parse_chunks(chunks: DataFrame, encoding: str | None = None, timeout_ms: int = 600_000, **options) -> XmlTables:
    """Tables of documents that arrive in chunks; use one of them per streaming query."""
    return parse_xml(assemble(chunks, encoding, timeout_ms), "text", **options)


def parse_stream(documents: DataFrame, content: str = "content", doc_id: str = "doc_id", **options) -> XmlTables:
    """Tables of whole documents that arrive as rows: stateless, so any output mode will do."""
    return parse_xml(documents, content, doc_id, **options)


class PushParser:
    """Incremental parse of one document on one machine: feed() bytes, then close()."""

    def __init__(self, options: Options = Options(), encoding: str | None = None, resources: dict | None = None) -> None:  # noqa: B008
        self.parser, self.encoding, self.parts = Parser(options, resources), encoding, []

    def feed(self, data: bytes) -> None:
        self.parts.append(data)

    def close(self) -> dict:
        try:
            return self.parser.parse(decode_bytes(b"".join(self.parts), self.encoding, self.parser.o.swapped_utf16)[0])
        except DecodeProblem as problem:
            return {"error": {"code": "DECODE", "line": None, "column": None, "context": None, "message": str(problem)}, "dtd": None, "nodes": []}
