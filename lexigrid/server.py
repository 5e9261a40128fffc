"""The corpus' three questions as tools of the Model Context Protocol, over standard input and output.

python -m lexigrid.server PAPERS ASSIGNMENTS LABELS serves a folder of papers, a Parquet table
(paper_id, leaf) and a JSON map of labels. The protocol's messages are JSON-RPC 2.0, one per line.
What a caller asks wrongly (unknown paper, a bad argument, a snapshot that is not there) is the
result of the call, marked as an error; a message that is no call is an error of the protocol.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from lexigrid.api import Corpus
from lexigrid.operators.search import MOST

VERSION = "2025-06-18"
PARSE, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602  # fixed values of JSON-RPC

_TEXT, _YEAR, _LIMIT = {"type": "string"}, {"type": "integer"}, {"type": "integer", "minimum": 1, "maximum": MOST, "default": 10}
#: Name, what it tells, its arguments, and which of them are needed.
TOOLS = [
    ("search_papers", "Papers whose metadata or abstract hold every word of a query, best first; full texts are not read.", {"query": _TEXT, "venue": _TEXT, "year": _YEAR, "limit": _LIMIT}, ["query"]),
    ("get_paper", "One paper's metadata, abstract and links.", {"paper_id": _TEXT}, ["paper_id"]),
    ("related_papers", "Papers of the same leaf cluster, newest first; they are not ranked by likeness.", {"paper_id": _TEXT, "limit": _LIMIT}, ["paper_id"]),
]


class Fault(Exception):
    """A message that the protocol does not allow."""

    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


class Server:
    """Answers messages; the corpus is opened by the first call that needs it and kept."""

    def __init__(self, opened: Callable[[], Corpus]):
        self._opened, self._corpus = opened, None

    def call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """The result of a tool, as text and as structure."""
        schema = next((t for t in TOOLS if t[0] == name), None)
        if schema is None:
            raise Fault(BAD_PARAMS, f"unknown tool: {name}")
        try:
            if unknown := sorted(set(arguments) - set(schema[2])):
                raise ValueError(f"unknown argument: {unknown[0]}")
            if lacking := [a for a in schema[3] if a not in arguments]:
                raise ValueError(f"missing argument: {lacking[0]}")
            if self._corpus is None:
                self._corpus = self._opened()
            found = getattr(self._corpus, name)(**arguments)
        except (ValueError, LookupError, FileNotFoundError) as e:
            return {"content": [{"type": "text", "text": str(e.args[0] if e.args else e)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, default=str)}], "structuredContent": found, "isError": False}

    def result(self, method: str, params: dict[str, Any]) -> dict[str, Any]:
        if method == "initialize":
            return {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "lexigrid", "version": "0.1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, "required": r}} for n, d, a, r in TOOLS]}
        if method == "tools/call":
            if not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), dict):
                raise Fault(BAD_PARAMS, "a call has a name and arguments")
            return self.call(params["name"], params.get("arguments", {}))
        raise Fault(NO_METHOD, f"unknown method: {method}")

    def answer(self, line: str) -> str | None:
        """The reply to one message; none to a notification."""
        of = None
        try:
            try:
                message = json.loads(line)
            except ValueError as e:
                raise Fault(PARSE, "not JSON") from e
            if not isinstance(message, dict) or not isinstance(message.get("method"), str) or not isinstance(message.get("params", {}), dict):
                raise Fault(INVALID, "not a request")
            if "id" not in message:
                return None
            of = message["id"]
            body = {"result": self.result(message["method"], message.get("params", {}))}
        except Fault as e:
            body = {"error": {"code": e.code, "message": str(e)}}
        return json.dumps({"jsonrpc": "2.0", "id": of} | body, ensure_ascii=False, default=str)

    def serve(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if line.strip() and (reply := self.answer(line)) is not None:
                print(reply, file=sink, flush=True)


def open_corpus(papers: str, assignments: str, labels: str) -> Corpus:
    """The snapshot at three paths; FileNotFoundError names one that is missing."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from lexigrid.sources import corpus

    spark = SparkSession.builder.getOrCreate()
    read = [(papers, lambda p: corpus.scan_unique(spark, p)), (assignments, spark.read.parquet), (labels, lambda p: corpus.read_labels(spark, p))]
    frames = []
    for path, reader in read:
        try:
            frames.append(reader(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise FileNotFoundError(f"the snapshot lacks {path}") from e
    return Corpus(*frames)


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    Server(lambda: open_corpus(*args)).serve(sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
