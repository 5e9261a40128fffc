import io
import json

import pytest
from test_search import LEAVES, leaves, papers

from lexigrid import server
from lexigrid.api import Corpus


@pytest.fixture(scope="module")
def told(spark):
    corpus = Corpus(papers(spark), leaves(spark, LEAVES), spark.createDataFrame([(3, "Rivers")], "cluster_id int, label string"))
    return server.Server(lambda: corpus)


def ask(s, method, **params):
    return json.loads(s.answer(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params})))


def test_tools(told):
    assert ask(told, "initialize")["result"]["capabilities"] == {"tools": {}} and ask(told, "ping")["result"] == {}
    assert [t["name"] for t in ask(told, "tools/list")["result"]["tools"]] == ["search_papers", "get_paper", "related_papers"]
    found = ask(told, "tools/call", name="search_papers", arguments={"query": "floods", "limit": 2})["result"]
    assert found["isError"] is False and found["structuredContent"]["total_matches"] == 3 and len(found["structuredContent"]["papers"]) == 2
    assert json.loads(found["content"][0]["text"]) == found["structuredContent"]
    assert ask(told, "tools/call", name="get_paper", arguments={"paper_id": "geo:2022:4"})["result"]["structuredContent"]["title"] == "Deserts"
    assert ask(told, "tools/call", name="related_papers", arguments={"paper_id": "geo:2019:1"})["result"]["structuredContent"]["total_cluster_peers"] == 2


@pytest.mark.parametrize("name, arguments, says", [
    ("get_paper", {"paper_id": "none"}, "unknown paper_id"), ("related_papers", {"paper_id": "none"}, "unknown paper_id"),
    ("search_papers", {"query": " "}, "query"), ("search_papers", {"query": "x", "limit": 51}, "limit"), ("related_papers", {"paper_id": "geo:2019:1", "limit": 0}, "limit"),
    ("search_papers", {}, "missing argument: query"), ("get_paper", {"paper_id": "x", "y": 1}, "unknown argument: y"),
])
def test_wrong_questions_are_results(told, name, arguments, says):
    got = ask(told, "tools/call", name=name, arguments=arguments)["result"]
    assert got["isError"] is True and says in got["content"][0]["text"]


def test_protocol_errors(told):
    assert ask(told, "tools/call", name="drop")["error"]["code"] == server.BAD_PARAMS and ask(told, "tools/call")["error"]["code"] == server.BAD_PARAMS
    assert ask(told, "other")["error"]["code"] == server.NO_METHOD
    sink = io.StringIO()
    told.serve(io.StringIO('not json\n\n[1]\n{"method": "notifications/initialized"}\n{"id": 1, "method": "ping"}\n'), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r.get("error", {}).get("code") for r in replies] == [server.PARSE, server.INVALID, None] and replies[2]["id"] == 1


def test_snapshot_from_paths(spark, tmp_path):
    papers(spark).write.parquet(str(tmp_path / "p"))
    leaves(spark, LEAVES).write.parquet(str(tmp_path / "a"))
    (tmp_path / "l.json").write_text('{"3": {"label": "Rivers", "size": 3}}')
    whole = server.Server(lambda: server.open_corpus(*(str(tmp_path / x) for x in ("p", "a", "l.json"))))
    assert whole.call("get_paper", {"paper_id": "geo:2019:1"})["structuredContent"]["leaf_cluster"]["label"] == "Rivers"
    lacking = server.Server(lambda: server.open_corpus(*(str(tmp_path / x) for x in ("p", "gone", "l.json"))))
    assert "the snapshot lacks" in lacking.call("get_paper", {"paper_id": "geo:2019:1"})["content"][0]["text"]
