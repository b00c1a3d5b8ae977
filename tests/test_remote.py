"""The remote source against a server in the test."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from quarrylake.sources import remote

COUNTS = {"critical": 5, "warning": 7, "info": 450}


@pytest.fixture()
def server():
    asked, refused = [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            body = None
            if url.path == "/api/v1/lessons" and q["severity"] not in refused:
                n, at, s = COUNTS[q["severity"]], int(q["offset"]), q["severity"]
                own = [{"id": f"{s}{k}", "title": f"t {k} é", "content": "c", "severity": s, "tags": ["x", s], "created_at": k} for k in range(n)]
                body = {"lessons": own[at : at + int(q["limit"])], "total": n}
            elif url.path == "/api/v1/agents":
                body = {"agents": [{"name": f"agent {k}/é", "checkpoint_count": 1, "last_active": 0} for k in (3, 1, 2, 0)]}
            elif url.path == "/api/v1/checkpoints" and q["agent"] not in refused:
                none = q["agent"].startswith("agent 2")
                body = {"checkpoints": [] if none else [{"id": "c", "agent": q["agent"], "working_on": "w", "state": {"k": [1]}, "created_at": 4}], "total": 1}
            self.send_response(200 if body else 500)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", asked, refused
    s.shutdown()
    s.server_close()


def test_lessons_come_in_order_of_severity(spark, server):
    url, asked, refused = server
    got = [r["id"] for r in remote.remote_lessons(spark, url, page=100).orderBy("rank", "position").collect()]
    assert got == [f"{s}{k}" for s, n in COUNTS.items() for k in range(n)]
    assert remote.remote_lessons(spark, url, page=100).rdd.getNumPartitions() == 1 + 1 + 5
    few = remote.remote_lessons(spark, url, most=9, page=3).orderBy("rank", "position").collect()
    assert [r["id"] for r in few] == [f"critical{k}" for k in range(5)] + [f"warning{k}" for k in range(4)]
    assert few[0]["tags"] == ["x", "critical"] and few[0]["title"] == "t 0 é"
    refused.add("warning")
    assert {r["severity"] for r in remote.remote_lessons(spark, url).collect()} == {"critical", "info"}
    refused |= {"critical", "info"}
    assert remote.remote_lessons(spark, url).count() == 0


def test_a_filter_on_severity_reaches_the_server(spark, server):
    url, asked, _ = server
    lessons = remote.remote_lessons(spark, url)
    asked.clear()
    assert lessons.filter("severity = 'warning' and created_at > 2").count() == 4
    assert asked and all("severity=warning" in p for p in asked)
    asked.clear()
    assert lessons.filter(F.col("severity").isin("critical", "info") & (F.col("severity") != "info")).count() == 5
    assert not any("severity=warning" in p for p in asked)
    asked.clear()
    assert lessons.filter("severity = 'warning' and severity = 'info'").count() == 0 and not any("warning" in p for p in asked)


def test_latest_checkpoints_of_the_first_agents(spark, server):
    url, asked, refused = server
    got = [tuple(r) for r in remote.remote_checkpoints(spark, url, page=1).collect()]
    assert [r[1] for r in got] == ["agent 0/é", "agent 1/é", "agent 3/é"] and json.loads(got[0][3]) == {"k": [1]}
    assert [r["agent"] for r in remote.remote_checkpoints(spark, url, most=2).collect()] == ["agent 1/é", "agent 3/é"]
    asked.clear()
    assert remote.remote_checkpoints(spark, url).filter("agent = 'agent 1/é'").count() == 1 and sum("checkpoints" in p for p in asked) == 1
    refused.add("agent 1/é")
    assert [r["agent"] for r in remote.remote_checkpoints(spark, url).collect()] == ["agent 0/é", "agent 3/é"]


def test_no_server_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)refused|urlopen"):
        remote.remote_lessons(spark, "http://127.0.0.1:9").count()
