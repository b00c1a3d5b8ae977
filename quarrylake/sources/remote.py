"""Records of a server over HTTP as a source: pages are partitions, and filters travel with the request."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..shipping import ship_package

FORMAT = "quarrylake_remote"
#: In the order in which they are wanted.
SEVERITIES = ("critical", "warning", "info")
LESSONS = "id string, title string, content string, severity string, tags array<string>, created_at long, rank int, position int"
CHECKPOINTS = "id string, agent string, working_on string, state string, created_at long"


@dataclass
class Page(InputPartition):
    """Requests that one task sends: (rank, position of the first record, path with its parameters)."""

    requests: list[tuple[int, int, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"].rstrip("/")
        self.page = int(options.get("pagesize", 200))
        self.most = int(options["most"]) if "most" in options else None
        self.timeout = float(options.get("timeout", 30))
        self.wanted: list[str] | None = None

    #: The column whose equality the server can test.
    column = ""

    def pushFilters(self, filters: list) -> Iterator:
        """Takes = and IN on the reader's column; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.column,):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.wanted = [v for v in (values if self.wanted is None else self.wanted) if v in values]
            else:
                yield f

    def get(self, path: str) -> dict | None:
        """The parsed answer; null for one that is no success."""
        try:
            with urlopen(f"{self.url}{path}", timeout=self.timeout) as answer:
                return json.load(answer)
        except HTTPError:
            return None

    def fetch(self, path: str) -> dict:
        got = self.get(path)
        if got is None:  # planned from an answer that was there: the task fails and is tried again
            raise RuntimeError(f"{path} was refused")
        return got


class LessonReader(_Reader):
    """Severity by severity, as many lessons in all as most allows; a severity that the server refuses is left out."""

    column = "severity"

    def partitions(self) -> list[Page]:
        pages, left = [], self.most
        for rank, severity in enumerate(SEVERITIES):
            if self.wanted is not None and severity not in self.wanted or left is not None and left <= 0:
                continue
            head = self.get("/api/v1/lessons?" + urlencode({"severity": severity, "limit": 1, "offset": 0}))
            n = head["total"] if head else 0
            n = n if left is None else min(n, left)
            for at in range(0, n, self.page):
                size = min(self.page, n - at)
                pages.append(Page([(rank, at, "/api/v1/lessons?" + urlencode({"severity": severity, "limit": size, "offset": at}))]))
            left = None if left is None else left - n
        return pages or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for rank, at, path in partition.requests:
            for k, r in enumerate(self.fetch(path)["lessons"]):
                yield r["id"], r["title"], r["content"], r["severity"], list(r.get("tags") or []), r["created_at"], rank, at + k


class CheckpointReader(_Reader):
    """The latest checkpoint of each agent that the server names, of the first most of them."""

    column = "agent"

    def partitions(self) -> list[Page]:
        named = self.get("/api/v1/agents")
        agents = [a["name"] for a in named["agents"]][: self.most] if named else []
        agents = [a for a in agents if self.wanted is None or a in self.wanted]
        paths = [(0, k, "/api/v1/checkpoints?" + urlencode({"agent": a, "limit": 1})) for k, a in enumerate(agents)]
        return [Page(paths[k : k + self.page]) for k in range(0, len(paths), self.page)] or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for _, _, path in partition.requests:
            got = self.get(path)  # an agent that has gone since is passed over
            for r in (got or {"checkpoints": []})["checkpoints"][:1]:
                state = r.get("state")
                yield r["id"], r["agent"], r["working_on"], state if isinstance(state, str) else json.dumps(state), r["created_at"]


class RemoteRecords(DataSource):
    """The format quarrylake_remote. Options: url, kind (lessons, checkpoints), most (records; agents), pageSize, timeout."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"lessons": LESSONS, "checkpoints": CHECKPOINTS}[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return {"lessons": LessonReader, "checkpoints": CheckpointReader}[self.options["kind"]]({k.lower(): v for k, v in self.options.items()})


def _load(spark: SparkSession, url: str, kind: str, most: int | None, page: int) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(RemoteRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format(FORMAT).option("url", url).option("kind", kind).option("pageSize", page)
    return (r if most is None else r.option("most", most)).load()


def remote_lessons(spark: SparkSession, url: str, most: int | None = None, page: int = 200) -> DataFrame:
    """id, title, content, severity, tags, created_at, rank, position of the lessons of a server: critical ones, then
    warnings, then infos, most in all. Each page is a partition; a filter on severity is sent to the
    server. Their order is that of rank and position. A connection that fails is an error."""
    return _load(spark, url, "lessons", most, page)


def remote_checkpoints(spark: SparkSession, url: str, most: int | None = None, page: int = 20) -> DataFrame:
    """id, agent, working_on, state (JSON), created_at: the latest of each of the server's first most agents, by agent.
    A partition asks for page agents; a filter on agent asks for those alone."""
    return _load(spark, url, "checkpoints", most, page).orderBy(F.col("agent"))
