"""One object in front of retrieval, tables and wiki, as an application uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.config import Settings, User
from orefall.errors import CodedError
from orefall.functions.text import seems_to_instruct
from orefall.operators import grounding, wiki
from orefall.operators.access import visible
from orefall.plans.guard import Answer, Guard
from orefall.plans.index import Cache, Index
from orefall.plans.question import Question
from orefall.plans.retrieval import Options, Retriever

TOOLS = [
    {"name": "vector_search", "description": "Passages of the visible documents", "parameters": {"type": "object", "properties": {"query": {"type": "string"}, "filename": {"type": "string"}, "source": {"type": "string"}, "top_k": {"type": "integer", "default": 5}}, "required": ["query"]}},
    {"name": "table_query", "description": "One SELECT over the visible tables", "parameters": {"type": "object", "properties": {"sql": {"type": "string"}}, "required": ["sql"]}},
]


class Engine:
    """nodes: as for Retriever, or a stored index, whose nodes, postings and version are read. tables: name to (DataFrame, owner_id, visibility)."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | Index, tables: dict[str, tuple[DataFrame, str, str]] | None = None, settings: Settings = Settings(), version: str = "") -> None:
        self.spark, self.tables, self.settings, self._version = spark, tables or {}, settings, version
        self.index, self._nodes = (nodes, None) if isinstance(nodes, Index) else (None, nodes)
        self.cache = Cache()
        self.question = Question(self.index) if self.index else None

    @property
    def nodes(self) -> DataFrame:
        return self.index.part("nodes") if self.index else self._nodes

    @property
    def version(self) -> str:
        return self.index.version or "" if self.index else self._version

    def search(self, user: User, query: str, embedding: list[float] | None = None, **options) -> list[dict]:
        if not query.strip():
            raise CodedError("empty_query", "the question is empty")
        o = Options(**({"mode": "hybrid" if embedding else "keyword"} | options))
        key = Cache.key(user.user_id, user.is_admin, self.version, query, **options, vector=embedding)
        held = self.cache.get(key)
        plain = o.mode == "keyword" and o.mmr_weight is None and not (o.filename or o.source or o.filters)
        if held is None and self.question and plain:
            held = self.question.answer(user, query, o.top_k, o.fetch, self.nodes)
        if held is None:
            q = self.spark.createDataFrame([(1, query, embedding)], "query_id long, text string, embedding array<double>")
            held = [r.asDict() for r in Retriever(self.nodes, user, self.index).plan(q, o).orderBy("rank").collect()]
        self.cache.put(key, held)
        return held

    def visible_tables(self, user: User) -> list[str]:
        return sorted(n for n, (_, owner, vis) in self.tables.items() if user.is_admin or vis == "public" or owner == user.user_id)

    def query(self, user: User, sql: str) -> Answer:
        return Guard(self.spark, {n: self.tables[n][0] for n in self.visible_tables(user)}, self.settings).run(sql)

    def describe(self, user: User) -> dict[str, list[tuple[str, str]]]:
        """Columns and types of the visible tables."""
        return {n: self.tables[n][0].dtypes for n in self.visible_tables(user)}

    def domains(self, user: User) -> DataFrame:
        return visible(self.nodes, user).groupBy("source_name").agg(F.countDistinct("filename").alias("documents"))

    def execute(self, user: User, call: int, name: str, arguments: dict) -> list[dict]:
        """Evidence of one tool call, numbered E<call>.<place>; passages that seem to instruct the model are marked."""
        if name == "vector_search":
            rows = self.search(user, arguments["query"], **{k: v for k, v in arguments.items() if k != "query"})
            return [{"evidence_id": f"E{call}.{i}", "module": "vector", "location": r["filename"], "snippet": r["content"], "suspect": seems_to_instruct(r["content"])} for i, r in enumerate(rows, start=1)]
        if name == "table_query":
            a = self.query(user, arguments["sql"])
            shown = "\n".join(str(dict(zip(a.columns, r))) for r in a.rows)
            return [{"evidence_id": f"E{call}.1", "module": "table", "location": a.sql, "snippet": shown, "suspect": seems_to_instruct(shown)}]
        raise CodedError("unknown_tool", name)

    check_claims = staticmethod(grounding.check_claims)
    search_pages = staticmethod(wiki.search)
