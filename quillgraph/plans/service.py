"""The application's operations as methods: queries, chats, uploads and the catalog of documents, categories and agents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.operators import listings, versions
from quillgraph.plans.answering import Answer, Engine
from quillgraph.plans.ingest import Ingestion
from quillgraph.plans.providers import Providers
from quillgraph.sources.catalog import Catalog, settled


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


@dataclass
class Service:
    catalog: Catalog
    providers: Providers = field(default_factory=Providers)
    config: EngineConfig = DEFAULT
    clock: Column | None = None

    def __post_init__(self):
        self.engine = Engine(self.catalog, self.providers, self.config, self.clock)
        self.ingestion = Ingestion(self.catalog, self.providers, self.config, self.clock)

    def _rows(self, schema: str, *rows) -> DataFrame:
        return self.catalog.spark.createDataFrame(list(rows), schema)

    def _one(self, table: str, key: str) -> dict:
        row = self.catalog.read(table).filter(F.col("id") == key).first()
        if row is None:
            raise NotFound(f"no row {key} in {table}")
        return row.asDict(recursive=True)

    def _change(self, table: str, key: str, **values) -> dict:
        self._one(table, key)
        own = settled(self.catalog.read(table).filter(F.col("id") == key))
        for column, value in values.items():
            own = own.withColumn(column, value if isinstance(value, Column) else F.lit(value).cast(own.schema[column].dataType))
        self.catalog.upsert(table, own)
        return self._one(table, key)

    # Questions and chats

    def query(self, text: str, conversation_id: str | None = None) -> Answer:
        return self._chat(text, conversation_id, None, None)

    def agent_chat(self, agent_id: str, text: str, conversation_id: str | None = None) -> Answer:
        agent = self._one("agents", agent_id)
        linked = [r["category_id"] for r in self.catalog.read("agent_categories").filter(F.col("agent_id") == agent_id).collect()]
        return self._chat(text, conversation_id, linked, agent["system_prompt"])

    def _chat(self, text, conversation_id, categories, prompt) -> Answer:
        history = []
        if conversation_id is not None:
            history = [{"role": m["role"], "content": m["content"]} for m in self.messages(conversation_id).collect()]
            self._say(conversation_id, "user", text)
        told = self.engine.query(text, history, categories, prompt)
        if conversation_id is not None:
            self._say(conversation_id, "assistant", told.answer)
        return told

    def _say(self, conversation_id: str, role: str, content: str) -> None:
        at = self.engine.now()
        n = self.catalog.read("messages").filter(F.col("conversation_id") == conversation_id).count()
        row = self._rows("conversation_id string, role string, content string", (conversation_id, role, content)).withColumn("created_at", at + F.make_dt_interval(secs=F.lit(n / 1e6)))
        self.catalog.append("messages", row.withColumn("id", F.sha2(F.concat_ws("|", "conversation_id", F.lit(str(n))), 256)))
        self._change("conversations", conversation_id, updated_at=at)

    def conversations(self) -> DataFrame:
        return listings.conversations(self.catalog.read("conversations"), self.catalog.read("messages"))

    def create_conversation(self, title: str = "New conversation") -> str:
        key, at = str(uuid.uuid4()), self.engine.now()
        self.catalog.append("conversations", self._rows("id string, title string", (key, title)).withColumn("created_at", at).withColumn("updated_at", at))
        return key

    def messages(self, conversation_id: str) -> DataFrame:
        self._one("conversations", conversation_id)
        return self.catalog.read("messages").filter(F.col("conversation_id") == conversation_id).orderBy("created_at", "id")

    def rename_conversation(self, conversation_id: str, title: str) -> dict:
        return self._change("conversations", conversation_id, title=title, updated_at=self.engine.now())

    def delete_conversation(self, conversation_id: str) -> None:
        self._one("conversations", conversation_id)
        self.catalog.delete("messages", F.col("conversation_id") == conversation_id)
        self.catalog.delete("conversations", F.col("id") == conversation_id)

    # Documents

    def upload(self, paths: list[str], category_id: str | None = None) -> DataFrame:
        """PDF files only, as the upload route has it; the engine itself takes all formats."""
        if category_id is not None:
            self._one("categories", category_id)
        if other := [p for p in paths if not p.lower().endswith(".pdf")]:
            raise ValueError(f"only PDF files can be uploaded: {other}")
        return self.ingestion.ingest_paths(paths, category_id)

    def documents(self) -> DataFrame:
        return listings.documents(self.catalog.read("documents").drop("full_markdown"), self.catalog.read("chunks"), self.catalog.read("categories"))

    def move_document(self, document_id: str, category_id: str | None) -> dict:
        if category_id is not None:
            self._one("categories", category_id)
        return self._change("documents", document_id, category_id=category_id)

    def delete_document(self, document_id: str) -> None:
        self._one("documents", document_id)
        self.catalog.write("documents", versions.deprecate(self.catalog.read("documents"), F.col("id") == document_id, self.engine.now()))

    def transcribe(self, audio: bytes) -> str:
        if self.providers.transcribe is None:
            raise NotFound("no transcription provider")
        return self.providers.transcribe(audio)

    # Categories and agents

    def categories(self) -> DataFrame:
        return listings.categories(self.catalog.read("categories"), self.catalog.read("documents"))

    def create_category(self, name: str) -> str:
        if self.catalog.read("categories").filter(F.col("name") == name).limit(1).count():
            raise Conflict(f"category {name} exists")
        key = str(uuid.uuid4())
        self.catalog.append("categories", self._rows("id string, name string", (key, name)).withColumn("created_at", self.engine.now()))
        return key

    def delete_category(self, category_id: str) -> None:
        self._one("categories", category_id)
        own = F.col("category_id") == category_id
        docs = self.catalog.read("documents")
        if docs.filter(own & (F.col("status") == "active")).limit(1).count():
            raise Conflict("category has active documents")
        self.catalog.write("documents", docs.withColumn("category_id", F.when(~F.coalesce(own, F.lit(False)), F.col("category_id"))))
        self.catalog.delete("agent_categories", own)
        self.catalog.delete("categories", F.col("id") == category_id)

    def agents(self) -> DataFrame:
        return listings.agents(self.catalog.read("agents"), self.catalog.read("agent_categories"), self.catalog.read("categories"))

    def agent(self, agent_id: str) -> dict:
        self._one("agents", agent_id)
        return self.agents().filter(F.col("id") == agent_id).first().asDict(recursive=True)

    def create_agent(self, name: str, description: str = "", system_prompt: str = "", categories: list[str] | None = None) -> str:
        key = str(uuid.uuid4())
        self.catalog.append("agents", self._rows("id string, name string, description string, system_prompt string", (key, name, description, system_prompt)).withColumn("created_at", self.engine.now()))
        self._link(key, categories or [])
        return key

    def _link(self, agent_id: str, categories: list[str]) -> None:
        for c in categories:
            self._one("categories", c)
        others = self.catalog.read("agent_categories").filter(F.col("agent_id") != agent_id)
        self.catalog.write("agent_categories", others.unionByName(self._rows("agent_id string, category_id string", *[(agent_id, c) for c in dict.fromkeys(categories)])))

    def update_agent(self, agent_id: str, categories: list[str] | None = None, **values) -> dict:
        """Only the given fields change; ``categories`` replaces all links."""
        if unknown := set(values) - {"name", "description", "system_prompt"}:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        self._change("agents", agent_id, **values)
        if categories is not None:
            self._link(agent_id, categories)
        return self.agent(agent_id)

    def delete_agent(self, agent_id: str) -> None:
        self._one("agents", agent_id)
        self.catalog.delete("agent_categories", F.col("agent_id") == agent_id)
        self.catalog.delete("agents", F.col("id") == agent_id)

    def reset(self) -> None:
        self.catalog.truncate()
