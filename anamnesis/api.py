"""One object with the tools a conversation-memory client calls; each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators import dag, search
from anamnesis.operators.latest import latest
from anamnesis.operators.ordered import running_sums
from anamnesis.sources import files
from anamnesis.session import micros, table


class Memory:
    """Tables of one directory, seen as ``owner`` (own and public rows) and in ``namespace`` (None: all)."""

    def __init__(self, spark: SparkSession, directory: str, owner: str | None = None, namespace: str | None = None):
        self.spark, self.directory, self.owner, self.namespace = spark, directory, owner, namespace

    def _seen(self, df: DataFrame) -> DataFrame:
        if self.owner is not None and "owner" in df.columns:
            df = df.where(F.col("owner").isin(self.owner, "public"))
        if self.namespace is not None and "conversation_id" in df.columns:
            own = table(self.spark, self.directory, "conversations").where(F.lower(F.trim("namespace")) == self.namespace.lower())
            df = df.join(own.select("conversation_id"), "conversation_id", "left_semi")
        return df

    def messages(self, conversation: str | None = None) -> DataFrame:
        m = self._seen(latest(table(self.spark, self.directory, "messages"), "message_id", "ingest_no"))
        return m if conversation is None else m.where(F.col("conversation_id") == conversation)

    def notes(self, open_only: bool = True) -> DataFrame:
        n = self._seen(latest(table(self.spark, self.directory, "notes"), "note_id", "ingest_no"))
        return n.where("superseded_by IS NULL") if open_only else n

    def summaries(self) -> DataFrame:
        return self._seen(table(self.spark, self.directory, "summaries").distinct())

    def list_sessions(self, min_tokens: int = 0) -> DataFrame:
        tokens = F.floor(F.sum(F.coalesce(F.length("content"), F.lit(0))) / 3).cast("bigint")
        return self.messages().groupBy("conversation_id").agg(tokens.alias("tokens"), F.count(F.lit(1)).alias("messages")).where(F.col("tokens") >= min_tokens)

    def grep(self, query: str, limit: int = 20, every: bool = True) -> DataFrame:
        """Messages that hold the query's words (read as the index reads texts), best first.

        The index holds all messages; what the owner or the namespace doesn't see is taken out of its hits.
        """
        path = f"{self.directory}/messages.parquet"
        index, size = search.written_index(self.spark, "messages", [path], lambda: latest(table(self.spark, self.directory, "messages"), "message_id", "ingest_no").where("content IS NOT NULL"), "message_id", "content")
        hits = search.bm25(index, size, search.query_terms(query), every)
        seen = self.messages().where("content IS NOT NULL").select(F.col("message_id").alias("doc"), "conversation_id", "content")
        return hits.join(seen, "doc").orderBy(F.desc("score"), "doc").limit(limit)

    def describe(self, summary: str | None = None) -> DataFrame:
        """Structure of one summary (what it covers) or of all conversations."""
        if summary is None:
            return self.summaries().groupBy("conversation_id", "depth").agg(F.countDistinct("summary_id").alias("summaries"))
        below = table(self.spark, self.directory, "summary_parents").where(F.col("summary_id") == summary).select(F.col("parent_summary_id").alias("id"), F.lit("summary").alias("kind"))
        return below.union(table(self.spark, self.directory, "summary_messages").where(F.col("summary_id") == summary).select("message_id", F.lit("message"))).distinct()

    def expand(self, summary: str, max_depth: int = 3) -> DataFrame:
        """The messages below a summary."""
        roots = self.spark.createDataFrame([(summary,)], "node string")
        edges = table(self.spark, self.directory, "summary_parents").select(F.col("summary_id").alias("above"), F.col("parent_summary_id").alias("below")).distinct()
        nodes = dag.expand(roots, edges, max_depth)
        own = nodes.join(table(self.spark, self.directory, "summary_messages"), F.col("node") == F.col("summary_id")).select("message_id").distinct()
        return self.messages().join(own, "message_id", "left_semi")

    def preview(self, max_tokens: int = 40_000) -> DataFrame:
        """Usage and strategy of each conversation."""
        used = self.messages().groupBy("conversation_id").agg(F.sum(F.coalesce(T.token_estimate(F.col("content")), F.lit(0))).alias("tokens"))
        usage = F.least(F.col("tokens") / max_tokens, F.lit(1.0))
        return used.select("conversation_id", "tokens", usage.alias("usage"), S.strategy_three(usage).alias("strategy"))

    def compress(self, fan_out: int = 4) -> DataFrame:
        """All levels that condensing the leaf summaries gives."""
        leaves = self.summaries().where("depth = 0 AND conversation_id IS NOT NULL").groupBy("conversation_id", "summary_id").agg(F.min("created_at").alias("made"), F.max(F.coalesce("descendant_count", F.lit(0))).alias("descendants"), F.min("content").alias("content"))
        return dag.cascade(leaves.select("conversation_id", F.lit(0).alias("depth"), "summary_id", "made", "descendants", "content"), fan_out)

    def assemble(self, budget: int = 8000) -> DataFrame:
        """Newest notes, summaries and messages within their shares of a token budget."""
        s = self.summaries()
        s = s.withColumn("us", micros(s, "created_at")).groupBy("summary_id").agg(F.max(F.coalesce("token_count", F.lit(0))).alias("cost"), (-F.max("us")).alias("o"), F.min("content").alias("content"))
        m = self.messages().where("created_at IS NOT NULL")
        items = (
            self.notes().select(F.lit("semantic").alias("tier"), F.col("note_id").alias("id"), (F.floor(F.coalesce(F.length("content"), F.lit(0)) / 4) + 10).alias("cost"), (-F.col("ingest_no")).alias("o"), "content")
            .unionByName(s.select(F.lit("episodic").alias("tier"), F.col("summary_id").alias("id"), "cost", "o", "content"))
            .unionByName(m.select(F.lit("working").alias("tier"), F.col("message_id").alias("id"), F.coalesce(T.token_estimate(F.col("content")), F.lit(0)).alias("cost"), (-micros(m, "created_at")).alias("o"), "content"))
        )
        share = F.when(F.col("tier") == "working", int(budget * 0.4)).otherwise(int(budget * 0.3))
        return running_sums(items, "tier", ["o", "id"], {"used": "cost"}).where(F.col("used") <= share).select("tier", "id", "used", "content")

    def correct(self, corrections: DataFrame) -> DataFrame:
        """Messages after corrections (target_id, correction_type, new_value, created_at): last one wins, deletes take rows out."""
        last = corrections.groupBy("target_id").agg(F.max(F.struct("created_at", "correction_type", "new_value")).alias("c"))
        j = self.messages().join(last, F.col("message_id") == F.col("target_id"), "left").where("c IS NULL OR c.correction_type <> 'delete'")
        return j.withColumn("content", F.when(F.col("c.correction_type") == "content", F.col("c.new_value")).otherwise(F.col("content"))).drop("c", "target_id")

    def sweep(self, now_us: int, min_hours: float = 720.0) -> DataFrame:
        """Messages that have faded: old enough, not exempt, with little left."""
        m = self.messages().where("created_at IS NOT NULL")
        hours = S.hours_between(F.lit(now_us), micros(m, "created_at"))
        left = S.retention_by_hours(hours, S.half_life_hours(F.lit(0.5), F.lit(0)))
        return m.where((hours > min_hours) & (left < 0.3) & ~F.coalesce(S.exempt(S.message_class(F.col("content"))), F.lit(False)))

    def status(self) -> DataFrame:
        count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        return count(self.messages(), "messages").union(count(self.notes(False), "notes")).union(count(self.summaries(), "summaries"))

    def prune(self, now_us: int, dry_run: bool = True) -> DataFrame:
        """A preview of what a sweep would delete, or what stays."""
        gone = self.sweep(now_us)
        if dry_run:
            return gone.agg(F.count(F.lit(1)).alias("n"))
        return self.messages().join(gone.select("message_id"), "message_id", "left_anti")

    def ingest(self, rows: DataFrame, path: str) -> None:
        """Append messages, scored and classed, to a table."""
        c = F.col("content")
        rows.withColumn("token_count", T.token_estimate(c)).withColumn("msg_type", S.message_class(c)).withColumn("compression_exempt", S.exempt(S.message_class(c))).withColumn("structural_bonus", S.signal_bonus(c)).write.mode("append").parquet(path)

    def import_new(self, rows: DataFrame) -> DataFrame:
        """Rows whose content isn't here yet."""
        seen = self.messages().where("content IS NOT NULL").select(F.substring(F.sha2("content", 256), 1, 16).alias("content_hash")).distinct()
        return files.import_new(rows, seen)

    def write_public(self, texts: DataFrame) -> DataFrame:
        """Notes with public ids made of their text."""
        return texts.select(T.short_id(F.col("content"), 16, "pub_").alias("note_id"), F.lit("public").alias("owner"), "content").dropDuplicates(["note_id"])

    def skill_search(self, skills: DataFrame, words: str, scope: str = "mix") -> DataFrame:
        """Skills by words and scope (mix, self, public), best quality first; no words or * lists all."""
        me = F.col("owner") == (self.owner or "default")
        seen = {"self": me, "public": F.col("visibility") == "public", "mix": me | (F.col("visibility") == "public")}[scope]
        hits = skills.where(seen)
        if words and words != "*":
            for w in words.lower().split():
                hits = hits.where(F.lower(F.concat_ws(" ", "name", "description")).contains(w))
        return hits.orderBy(F.desc("quality_score"), "skill_id")

    @staticmethod
    def publish(skills: DataFrame, events: DataFrame) -> DataFrame:
        """Skills with the visibility of their last event (skill_id, visibility, created_at)."""
        last = events.groupBy("skill_id").agg(F.max_by("visibility", "created_at").alias("_v"))
        return skills.join(last, "skill_id", "left").withColumn("visibility", F.coalesce("_v", "visibility")).drop("_v")

    @staticmethod
    def update_weights(weights: dict[str, float], changes: dict[str, float]) -> dict[str, float]:
        """New keyword weights; only known names change."""
        return {k: changes.get(k, v) for k, v in weights.items()}
