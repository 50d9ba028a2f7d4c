"""Chat streams saved into conversation tables: finished exchanges are added once, whatever is replayed and in whatever order it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rollups import topic
from ..session import dropped, exists, replace_partitions, stage

#: Fixed value: what a conversation is called before anything is said.
NEW = "New Discussion"
CONVERSATIONS = "conversation_id string, goal_id string, topic string, own_topic boolean, created_at timestamp, part int"
MESSAGES = "conversation_id string, seq bigint, role string, content string, sources array<string>, timestamp timestamp, exchange_id string, part int"


class ConversationStore:
    """Conversations and their messages as two Parquet tables dealt into partitions by conversation, of which a save rewrites those it touches, and a ledger of saved epochs.

    An exchange (a question with its answer) is two messages. Those of a conversation stand behind what it began with in the order of (timestamp, exchange_id), and its topic, unless it has one of
    its own, is that of its first user message: both follow from what is saved and not from when it came. A save leaves out exchanges that are saved already and of repeated ones takes the least,
    so that an epoch that failed between its tables and is replayed completes them and changes nothing else; an epoch in the ledger is not looked at again."""

    def __init__(self, spark: SparkSession, location: str, partitions: int = 16):
        self.spark, self.location, self.partitions = spark, location.rstrip("/"), partitions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("conversation_id"), F.lit(self.partitions)).cast("int").alias("part")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.location}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def conversations(self) -> DataFrame:
        return self._table("conversations", CONVERSATIONS).drop("part", "own_topic")

    def messages(self) -> DataFrame:
        return self._table("messages", MESSAGES).drop("part", "exchange_id")

    def epochs(self) -> DataFrame:
        return self._table("epochs", "writer string, epoch bigint")

    def create(self, conversations: DataFrame, messages: DataFrame) -> None:
        """The tables of conversations(conversation_id, goal_id, topic, created_at) and messages(conversation_id, seq, role, content, sources, timestamp)."""
        own = conversations.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("goal_id").cast("string").alias("goal_id"), "topic", (F.col("topic") != NEW).alias("own_topic"), F.col("created_at").cast("timestamp").alias("created_at"))
        self._write(own.withColumn("part", self._part()), "conversations")
        rows = messages.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("seq").cast("bigint").alias("seq"), "role", "content", F.col("sources").cast("array<string>").alias("sources"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("exchange_id"))
        self._write(rows.withColumn("part", self._part()), "messages")

    def _write(self, rows: DataFrame, name: str) -> None:
        replace_partitions(rows, f"{self.location}/{name}", "part")

    def save(self, exchanges: DataFrame, epoch: int | None = None, writer: str = "") -> bool:
        """Add exchanges(exchange_id, conversation_id, question, content, sources, timestamp); whether there was anything to do: nothing for an epoch of a writer that the ledger has."""
        if epoch is not None and self.epochs().where((F.col("epoch") == epoch) & (F.col("writer") == writer)).head(1):
            return False
        fields = F.struct(F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("conversation_id").cast("string").alias("conversation_id"), "question", "content", F.col("sources").cast("array<string>").alias("sources"))
        given = exchanges.where("exchange_id is not null and conversation_id is not null").groupBy(F.col("exchange_id").cast("string").alias("exchange_id")).agg(F.min(fields).alias("x")).select("exchange_id", "x.*")
        given = stage(given.join(self._table("conversations", CONVERSATIONS).select("conversation_id"), "conversation_id", "left_semi").withColumn("part", self._part()), "exchanges")
        parts = F.broadcast(given.select("part").distinct())  # at most as many rows as partitions
        held = self._table("messages", MESSAGES).join(parts, "part", "left_semi")
        fresh = given.join(held.where("exchange_id is not null").select("exchange_id").distinct(), "exchange_id", "left_anti")
        none = F.lit(None).cast("array<string>")
        said = lambda place, role, content, sources: fresh.select("conversation_id", F.lit(place).cast("bigint").alias("seq"), F.lit(role).alias("role"), F.col(content).alias("content"), sources.alias("sources"), "timestamp", "exchange_id", "part")
        every = held.select("conversation_id", F.when(F.col("exchange_id").isNull(), F.col("seq")).otherwise(F.when(F.col("role") == "user", 0).otherwise(1)).alias("seq"), "role", "content", "sources", "timestamp", "exchange_id", "part")
        every = every.unionByName(said(0, "user", "question", none)).unionByName(said(1, "assistant", "content", F.col("sources")))
        # what it began with first, then exchanges by time
        first = F.max(F.when(F.col("exchange_id").isNull(), F.col("seq"))).over(Window.partitionBy("conversation_id"))
        place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.col("exchange_id").isNotNull(), F.when(F.col("exchange_id").isNotNull(), F.col("timestamp")), "exchange_id", "seq"))
        began = F.count(F.when(F.col("exchange_id").isNull(), 1)).over(Window.partitionBy("conversation_id"))
        numbered = every.withColumns({"_first": F.coalesce(first, F.lit(-1)), "_place": place, "_began": began})
        seq = F.when(F.col("exchange_id").isNull(), F.col("seq")).otherwise(F.col("_first") + F.col("_place") - F.col("_began")).cast("bigint")
        rows = stage(numbered.withColumn("seq", seq).drop("_first", "_place", "_began"), "messages")
        user = rows.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "seq").alias("_u"))
        told = self._table("conversations", CONVERSATIONS).join(parts, "part", "left_semi").join(user, "conversation_id", "left")
        named = told.withColumn("topic", F.when(F.col("own_topic") | F.col("_u").isNull(), F.col("topic")).otherwise(topic(F.col("_u"))))
        named = stage(named.select("conversation_id", "goal_id", "topic", "own_topic", "created_at", "part"), "conversations")
        self._write(rows, "messages")
        self._write(named, "conversations")
        if epoch is not None:
            self.spark.createDataFrame([(writer, epoch)], "writer string, epoch bigint").coalesce(1).write.mode("append").parquet(f"{self.location}/epochs")
        dropped(given, rows, named)
        return True

    def saver(self, questions: DataFrame, key: str = "stream_id", writer: str = "") -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function for rows of ``fold_stream``: finished answers that did not fail, with their questions(key, conversation_id, question, sources, timestamp), are saved; failed and unfinished ones are not."""

        def run(df: DataFrame, epoch: int) -> None:
            done = df.where("ended and not failed").groupBy(key).agg(F.max("content").alias("content"))
            asked = questions.select(key, "conversation_id", "question", "sources", "timestamp")
            self.save(asked.join(done, key).withColumnRenamed(key, "exchange_id"), epoch, writer)

        return run
