"""Problem 6: conversations rebuilt from message rows by keyed streaming state.

Messages are keyed by conversation and by a block of its sequence numbers, so a conversation of any length is
spread over many keys. A key's state buffers its messages in a session that late and repeated rows join; it closes
when the watermark passes its last message by the idle time. A closed block comes out in order and validated as far
as it can be inside the block: broken rows, repeated sequence numbers, replies answered inside it. With every batch
of closed blocks the conversations they belong to are put together, by sums and by a join of the replies that cross
blocks, and those that are whole and valid are emitted. A conversation that goes on after that is emitted anew.

A finished table is replayed through the same stream in slices of event time, so the watermark moves along and state
holds what was said within the idle time, not the table. State is kept by RocksDB, outside of the heap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.records import stripped
from corvane.session import Workspace

BLOCK = 512  # sequence numbers of one key
END = "2500-01-01"  # event time of the row that ends a replayed table
IDLE = "30 days"  # a block is closed so long after its last message
SLICES = 2  # parts of event time in which a table is replayed
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LOOSE = 1024  # keys for the rows of a conversation that have no sequence number

EMITTED = "conversation_id string, turn bigint, event_ref string, speaker_role string, epoch int"

_PAYLOAD = "conversation_id string, sequence string, role string, content string, in_reply_to string, _corrupt_record string"


def messages(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """(conversation_id, block, turn, event_ref, speaker, content, reply_to, broken, event_time) of every row.

    A null conversation_id or sequence is taken from the payload; rows without a conversation or an id are left
    out. broken: the payload is null or does not parse, the role is unknown, or the sequence is missing or below 1.
    content: at least one letter or digit.
    """
    alias = roles.select(F.col("alias").alias("role"), "speaker_role").where("role is not null").dropDuplicates(["role"])
    p = F.from_json("payload", _PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt_record"})
    m = rows.select("id", "conversation_id", "sequence", "created_at", "ingested_at", p.alias("p"), F.col("payload").isNotNull().alias("given"))
    parsed = F.col("given") & F.col("p").isNotNull() & F.col("p._corrupt_record").isNull()
    m = m.select(
        F.coalesce("conversation_id", "p.conversation_id").alias("conversation_id"),
        F.coalesce("sequence", stripped(F.col("p.sequence")).try_cast("bigint")).alias("turn"),
        F.col("id").alias("event_ref"),
        F.lower(stripped(F.col("p.role"))).alias("role"),
        F.coalesce(F.col("p.content").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("content"),
        F.col("p.in_reply_to").alias("reply_to"),
        parsed.alias("parsed"),
        F.greatest(F.least(F.coalesce("created_at", "ingested_at", F.to_timestamp(F.lit("2000-01-01"))), F.to_timestamp(F.lit("2099-01-01"))), F.to_timestamp(F.lit("2000-01-01"))).alias("event_time"),
    ).where("conversation_id is not null and event_ref is not null")
    m = m.join(alias, "role", "left")
    block = F.when(F.col("turn") >= 1, F.floor((F.col("turn") - 1) / BLOCK)).otherwise(-1 - F.pmod(F.xxhash64("event_ref"), F.lit(LOOSE))).cast("bigint")
    broken = ~F.col("parsed") | F.col("speaker_role").isNull() | F.coalesce(F.col("turn") < 1, F.lit(True))
    return m.select("conversation_id", block.alias("block"), "turn", "event_ref", F.col("speaker_role").alias("speaker"), "content", "reply_to", broken.alias("broken"), "event_time")


def _validated(blocks: DataFrame) -> DataFrame:
    """(conversation_id, block, n, lo, hi, broken, asked, last_human, last_answer, open_replies, messages) of closed blocks.

    blocks: (conversation_id, block, raw), raw sorted by event_ref, of repeated rows the one that parses first.
    """
    once = F.filter("raw", lambda x, i: (i == 0) | (F.get("raw", i - 1)["event_ref"] != x["event_ref"]))
    fields = ("turn", "event_ref", "speaker", "content", "reply_to", "broken")
    b = blocks.select("conversation_id", "block", F.array_sort(F.transform(once, lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("m"))
    turns = F.map_from_entries(F.transform("m", lambda x: F.struct(x["event_ref"], x["turn"])))
    b = b.withColumn("turns", turns)
    there = lambda x: F.try_element_at("turns", x["reply_to"])
    inside = lambda x: F.map_contains_key("turns", x["reply_to"])
    asks = lambda x: x["reply_to"].isNotNull()
    wrong = F.exists("m", lambda x: x["broken"] | (asks(x) & F.coalesce(inside(x), F.lit(False)) & ~F.coalesce(there(x) < x["turn"], F.lit(False))))
    of = lambda keep: F.array_max(F.transform(F.filter("m", keep), lambda x: x["turn"]))
    human: Column = lambda x: F.coalesce(x["speaker"] == "human", F.lit(False))
    agent: Column = lambda x: F.coalesce(x["speaker"] == "agent", F.lit(False))
    same = F.size(F.array_distinct(F.transform("m", lambda x: x["turn"]))) < F.size("m")
    lost = F.filter("m", lambda x: asks(x) & ~F.coalesce(inside(x), F.lit(False)))
    return b.select(
        "conversation_id",
        "block",
        F.size("m").cast("bigint").alias("n"),
        F.array_min(F.transform("m", lambda x: x["turn"])).alias("lo"),
        F.array_max(F.transform("m", lambda x: x["turn"])).alias("hi"),
        (wrong | same).alias("broken"),
        F.exists("m", lambda x: human(x) & x["content"]).alias("asked"),
        of(human).alias("last_human"),
        of(lambda x: agent(x) & x["content"]).alias("last_answer"),
        F.transform(lost, lambda x: F.struct(x["reply_to"].alias("event_ref"), x["turn"].alias("from"))).alias("open_replies"),
        F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["event_ref"].alias("event_ref"), x["speaker"].alias("speaker_role"))).alias("messages"),
    )


def assemble(stream: DataFrame, delay: str, idle: str = IDLE) -> DataFrame:
    """Streaming messages to streaming validated blocks; rows later than `delay` behind the watermark are late.

    A conversation silent for longer than `idle` between two messages of one block comes out in two parts.
    """
    row = F.struct("event_ref", "broken", "turn", "speaker", "content", "reply_to")
    closed = stream.withWatermark("event_time", delay).groupBy(F.session_window("event_time", idle), "conversation_id", "block").agg(F.array_sort(F.collect_set(row)).alias("raw"))
    return _validated(closed)


def settle(blocks: DataFrame) -> DataFrame:
    """(conversation_id, turn, event_ref, speaker_role) of the conversations that closed blocks make whole and valid.

    A conversation's blocks are added up; its sequences are 1..n if the least is 1, the greatest n and no block
    repeats one. Replies that cross blocks are joined with all its messages.
    """
    c = "conversation_id"
    # a block that was silent for longer than the idle time came in parts, which may repeat a sequence number
    turns = F.flatten(F.collect_list(F.transform("messages", lambda m: m["turn"])))
    whole = blocks.groupBy(c, "block").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("broken") | (F.size(F.array_distinct(turns)) < F.sum("n"))).alias("broken"), F.max("asked").alias("asked"), F.max("last_human").alias("last_human"), F.max("last_answer").alias("last_answer"))
    sums = whole.groupBy(c).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("broken").alias("broken"), F.max("asked").alias("asked"), F.max("last_human").alias("last_human"), F.max("last_answer").alias("last_answer"))
    kept = sums.where("not broken and lo = 1 and hi = n and asked and last_answer > last_human").select(c)
    flat = blocks.select(c, F.explode("messages").alias("m")).select(c, "m.turn", "m.event_ref", "m.speaker_role")
    asks = blocks.select(c, F.explode("open_replies").alias("a")).select(c, "a.event_ref", "a.from")
    lost = asks.join(flat.select(c, "event_ref", F.col("turn").alias("to")), [c, "event_ref"], "left").where("to is null or to >= `from`").select(c).distinct()
    return flat.join(kept.join(lost, c, "left_anti"), c, "left_semi")


def emit(stream: DataFrame, root: str, checkpoint: str, delay: str, idle: str = IDLE):
    """Starts the stream that writes closed blocks and, batch by batch, the conversations they settle to root.

    stream: streaming messages(). A batch that is run again replaces what it wrote. Read the result by emitted().
    """
    spark = stream.sparkSession
    spark.createDataFrame([], EMITTED).write.mode("ignore").parquet(f"{root}/conversations/start")

    def settled(batch: DataFrame, epoch: int) -> None:
        path = f"{root}/blocks/e{epoch:08d}"
        batch.write.mode("overwrite").parquet(path)
        new = spark.read.schema(batch.schema).parquet(path)
        if not new.limit(1).count():
            return
        so_far = spark.read.schema(batch.schema).parquet(*[f"{root}/blocks/e{e:08d}" for e in range(epoch + 1)])
        touched = so_far.join(new.select("conversation_id").distinct(), "conversation_id", "left_semi")
        good = settle(touched)
        none = [F.lit(None).cast(t).alias(c) for c, t in good.dtypes[1:]]
        bad = touched.select("conversation_id").distinct().join(good.select("conversation_id"), "conversation_id", "left_anti").select("conversation_id", *none)
        good.unionByName(bad).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/conversations/e{epoch:08d}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return assemble(stream, delay, idle).writeStream.foreachBatch(settled).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def emitted(spark: SparkSession, root: str) -> DataFrame:
    """(conversation_id, turn, event_ref, speaker_role): every conversation as it was settled last; one that was valid and
    is no longer so has been taken back by a row without a message."""
    found = spark.read.schema(EMITTED).option("recursiveFileLookup", "true").parquet(f"{root}/conversations")
    last = found.groupBy("conversation_id").agg(F.max("epoch").alias("epoch"))
    return found.join(last, ["conversation_id", "epoch"], "left_semi").where("event_ref is not null").drop("epoch")


def replay(ws: Workspace, table: DataFrame) -> DataFrame:
    """Runs a finished table of messages() through the stream until every conversation is settled.

    Rows of one id become one row, the one that parses first, at its least time. The table lands in slices of event
    time, one after the other, so that no row is late; a last row moves the watermark past all of them.
    """
    spark: SparkSession = table.sparkSession
    rest = ("broken", "turn", "speaker", "content", "reply_to")
    once = table.groupBy("conversation_id", "block", "event_ref").agg(F.min(F.struct(*rest)).alias("r"), F.min("event_time").alias("event_time"))
    once = ws.save(once.select("conversation_id", "block", "r.turn", "event_ref", "r.speaker", "r.content", "r.reply_to", "r.broken", "event_time"), "once")
    at = F.unix_micros("event_time")
    cuts = sorted(set(once.agg(F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 200)).first()[0] or []))
    end = spark.range(1).select(F.lit("\u0000end").alias("conversation_id"), F.lit(-1).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("turn"), F.lit("end").alias("event_ref"), F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("content"), F.lit(None).cast("string").alias("reply_to"), F.lit(True).alias("broken"), F.to_timestamp(F.lit(END)).alias("event_time"))
    landed, root = f"{ws.root}/landed", f"{ws.root}/stream"
    bounds = [None, *cuts, None]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = once if lo is None else once.where(at > lo)
        part = part if hi is None else part.where(at <= hi)
        q_in = part.unionByName(end) if hi is None else part
        q_in.write.parquet(f"{landed}/s{n:03d}")
        q = emit(spark.readStream.schema(once.schema).parquet(f"{landed}/*"), root, f"{ws.root}/stream-state", "0 seconds")
        q.awaitTermination()
    return emitted(spark, root)


def rebuild(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """(conversation_id, turn, event_ref, speaker_role) of the messages of every kept conversation.

    Kept is a conversation whose rows are all sound, whose sequences are exactly 1..n, whose replies point to
    earlier messages of its own, in which a human says something and an agent says something after the last human
    message. Rows that repeat an id count once, of several different ones the one that parses. An empty table
    gives no rows.
    """
    return replay(Workspace(rows.sparkSession, "conversations"), messages(rows, roles))
