"""A message queue as a table: messages with the time from which they can be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def send(queue: DataFrame, messages: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """The queue with new messages (a column `message`), which get the next ids, from 1 on, in order, and can be seen at once."""
    last = queue.agg(F.coalesce(F.max("msg_id"), F.lit(0)).alias("_last"))  # one row
    new = numbered(messages, "_n", order).join(F.broadcast(last)).select((F.col("_last") + F.col("_n")).alias("msg_id"), now.alias("visible_at"), F.lit(0).alias("read_count"), "message")
    return queue.unionByName(new.select(queue.columns))


def pop(queue: DataFrame, now: Column, quantity: int = 1) -> tuple[DataFrame, DataFrame]:
    """The oldest messages that can be seen, and the queue without them."""
    got = readable(queue, now, quantity)
    return got, delete(queue, got.select("msg_id"))


def delete(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids, "msg_id", "left_anti")


def readable(queue: DataFrame, now: Column, quantity: int) -> DataFrame:
    """The oldest messages that can be seen now."""
    return queue.where(F.col("visible_at") <= now).orderBy("msg_id").limit(quantity)


def read(queue: DataFrame, now: Column, seconds: int, quantity: int) -> tuple[DataFrame, DataFrame]:
    """The messages read, and the queue in which they stay hidden for so many seconds and count one more read."""
    got = readable(queue, now, quantity).select("msg_id").withColumn("_got", F.lit(True))
    marked = queue.join(got, "msg_id", "left").withColumn("_got", F.coalesce("_got", F.lit(False)))
    hidden = F.when(F.col("_got"), now + F.make_dt_interval(secs=F.lit(float(seconds)))).otherwise(F.col("visible_at"))
    after = marked.withColumn("visible_at", hidden).withColumn("read_count", F.col("read_count") + F.col("_got").cast("int"))
    return after.where("_got").drop("_got"), after.drop("_got")


def archive(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue without some messages, and those messages."""
    return queue.join(ids, "msg_id", "left_anti"), queue.join(ids, "msg_id", "left_semi")
