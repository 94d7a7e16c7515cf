"""Change feeds: the difference of two results by key, in order, the fold that rebuilds a result from its changes, and change logs applied to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import write_and_reread
from .ordered import with_previous

#: Columns that a change has beside those of the result, and the operations in the order in which they are told.
OP, CHANGED, AFTER = "__op__", "__changed_columns__", "__after__"
OPERATIONS = ("RESET", "INSERT", "DELETE", "UPDATE")
#: Operations of a change log, two of which are no change of a row.
UP_TO_DATE, MUST_REFETCH = "up-to-date", "must-refetch"


def with_predecessor(df: DataFrame, key: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Add the key of the row before, in the result's order. Give partition columns where the order is only meant within them."""
    if partition:
        return df.withColumn(AFTER, F.lag(key).over(Window.partitionBy(*partition).orderBy(*order)))
    return with_previous(df, AFTER, key, order)


def changes(before: DataFrame, after: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """What turns before into after: INSERT has all columns, DELETE the key alone, UPDATE the columns that changed, all others null.

    Both sides have the same columns, key being unique and not null. The changed columns are listed for updates. With an order, rows also say
    which key they come after, and a row that has moved is an update. told() sorts changes as a feed tells them.
    """
    if order:
        before, after = with_predecessor(before, key, order), with_predecessor(after, key, order)
    columns = [c for c in after.columns if c != key]
    p = before.select(F.col(key).alias("_pk"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    c = after.select(F.col(key).alias("_ck"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    both = p.join(c, F.col("_pk") == F.col("_ck"), "full")
    differs = {x: ~F.col(f"_p_{x}").eqNullSafe(F.col(f"_c_{x}")) for x in columns}
    op = F.when(F.col("_pk").isNull(), "INSERT").when(F.col("_ck").isNull(), "DELETE").otherwise("UPDATE")
    listed = F.array_compact(F.array(*[F.when(d, F.lit(x)) for x, d in differs.items()]))
    changed = F.when(op == "UPDATE", listed).otherwise(F.array().cast("array<string>"))
    values = [F.when((op == "INSERT") | (op == "UPDATE") & differs[x], F.col(f"_c_{x}")).alias(x) for x in columns]
    out = both.select(op.alias(OP), F.coalesce("_ck", "_pk").alias(key), *values, changed.alias(CHANGED))
    return out.where((F.col(OP) != "UPDATE") | (F.size(CHANGED) > 0))


def op_rank() -> Column:
    """The place of a change's operation in a feed."""
    return F.array_position(F.array(*map(F.lit, OPERATIONS)), F.col(OP)).cast("int")


def told(change: DataFrame, key: str) -> DataFrame:
    """Changes in the order of a feed: a reset, then inserts, deletes and updates, each by key."""
    return change.orderBy(op_rank(), key)


def reset(result: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """What a feed says whose last state is lost: a RESET, then all rows as inserts."""
    rows = changes(result.where("false"), result, key, order)
    return rows.sparkSession.createDataFrame([("RESET",)], f"{OP} string").unionByName(rows, allowMissingColumns=True).select(rows.columns)


def fold(before: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Apply changes to a result: the inverse of changes(). A RESET among them discards what was before.

    If the changes tell an order, before has the column of predecessors too (or is empty).
    """
    columns = [c for c in before.columns if c != key]
    gone = F.broadcast(change.agg(F.coalesce(F.bool_or(F.col(OP) == "RESET"), F.lit(False)).alias("_reset")))  # one row
    before = before.join(gone).where("NOT _reset").drop("_reset")
    c = change.where(F.col(OP) != "RESET").select(F.col(key).alias("_k"), OP, CHANGED, *[F.col(x).alias(f"_n_{x}") for x in columns])
    both = before.join(c, F.col(key) == F.col("_k"), "full").where(f"{OP} IS NULL OR {OP} <> 'DELETE'")
    new = {x: (F.col(OP) == "INSERT") | F.array_contains(CHANGED, x) for x in columns}
    return both.select(F.coalesce(key, "_k").alias(key), *[F.when(F.coalesce(new[x], F.lit(False)), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) for x in columns]).select(before.columns)


def in_list_order(rows: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Positions (from 1) of rows that each name the key before them; the first one names none. Rows that no chain leads to are left out.

    By pointer jumping: each round doubles how far every row has looked back, so rounds grow with the logarithm of the rows.
    Each round joins a table of all rows, which would be broadcast in every one of them while its packed files are small: the joins are shuffled.
    """
    at = write_and_reread(rows.select(F.col(key).alias("_k"), F.col(AFTER).alias("_to"), F.lit(1).cast("bigint").alias("_steps")), "positions")
    for _ in range(64):  # 2 ** 64 rows
        if at.where("_to IS NOT NULL").isEmpty():
            break
        on = at.select(F.col("_k").alias("_to"), F.col("_to").alias("_next"), F.col("_steps").alias("_more")).hint("merge")
        done = at.where("_to IS NULL")
        further = at.where("_to IS NOT NULL").join(on, "_to").select("_k", F.col("_next").alias("_to"), (F.col("_steps") + F.col("_more")).alias("_steps"))
        at = write_and_reread(done.unionByName(further), "positions")
    return rows.join(at.where("_to IS NULL").select(F.col("_k").alias(key), F.col("_steps").alias(position)).hint("merge"), key)


def latest_by_key(messages: DataFrame, keys: list[str], lsn: str = "lsn", seq: str = "seq", op: str = "op") -> DataFrame:
    """Of a log of row images the last of each key by (lsn, seq), unless it is a delete."""
    last = messages.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(lsn, seq)).alias("m"))
    return last.select("m.*").where(F.col(op) != "delete")


def apply_log(table: DataFrame, messages: DataFrame, keys: list[str], frontier: int | None = None, done: int = -1) -> DataFrame:
    """The table after the messages with done < lsn <= frontier, each having lsn, seq, op (insert, update, delete) and the row's columns.

    Messages up to `done` were applied before and are skipped, so a replay changes nothing. An array `present` names the columns that a message
    brings (without one: all); an update sets these alone, and changes nothing where there is no row. A boolean `move_in` marks rows that
    come from a query, not from the log: they have no lsn, are never skipped, and set their columns in a row that is there already; where there is that
    column, seq is the order of arrival and decides alone. A key's messages are folded by aggregates, each task keeping the last one for every key and column.
    """
    has = messages.columns
    move_in = F.coalesce(F.col("move_in"), F.lit(False)) if "move_in" in has else F.lit(False)
    values = [c for c in table.columns if c not in keys]
    present = F.col("present") if "present" in has else F.lit(None).cast("array<string>")
    m = messages.where(F.col("op").isin("insert", "update", "delete")).withColumn("move_in", move_in).withColumn("present", present)
    m = m.where(F.col("move_in") | (F.col("lsn") > done))
    if frontier is not None:
        m = m.where(F.col("move_in") | (F.col("lsn") <= frontier))
    by = F.lit(0) if "move_in" in has else F.col("lsn")
    m = m.withColumn("_at", F.struct(by.cast("bigint").alias("lsn"), F.col("seq").cast("bigint").alias("seq")))
    # Where a key's story starts anew: its last delete or plain insert.
    anew = (F.col("op") == "delete") | (F.col("op") == "insert") & ~F.col("move_in")
    starts = m.groupBy(*keys).agg(F.max(F.when(anew, F.col("_at"))).alias("_anew"), F.max_by(F.when(anew, F.col("op")), F.when(anew, F.col("_at"))).alias("_anew_op"))
    old = table.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(True).alias("_there"))
    told = old.join(starts.withColumn("_told", F.lit(True)), keys, "full")
    kept = told.where("_told IS NULL").select(*keys, *[F.col(f"_old_{c}").alias(c) for c in values])
    told = told.where("_told").withColumn("_row", F.when(F.col("_anew").isNull(), F.coalesce("_there", F.lit(False))).otherwise(F.col("_anew_op") == "insert"))
    due = m.join(told.select(*keys, "_anew", "_row"), keys).where("_anew IS NULL OR _at >= _anew").where((F.col("op") != "delete"))
    # Without a row, what comes before the first moved-in one is lost.
    first = due.groupBy(*keys).agg(F.min(F.when(F.col("move_in"), F.col("_at"))).alias("_first"))
    due = due.join(first, keys).where("_row OR _at >= _first")
    last = []
    for c in values:
        brings = F.col("present").isNull() | F.array_contains("present", c)
        last.append(F.max_by(F.when(brings, F.struct(F.col(c).alias("v"))), F.when(brings, F.col("_at"))).alias(f"_new_{c}"))
    new = due.groupBy(*keys).agg(*(last or [F.count("*").alias("_n")]), F.bool_or("move_in").alias("_moved"))
    rows = told.join(new, keys, "left").where("_row OR _moved")
    # Columns of an inserted row that nothing brings are null; those of a row that was there stay.
    picked = [F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).when(F.col("_anew").isNull(), F.col(f"_old_{c}")).alias(c) for c in values]
    return kept.unionByName(rows.select(*keys, *picked)).select(table.columns)


@dataclass
class Applied:
    """A table after a stream's messages, and the lsn that is complete with them."""

    table: DataFrame
    done: int


def apply_stream(table: DataFrame, messages: DataFrame, keys: list[str], done: int = -1, frontier: int | None = None) -> Applied:
    """Apply one stream's messages, `seq` being their order of arrival, up to what is complete (and a frontier, if other streams are behind).

    An `up-to-date` message completes its lsn, and so does one whose boolean `last` is true. A `must-refetch` discards all that came before it, the table's
    rows too, and what was complete. The state to keep with the table is the number that is returned.
    """
    refetch = messages.where(F.col("op") == MUST_REFETCH).agg(F.max("seq").alias("seq")).first()["seq"]
    if refetch is not None:
        table, messages, done = table.where("false"), messages.where(F.col("seq") > refetch), -1
    complete = F.col("op") == UP_TO_DATE
    if "last" in messages.columns:
        complete = complete | F.coalesce(F.col("last"), F.lit(False))
    reached = messages.where(complete).agg(F.max("lsn").alias("lsn")).first()["lsn"]
    reached = done if reached is None else max(done, reached)
    if frontier is not None:
        reached = min(reached, frontier)
    return Applied(apply_log(table, messages, keys, frontier=reached, done=done), reached)


def frontier(completed: DataFrame, stream: str = "stream", lsn: str = "lsn") -> DataFrame:
    """How far several streams can be applied together: the least of the lsn that each has completed."""
    return completed.groupBy(stream).agg(F.max(lsn).alias("done")).agg(F.min("done").alias("frontier"))


def notifications(change: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """A line for each change: the quoted table, I, U or D, and the key columns with their values as literals."""
    quoted = [F.concat(F.lit(f'"{k}"='), F.lit("'"), F.replace(F.col(k).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) for k in keys]
    return change.where(F.col(OP) != "RESET").select(F.concat(F.lit(f'"{table}",'), F.substring(OP, 1, 1), F.lit(","), F.concat_ws(",", *quoted)).alias("payload"))
