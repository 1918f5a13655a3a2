"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ">" are quotes, as many levels deep as there are marks. Runs of quoted lines of one level are
passages; their normalised text (lower case, single spaces) is hashed, and so are each message's own lines and its own
whole text. A passage's original is the first message of its conversation that has the hash; it must come before the
quoting message. A message replies to the latest original of its least deep linked passages, and belongs to the thread
of what it replies to. Messages come out without quotes, threads in order of their first message, and each thread in
turn order, so that every reply stands behind what it answers.

A conversation is never gathered: hashes are pre-aggregated to one original each, threads are found by pointer
jumping over checkpointed tables, and the order is a range sort over all conversations. The joins have one row a key on
one side, which is broadcast if it is small; else adaptive execution splits the keys that many messages share.

Edge cases: a null text is an empty message; a null conv_id or turn links with nothing and keeps its row; rows that
share conv_id and turn keep their rows and share their links; an empty table gives an empty result; other columns,
whatever their names, do not matter; messages are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.store import cut, small

MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sha2(text, 256))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, own (text without quotes) of every row."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n")
    own = F.when(F.exists("lines", lambda x: _level(x) > 0), F.trim(F.array_join(F.filter("lines", lambda x: _level(x) == 0), "\n"))).otherwise(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines.alias("lines"), "text").withColumn("own", own).drop("text")


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage for each quoted run of lines."""
    quoting = rows.where(F.exists("lines", lambda x: _level(x) > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    keyed = quoting.select("conv_id", "turn", F.xxhash64("lines").alias("copy"), "lines").dropDuplicates(["conv_id", "turn", "copy"])
    lines = keyed.select("conv_id", "turn", "copy", F.posexplode("lines").alias("at", "line"))
    lines = lines.withColumn("level", _level(F.col("line"))).withColumn("body", F.regexp_replace("line", MARKS, ""))
    order = W.partitionBy("conv_id", "turn", "copy").orderBy("at")
    lines = lines.withColumn("fresh", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int"))
    lines = lines.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).where("level > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    return lines.groupBy("conv_id", "turn", "copy", "run", "level").agg(joined.alias("passage")).select("conv_id", "turn", "level", "passage")


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, quotes (linked passages) for messages that quote an earlier one."""
    quoted = passages(rows)
    single = F.size(F.split("passage", "\n")) == 1
    quoted = quoted.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.concat(F.array(_hash(_normal(F.col("passage")))), F.when(single, F.array()).otherwise(F.transform(F.split("passage", "\n"), lambda x: _hash(_normal(x))))))).alias("hash")).where("hash is not null")
    wanted = cut(quoted)
    if not wanted.limit(1).count():
        return wanted.select("conv_id", "turn", F.col("turn").alias("reply_to"), F.lit(0).cast("long").alias("quotes")).where("false")
    hashes = F.array_distinct(F.concat(F.array(_hash(_normal(F.col("own")))), F.transform(F.split("own", "\n"), lambda x: _hash(_normal(x)))))
    originals = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(hashes).alias("hash")).where("hash is not null")
    # one row for each passage that is quoted: a passage that many messages quote is broadcast, or its messages are split
    originals = originals.join(wanted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    found = wanted.join(small(cut(originals)), ["conv_id", "hash"]).where("original < turn")
    return found.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct(-F.col("level"), "original")).alias("reply_to"), F.count_distinct("hash").alias("quotes"))


def threads(found: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, quotes, thread: the first message that the replies lead back to."""
    state = cut(found.withColumn("thread", F.col("reply_to")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        fresh = cut(state.join(small(up), ["conv_id", "thread"], "left").select("conv_id", "turn", "reply_to", "quotes", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")))
        state = fresh.drop("moved")
        if not fresh.where("moved").limit(1).count():
            return state


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, quotes, rendered of every row, in reply order."""
    rows = messages(conversations)
    found = threads(links(rows))
    out = rows.join(found, ["conv_id", "turn"], "left")
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"))
    out = out.select("conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("quotes", F.lit(0).cast("long")).alias("quotes"), rendered.alias("rendered"))
    return out.orderBy(F.col("conv_id").asc_nulls_last(), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "text")
