"""Chat formatting: conversations merged into prefix trees, each shared turn emitted once in depth-first order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxspark.llm.shared import running_total, written

START, END = "<s>", "</s>"
#: Role whose text carries loss.
LEARNED = "assistant"
# A control string inside a text gets a backslash behind its first character, one more if it had some already.
_ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def escaped_role(role: Column) -> Column:
    """A role in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    """Cut at the doubled backslashes, a line feed's mark is what is left of them; no character stands in for another."""
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: node (a digest of all turns up to it), piece (formatted), pos, loss span inside the piece.

    Turns are ordered by turn (nulls last), then role and text, so repeated turns stay. Null roles and texts are empty.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    body = escaped(text)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("raw"), head.alias("head"), body.alias("body"))
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "raw", "head", "body")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kind = "array<struct<node:string,piece:string,pos:bigint,loss_from:bigint,loss_to:bigint>>"
    state = F.struct(F.lit("").alias("node"), F.lit(0).cast("bigint").alias("pos"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(x["head"], x["body"], F.lit(END))
        node = F.sha2(F.concat(a["node"], piece), 256)
        learned = x["role"] == LEARNED
        at = F.when(learned, F.length(x["head"])).otherwise(0).cast("bigint")
        to = F.when(learned, F.length(x["head"]) + F.length(x["body"])).otherwise(0).cast("bigint")
        one = F.struct(node.alias("node"), piece.alias("piece"), a["pos"].alias("pos"), at.alias("loss_from"), to.alias("loss_to"))
        return F.struct(node.alias("node"), (a["pos"] + F.length(piece)).alias("pos"), F.concat(a["out"], F.array(one)).alias("out"))

    return grouped.select("conv_id", F.aggregate("turns", state, step, lambda a: a["out"]).alias("turns"))


def write_tree(conversations: DataFrame, folder: str) -> None:
    """Write ``folder``/stream and ``folder``/conversations.

    stream: one row per distinct run of initial turns, in depth-first order: start (its offset in the stream of all pieces), piece,
    pos (position id of its first character, the others follow), loss_from and loss_to (inside the piece), and seen: the
    stretches of the stream that it attends to besides itself, which are its ancestors, adjacent ones joined.
    conversations: conv_id, starts (of its nodes in order), seen (all its stretches).

    Conversations are sorted by their node digests, so those that share turns are neighbours; a node belongs to the
    first of them. Trees of any size are cut anywhere by the sort and by the running total of lengths.
    """
    convs = written(paths(conversations).withColumn("leaf", F.get("turns", F.size("turns") - 1)["node"]), "chat-paths")
    # The tree is laid out without the texts, which come back to their nodes at the end.
    slim = F.transform("turns", lambda x: F.struct(x["node"].alias("node"), x["pos"].alias("pos"), F.length(x["piece"]).cast("bigint").alias("length")))
    distinct = convs.select("leaf", slim.alias("turns")).groupBy("leaf").agg(F.first("turns").alias("turns")).withColumn("path", F.transform("turns", lambda x: x["node"]))
    sorted_ = distinct.repartitionByRange("path").sortWithinPartitions("path")
    ranked = written(sorted_.select("leaf", "turns", F.monotonically_increasing_id().alias("rank")), "chat-ranked")
    turns = ranked.select("rank", "leaf", F.posexplode("turns").alias("k", "t")).select("rank", "leaf", "k", "t.*")
    owner = turns.groupBy("node").agg(F.min(F.struct("rank", "k")).alias("o"), F.first(F.struct("pos", "length")).alias("t"))
    nodes = owner.select("node", "o.rank", "o.k", "t.*").withColumn("part", F.shiftright("rank", 33))
    placed = written(running_total(nodes, "length", ["part"], ["rank", "k"]).withColumn("start", F.col("__cum") - F.col("length")).drop("__cum"), "chat-nodes")
    where = turns.select("rank", "leaf", "k", "node").join(placed.select("node", "start", "length"), "node")
    lines = where.groupBy("rank", "leaf").agg(F.array_sort(F.collect_list(F.struct("k", "start", "length"))).alias("nodes"))
    kind = "array<struct<start:bigint,end:bigint>>"

    def joined(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        end = x["start"] + x["length"]
        more = F.concat(a, F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.when(F.size(a) == 0, more).when(last["end"] == x["start"], grown).otherwise(more)

    seen = F.aggregate("nodes", F.array().cast(kind), joined)
    lines = written(lines.select("rank", "leaf", F.transform("nodes", lambda x: x["start"]).alias("starts"), seen.alias("seen")), "chat-lines")

    def before(a: Column, x: Column) -> Column:
        end = F.least(x["end"], x["start"] + a["left"])
        more = F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        return F.struct((a["left"] - (end - x["start"])).alias("left"), F.when(a["left"] > 0, more).otherwise(a["out"]).alias("out"))

    clip = F.aggregate("seen", F.struct(F.col("pos").alias("left"), F.array().cast(kind).alias("out")), before, lambda a: a["out"])
    texts = convs.select(F.explode("turns").alias("t")).groupBy("t.node").agg(F.first(F.struct("t.piece", "t.loss_from", "t.loss_to")).alias("x"))
    stream = placed.join(lines.select("rank", "seen"), "rank").select("node", "start", "pos", clip.alias("seen")).join(texts, "node")
    stream = stream.select("start", "x.piece", "pos", "x.loss_from", "x.loss_to", "seen")
    stream.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{folder}/stream")
    convs.select("conv_id", "leaf").join(lines.select("leaf", "starts", "seen"), "leaf").select("conv_id", "starts", "seen").write.parquet(f"{folder}/conversations")


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, formatted, loss (the text under the loss mask, unescaped), turns (role, text), read from the files."""
    stream, convs = spark.read.parquet(f"{folder}/stream"), spark.read.parquet(f"{folder}/conversations")
    wanted = convs.select("conv_id", F.posexplode("starts").alias("k", "start"))
    rows = wanted.join(stream.select("start", "piece", "loss_from", "loss_to"), "start")
    part = F.struct("k", "piece", F.substring("piece", F.col("loss_from").cast("int") + 1, (F.col("loss_to") - F.col("loss_from")).cast("int")).alias("learned"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = whole.select("conv_id", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"), F.array_join(F.transform("parts", lambda x: unescaped(x["learned"])), "").alias("loss"))
    turn = lambda s: F.struct(
        unescaped_role(F.substring_index(s, "\n", 1)).alias("role"), unescaped(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s))).alias("text")
    )
    bodies = F.transform(F.filter(F.split("formatted", END, -1), lambda s: s != ""), lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s)))
    return text.select("conv_id", "formatted", "loss", F.transform(bodies, turn).alias("turns"))


def formatted_chats(conversations: DataFrame, folder: str) -> DataFrame:
    """Write the prefix tree of (conv_id, turn, role, text) to a new folder and read every conversation back from it."""
    path = f"{folder}/chat-{uuid.uuid4().hex}"
    write_tree(conversations, path)
    return read_conversations(conversations.sparkSession, path)
