"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the reach of every pointer: after k rounds a
message knows the ancestor 2^k steps up, the sum of scores on the way, and its depth, so a thread of n turns takes log2(n) rounds.
Leaves are branches; they are ranked by mean score, and the chosen ones are read back to their root through the stored rounds.
Each chosen path becomes one formatted conversation with a loss mask over the assistant's texts.

Template, per turn:  <turn ROLE>TEXT</turn> and a line feed.  Backslashes in role and text become \\b and `<` becomes
\\l (and `>` in a role \\g), so no text can hold a mark; undoing is exact.  The mask lists (turn, start, length) of the texts to learn, in
code points within the turn's block.

Built-in functions only.  Defined cases: a null text or role is empty; a null conversation id is one conversation; a message whose
parent is missing or null starts a tree; messages in a circle have no root and are left out, as are messages without an id; of rows with the same conversation and id the
first by parent, role and text is the message; ties between branches go to the lower leaf id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.llm.common import store, text_of

OPEN, SHUT = "<turn ", "</turn>\n"
LEARN = "assistant"
MESSAGES = "conv_id long, id long, parent long, role string, text string, score double"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\g"), F.lit(">")))


def _same(a: DataFrame, b: DataFrame, left: str, right: str):
    """Join condition within a conversation; a null conversation equals itself."""
    return a["conv_id"].eqNullSafe(b["other_conv"]) & (a[left] == b[right])


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, path, step, id) of the `branches` best root-to-leaf paths per conversation: `path` is the leaf's id, `step` counts from the root."""
    ids = messages.select("conv_id", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = ids.select(F.col("conv_id").alias("other_conv"), F.col("id").alias("other_id"))
    # an answer to nothing starts a tree
    linked = ids.join(known, _same(ids, known, "parent", "other_id"), "left").select("conv_id", "id", F.col("other_id").alias("up"), "score", F.when(F.col("other_id").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("score").alias("total"), F.col("other_id").isNull().alias("rooted"))
    state = store(linked, "chat-up")
    n, reach = state.count(), 1
    climbing, done = state.filter("up is not null"), state.filter("up is null")
    jumps = [climbing]
    # a thread is at most as long as the table; what still climbs after that runs in a circle
    while reach < n and not climbing.isEmpty():
        every = done.unionByName(climbing)
        far = every.select(F.col("conv_id").alias("other_conv"), F.col("id").alias("other_id"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"), F.col("rooted").alias("rooted2"))
        # only messages that have not reached their root are joined
        joined = climbing.join(far, _same(climbing, far, "up", "other_id")).select(
            "conv_id", "id", F.col("up2").alias("up"), "score", (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"), F.col("rooted2").alias("rooted"))
        state = store(joined, "chat-up")
        climbing, done = state.filter("up is not null"), done.unionByName(state.filter("up is null"))
        jumps.append(climbing)
        reach *= 2
    done = done.filter("rooted")
    answered = jumps[0].select(F.col("conv_id").alias("other_conv"), F.col("up").alias("other_id")).distinct()
    leaves = done.join(answered, _same(done, answered, "id", "other_id"), "left_anti")
    salted = leaves.withColumn("mean", F.col("total") / (F.col("steps") + 1)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("mean"), F.asc("id")]
    # in two rounds: a conversation may hold very many branches
    kept = salted.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "salt").orderBy(*order))).filter(F.col("n") <= branches)
    chosen = kept.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(*order))).filter(F.col("n") <= branches)
    walk = chosen.select("conv_id", F.col("id").alias("path"), "id", F.col("steps").alias("step"))
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select(F.col("conv_id").alias("other_conv"), F.col("id").alias("other_id"), "up")
        above = walk.join(jump, _same(walk, jump, "id", "other_id")).select("conv_id", "path", F.col("up").alias("id"), (F.col("step") - F.lit(1 << k)).alias("step"))
        walk = store(walk.unionByName(above), "chat-walk")
    return walk


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: conv_id, path, formatted, and the loss mask array<struct<turn, start, length>>."""
    body = messages.select(F.col("conv_id").alias("other_conv"), F.col("id").alias("other_id"), text_of("role").alias("role"), text_of("text").alias("text"))
    turns = paths.join(body, _same(paths, body, "id", "other_id"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">"))
    inner = escape(F.col("text"))
    turns = turns.select("conv_id", "path", F.struct("step", F.concat(head, inner, F.lit(SHUT)).alias("block"), F.length(head).alias("start"), F.length(inner).alias("length"), (F.col("role") == LEARN).alias("learn")).alias("turn"))
    # a path is one conversation, and so one string in the result
    grouped = turns.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    marked = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["learn"].alias("learn")))
    mask = F.transform(F.filter(marked, lambda m: m["learn"]), lambda m: F.struct(m["turn"].alias("turn"), m["start"].alias("start"), m["length"].alias("length")))
    return grouped.select("conv_id", "path", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"), mask.alias("loss"))


def read_turns(formatted: str | Column) -> Column:
    """Turns of a formatted conversation: array<struct<role, text>>."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    # no `<` is left inside roles and texts, so the opening mark cuts exactly
    blocks = F.filter(F.split(c, OPEN), lambda b, i: i > 0)
    end = -len(SHUT)
    return F.transform(blocks, lambda b: F.struct(unescape_role(F.substring_index(b, ">", 1)).alias("role"),
                                                   unescape(F.substring(b, F.instr(b, ">") + 1, F.length(b) + end - F.instr(b, ">"))).alias("text")))


def read_loss(formatted: str | Column, loss: str | Column) -> Column:
    """All text under the mask, unescaped, in order."""
    c, m = (F.col(x) if isinstance(x, str) else x for x in (formatted, loss))
    blocks = F.split(c, OPEN)
    # the split takes the opening mark away, and the first piece is empty
    return F.array_join(F.transform(m, lambda s: unescape(F.substring(F.get(blocks, s["turn"] + 1), s["start"] + 1 - len(OPEN), s["length"]))), "")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it.  Rows with equal turns follow each other by role and text."""
    # a conversation is one string in the result, so its turns fit a task
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("id", place)
    return numbered.select("conv_id", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Best branches of every conversation, formatted."""
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    messages = messages.filter(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(first).select("conv_id", "id", "m.*")
    return format_paths(messages, best_paths(messages, branches))


def digests(done: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations."""
    read = done.select("conv_id", "formatted", read_turns("formatted").alias("turns"), read_loss("formatted", "loss").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def added(spark) -> DataFrame:
    """A conversation whose texts look like marks of templates."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
