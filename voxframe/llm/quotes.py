"""Chat formatting by quotation linking, in DataFrame operations alone.

Messages are cut into lines, a line's quote level is its count of leading `>`. Runs of quoted lines of one level
are passages. Passages and the unquoted parts of messages are normalised and hashed; a passage links its message
to the first message of the conversation that has the same words unquoted. Each message then has a parent, and
its place in a walk through the tree of replies orders a conversation, without the quotes. Trees are walked by
doubling: a row for each step, whose end and length are joined with the next one's until all reach the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import removed, staged

#: Rounds of doubling: walks of 2 ** ROUNDS steps.
ROUNDS = 40

# How quotes look.
MARKS = r"^(?:[ \\t]*>)+"
ATTRIBUTION = r"(?i)^\\s*on\\s.{1,200}\\swrote:\\s*$"


def _normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, id, lines (level, body), reply: the message's own text."""
    m = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = m.withColumn("id", F.md5(F.encode(F.concat_ws("|", F.coalesce("role", F.lit("")), "text"), "UTF-8")))
    parts = f"transform(split(text, '\\n', -1), l -> struct(length(regexp_replace(regexp_extract(l, '{MARKS}', 0), '[^>]', '')) AS level, regexp_replace(l, '{MARKS}', '') AS body))"
    m = m.withColumn("lines", F.expr(parts))
    quoted = F.expr("exists(lines, x -> x.level > 0)")
    own = F.expr(f"array_join(transform(filter(lines, x -> x.level = 0 AND NOT x.body RLIKE '{ATTRIBUTION}'), x -> x.body), '\\n')")
    m = m.withColumn("own", own)
    return m.withColumn("reply", F.when(quoted, F.expr("trim(BOTH ' \\n\\t\\r' FROM own)")).otherwise(F.col("text"))).drop("own", "text")


def links(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, id, parent) of messages that quote an earlier one, and (conv_id, turn, id, n_passages) of all that quote."""
    who = ["conv_id", "turn", "id"]
    some = messages.where("exists(lines, x -> x.level > 0)").select(*who, "lines").distinct()
    rows = some.select(*who, F.posexplode("lines").alias("at", "line")).select(*who, "at", "line.level", "line.body")
    order = Window.partitionBy(*who).orderBy("at")  # the lines of one message
    rows = rows.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order)).where("level > 0")
    runs = rows.groupBy(*who, "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("body"))
    counted = runs.groupBy(*who).agg(F.count(F.lit(1)).alias("n_passages"))
    asked = runs.select(*who, "level", F.expr(_normal("body")).alias("words")).unionByName(rows.select(*who, "level", F.expr(_normal("body")).alias("words")))
    asked = asked.where(F.length("words") > 0).select(*who, "level", F.length("words").alias("size"), F.md5(F.encode("words", "UTF-8")).alias("key"))
    talks = some.select("conv_id").distinct()
    known = messages.join(talks, "conv_id", "left_semi")
    pieces = F.expr("filter(transform(lines, x -> CASE WHEN x.level = 0 THEN x.body END), b -> b IS NOT NULL)")
    said = known.select("conv_id", "turn", F.explode(F.array_union(pieces, F.array("reply"))).alias("body"))
    said = said.select("conv_id", "turn", F.expr(_normal("body")).alias("words")).where(F.length("words") > 0)
    first = said.groupBy("conv_id", F.md5(F.encode("words", "UTF-8")).alias("key")).agg(F.min("turn").alias("origin"))
    met = asked.join(first, ["conv_id", "key"]).where("origin < turn")
    best = met.groupBy(*who).agg(F.max(F.struct((-F.col("level")).alias("near"), "size", "origin")).alias("best"))
    return best.select(*who, F.col("best.origin").alias("parent")), counted


def _doubled(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, end, length of the way from each node to the last one it leads to; steps: keys, next_<key>, length (null next_: the end).

    Constant storage a row: each round joins a row's end with that node's own row.
    """
    ends = [f"next_{k}" for k in keys]
    now = staged(steps, "steps")
    for _ in range(ROUNDS):
        ahead = now.select(*[F.col(k).alias(e) for k, e in zip(keys, ends, strict=True)], *[F.col(e).alias("far_" + e) for e in ends], F.col("length").alias("more"))
        met = now.join(ahead, ends, "left")
        on = F.col("far_" + ends[-1]).isNotNull()
        new = met.select(*keys, *[F.when(on, F.col("far_" + e)).otherwise(F.col(e)).alias(e) for e in ends], (F.col("length") + F.when(on, F.col("more")).otherwise(0)).alias("length"), on.alias("moved"))
        new = staged(new, "steps")
        more = new.where("moved").limit(1).count()
        removed(steps.sparkSession, now)
        now = new.drop("moved")
        if not more:
            return now
    raise RuntimeError("reply chains did not settle")


def trees(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, position) for each turn that has a parent.

    depth counts the steps to the root. position is the turn's place in its tree when every turn comes before
    its replies, and these follow one another by turn: the Euler tour of the tree (a step down to each turn
    and one up from it), of which a way's length counts the steps down.
    """
    up = staged(parents.groupBy("conv_id", "turn").agg(F.min("parent").alias("parent")), "parents")
    tops = _doubled(up.select("conv_id", "turn", F.col("conv_id").alias("next_conv_id"), F.col("parent").alias("next_turn"), F.lit(1).cast("long").alias("length")), ["conv_id", "turn"])
    tops = tops.select("conv_id", "turn", F.col("next_turn").alias("root_turn"), F.col("length").alias("depth"))
    siblings = Window.partitionBy("conv_id", "parent").orderBy("turn")  # sorted by Spark, which spills
    known = up.withColumn("after", F.lead("turn").over(siblings))
    roots = up.select("conv_id", F.col("parent").alias("turn")).distinct().join(up.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    nodes = known.unionByName(roots, allowMissingColumns=True)
    first = up.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = nodes.join(first, ["conv_id", "turn"], "left")
    step = lambda down, turn, to_down, length: F.struct(F.lit(down).alias("down"), F.col("conv_id").alias("next_conv_id"), turn.alias("next_turn"), to_down.alias("next_down"), F.lit(length).cast("long").alias("length"))
    downward = step(True, F.coalesce("child", "turn"), F.col("child").isNotNull(), 1)
    upward = step(False, F.coalesce("after", "parent"), F.when(F.coalesce("after", "parent").isNotNull(), F.col("after").isNotNull()), 0)
    steps = nodes.select("conv_id", "turn", F.explode(F.array(downward, upward)).alias("s")).select("conv_id", "turn", "s.*")
    ways = _doubled(steps.select("conv_id", "turn", "down", "next_conv_id", "next_turn", "next_down", "length"), ["conv_id", "turn", "down"]).where("down").select("conv_id", "turn", "length")
    whole = ways.select("conv_id", F.col("turn").alias("root_turn"), F.col("length").alias("whole"))
    return tops.join(ways, ["conv_id", "turn"]).join(whole, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", "depth", (F.col("whole") - F.col("length")).alias("position"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, parent_turn, root_turn, depth, position, n_passages, content, formatted.

    parent_turn is the first earlier turn of the conversation that has unquoted what the message quotes at
    its outermost matched level (the longest match there, of equals the latest); null without one. Passages
    of any length link, one word too; those without a letter or digit do not. Rows sorted by conv_id,
    root_turn, position, turn give each conversation in reply order: root_turn is the message that a thread
    goes back to, position the place in it, depth how many replies lie between. content is the text without
    quoted lines and attributions ("On ... wrote:" of 200 characters at most; the text as it is if nothing
    is quoted); formatted puts the role before it. Null text is empty, a null role is "". Repeated rows each
    give a row; rows that share a turn share a place only if their text agrees or neither quotes. Messages
    with a null conv_id or turn link nothing.
    """
    m = _messages(conversations)
    found, counted = links(m)
    found = staged(found, "quotes")
    who = ["conv_id", "turn", "id"]
    out = m.join(counted, who, "left")
    if found.limit(1).count():
        out = out.join(found, who, "left").join(trees(found), ["conv_id", "turn"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("long") for c in ("parent", "root_turn", "depth", "position")})
    own = F.col("parent").isNull()
    return out.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.when(own, F.col("turn")).otherwise(F.col("root_turn")).alias("root_turn"),
        *[F.when(own, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in ("depth", "position")],
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.col("reply").alias("content"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("reply")).alias("formatted"))
