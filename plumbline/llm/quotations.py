"""Operator 10: conversations in reply order, linked by their quotations.

Each line has a quote level (its leading ``>`` marks). The text of one level is cut into passages
(sentences, so that lines may have been wrapped anew), each passage is normalised and hashed, and
the hashes are joined to the earliest message of the conversation that wrote the passage itself.
The message most of a reply's first-level quotation comes from is its parent. Built-in DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch

#: Lines that announce a quotation and belong to it.
ATTRIBUTION = r"^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:\s*$"


def parsed_lines(text: Column) -> Column:
    """Array of (level, content) for the lines of a text; empty for NULL."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^([> \t]*>)", 1)
        rest = F.substring(line, F.length(marks) + 1, F.length(line))
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"),
                        F.when(marks == "", line).otherwise(F.regexp_replace(rest, r"^ ", "")).alias("content"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), parse)


def own_text(lines: Column) -> Column:
    """What the message says itself, without quoted lines and their announcements."""
    kept = F.filter(lines, lambda p: (p["level"] == 0) & ~p["content"].rlike(ATTRIBUTION))
    return F.array_join(F.transform(kept, lambda p: p["content"]), "\n")


def passages(text: Column) -> Column:
    """Normalised sentences of a text: lower case, single blanks, none empty."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?]) "), lambda s: s != "")


def _hashed(df: DataFrame, passage: str) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64(F.lit(1), passage), "h2": F.xxhash64(F.lit(2), passage),
                           "chars": F.length(passage)}).drop(passage)


def link_quotations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Messages ``(conv, turn, quoted)`` with passages quoted, and links ``(conv, turn, level, origin, chars)``.

    ``origin`` is the earliest turn of the same conversation, before ``turn``, that has the passage
    as its own words.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).cast("string").alias("text")
                     ).filter("turn IS NOT NULL").withColumn("lines", parsed_lines(F.col("text")))
    own = _hashed(rows.select("conv", "turn", F.explode(F.array_distinct(passages(own_text(F.col("lines"))))).alias("passage")),
                  "passage")
    origin = own.groupBy("conv", "h1", "h2").agg(F.min("turn").alias("origin"))
    levels = F.array_distinct(F.transform(F.filter("lines", lambda p: p["level"] > 0), lambda p: p["level"]))
    leveled = rows.select("conv", "turn", "lines", F.explode(levels).alias("level"))
    at_level = F.array_join(F.transform(F.expr("filter(lines, p -> p.level = level)"), lambda p: p["content"]), "\n")
    quoted = _hashed(leveled.select("conv", "turn", "level", F.explode(F.array_distinct(passages(at_level))).alias("passage")),
                     "passage").distinct()
    quoted = scratch(quoted, "quoted")
    match = quoted.conv.eqNullSafe(origin.conv) & (quoted.h1 == origin.h1) & (quoted.h2 == origin.h2)
    links = quoted.join(origin, match & (origin.origin < quoted.turn)).groupBy(
        quoted.conv, "turn", "level", "origin").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("passages"))
    messages = rows.select("conv", "turn").distinct()
    counts = quoted.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("quoted"))
    on = messages.conv.eqNullSafe(counts.conv) & (messages.turn == counts.turn)
    return messages.join(counts, on, "left").select(
        messages.conv, messages.turn, F.coalesce("quoted", F.lit(0)).alias("quoted")), scratch(links, "links")


def reply_tree(messages: DataFrame, links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``conv, turn, quoted, linked, parent, root, depth`` of every message.

    The parent is the origin of most first-level characters, the later one of equals. Root and
    depth come from pointer doubling: each round joins every message with the ancestor it knows,
    so a chain of n replies takes about log2(n) rounds, each written to shared storage.
    """
    first = links.filter("level = 1").groupBy("conv", "turn").agg(
        F.max(F.struct("chars", "origin")).getField("origin").alias("parent"))
    total = links.groupBy("conv", "turn").agg(F.sum("passages").alias("linked"))
    same = lambda a, b: a.conv.eqNullSafe(b.conv) & (a.turn == b.turn)
    tree = messages.join(first, same(messages, first), "left").select(messages.conv, messages.turn, "quoted", "parent")
    tree = scratch(tree.join(total, same(tree, total), "left").select(
        tree.conv, tree.turn, "quoted", F.coalesce("linked", F.lit(0)).alias("linked"), "parent"), "parents")
    state = scratch(tree.select("conv", "turn", F.coalesce("parent", "turn").alias("root"),
                                F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "ancestors")
    before = None
    for _ in range(max_rounds):
        after = state.agg(F.sum("depth")).first()[0]
        if after == before:
            break
        before = after
        up = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        state = scratch(state.join(up, state.conv.eqNullSafe(up.c) & (state.root == up.t)).select(
            "conv", "turn", F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth")), "ancestors")
    return tree.join(state, same(tree, state)).select(tree["*"], "root", "depth")


def reply_ordered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Every message without its quotations, with the keys that order a conversation by replies.

    Columns: conv_id, turn, role, text, parent_turn, root_turn, depth, quoted_passages,
    linked_passages. Order by ``conv_id, root_turn, depth, turn``: each reply comes after what
    it answers. A message that quotes nothing known is its own root at depth 0. NULL
    conversations are one conversation; messages with a NULL turn keep their text but have neither
    parent nor root. A NULL text stays NULL and neither quotes nor is quoted; a text of quotations
    only becomes empty. Rows that repeat a conversation and turn count as one message in the order
    and each come back. Further columns are ignored.
    """
    messages, links = link_quotations(df, conv_col, turn_col, text_col)
    tree = reply_tree(messages, links)
    base = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                     F.when(F.col(text_col).isNotNull(), own_text(parsed_lines(F.col(text_col).cast("string")))).alias("text"))
    on = base.conv_id.eqNullSafe(tree.conv) & (base.turn == tree.turn)
    return base.join(tree, on, "left").select(
        "conv_id", base.turn, "role", "text", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted_passages"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked_passages"))


def as_mail(df: DataFrame) -> DataFrame:
    """A conversations table as mail: each turn quotes the turn before it, and that one's quotation.

    Derived input for tables whose turns hold no quotation. Where a turn is repeated, the least of
    its texts is quoted.
    """
    given = df.filter("turn IS NOT NULL AND text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("quoted"))
    one, two = (given.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"),
                             F.col("quoted").alias(f"q{k}")) for k in (1, 2))
    joined = df.join(one, df.conv_id.eqNullSafe(one.c1) & (df.turn == one.t1), "left").join(
        two, df.conv_id.eqNullSafe(two.c2) & (df.turn == two.t2), "left")
    marked = lambda name, mark: F.regexp_replace(F.col(name), "(?m)^", mark)
    return joined.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), F.concat_ws(
        "\n", marked("q2", "> > "), marked("q1", "> "), "text")).alias("text"))
