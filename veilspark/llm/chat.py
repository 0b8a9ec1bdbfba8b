"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the nodes of a tree: a node is a turn together with
all turns before it, named by a chained hash.  Every node is formatted and emitted once, in
depth-first order, with its place in the tree's token layout, the position ids of its tokens along
its own path, and the layout intervals of its ancestors, which are all that its tokens may attend to
besides themselves.  A token is a code point.

Distinct conversations are ranked by the names of their nodes, so those that share a node stand side
by side and (first rank that holds a node, depth) is the depth-first order.  Names are listed once
for a conversation and never once for a turn: sizes stay linear in the turns.  The layout offsets are
prefix sums in that order.  They are taken inside range partitions first and joined with the sums of
the partitions before, so a tree of any size (one first turn may start a third of all conversations)
never has to fit one task.  Joins on a node deal the conversations that hold it to as many tasks as a
shuffle has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

#: strings that mean something to this or other chat templates; never left whole inside a text
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|/?SYS>)|(\|)(>)"
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
TURN = r"(?s)<\|(.*?)\|>(.*?)<\|end\|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Breaks control strings with a backslash after their first character; backslashes are doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order; null roles and texts are empty.

    Rows of one conversation and turn number are ordered by role and text; a null turn number comes
    first; rows with a null conv_id are one conversation.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, names): a row for each conversation; names holds the node of each turn."""
    chain = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda s, t: _link(s, F.sha2(F.concat_ws("\x1f", s["last"], F.length(t["role"]), t["role"], t["text"]), 256)),
        lambda s: s["all"],
    )
    return turns_of(conversations).select("conv_id", F.size("turns").alias("n_turns"), "turns", chain.alias("names"))


def _link(state: Column, name: Column) -> Column:
    return F.struct(name.alias("last"), F.concat(state["all"], F.array(name)).alias("all"))


def _meet(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of rows with a table that has each key once; a key that many rows have is dealt by ``by`` to many tasks.

    The table's row is copied for the deals in which its key occurs, at most as many as a shuffle has tasks.
    """
    deals = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(by), F.lit(deals)))
    copies = dealt.select(key, "deal").distinct().join(table, key)
    return dealt.join(copies, [key, "deal"]).drop("deal")


def tree(chained: DataFrame, stages: Stages) -> DataFrame:
    """The emitted output: each distinct node once.

    tree (name of the first turn), node, parent (null at the root), depth, role, formatted (template
    text, escaped), text_start and text_end (where the escaped text stands in it), learned (whether
    it is under the loss mask), start and end (layout interval in the tree), position (position id of
    its first token) and attends (layout intervals of its ancestors, root first, neighbouring ones
    joined).
    """
    above = F.concat(F.array(F.lit(None).cast("string")), F.slice("names", 1, F.size("names") - 1))
    rows = chained.select(F.element_at("names", 1).alias("tree"), "names", "turns", above.alias("above"))
    rows = rows.select("tree", F.posexplode(F.arrays_zip("names", "above", "turns")).alias("depth", "x"))
    rows = rows.select("tree", "depth", F.col("x.names").alias("node"), F.col("x.above").alias("parent"), "x.turns.role", "x.turns.text")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("tree", "parent", "depth", "role", "text")])
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    nodes = nodes.select(
        "tree", "node", "parent", "depth", "role",
        F.concat(head, body, F.lit(END)).alias("formatted"),
        F.length(head).alias("text_start"),
        (F.length(head) + F.length(body)).alias("text_end"),
        (F.col("role") == LEARNED).alias("learned"),
    )
    nodes = stages.write(nodes, "nodes")
    distinct = chained.select(F.element_at("names", -1).alias("leaf"), "names").groupBy("leaf").agg(F.first("names").alias("names"))
    ranked = distinct.repartitionByRange("names").sortWithinPartitions("names").withColumn("rank", F.monotonically_increasing_id())
    ranked = stages.write(ranked, "ranked")
    owners = ranked.select("rank", F.explode("names").alias("node")).groupBy("node").agg(F.min("rank").alias("rank"))
    # The layout needs sizes only; texts are joined to it once at the end.
    sizes = nodes.select("tree", "node", "depth", F.length("formatted").cast("long").alias("size")).join(owners, "node")
    ordered = stages.write(sizes.repartitionByRange("rank", "depth").withColumn("part", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("tree", "part").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = stages.write(sums.select("tree", "part", before.alias("before")), "before")
    here = F.sum("size").over(Window.partitionBy("part", "tree").orderBy("rank", "depth"))
    placed = ordered.withColumn("end", here).join(before, ["tree", "part"]).withColumn("end", F.col("end") + F.col("before"))
    placed = stages.write(placed.select("node", F.col("rank").alias("owner"), (F.col("end") - F.col("size")).alias("start"), "end"), "placed")
    # Walked along whole conversations; a node is given out by the first conversation that holds it.
    steps = ranked.select("leaf", "rank", F.posexplode("names").alias("k", "node"))
    step = F.struct("k", "node", "start", "end", (F.col("rank") == F.col("owner")).alias("own"))
    walked = _meet(steps, placed, "node", "leaf").groupBy("leaf").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    seen = walked.select(F.explode(_prefix_runs("steps")).alias("x")).select("x.*")
    position = F.aggregate("attends", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return stages.write(nodes.join(seen.withColumn("position", position), "node"), "tree")


def _prefix_runs(steps: str) -> Column:
    """For each own step of a path the layout intervals of the steps before it, neighbours joined."""
    run = "array<struct<start:bigint,end:bigint>>"

    def add(state, x):
        runs, last = state["runs"], F.try_element_at(state["runs"], F.lit(-1))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        more = F.concat(runs, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        runs_after = F.when(F.coalesce(last["end"] == x["start"], F.lit(False)), longer).otherwise(more)
        given = F.concat(state["out"], F.array(F.struct(x["node"].alias("node"), x["start"].alias("start"), x["end"].alias("end"), runs.alias("attends"))))
        return F.struct(runs_after.alias("runs"), F.when(x["own"], given).otherwise(state["out"]).alias("out"))

    start = F.struct(F.array().cast(run).alias("runs"), F.array().cast(f"array<struct<node:string,start:bigint,end:bigint,attends:{run}>>").alias("out"))
    return F.aggregate(steps, start, add, lambda state: state["out"])


def format_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): the output of ``tree`` and (conv_id, n_turns, node, names), the last node of each conversation and all its nodes.

    Columns other than conv_id, turn, role and text are not read.  Equal conversations share all
    nodes.  An empty table gives two empty tables.  Texts and conversations of any length are
    formatted whole; the turns of one conversation must fit a task.
    """
    stages = Stages(conversations.sparkSession, "chat")
    chained = stages.write(chains(conversations.select("conv_id", "turn", "role", "text")), "chains")
    leaves = stages.write(chained.select("conv_id", "n_turns", F.element_at("names", -1).alias("node"), "names"), "leaves")
    nodes = tree(chained, stages)
    stages.drop_all_but("leaves", "tree")
    return nodes, leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, learned): each conversation from the emitted nodes it attends to.

    formatted joins the segments on the leaf's path that lie in the layout intervals it may see; learned joins
    what stands under the loss mask, still escaped, in order.
    """
    paths = leaves.groupBy("node").agg(F.first("names").alias("names"))
    steps = paths.select(F.col("node").alias("leaf"), F.posexplode("names").alias("k", "node"))
    segments = nodes.select("node", F.struct("start", "end", "formatted", "text_start", "text_end", "learned").alias("segment"))
    parts = _meet(steps, segments, "node", "leaf").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("k", "segment"))).alias("parts"))
    visible = F.concat("attends", F.array(F.struct("start", "end"))).alias("visible")
    parts = parts.join(nodes.select(F.col("node").alias("leaf"), visible), "leaf")

    def seen(p):
        return F.exists("visible", lambda v: (v["start"] <= p["segment"]["start"]) & (p["segment"]["end"] <= v["end"]))

    def masked(p):
        s = p["segment"]
        return F.when(s["learned"], F.substring(s["formatted"], s["text_start"] + 1, s["text_end"] - s["text_start"])).otherwise("")

    parts = parts.select(F.col("leaf").alias("node"), F.filter("parts", seen).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: p["segment"]["formatted"]), "")
    texts = parts.select("node", formatted.alias("formatted"), F.array_join(F.transform("parts", masked), "").alias("learned"))
    return _meet(leaves.drop("names"), texts, "node", "conv_id").select("conv_id", "n_turns", "formatted", "learned")


def digest(back: DataFrame) -> DataFrame:
    """Digest columns of conversations read back: turns are parsed out of the formatted text."""
    roles, texts = (F.transform(F.regexp_extract_all("formatted", F.lit(TURN), k), unescape) for k in (1, 2))
    said = F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    learned = unescape(F.col("learned"))
    return back.select(
        "conv_id",
        F.size(roles).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
