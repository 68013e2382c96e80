"""Chat formatting from reply trees; DataFrame functions only.

Messages point to the message they answer.  Iterative self-joins double the reach of every message's pointer towards its
root, so a tree of depth d takes log2(d) joins, each of the messages that have not met their root yet; the sums they carry give each leaf the mean
score of its branch.  The best leaves of each tree are chosen, the same doubled pointers enumerate their root-to-leaf
paths, and every path is formatted as one conversation with a loss mask over the assistant's words.

Template: an assistant turn is <s>text</s>, any other turn is [INST] role, a line feed, text and [/INST].  Inside
texts and roles a backslash follows each backslash, < and [, so no control string can occur there; a line feed in a role
becomes <n.  read_back() undoes this.

Defined results: null text and null role are empty; a null tree id is a tree of its own; a message whose parent is
missing, itself or null is a root; messages on a cycle of parents have no root and belong to no conversation, nor do messages
without an id; messages that share tree and id count once, the smallest by parent, role, text and score (null first); ties in
the score of branches go to the smaller leaf; turns that repeat a row are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm import _common as c

ASSISTANT = "assistant"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def from_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees of one branch: each row answers the row before it, by turn, role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """Each message of each tree once."""
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return c.materialise(messages.where("node is not null").groupBy("tree", "node").agg(first).select("tree", "node", "m.*"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.tree").eqNullSafe(F.col(f"{right}.tree"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, back, branch): the nodes of the best branches; back counts from the leaf, branch from 1."""
    ids = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    has = ids.select("tree", "node")
    joined = ids.alias("x").join(has.alias("y"), _same("x", "y") & (F.col("x.parent") == F.col("y.node")) & (F.col("x.parent") != F.col("x.node")), "left")
    first = c.materialise(joined.select("x.tree", "x.node", F.col("y.node").alias("to"), F.col("x.score").alias("sum"), F.lit(1).cast("bigint").alias("n")))
    parents = first.where("to is not null").select("tree", F.col("to").alias("node")).distinct()
    leaves = first.alias("x").join(parents.alias("y"), _same("x", "y") & (F.col("x.node") == F.col("y.node")), "left_anti").select("tree", F.col("node").alias("leaf"))
    longest = first.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    # live[k]: the messages with 2**k others on the way to their root, and the last of these; done: those that have met their root
    live, done = [first.where("to is not null")], first.where("to is null")
    for _ in range(int(longest - 1).bit_length()):
        if live[-1].isEmpty():
            break
        x, y = live[-1].alias("x"), live[-1].unionByName(done).alias("y")
        met = x.join(y, _same("x", "y") & (F.col("x.to") == F.col("y.node")))
        far = c.materialise(met.select("x.tree", "x.node", F.col("y.to").alias("to"), (F.col("x.sum") + F.col("y.sum")).alias("sum"), (F.col("x.n") + F.col("y.n")).alias("n")))
        live.append(far.where("to is not null"))
        done = done.unionByName(far.where("to is null"))
    rooted = done.alias("x").join(leaves.alias("y"), _same("x", "y") & (F.col("x.node") == F.col("y.leaf"))).select("x.tree", "y.leaf", (F.col("sum") / F.col("n")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    path = c.materialise(rooted.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("back"), "branch"))
    for k, hop in enumerate(live):
        step = path.alias("x").join(hop.alias("y"), _same("x", "y") & (F.col("x.node") == F.col("y.node"))).select("x.tree", "x.leaf", F.col("y.to").alias("node"), (F.col("x.back") + 2**k).alias("back"), "x.branch")
        path = c.materialise(path.union(step))
    return path


def format_trees(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """(tree, branch, formatted, loss_mask): one row for each chosen path; loss_mask is an array of (start, finish).

    unique: no message comes twice and each has an id, as from_turns() sees to.
    """
    if not unique:
        messages = once(messages)
    paths = best_paths(messages, branches)
    rows = paths.alias("x").join(messages.alias("y"), _same("x", "y") & (F.col("x.node") == F.col("y.node"))).select("x.tree", "branch", "back", "role", "text")
    role, text = F.coalesce("role", F.lit("")), _escaped(F.coalesce("text", F.lit("")))
    mine = role == ASSISTANT
    other = F.concat(F.lit("[INST] "), F.replace(_escaped(role), F.lit("\n"), F.lit("<n")), F.lit("\n"), text, F.lit("[/INST]"))
    rows = rows.select("tree", "branch", "back", mine.alias("mine"), F.when(mine, F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(other).alias("piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("tree", "branch").orderBy(F.desc("back")))
    rows = rows.withColumn("upto", upto.cast("bigint"))
    start, finish = F.col("upto") - F.length("piece") + len("<s>"), F.col("upto") - len("</s>")
    turn = F.struct((-F.col("back")).alias("at"), F.col("piece"), F.when(F.col("mine"), F.struct(start.alias("start"), finish.alias("finish"))).alias("loss"))
    out = rows.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces, losses = F.transform("turns", lambda t: t["piece"]), F.transform("turns", lambda t: t["loss"])
    return out.select("tree", "branch", F.array_join(pieces, "").alias("formatted"), F.filter(losses, lambda x: x.isNotNull()).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    ended = F.split(formatted, r"</s>|\[/INST\]", -1)
    body = lambda x: F.substring(x, 8, F.length(x))
    named = lambda x: F.substring_index(body(x), "\n", 1)

    def turn(x: Column) -> Column:
        mine = F.startswith(x, F.lit("<s>"))
        role = F.when(mine, F.lit(ASSISTANT)).otherwise(_plain(F.replace(named(x), F.lit("<n"), F.lit("\n"))))
        text = F.when(mine, F.substring(x, 4, F.length(x))).otherwise(F.substring(body(x), F.length(named(x)) + 2, F.length(x)))
        return F.struct(role.alias("role"), _plain(text).alias("text"))

    return F.transform(F.slice(ended, 1, F.size(ended) - 1), turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: _plain(F.substring(formatted, (s["start"] + 1).cast("int"), (s["finish"] - s["start"]).cast("int")))), "")
