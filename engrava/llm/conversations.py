"""Conversations out of message rows: parent pointers, pointer jumping to the roots, and the sessions to drop.

Rows that follow each other in one range partition are contracted to a segment first, so pointers are jumped over the heads of
segments only: as many rows as there are sessions and partitions, and none but those of sessions cut by a partition are open.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions.text import is_blank
from engrava.operators import delivery
from engrava.session import materialise, shuffle_partitions


def turns(messages: DataFrame) -> DataFrame:
    """``id``, ``sid``, ``sec`` (infinite where missing) and plain ``role`` of every row with a session; ``role`` is null where the row takes no part.

    Rows of system, tool and unknown roles and blank rows take no part in the conversation, but their session still counts.
    """
    sid = delivery.session_name(F.col("session_id"))
    role = delivery.plain_role(F.col("role"))
    speaks = role.isin("user", "assistant") & ~is_blank(F.col("content"))
    return messages.where(sid.isNotNull()).select(
        "id", sid.alias("sid"), F.coalesce(delivery.seconds(F.col("timestamp")), F.lit(float("inf"))).alias("sec"), F.when(speaks, role).alias("role")
    )


def kept_turns(messages: DataFrame) -> DataFrame:
    """``turns`` of the rows that deduplication leaves; the texts are not carried through its join."""
    gone = delivery.redelivered(messages).withColumnRenamed("id", "__gone")
    all_turns = turns(messages)
    return all_turns.join(gone, all_turns["id"] == gone["__gone"], "left_anti")


def link(spoken: DataFrame) -> DataFrame:
    """The rows of ``spoken`` (``id``, ``sid``, ``sec``, ``role``) in order, cut into segments: ``part``, ``place`` in the segment and the row ``before`` in it (``id``, ``role``).

    The order is made by range partitions over (session, time, id), so a session with a third of all rows is spread over many
    tasks. A segment is what a session has in one range partition.
    """
    ranged = spoken.repartitionByRange(shuffle_partitions(spoken.sparkSession), "sid", "sec", "id").withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "sid").orderBy("sec", "id")
    return materialise(ranged.select("id", "sid", "role", "part", (F.row_number().over(here) - 1).alias("place"), F.lag(F.struct("id", "role")).over(here).alias("before")), "links")


def segments(linked: DataFrame) -> DataFrame:
    """One row for each segment: its head, its counts by role, and the parent pointer of the head: the last row of the session's segment before it.

    Result: ``part``, ``sid``, ``head``, ``head_role``, ``n``, ``n_user``, ``n_assistant``, ``n_answered``, ``above`` (head of
    the segment before, null where there is none), ``step`` (rows of that segment), ``parent``, ``parent_role``, ``n_segments``.
    """
    row = F.struct("place", "id", "role")
    answers = (F.col("role") == "assistant") & (F.col("before.role") == "user")
    cut = linked.groupBy("part", "sid").agg(
        F.min(row).alias("first"), F.max(row).alias("last"), F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(answers).alias("n_answered")
    )
    # a session has at most one row here for each range partition
    order = Window.partitionBy("sid").orderBy("part")
    told = cut.withColumns({"up": F.lag(F.struct("first", "last", "n")).over(order), "n_segments": F.count("*").over(Window.partitionBy("sid"))})
    head_answers = (F.col("first.role") == "assistant") & (F.col("up.last.role") == "user")
    return materialise(
        told.select(
            "part", "sid", F.col("first.id").alias("head"), F.col("first.role").alias("head_role"), "n", "n_user", "n_assistant", (F.col("n_answered") + F.coalesce(head_answers, F.lit(False)).cast("bigint")).alias("n_answered"),
            F.col("up.first.id").alias("above"), F.col("up.n").alias("step"), F.col("up.last.id").alias("parent"), F.col("up.last.role").alias("parent_role"), "n_segments",
        ),
        "segments",
    )


def rooted(cut: DataFrame) -> DataFrame:
    """The segments with the ``root`` of their conversation and the rows ``above_rows`` between it and their head, by pointer jumping over heads only; segments on a cycle or below a missing row are left out."""
    long = cut.where("n_segments > 1")
    jumped = resolve(long.select(F.col("head").alias("id"), F.col("above").alias("parent"), "step")).where("state = 'rooted'").select(F.col("id").alias("head"), "root", F.col("depth").alias("above_rows"))
    whole = cut.where("n_segments = 1").select("*", F.col("head").alias("root"), F.lit(0).cast("bigint").alias("above_rows"))
    return whole.unionByName(long.join(jumped, "head").select(*whole.columns))


def resolve(nodes: DataFrame) -> DataFrame:
    """Pointer jumping: the root of every node of ``nodes`` (unique ``id``, nullable ``parent``, ``step`` to the parent or 1), in log2(longest path) joins.

    Result: ``id``, ``root``, ``depth`` (steps below the root) and ``state``: ``rooted``; ``orphan`` (hangs on a parent that is
    not in the table; the topmost node present is the root); ``cycle`` (``root`` and ``depth`` null). Each round joins only the
    nodes that have not met a root, against the pointers of all; each round's pointers are written to the shared folder.
    """
    step = F.col("step") if "step" in nodes.columns else F.lit(1)
    nodes = nodes.select("id", "parent", step.cast("bigint").alias("step"))
    nodes = nodes.join(nodes.select(F.col("id").alias("known")), F.col("parent") == F.col("known"), "left")
    missing = F.col("parent").isNotNull() & F.col("known").isNull()
    top = F.col("parent").isNull() | missing
    start = nodes.select("id", F.when(top, F.col("id")).otherwise(F.col("parent")).alias("ptr"), F.when(top, F.lit(0).cast("bigint")).otherwise(F.col("step")).alias("depth"), top.alias("done"), missing.alias("orphan"))
    state = materialise(start, "jump")
    n_open = state.where("NOT done").count()
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    settled = []
    while n_open and len(settled) < rounds:
        to = state
        for s in settled:
            to = to.unionByName(s)
        there = to.select(F.col("id").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("depth").alias("t_depth"), F.col("done").alias("t_done"), F.col("orphan").alias("t_orphan"))
        jumped = state.where("NOT done").join(there, "ptr").select(
            "id", F.col("t_ptr").alias("ptr"), (F.col("depth") + F.col("t_depth")).alias("depth"), F.col("t_done").alias("done"), F.col("t_orphan").alias("orphan")
        )
        settled.append(state.where("done"))
        state = materialise(jumped, "jump")
        n_open = state.where("NOT done").count()
    out = state
    for s in settled:
        out = out.unionByName(s)
    return out.select(
        "id",
        F.when(F.col("done"), F.col("ptr")).alias("root"),
        F.when(F.col("done"), F.col("depth")).alias("depth"),
        F.when(~F.col("done"), "cycle").when(F.col("orphan"), "orphan").otherwise("rooted").alias("state"),
    )


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of the rooted trees in ``nodes`` (``id``, ``parent``): ``leaf``, ``position`` from 0, ``id``.

    Chains without branches are jumped as one segment; only branchings are walked level by level. Nodes on or below a cycle
    and below a missing parent have no path.
    """
    spark = nodes.sparkSession
    nodes = materialise(nodes.select("id", "parent"), "nodes")
    whole = resolve(nodes).where("state = 'rooted'").select("id", "depth")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    branching = children.where("n_children > 1").select(F.col("parent").alias("fork"))
    cut = nodes.join(branching, nodes["parent"] == branching["fork"], "left")
    chain = cut.select("id", F.when(F.col("fork").isNull(), F.col("parent")).alias("parent"), F.when(F.col("fork").isNotNull(), F.col("parent")).alias("above"))
    chain = materialise(chain, "chain")
    member = materialise(resolve(chain.select("id", "parent")).where("state = 'rooted'").select("id", F.col("root").alias("head")).join(whole, "id"), "members")
    # head of the segment above each segment
    above = chain.where("above IS NOT NULL").select(F.col("id").alias("head"), F.col("above"))
    up = above.join(member.select(F.col("id").alias("above"), F.col("head").alias("up")), "above").select("head", "up")
    leaves = member.join(children, member["id"] == children["parent"], "left_anti").select(F.col("id").alias("leaf"), F.col("head").alias("segment"))
    found, level = None, materialise(leaves, "level")
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        level = materialise(level.join(up, level["segment"] == up["head"]).select("leaf", F.col("up").alias("segment")), "level")
    if found is None:
        return spark.createDataFrame([], "leaf bigint, position bigint, id bigint")
    return found.join(member, found["segment"] == member["head"]).select("leaf", F.col("depth").alias("position"), "id")


def rebuild(messages: DataFrame) -> DataFrame:
    """Every turn that takes part, placed in its conversation.

    ``messages`` is deduplicated first (``delivery``). Result: ``id``, ``sid``, ``role``, ``parent``, ``parent_role``, ``root``
    (first turn of the conversation) and ``position`` from 0. Null sessions, blank texts and roles that cannot be told take no
    part; equal times are ordered by id, missing times come last; an empty table gives an empty result.
    """
    linked = link(kept_turns(messages).where(F.col("role").isNotNull()))
    return _placed(linked, rooted(segments(linked)))


def _placed(linked: DataFrame, cut: DataFrame) -> DataFrame:
    heads = cut.select("part", "sid", "root", "above_rows", F.col("parent").alias("up"), F.col("parent_role").alias("up_role"))
    inner = F.col("place") > 0
    return linked.join(heads, ["part", "sid"]).select(
        "id", "sid", "role", F.when(inner, F.col("before.id")).otherwise(F.col("up")).alias("parent"), F.when(inner, F.col("before.role")).otherwise(F.col("up_role")).alias("parent_role"), "root", (F.col("above_rows") + F.col("place")).alias("position")
    )


def _judged(kept: DataFrame, cut: DataFrame) -> DataFrame:
    told = cut.groupBy("root").agg(
        F.sum("n_user").alias("n_user"), F.sum("n_assistant").alias("n_assistant"), F.sum("n_answered").alias("n_answered"), F.max(F.when(F.col("head") == F.col("root"), F.struct("sid", "head_role"))).alias("first")
    )
    told = told.select(F.col("first.sid").alias("sid"), F.col("first.head_role").alias("first_role"), "n_user", "n_assistant", "n_answered")
    reason = (
        F.when(F.coalesce("n_user", F.lit(0)) == 0, "no_user")
        .when(F.col("n_assistant") == 0, "no_assistant")
        .when(F.col("first_role") != "user", "late_user")
        .when(F.col("n_answered") < F.col("n_user"), "unanswered")
    )
    return kept.select("sid").distinct().join(told, "sid", "left").select(F.col("sid").alias("session_id"), reason.isNotNull().alias("dropped"), reason.alias("reason"))


def judged_sessions(messages: DataFrame) -> DataFrame:
    """Every session with ``dropped`` and ``reason``: ``no_user``, ``no_assistant``, ``late_user`` (the first turn is not a user's) or ``unanswered``."""
    kept = materialise(kept_turns(messages), "turns")
    return _judged(kept, rooted(segments(link(kept.where(F.col("role").isNotNull())))))


def conversations(messages: DataFrame) -> DataFrame:
    """The turns of the sessions that stay, in order: ``session_id``, ``position``, ``role``, ``id``, ``content``."""
    kept = materialise(kept_turns(messages), "turns")
    linked = link(kept.where(F.col("role").isNotNull()))
    cut = materialise(rooted(segments(linked)), "rooted")
    good = _judged(kept, cut).where("NOT dropped").select(F.col("session_id").alias("sid"))
    whole = _placed(linked, cut.join(good, "sid", "left_semi"))
    return whole.join(messages.select("id", "content"), "id").select(F.col("sid").alias("session_id"), "position", "role", "id", "content")
