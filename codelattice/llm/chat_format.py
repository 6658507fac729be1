"""Operator 5: chat formatting of reply trees.

Messages point at the message they reply to. Self-joins that double their
reach each round (a message knows its ancestor 1, 2, 4, ... steps up) give
every message its root and depth, and so every leaf a root-to-leaf path. The
branches of a root are ranked by score; the ancestors of a chosen leaf come
from the same doubled links. Each chosen path is formatted as one
conversation: ``<|im_start|>role\\n text <|im_end|>\\n`` for each turn, with a
loss mask over the assistant texts.

Control strings inside texts: every ``<``, backslashes, ``|`` gets one more
backslash, so an escaped text holds no ``<|`` at all, and reading takes one
backslash back. Texts without ``<|`` or ``<\\|`` stay as they are. Roles are
escaped the same way after ``\\`` and line ends in them.

A conversation is written as parts of bounded size, in order; a conversation
of any length streams through a task and is never held whole.

Defined results. Null text and null role are empty. Messages whose parent is
null or missing are roots. Messages on a cycle have no root and are left out.
A null score is 0; equal scores rank the deeper branch first, then the
smaller leaf id. Of rows that repeat (conversation, id) each is a turn where
``linear_replies`` makes the tree (it numbers rows by turn, role and text);
given trees must have unique ids. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Characters in a formatted part, but for the last turn of each.
PART_CHARS = 1 << 20
#: Roles whose texts carry loss.
LOSS_ROLES = ("assistant",)

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Conversations whose rows answer one another by turn, as reply trees."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).cast("bigint").alias("id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def _same(left: DataFrame, right: DataFrame):
    return left["conv_id"].eqNullSafe(right["c"])


def branch_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages on each root's ``top`` best branches: conv_id, root, branch, depth, id.

    ``messages`` has conv_id, id, parent, score.
    """
    nodes = cut(messages.select("conv_id", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    ids = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("p"))
    known = nodes.join(ids, _same(nodes, ids) & (nodes["parent"] == ids["p"]), "left")
    # up: the ancestor `reach` steps up, or the root; dist: steps to it.
    jump = cut(known.select("conv_id", "id", F.coalesce("p", "id").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("bigint").alias("dist")), "jump")
    links, reach, most = [], 1, nodes.count()
    while reach <= most:
        # Only messages that have not met their root yet look further up.
        active = cut(jump.filter(F.col("dist") == reach), "active")
        if active.isEmpty():
            break
        links.append((reach, active))
        above = jump.select(F.col("conv_id").alias("c"), F.col("id").alias("mid"), F.col("up").alias("far"), F.col("dist").alias("more"))
        moved = active.join(above, _same(active, above) & (active["up"] == above["mid"])).select("conv_id", "id", F.col("far").alias("up"), (F.col("dist") + F.col("more")).alias("dist"))
        jump = cut(jump.filter(F.col("dist") < reach).unionByName(moved), "jump")
        reach *= 2
    rooted = nodes.join(jump.filter(F.col("dist") < reach).select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("up").alias("root"), "dist"), nodes["conv_id"].eqNullSafe(F.col("c")) & (nodes["id"] == F.col("i"))).select("conv_id", "id", "parent", "score", "root", "dist")
    parents = nodes.filter("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["conv_id"].eqNullSafe(parents["c"]) & (rooted["id"] == parents["p"]), "left_anti")
    rank = Window.partitionBy("conv_id", "root").orderBy(F.col("score").desc(), F.col("dist").desc(), F.col("id"))
    path = cut(leaves.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= top).select("conv_id", "root", "branch", "id", F.col("dist").alias("depth")), "leaves")
    # Ancestors of the leaves: with every link of 1, 2, 4, ... steps the set of
    # collected messages doubles its reach.
    for step, link in reversed(links):
        hop = link.select(F.col("conv_id").alias("c"), F.col("id").alias("at"), "up")
        more = path.join(hop, _same(path, hop) & (path["id"] == hop["at"])).select("conv_id", "root", "branch", F.col("up").alias("id"), (F.col("depth") - step).alias("depth"))
        path = cut(path.unionByName(more), "path")
    return path


def _format(batches, part_chars: int):
    """Rows (conv_id, root, branch, depth, role, text), sorted, to parts."""
    key, turns, start, part = None, [], 0, 0
    text, spans, size = [], [], 0

    def flush():
        return (*key, part, "".join(text), [a for a, _ in spans], [b for _, b in spans])

    for batch in batches:
        out = []
        for conv, root, branch, role, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "root", "branch", "role", "text")), strict=True):
            if key is not None and ((conv, root, branch) != key or size >= part_chars):
                out.append(flush())
                part = part + 1 if (conv, root, branch) == key else 0
                text, spans, size = [], [], 0
            key = (conv, root, branch)
            head, body = f"{START}{_escape_role(role)}\n", escape(said)
            text += [head, body, END, "\n"]
            if role in LOSS_ROLES:
                spans.append((size + len(head), size + len(head) + len(body)))
            size += len(head) + len(body) + len(END) + 1
        yield from _parts(out)
    if key is not None:
        yield from _parts([flush()])


def _parts(rows):
    if rows:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], ["conv_id", "root", "branch", "part", "formatted", "loss_from", "loss_to"])


PARTS = "conv_id bigint, root bigint, branch int, part int, formatted string, loss_from array<bigint>, loss_to array<bigint>"


def format_conversations(messages: DataFrame, top: int = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted parts of each chosen path, with the loss mask as spans of code points.

    ``messages``: conv_id, id, parent, score, role, text.
    """
    path = branch_paths(messages, top)
    said = messages.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = path.join(said, _same(path, said) & (path["id"] == said["i"])).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("root").cast("bigint").alias("root"), F.col("branch").cast("int").alias("branch"), "depth", "role", "text")
    sorted_ = rows.repartition("conv_id", "root", "branch").sortWithinPartitions("conv_id", "root", "branch", "depth")
    return sorted_.mapInArrow(lambda batches: _format(batches, part_chars), PARTS)


def parse_part(formatted: str):
    """(role, text, start of the escaped text, its end) of each turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield _unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def _read(batches):
    key, state, rows = None, None, []

    def close():
        n, turns, chars, loss, size = state
        return (*key, n, turns.hexdigest(), chars, loss.hexdigest(), size)

    for batch in batches:
        for conv, root, branch, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "root", "branch", "formatted", "loss_from", "loss_to")), strict=True):
            if (conv, root, branch) != key:
                if key is not None:
                    rows.append(close())
                key, state = (conv, root, branch), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse_part(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                said = unescape(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        yield from _facts(rows)
        rows = []
    if key is not None:
        yield from _facts([close()])


def _facts(rows):
    if rows:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], ["conv_id", "root", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(parts: DataFrame) -> DataFrame:
    """Facts of each formatted conversation, parsed from its parts."""
    ordered = parts.repartition("conv_id", "root", "branch").sortWithinPartitions("conv_id", "root", "branch", "part")
    return ordered.mapInArrow(_read, "conv_id bigint, root bigint, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
