"""Chat formatting: root-to-leaf paths of reply trees, each formatted as one conversation."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, stream_groups, written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string is left: each starts with `<|`, and the escaped text has none."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the loss mask in it: the assistant's escaped texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        role, text = role or "", text or ""
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, as they were."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        out.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return out


def best_paths(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the messages on each tree's best root-to-leaf paths: `paths` of them, all if None.

    messages: tree, node, parent (null at a root), score. Iterative self-joins
    by pointer doubling: after round k a node knows its 2**k-th ancestor and
    the score and length of the path between, so a path of n messages takes
    log2(n) rounds and no list of a path is ever built. A node that has reached
    its root is set aside and no longer joined. Branches rank by the
    mean score of their path, ties by the least leaf; the chosen leaves'
    ancestors are then gathered through the same jump tables, half a path at
    a time. A parent that isn't there makes a root; nodes on a cycle reach no
    root and are left out. Null trees and nodes are left out; of rows that
    share tree and node one counts, the least.
    """
    base = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("x"))
    base = written(base.select("tree", "node", F.col("x.parent").alias("parent"), F.coalesce("x.score", F.lit(0.0)).cast("double").alias("total")))
    there = base.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    state = base.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("up"), "total", F.lit(1).cast("long").alias("n"))
    state = written(state)
    has_child = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = state.join(has_child, ["tree", "node"], "left_anti").select("tree", "node")
    jumps, finished, moving = [], state.where("up is null"), state.where("up is not null")
    longest = base.groupBy("tree").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    for _ in range(longest.bit_length()):  # a path isn't longer than its tree; what moves beyond that is a cycle
        if moving.limit(1).count() == 0:
            break
        jumps.append(moving.select("tree", "node", "up"))
        above = finished.unionByName(moving).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("t"), F.col("n").alias("m"))
        state = written(moving.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("n") + F.col("m")).alias("n")))
        finished, moving = finished.unionByName(state.where("up is null")), state.where("up is not null")
    reached = finished.select("tree", "node", "total", F.col("n").alias("depth"))
    ranked = leaves.join(reached, ["tree", "node"])
    if paths is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(-F.col("total") / F.col("depth"), "node"))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= paths)
    path = written(ranked.select("tree", F.col("node").alias("leaf"), "node"))
    for jump in reversed(jumps):
        path = written(path.union(path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))))
    return path.join(reached, ["tree", "node"]).select("tree", "leaf", "node", "depth")


def format_trees(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """tree, leaf, formatted, loss (spans of the assistant's texts in it) of each of a tree's chosen paths.

    messages: tree, node, parent, score, role, text. The paths are found with
    ids and scores alone; texts are joined to the chosen messages afterwards. A
    path is one conversation, one row, and is built in one task, in turn order;
    null role and text are empty. Of rows that share tree and node the least
    counts, as best_paths has it. Empty tables give no rows.
    """
    found = best_paths(messages.select("tree", "node", "parent", "score"), paths)
    said = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x")).select("tree", "node", "x.role", "x.text")
    turns = said.join(found, ["tree", "node"]).select("tree", "leaf", "depth", "role", "text")

    def one(key, rows):
        formatted, spans = format_turns((role, text) for *_, role, text in rows)
        yield *key, formatted, [{"start": a, "end": b} for a, b in spans]

    kind = dict(messages.dtypes)
    return stream_groups(turns, ["tree", "leaf"], ["depth"], f"tree {kind['tree']}, leaf {kind['node']}, formatted string, loss array<struct<start:long,end:long>>", one)


def linear_messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A conversation's rows, by turn (null turns first; ties by role and text, null as empty), as a tree without branches.

    tree is the conversation's id as text. Rows of a null id make one
    conversation, whose tree is the empty text; an empty table gives no rows.
    """
    order = F.row_number().over(Window.partitionBy("tree").orderBy(turn, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).cast("long")
    at = rows.withColumn("tree", F.coalesce(F.col(conv).cast("string"), F.lit(""))).select("tree", order.alias("node"), "role", "text")
    return at.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations; conv_id is the tree's number, null for the empty tree."""

    def task():
        def each(c):
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            out["conv_id"] = [int(t) if t else None for t in c["tree"].to_pylist()]
            for text, spans in zip(c["formatted"].to_pylist(), c["loss"].to_pylist()):
                turns = read_turns(text)
                said, lost, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, words in turns:
                    said.update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    part = unescape(text[s["start"] : s["end"]])
                    chars += len(part)
                    lost.update(part.encode("utf-8", "surrogatepass"))
                for k, x in (("n_turns", len(turns)), ("turns_sha256", said.hexdigest()), ("loss_chars", chars), ("loss_sha256", lost.hexdigest()), ("formatted_chars", len(text))):
                    out[k].append(x)
            return out

        return each

    return map_rows(formatted, ["tree", "formatted", "loss"], "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", task)
