"""Chat formatting of reply trees (operator 5).

Messages point to the message they answer.  Iterated self-joins enumerate the
root-to-leaf paths: with the 2^k-th ancestor of every message known, a leaf's first
2^k ancestors give its next 2^k, so a path of any length takes a logarithm of its
length in rounds, and rows are only those of the paths themselves.  Branches of a
tree are ranked by score and each chosen path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  A control string inside
a text gets a backslash behind its ``<``, one that has backslashes there one more;
taking one away restores the text exactly.  The loss mask lists the places of the
assistant texts, in code points of the formatted conversation.

Scale: a tree is joined by message number, never by tree, and the best branches
are chosen by a pre-ranked aggregate; only one path's texts come together, as its
formatted conversation is one value.

Cases: null roles and texts count as empty; equal turns keep their row order; a
null ``conv_id`` is one conversation; replies to unknown messages are roots; loops
without a root give no path; extra columns are left aside; an empty table gives no
conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import number_rows, write_table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*\|im_(?:start|end)\|>)")
ESCAPED = re.compile(r"<\\(\\*\|im_(?:start|end)\|>)")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
TRAINED = "assistant"
SALTS = 64


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turns(turns: list[tuple[str, str]], trained: str = TRAINED) -> tuple[str, list[list[int]]]:
    """The formatted conversation and the [start, end) of each text to learn from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        if role == trained:
            spans.append([at + len(head), at + len(head) + len(body)])
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def linear_replies(rows: DataFrame) -> DataFrame:
    """Conversations with numbered turns as reply trees: each row answers the one before it.

    Gives (node, parent, tree, role, text, score); rows of one turn number keep
    their order in the table.
    """
    plain = rows.select(
        F.col("conv_id").cast("long").alias("tree"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    numbered = number_rows(plain, "chat-turns")
    before = W.partitionBy("tree").orderBy("turn", "_row")
    links = numbered.select("_row", "tree", F.lag("_row").over(before).alias("parent"))
    links = write_table(links, "chat-links")
    return numbered.join(links.select(F.col("_row").alias("_r"), "parent"), F.col("_row") == F.col("_r")).select(
        F.col("_row").alias("node"), "parent", "tree", "role", "text", F.lit(0.0).alias("score")
    )


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, distance) of every root-to-leaf path; distance 0 is the leaf."""
    links = write_table(messages.select("node", "parent"), "chat-tree")
    known = links.select(F.col("node").alias("_n"))
    jump = links.join(known, F.col("parent") == F.col("_n")).select("node", F.col("parent").alias("up"))
    jump = write_table(jump, "chat-jump")
    leaves = links.select("node").join(jump.select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    step, messages_in_all = 1, links.count()
    while step <= messages_in_all and not jump.isEmpty():
        further = paths.join(jump, "node").select(
            "leaf", F.col("up").alias("node"), (F.col("distance") + step).alias("distance")
        )
        paths = write_table(paths.unionByName(further), "chat-paths")
        high = jump.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = write_table(jump.join(high, "up").select("node", F.col("top").alias("up")), "chat-jump")
        step *= 2
    roots = links.join(known, F.col("parent") == F.col("_n"), "left_anti").select("node")
    whole = paths.join(roots, "node").select("leaf")
    return paths.join(whole, "leaf", "left_semi")


def best_branches(paths: DataFrame, messages: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` leaves of each tree with the highest mean score; ties to the smaller leaf."""
    scored = (
        paths.join(messages.select("node", "tree", "score"), "node")
        .groupBy("leaf")
        .agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.first("tree").alias("tree"))
        .withColumn("_salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    )
    order = [F.col("score").desc(), F.col("leaf")]
    some = scored.withColumn("_rank", F.row_number().over(W.partitionBy("tree", "_salt").orderBy(*order)))
    some = some.filter(F.col("_rank") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(*order)))
    return ranked.filter(F.col("rank") <= keep).select("leaf", "tree", "rank")


def format_trees(messages: DataFrame, keep: int = 1, trained: str = TRAINED) -> DataFrame:
    """One formatted conversation per chosen branch: tree, rank, formatted, loss_spans.

    ``messages(node, parent, tree, role, text, score)`` with unique ``node``.
    """
    paths = leaf_paths(messages)
    chosen = best_branches(paths, messages, keep)
    turns = (
        paths.join(chosen, "leaf")
        .join(messages.select("node", "role", "text"), "node")
        .groupBy("leaf", "tree", "rank")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "role", "text")), asc=False).alias("turns"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns], trained) for turns in rows["turns"]]
            yield pd.DataFrame(
                {
                    "tree": rows["tree"],
                    "rank": rows["rank"],
                    "formatted": [text for text, _ in made],
                    "loss_spans": [spans for _, spans in made],
                }
            )

    # ids as text: pandas has no exact long column with nulls
    formatted = turns.select(F.col("tree").cast("string").alias("tree"), "rank", "turns").mapInPandas(
        write, "tree string, rank int, formatted string, loss_spans array<array<long>>"
    )
    return formatted.withColumn("tree", F.col("tree").cast("long"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted text and its mask alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, spans in zip(rows["formatted"], rows["loss_spans"], strict=True):
                turns = read_turns(text)
                learnt = "".join(unescape(text[int(a) : int(b)]) for a, b in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append(
                    (
                        len(turns),
                        hashlib.sha256(said.encode()).hexdigest(),
                        len(learnt),
                        hashlib.sha256(learnt.encode()).hexdigest(),
                        len(text),
                    )
                )
            made = pd.DataFrame(
                out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )
            made.insert(0, "conv_id", rows["tree"].array)
            yield made

    named = formatted.withColumn("tree", F.col("tree").cast("string"))
    digests = named.select("tree", "formatted", "loss_spans").mapInPandas(
        read,
        "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    return digests.withColumn("conv_id", F.col("conv_id").cast("long"))
