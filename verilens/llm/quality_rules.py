"""Quality rules as weak supervision (operator 7).

Every rule votes good (+1) or bad (-1) on a document or abstains (0).  How far a
rule is to be believed is estimated from all documents without labels, by
expectation-maximisation over a two-class model in which votes are independent
given the class, on all documents that pass the two base rules; a document is kept if its posterior probability of good quality
is at least one half and the base rules do not fail.

Scale: one pass computes a document's figures and its vote pattern.  There are at
most 3^9 patterns, so the statistics of all documents are one aggregate of bounded
size; the model is fitted on it and applied by pattern.  No shuffle carries text.

Cases: a null or empty text has no words, all figures 0, and fails the base rule;
repeated rows and null ids are judged as documents of their own; extra columns are
left aside; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Two or more of the same punctuation mark.
RUN = re.compile(r"([^\w\s])\1+")
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
BLANKS = " \t\n\x0b\x0c\r"
ROUNDS = 100
#: Pseudo-counts of a rule's good, abstaining and bad votes in either class, as shares of all
#: documents: they keep the classes' meaning, "a good text gets hardly a bad vote".
EXPECTED = ((0.08, 0.019, 0.001), (0.008, 0.006, 0.006))
FIGURES = (
    "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"
)
RULES = ("length", "word length", "symbols", "lines", "repeats", "capitals", "bare marks", "mark runs", "variety")


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrences included."""
    if len(ids) < 4:
        return 0
    # windows get small numbers pair by pair, so that products cannot overflow
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 3, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def figures_of(text: str) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    repeats = repeated_words(ids, len(number))
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            again += line in seen
            seen.add(line)
    n = max(len(words), 1)
    capitals = len(CAPITAL.findall(text)) / max(chars, 1)
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n
    runs = sum(1 for _ in RUN.finditer(text)) / n
    variety = len(number) / n
    votes = "".join(
        "+" if good else "-" if bad else "0"
        for good, bad in (
            (len(words) >= MIN_WORDS, len(words) < 20),
            (2.5 <= chars / n <= 12, chars / n < 2 or chars / n > 20),
            (symbols <= 0.05 * n, symbols > 0.15 * n),
            (again <= 0.1 * lines, again > 0.3 * lines),
            (repeats <= 0.2 * n, repeats > 0.5 * n),
            (capitals <= 0.15, capitals > 0.4),
            (bare <= 0.02, bare > 0.2),
            (runs <= 0.02, runs > 0.1),
            (variety >= 0.25, variety < 0.1),
        )
    )
    return len(words), chars, symbols, again, repeats, votes


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of a document's words, symbols, lines and repeats, and its votes."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = pd.DataFrame(
                [figures_of(t) for t in rows["text"]],
                columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"],
            )
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    # ids as text: pandas has no exact long column with nulls
    return (
        docs.select(
            F.col("doc_id").cast("long").cast("string").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .mapInPandas(judge, FIGURES)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def fit(patterns: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each vote pattern, and each rule's accuracy when it votes.

    Starts from "any bad vote means bad"; a maximisation step counts each rule's
    votes per class, an expectation step weighs all rules by what they then tell.
    """
    if not patterns:
        return np.zeros(0), np.zeros(len(RULES))
    cast = np.array([["+0-".index(v) for v in p] for p in patterns])
    total = counts.sum()
    good = np.where((cast == 2).any(axis=1), 0.05, 0.95)
    expected = np.array(EXPECTED) * total + 1e-3
    for _ in range(rounds):
        share = np.stack([good, 1 - good]) * counts
        logs = np.log(share.sum(axis=1) + 1)[:, None].repeat(len(patterns), axis=1)
        tables = []
        for rule in range(cast.shape[1]):
            table = expected + np.stack([np.bincount(cast[:, rule], s, 3) for s in share])
            table /= table.sum(axis=1, keepdims=True)
            tables.append(table)
            logs = logs + np.log(table[:, cast[:, rule]])
        before, good = good, 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    share = np.stack([good, 1 - good]) * counts
    right = (share[0][:, None] * (cast == 0) + share[1][:, None] * (cast == 2)).sum(axis=0)
    cast_votes = (counts[:, None] * (cast != 1)).sum(axis=0)
    return good, right / np.maximum(cast_votes, 1)


def quality(docs: DataFrame) -> DataFrame:
    """Figures per document with ``base_failed``, ``posterior`` and ``kept``."""
    made = write_table(figures(docs), "quality-figures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # the base rules have decided on what fails them; accuracies are those on all other documents
    open_ = F.sum(F.when(failed, 0).otherwise(1)).alias("open")
    rows = made.groupBy("votes").agg(open_).orderBy("votes").collect()  # 3^9 rows at most
    patterns = [r["votes"] for r in rows]
    good, _ = fit(patterns, np.array([r["open"] for r in rows], float))
    belief = dict(zip(patterns, good, strict=True))

    @F.pandas_udf("double")
    def posterior(votes: pd.Series) -> pd.Series:
        return votes.map(belief)

    return made.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        posterior("votes").alias("posterior"),
        "votes",
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
