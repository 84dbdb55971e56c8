"""Toxicity by weak supervision (operator 6).

1. Voters come from a bounded sample of labelled rows: words or shared word beginnings that occur in toxic
   rows far beyond chance vote "toxic" where they occur; pattern voters look at the
   share and number of such words and at shouting, and vote both ways.
2. A generative label model (expectation-maximisation, two classes) estimates how
   often each voter, the row's own mark among them, votes in each class.  Pairs of voters that agree beyond what the
   class explains are correlated; such a voter's evidence is divided by the number
   of voters it stands for.
3. A logistic regression on words learns the model's posterior labels, and its
   weights, a bounded table, score every document in one pass without a shuffle.

Only ``text`` is an input of a score.  Rows held out by the fold never reach 1-3.

Cases: null and empty texts have no words and get the score of the intercept alone;
without usable labels every score is 0.5 * the prior of an unlabelled corpus, below
one half; repeated rows and null ids are documents of their own (a null id has no
fold and is not learnt from); extra columns are left aside; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labelled rows that are learnt from, at most; chosen by a hash of their id.
SAMPLE = 5_000
#: Words with weights, at most.
VOCABULARY = 5_000
VOTERS = 400
WORD = re.compile(r"[^\W\d_]+")
ROUNDS = 60
#: Least log-likelihood ratios of a voter and of a word with a weight.
SURPRISING = 14.0
TELLING = 5.0
#: How often a row's own mark is right.
MARK = 0.98
PENALTY = 1e-4

#: Public English insults that vote without having been seen in a labelled row (fixed values).
INSULTS = frozenset(
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile fool bastard".split()
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def words_of(text: str) -> set[str]:
    """Lower-case words, and beginnings of 4 letters that 2 or 3 different words share (forms of one word)."""
    words = set(WORD.findall(text.lower()))
    shared = Counter([w[:4] for w in words])
    return (
        words
        | {stem + "-2" for stem, n in shared.items() if n > 1}
        | {stem + "-3" for stem, n in shared.items() if n > 2}
    )


class Sample:
    """Labelled texts as rows of word numbers, near copies of a row put together for counts."""

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.shouting: list[bool] = []
        kin: dict[int, int] = {}
        groups = []
        for text in texts:
            words = words_of(text)
            # copies and near copies mostly share the smallest hash of their long words
            same = min((zlib.crc32(w.encode()) for w in words if len(w) > 7), default=-1 - len(groups))
            groups.append(kin.setdefault(same, len(kin)))
            found = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            self.rows.append(np.sort(found))
            self.shouting.append(sum(map(str.isupper, text)) > 0.5 * len(text) > 0)
        self.number = number
        self.words = list(number)
        self.group = np.array(groups, np.int64)

    def surprise(self, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: groups of rows with it, their toxic share, and the log-likelihood ratio against the base share.

        The ratio is negative for words that occur less in toxic rows.
        """
        kinds = self.group * 2 + (toxic > 0.5)
        chosen = np.unique(kinds, return_index=True)[1]  # one row of a kind stands for all of it
        column = np.concatenate([self.rows[r] for r in chosen])
        n = np.bincount(column, minlength=len(self.words)).astype(float)
        weights = np.repeat(toxic[chosen], [len(self.rows[r]) for r in chosen])
        bad = np.bincount(column, weights, len(self.words))
        rate = np.clip(toxic[chosen].mean(), 1e-6, 1 - 1e-6)
        share = np.clip(bad / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        gain = bad * np.log(share / rate) + (n - bad) * np.log((1 - share) / (1 - rate))
        return n, bad, np.where(n == 0, 0.0, np.where(share >= rate, gain, -gain))

    def lexicon(self, toxic: np.ndarray) -> np.ndarray:
        """Words whose rows are mostly toxic, beyond what chance gives among so many words."""
        n, bad, gain = self.surprise(toxic)
        strong = np.flatnonzero((bad >= 4) & (bad >= 0.7 * n) & (gain >= SURPRISING))
        return strong[np.lexsort((strong, -gain[strong]))][:VOTERS]

    def votes(self, lexicon: np.ndarray) -> np.ndarray:
        """Votes of all voters: +1 toxic, -1 clean, 0 abstains; the last four are pattern voters."""
        place = np.full(len(self.words), -1, np.int32)
        place[lexicon] = np.arange(len(lexicon))
        insults = {self.number[w] for w in INSULTS if w in self.number}
        votes = np.zeros((len(self.rows), len(lexicon) + 4), np.int8)
        for row, words in enumerate(self.rows):
            hits = place[words]
            hits = hits[hits >= 0]
            votes[row, hits] = 1
            votes[row, -4] = 0 if insults.isdisjoint(words.tolist()) else 1
            votes[row, -3] = 1 if len(hits) >= 2 else -1 if not len(hits) else 0
            votes[row, -2] = 1 if 50 * len(hits) >= len(words) > 0 else -1 if not len(hits) else 0
            votes[row, -1] = 1 if self.shouting[row] and len(hits) else 0
        return votes


def label_model(votes: np.ndarray, marks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of toxic per row from the voters and its mark, one more voter.

    The mark's accuracy is given, class-wise vote rates of all others are found by
    expectation-maximisation; after each step the
    correlation of voters that the classes leave unexplained divides their evidence.
    """
    prior = float(np.clip(marks.mean(), 0.001, 0.999))
    votes = np.concatenate([votes, np.where(marks > 0, 1, -1)[:, None].astype(np.int8)], axis=1)
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    belief = np.where(marks > 0, 0.95, 0.05)
    base = np.log(prior / (1 - prior))
    for _ in range(rounds):
        rates = []
        for share in (belief, 1 - belief):
            total = share.sum() + 2
            rates.append(((share @ up + 0.1) / total, (share @ down + 0.1) / total))
        (t_up, t_down), (c_up, c_down) = rates
        t_up[-1], t_down[-1], c_up[-1], c_down[-1] = MARK, 1 - MARK, 1 - MARK, MARK
        t_none, c_none = np.maximum(1 - t_up - t_down, 1e-6), np.maximum(1 - c_up - c_down, 1e-6)
        expected = belief[:, None] * (t_up - t_down) + (1 - belief)[:, None] * (c_up - c_down)
        rest = votes - expected
        scale = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0.0)
        stands_for = 1 + np.where(correlation > 0.3, correlation, 0.0).sum(axis=1)
        stands_for[-1] = 1.0
        evidence = (
            up * np.log(t_up / c_up) + down * np.log(t_down / c_down) + (1 - up - down) * np.log(t_none / c_none)
        )
        logit = base + (evidence / stands_for).sum(axis=1)
        before, belief = belief, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(belief - before).max() < 1e-6:
            break
    return belief


def linear_classifier(sample: Sample, belief: np.ndarray, steps: int = 300) -> tuple[dict[str, float], float]:
    """Word weights and intercept of a logistic regression on the posterior labels."""
    n, _, gain = sample.surprise(belief)
    telling = np.flatnonzero((n >= 3) & (np.abs(gain) >= TELLING))
    telling = telling[np.lexsort((telling, -np.abs(gain[telling])))][:VOCABULARY]
    place = np.full(len(sample.words), -1, np.int32)
    place[telling] = np.arange(len(telling))
    rows = [p[p >= 0] for p in (place[words] for words in sample.rows)]
    rate = float(belief.mean())
    column, row = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight, bias = np.zeros(len(telling)), float(np.log(rate / (1 - rate)))
    # balanced classes; steps sized per word by the squares of its gradients
    importance = np.where(belief > 0.5, 0.5 / max(rate, 1e-3), 0.5 / max(1 - rate, 1e-3))
    squares, bias_square = np.full(len(telling), 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[column], len(rows)), -30, 30)))
        error = importance * (p - belief) / len(rows)
        gradient = np.bincount(column, error[row], len(telling)) + PENALTY * weight
        squares += gradient * gradient
        weight -= 0.3 * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(bias_square)
    return {sample.words[k]: float(w) for k, w in zip(telling, weight, strict=True)}, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Word weights and intercept, learnt from at most ``sample`` labelled rows outside the fold."""
    marked = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = chosen.join(texts, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = found.limit(sample).toPandas()
    raw, toxic = rows["text"], rows["toxic"].to_numpy()
    if not len(toxic) or toxic.min() == toxic.max():
        return {}, -1.0
    held = Sample(raw)
    belief = label_model(held.votes(held.lexicon(toxic)), toxic)
    return linear_classifier(held, np.clip(belief, 0.001, 0.999))


def scorer(weights: dict[str, float], bias: float):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        get = weights.get
        logits = [bias + sum(get(w, 0.0) for w in words_of(t)) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(*fit(docs, labels, sample))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    score = scorer(*fit(docs, labels, sample))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_toxicity", score(text)).filter(F.col("_toxicity") < 0.5).drop("_toxicity")
