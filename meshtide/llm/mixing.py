"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token weights are summed by class of source, language and topic. Values that a
target does not name fall into OTHER, so the table that is fitted has at most
(named sources + 1) x (named languages + 1) x (topics) cells whatever the input.
The fit rakes it to the three marginals in turn; a cell's weight is its fitted
share over its own share, and a document is kept with probability
``weight / largest weight``, decided by a hash of its id, so the choice is the
same on every run and on every executor.

Defined results: null text counts as empty (no tokens, topic ``short``); null or
unnamed classes are OTHER; targets of classes without tokens are shared out over
the rest; documents in cells without tokens have the weight of an average cell
(1) but at most probability 1; repeated rows get the same decision; an empty
table gives an empty result; other columns are kept only by :func:`mixed`.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
#: Shares of tokens wanted, from a stated purpose and no table: no single crawl source above a quarter of the tokens,
#: half the tokens English and a sixth for each other language, and texts of every length.
TARGETS = {
    "source": {"src0": 0.25, OTHER: 0.75},
    "lang": {"en": 0.5, "de": 1 / 6, "fr": 1 / 6, "es": 1 / 6},
    "topic": {"record": 0.15, "short": 0.05, "prose": 0.5, "long": 0.3},
}
SHORT, LONG = 100, 1500
SEED, ROUNDS, TOLERANCE = 7, 200, 1e-12


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the whole text: ``record`` (has digits), else by its number of words."""
    return F.when(text.rlike("[0-9]"), "record").when(tokens < SHORT, "short").when(tokens < LONG, "prose").otherwise("long")


def classed(docs: DataFrame, targets: dict, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id, source, lang, topic, tokens`` with unnamed classes as OTHER; a token here is a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    named = lambda c, key: F.when(F.col(c).isin([k for k in targets[key] if k != OTHER]), F.col(c)).otherwise(F.lit(OTHER))
    return docs.select(F.col(id_col).alias("id"), named(source_col, "source").alias("source"), named(lang_col, "lang").alias("lang"), tokens.alias("tokens"), text.alias("text")).withColumn("topic", topic_of(F.col("text"), F.col("tokens"))).drop("text")


def rake(counts: np.ndarray, marginals: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fits a non-negative table to marginal shares; returns shares that sum to 1 (all zero for a zero table)."""
    if not counts.sum():
        return np.zeros_like(counts, float)
    fit = counts / counts.sum()
    axes = range(fit.ndim)
    wanted = []
    for a, m in enumerate(marginals):
        m = np.where(fit.sum(axis=tuple(x for x in axes if x != a)) > 0, m, 0.0)
        wanted.append(m / m.sum() if m.sum() else fit.sum(axis=tuple(x for x in axes if x != a)))
    for _ in range(rounds):
        worst = 0.0
        for a, m in enumerate(wanted):
            now = fit.sum(axis=tuple(x for x in axes if x != a))
            worst = max(worst, float(np.abs(now - m).max()))
            factor = np.divide(m, now, out=np.zeros_like(m), where=now > 0)
            fit = fit * factor.reshape([-1 if x == a else 1 for x in axes])
        if worst < tolerance:
            break
    return fit


def calibrated(docs: DataFrame, targets: dict | None = None, seed: int = SEED, **columns) -> DataFrame:
    """``id, source, lang, topic, tokens, weight, probability, kept`` for every row."""
    targets = targets or TARGETS
    rows = classed(docs, targets, **columns)
    keys = ["source", "lang", "topic"]
    names = [list(dict.fromkeys([*targets[k], OTHER])) for k in keys]
    sums = np.zeros([len(n) for n in names])
    for r in rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).collect():  # bounded by the targets' names
        sums[tuple(n.index(r[k]) for n, k in zip(names, keys, strict=True))] = r["tokens"]
    fit = rake(sums, [np.array([targets[k].get(x, 0.0) for x in n]) for n, k in zip(names, keys, strict=True)])
    share = sums / max(sums.sum(), 1.0)
    weight = np.divide(fit, share, out=np.ones_like(fit), where=share > 0)
    top = weight[share > 0].max(initial=1.0)
    cells = [(*(n[i] for n, i in zip(names, at, strict=True)), float(weight[at]), float(min(1.0, weight[at] / top))) for at in itertools.product(*(range(len(n)) for n in names))]
    table = F.broadcast(docs.sparkSession.createDataFrame(cells, "source string, lang string, topic string, weight double, probability double"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    return rows.join(table, keys).select("id", *keys, "tokens", "weight", "probability", (draw < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, targets: dict | None = None, seed: int = SEED, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` (all columns) that the sampling keeps."""
    gone = calibrated(docs, targets, seed, id_col=id_col, **columns).where("not kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[id_col]), "left_anti")
