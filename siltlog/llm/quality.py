"""Quality by hierarchical empirical Bayes.

A classifier on whole-text features gives each document a log-likelihood ratio.
Documents also belong to a host and a path below it. Grouped sums of the
classifier's posteriors give every host and path a rate of good documents; how
strongly a rate is drawn to its parent's is estimated from how much rates differ
between siblings, so a site of few documents takes its parent's rate and a large
one keeps its own. A document's score joins its own evidence with the rate of
its path, without its own share in that rate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from siltlog.llm.rows import pack, unpack
from siltlog.session import broadcast_if_small, materialize

MOST_LABELLED = 20_000
RIDGE = 1.0
THRESHOLD = 0.5
LEAST_RATE = 0.01
STRENGTH = (2.0, 10_000.0)
MOST_SITES = 200_000
# Posteriors are summed as whole numbers, so sums do not depend on the order of rows.
UNIT = 1_000_000

_COUNTS = {
    "words": r"[^\x20\x09-\x0D]+",
    "upper": r"[A-ZÀ-ÖØ-Þ]",
    "digits": r"[0-9]",
    "symbols": r"[#$%&*|<>{}\[\]\\^~=_@+/]",
    "calls": r"[!?]",
    "stops": r"[.,;:]",
    "long": r"[^\x20\x09-\x0D]{20,}",
    "lines": r"\n",
}


def features(text: Column) -> list[Column]:
    """Numbers that describe a whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = {name: F.regexp_count(text, F.lit(pattern)).cast("double") for name, pattern in _COUNTS.items()}
    chars, words = F.length(text).cast("double") + 1, count["words"] + 1
    # Kinds of words seen; white space at either end is no word.
    kinds = F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double")
    rate = lambda a, b: F.log1p(1000 * a / b)
    return [
        F.log1p(count["words"]),
        F.log(chars / words),
        *[rate(count[name], chars) for name in ("upper", "digits", "symbols", "calls")],
        *[rate(count[name], words) for name in ("stops", "long", "lines", "symbols")],
        F.log(kinds / words),
    ]


@dataclass(frozen=True)
class Classifier:
    """A logistic model on :func:`features`; ``prior`` is the share of good labels."""

    weights: tuple[float, ...]
    bias: float
    prior: float

    def evidence(self, text: Column) -> Column:
        """Log-likelihood ratio of good against bad."""
        score = F.lit(self.bias - _logit(self.prior))
        for w, x in zip(self.weights, features(text), strict=True):
            score = score + F.lit(w) * x
        return score


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; weights are for unscaled features."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Classifier:
    """Fit on at most ``most`` labelled documents, chosen by a hash of the id.

    Null labels and ids are left out; a document with several labels counts with
    each of them, up to the bound. Without labels of both kinds the evidence is
    zero and the prior is the share of good labels, one if there are none.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(most)
    # At most ``most`` ids travel to the tasks and as many rows of numbers to the driver;
    # of rows that repeat an id one counts.
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", F.array(*features(F.col("text"))).alias("x"))
    got = sorted(rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in got], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Classifier((0.0,) * len(features(F.lit(""))), _logit(y.mean() if len(y) else 1.0), float(y.mean()) if len(y) else 1.0)
    weights, bias = fit_logistic(np.array([r["x"] for r in got], dtype=float), y)
    return Classifier(tuple(float(w) for w in weights), bias, float(y.mean()))


def _log_odds(rate: Column) -> Column:
    rate = F.least(F.greatest(rate, F.lit(LEAST_RATE)), F.lit(1 - LEAST_RATE))
    return F.log(rate / (1 - rate))


def _posterior(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def _strength(sites: DataFrame, parent: Column) -> float:
    """How many documents a parent's rate is worth: from the spread of the sites'
    rates around it beyond what their sizes explain."""
    rate = F.col("good") / UNIT / F.col("n")
    spread = sites.agg(
        F.sum(F.col("n") * F.pow(rate - parent, 2)).alias("seen"),
        F.sum(parent * (1 - parent)).alias("chance"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("binomial"),
        F.sum("n").alias("n"),
    ).head()
    if not spread["n"]:
        return STRENGTH[1]
    between = max((spread["seen"] - spread["chance"]) / spread["n"], 1e-9)
    return float(min(max(spread["binomial"] / spread["n"] / between - 1, STRENGTH[0]), STRENGTH[1]))


def _scored(docs: DataFrame, model: Classifier, host: Column, path: Column, text: str, keep: Sequence[str]) -> DataFrame:
    rows = pack(docs, keep, host=host, path=path, evidence=model.evidence(F.col(text)))
    q = _posterior(F.col("evidence") + F.lit(_logit(model.prior)))
    return rows.withColumn("q", F.round(q * UNIT).cast("long"))


def site_rates(scored: DataFrame) -> DataFrame:
    """``host, path, host_rate, n, good, prior, k``: one row per path.

    Sums over documents are combined before they are shuffled, hosts are summed
    from paths and the whole from hosts, so no host is gathered in a task.
    ``prior`` is the shrunk rate of the host and ``k`` what it weighs.
    """
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("good")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).head()
    whole = total["good"] / UNIT / total["n"] if total["n"] else 1.0
    k = _strength(hosts, F.lit(whole))
    hosts = hosts.select(
        F.col("host").alias("_host"), ((F.col("good") / UNIT + k * whole) / (F.col("n") + k)).alias("host_rate")
    )
    joined = paths.join(broadcast_if_small(hosts, MOST_SITES), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = _strength(joined, F.col("host_rate"))
    return materialize(joined.withColumn("k", F.lit(k)), "site-rates")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    label: str = "quality",
    text: str = "text",
    threshold: float = THRESHOLD,
    most_labelled: int = MOST_LABELLED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``evidence, host_rate, path_rate, score double`` and ``kept boolean``.

    ``score`` is the posterior that a document is good; it is kept at
    ``threshold`` or above. Null and empty texts are judged as empty ones; a null
    host or path is one of its own. Rates lie between 1 % and 99 %. Input columns
    named like an added one come back as ``input_<name>``. No rows give no rows.

    With the text among the returned columns the texts are read twice, so that no
    copy of them is written; without it the scores are stored.
    """
    judged = _judged(docs, labels, host, path, label, text, threshold, most_labelled, keep)
    return unpack(judged, ["evidence", "host_rate", "path_rate", "score", "kept"])


def _judged(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str, text: str, threshold: float, most_labelled: int, keep
) -> DataFrame:
    """:func:`judge` with the columns of ``docs`` still in ``row``."""
    keep = docs.columns if keep is None else list(keep)
    scored = _scored(docs, fit(docs, labels, label, most_labelled), host, path, text, keep)
    if text in keep:
        light = materialize(scored.select("host", "path", "q"), "posteriors")
    else:
        light = scored = materialize(scored, "posteriors")
    return _with_sites(scored, site_rates(light), threshold)


def _with_sites(scored: DataFrame, rates: DataFrame, threshold: float) -> DataFrame:
    sites = rates.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", "n", "good", "k")
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    others = ((F.col("good") - F.col("q")) / UNIT + F.col("k") * F.col("host_rate")) / (F.col("n") - 1 + F.col("k"))
    # A score is never null. Saying so keeps Spark from looking for null evidence in
    # front of the join, where it would work out all features a second time.
    return (
        scored.join(broadcast_if_small(sites, MOST_SITES), same)
        .withColumn("path_rate", others)
        .withColumn("score", _posterior(F.col("evidence") + _log_odds(F.col("path_rate"))))
        .withColumn("kept", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    )


def url_sites(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables of web pages."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return host, path


def document_sites(docs: DataFrame) -> tuple[Column, Column]:
    """``documents`` has no URLs: the source is the host, its languages are the paths."""
    return docs["source"].cast("string"), docs["lang"].cast("string")


def accepted(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED
) -> DataFrame:
    """The rows of ``documents`` that are kept, as they are."""
    host, path = document_sites(docs)
    return unpack(_judged(docs, labels, host, path, label, "text", threshold, most_labelled, None).where("kept"))
