"""Mixing to target weights by soft membership, in DataFrame operations only.

1. A classifier learned from the labelled rows gives every document posterior
   probabilities over the domains: naive Bayes over the presence of words, word
   endings and a repetition grade, restricted to the ``max_features`` features
   that tell the domains apart best (log-likelihood ratio of at least
   ``min_g2``). The feature table has at most ``max_features + 1`` rows and is
   broadcast; words that are no features vanish before anything is shuffled.
2. Every document gets a nonnegative rate ``r`` (expected copies). With shares
   ``A_k = sum(tokens * p_k * r) / sum(tokens)`` the rates minimise
   ``sum_k (A_k - target_k)^2 / base_k + mu * sum(tokens * (r - 1)^2) / sum(tokens)``
   by projected gradient steps, the projection taken lazily: the unprojected rate
   stays of the form ``1 - p . y``, so K numbers ``y`` and one short column
   expression say all rates. A step needs the K shares only: one aggregate over
   the documents, K numbers on the driver; no step writes a table.
3. With ``exact``, Newton steps of K x K sums on the same form let ``mu`` go, so
   that expected totals meet their targets and rates stay as near to 1 as that
   allows. Without, ``mu`` stops short of targets that only documents of another
   likely domain could give up tokens for.

Targets are weights per domain; they are scaled so that the ``anchor`` domain
keeps its expected tokens (or to the corpus total without an anchor).

Defined results: a null or empty text has no tokens, the prior as posterior and
a rate like any other; without labelled rows all domains are equally likely;
labels outside the given domains are ignored; rows that share a document
number are one document (tokens add up, evidence is averaged); an empty table
gives no rows. A domain without any expected token is left out of the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key


@dataclass(frozen=True)
class MixParams:
    max_train: int = 10_000  #: bound of the training sample, in documents
    max_features: int = 1000
    min_documents: int = 5  #: training documents that must hold a feature
    min_g2: float = 30.0
    alpha: float = 0.5
    mu: float = 0.002
    steps: int = 120
    tolerance: float = 1e-5
    exact: float | None = None  #: largest relative miss of a target; with it, corrections follow the steps
    corrections: int = 12


#: Feature that every document has; it carries the prior and the token count.
BIAS = "\n"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _featured(rows: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` and ``features`` to rows with a ``text``, which goes.

    The feature array is never empty; callers use ``explode_outer``, because
    ``explode`` adds a filter on the array's size, which would compute the array
    twice, and once more for every row that a later join drops.
    """
    out = rows.withColumn("words", _words(F.col("text"))).withColumn("own", F.array_distinct("words"))
    grade = F.when(F.size("words") >= 20, F.floor(F.size("own") * 10 / F.size("words")).cast("string")).otherwise(F.lit("-"))
    endings = F.array_distinct(F.transform("own", lambda w: F.concat(F.lit("\t"), F.substring(w, -2, 2))))
    return out.select(
        *[c for c in rows.columns if c != "text"], F.size("words").cast("long").alias("n_tokens"),
        F.concat("own", endings, F.array(F.concat(F.lit("\r"), grade), F.lit(BIAS))).alias("features"))


def fit_features(docs: DataFrame, labels: DataFrame, domains: list[str], p: MixParams = MixParams(),
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(feature, weights array<double>)`` learned from ``labels (doc_id, domain)``; the bias row holds the log priors."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
              .select(F.col("doc_id").alias("train_id"), "domain").distinct()
              .orderBy(F.xxhash64("train_id"), "train_id", "domain").limit(p.max_train))
    sample = docs.select(F.col(doc_id).alias("train_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "train_id")
    counts = [F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"n{k}") for k, d in enumerate(domains)]
    rows = _featured(sample.select("domain", "text")).select("domain", F.explode_outer("features").alias("feature"))
    table = materialize(rows.groupBy("feature").agg(F.count("*").alias("n"), *counts)
                        .where((F.col("n") >= p.min_documents) | (F.col("feature") == BIAS)), "features")
    total = table.where(F.col("feature") == BIAS).select(*[f"n{k}" for k in range(len(domains))]).first() or [0.0] * len(domains)
    n_all = sum(total) or 1.0

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    g2 = F.lit(0.0)
    for k, t in enumerate(total):
        if t:
            have, all_have = F.col(f"n{k}"), F.col("n").cast("double")
            g2 = g2 + cell(have, all_have * (t / n_all)) + cell(t - have, (n_all - all_have) * (t / n_all))
    weights = F.array(*[F.log((F.col(f"n{k}") + p.alpha) / (t + 2 * p.alpha)) for k, t in enumerate(total)])
    best = (table.where(F.col("feature") != BIAS).withColumn("g2", 2 * g2).where(F.col("g2") >= p.min_g2)
            .orderBy(F.desc("g2"), "feature").limit(p.max_features).select("feature", weights.alias("weights")))
    prior = F.array(*[F.log(F.lit((t + p.alpha) / (n_all + p.alpha * len(domains)))) for t in total])
    spark = docs.sparkSession
    return materialize(best.union(spark.range(1).select(F.lit(BIAS).alias("feature"), prior.alias("weights"))), "weights")


def posteriors(docs: DataFrame, features: DataFrame, n_domains: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(nid, n_tokens, p0, p1, ...)``, one row per document number."""
    rows = _featured(docs.select(row_key(doc_id, text).alias("nid"), F.col(text).alias("text")))
    hits = rows.select("nid", "n_tokens", F.explode_outer("features").alias("feature")).join(F.broadcast(features), "feature")
    bias = F.col("feature") == BIAS
    sums = hits.groupBy("nid").agg(
        F.sum(F.when(bias, F.col("n_tokens"))).alias("n_tokens"), F.count(F.when(bias, 1)).alias("n_rows"),
        *[F.sum(F.col("weights")[k]).alias(f"w{k}") for k in range(n_domains)])
    means = [F.col(f"w{k}") / F.col("n_rows") for k in range(n_domains)]
    top = F.greatest(*means) if n_domains > 1 else means[0]
    scaled = sums.select("nid", "n_tokens", *[F.exp(m - top).alias(f"e{k}") for k, m in enumerate(means)])
    total = sum((F.col(f"e{k}") for k in range(1, n_domains)), F.col("e0"))
    return scaled.select("nid", "n_tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(n_domains)])


@dataclass(frozen=True)
class _Goal:
    base: list[float]  #: shares at rate 1
    target: list[float]


def _goal(base: list[float], weights: list[float], anchor: int | None) -> _Goal:
    scale = sum(weights) or 1.0
    target = [w / scale for w in weights]
    if anchor is not None and target[anchor] > 0:
        target = [t * base[anchor] / target[anchor] for t in target]
    return _Goal(base, target)


def _rate(y: list[float]) -> Column:
    """``max(0, 1 - p . y)``: every rate that the steps reach has this form, so the expression never grows."""
    return F.greatest(F.lit(0.0), sum((F.col(f"p{k}") * F.lit(-float(v)) for k, v in enumerate(y)), F.lit(1.0)))


def _shares(members: DataFrame, rate: Column, n: int) -> list[float]:
    tokens = F.col("n_tokens").cast("double")
    row = members.agg(F.sum(tokens).alias("t"), *[F.sum(tokens * F.col(f"p{k}") * rate).alias(f"a{k}") for k in range(n)]).first()
    return [(row[f"a{k}"] or 0.0) / (row["t"] or 1.0) for k in range(n)]


def _descend(members: DataFrame, weights: list[float], anchor: int | None, p: MixParams) -> tuple[list[float], list[float], _Goal]:
    ks = range(len(weights))
    y = [0.0 for _ in ks]
    now = _shares(members, F.lit(1.0), len(weights))
    goal, eta = _goal(now, weights, anchor), 1.0 / (1.0 + p.mu)
    for _ in range(p.steps):
        pull = [(now[k] - goal.target[k]) / goal.base[k] if goal.base[k] > 0 else 0.0 for k in ks]
        # gradient step for z = 1 - p . y, of which the rate is the projection to r >= 0
        y = [(1.0 - eta * p.mu) * y[k] + eta * pull[k] for k in ks]
        before, now = now, _shares(members, _rate(y), len(weights))
        if max(abs(a - b) for a, b in zip(before, now)) < p.tolerance:
            break
    return y, now, goal


def fit_rates(members: DataFrame, weights: list[float], anchor: int | None = None, p: MixParams = MixParams()) -> tuple[Column, list[float], list[float]]:
    """Rate column over ``members (n_tokens, p0, ...)``, the shares it gives and the target shares."""
    y, now, goal = _descend(members, weights, anchor, p)
    return _rate(y), now, goal.target


def meet_targets(members: DataFrame, weights: list[float], anchor: int | None = None, p: MixParams = MixParams()) -> tuple[Column, list[float], list[float]]:
    """As :func:`fit_rates`, then without the pull to 1: K x K Newton steps on the same form until each total is within ``exact`` of its target.

    A step needs K sums and the K x K products of the posteriors over the documents of positive rate. A step that
    does not come nearer is halved; targets out of reach leave the nearest rates found.
    """
    n, tokens, exact = len(weights), F.col("n_tokens").cast("double"), p.exact or 1e-6
    y, now, goal = _descend(members, weights, anchor, p)
    live = [k for k in range(n) if goal.base[k] > 0]

    def miss(a: list[float]) -> float:
        return max((abs(a[k] - goal.target[k]) / max(goal.target[k], 1e-9 + exact * goal.base[k]) for k in live), default=0.0)

    total = (members.agg(F.sum(tokens)).first()[0] or 1.0) if live else 1.0
    for _ in range(p.corrections):
        if miss(now) <= exact:
            break
        active = _rate(y) > 0
        row = members.agg(*[F.sum(F.when(active, tokens * F.col(f"p{i}") * F.col(f"p{j}"))).alias(f"h{i}_{j}") for i in live for j in live if i <= j]).first()
        h = np.array([[(row[f"h{min(i, j)}_{max(i, j)}"] or 0.0) / total for j in live] for i in live])
        gap = np.array([now[k] - goal.target[k] for k in live])
        move = np.linalg.lstsq(h + 1e-12 * np.eye(len(live)), gap, rcond=None)[0]
        for halvings in range(6):
            step = dict(zip(live, move * 0.5**halvings))
            trial = [y[k] + float(step.get(k, 0.0)) for k in range(n)]
            then = _shares(members, _rate(trial), n)
            if miss(then) < miss(now):
                break
        else:
            break
        y, now = trial, then
    return _rate(y), now, goal.target


def domain_labels(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document: ``toxic``, else ``clean`` or ``low`` by its quality mark."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


#: Target weights of the registered query and the pipeline.
DOMAINS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str | None = None,
                 p: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(nid, n_tokens, p_<domain>..., rate)`` per document number; ``labels`` is ``(doc_id, domain)``."""
    names = list(weights)
    features = fit_features(docs, labels, names, p, doc_id, text)
    members = materialize(posteriors(docs, features, len(names), doc_id, text), "members")
    rate, _, _ = (fit_rates if p.exact is None else meet_targets)(members, list(weights.values()), names.index(anchor) if anchor else None, p)
    return members.select("nid", "n_tokens", *[F.col(f"p{k}").alias(f"p_{n}") for k, n in enumerate(names)], rate.alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str | None = None,
        p: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate on average: ``floor(rate)`` copies, and one more
    for the share of document numbers (by hash) that the fraction says.

    With an anchor, documents that most likely are of its domain and whose rate rounds to one stay once.
    """
    key, n = fresh(docs, "mix_key"), fresh(docs, "mix_copies")
    rates = mixing_rates(docs, labels, weights, anchor, p, doc_id, text)
    draw = F.pmod(F.xxhash64("nid", F.lit(20240613)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    if anchor:
        held = (F.col(f"p_{anchor}") > 0.5) & (F.floor(F.col("rate") + 0.5) == 1)
        copies = F.when(held, F.lit(1)).otherwise(copies)
    rates = rates.select(F.col("nid").alias(key), copies.cast("int").alias(n)).where(F.col(n) > 0)
    joined = docs.withColumn(key, row_key(doc_id, text)).join(rates, key)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
