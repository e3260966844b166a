"""Mixing to target weights by soft membership, on DataFrame functions only.

A naive Bayes classifier is counted from labelled documents: tokens (words, and runs of signs) are hashed to
``BUCKETS`` buckets, and each domain's share of a bucket is drawn towards the share in all domains by
``PULL`` tokens. Every document gets posteriors over the domains and so expected domain tokens
a = tokens * posterior. Rates w >= 0 are then fitted by projected gradient steps

    w <- max(0, w - a . v),   v = (sum a a')^-1 (sum w a - target)

on the least squares of the domain totals, measured in the metric in which the step length is 1 for
any data. A step needs one sum over a narrow stored table, and a K-vector goes back to the driver; the
rate of a document is a fold over the steps' vectors, so nothing but these is kept between steps.

Defined cases: rows that share an id, null included, are one document with one rate; null and empty
texts have no tokens, the domains' prior as posterior, and the start rate; a label row without id or
domain is ignored, of several for an id the least counts; without labels there is no domain and every
rate is the start rate; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import joined, picked, stored, unit_hash

BUCKETS = 1 << 16
PULL = 20_000.0
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def token_buckets(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the bucket of each token of column text; one null bucket where there is none."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    each = rows.select(*keep, F.explode_outer(tokens).alias("token"))
    return each.select(*keep, F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).alias("bucket"), F.col("token").isNotNull().cast("int").alias("one"))


def labelled_domains(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(doc_id, domain) from the labels: ``good``, ``low``, ``toxic`` or ``low_toxic``."""
    low, bad = F.col(f"`{quality}`") == 0, F.col(f"`{toxic}`") == 1
    name = F.when(low & bad, "low_toxic").when(bad, "toxic").when(low, "low").when(~low & ~bad, "good")
    return labels.select(F.col(f"`{doc_id}`").alias("doc_id"), name.alias("domain"))


def sampled(domains: DataFrame, most: int) -> DataFrame:
    """About ``most`` labelled documents, taken by a hash of the id: the bound of the classifier's training."""
    found = domains.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = most / max(1, found.count())
    return found if share >= 1 else found.filter(unit_hash(F.col("doc_id"), F.lit("mixing")) < share)


def classifier(docs: DataFrame, domains: DataFrame, most: int = 20_000) -> tuple[list[str], list[float], DataFrame]:
    """Names of the domains, their log priors, and (bucket, weights) with a weight for each domain."""
    some = stored(sampled(domains, most).withColumnRenamed("doc_id", "labelled"), "labelled")
    priors = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(priors)
    rows = joined(docs, some, docs["doc_id"] == some["labelled"]).select("domain", "text")
    counts = token_buckets(rows, "domain").filter("one = 1").groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"c{k}") for k, d in enumerate(names)], F.count(F.lit(1)).cast("double").alias("c")
    )
    counts = stored(counts, "counts")
    totals = counts.agg(F.sum("c").alias("c"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(names))]).first()

    def weight(k: int) -> Column:
        share = F.col("c") / F.lit(totals["c"] or 1.0)
        return F.log((F.col(f"c{k}") + PULL * share) / ((F.lit(totals[f"c{k}"] or 0.0) + PULL) * share))

    table = counts.select("bucket", *[weight(k).alias(f"w{k}") for k in range(len(names))])
    whole = sum(priors.values())
    return names, [float(np.log(priors[d] / whole)) for d in names], stored(table, "weights")


def posteriors(docs: DataFrame, names: list[str], priors: list[float], weights: DataFrame, temperature: float = 2.0) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ... in the order of ``names``. ``weights`` has at most BUCKETS rows."""
    each = token_buckets(docs, "doc_id").join(F.broadcast(weights), "bucket", "left")
    sums = each.groupBy("doc_id").agg(F.sum("one").alias("n_tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))])
    score = [(F.col(f"s{k}") + F.lit(priors[k])) / temperature for k in range(len(names))]
    top = F.greatest(*score) if len(score) > 1 else (score[0] if score else None)
    sums = sums.select("doc_id", "n_tokens", *[F.exp(s - top).alias(f"e{k}") for k, s in enumerate(score)])
    whole = sum((F.col(f"e{k}") for k in range(len(names))), F.lit(0.0))
    return sums.select("doc_id", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(names))])


def fitted(members: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None, steps: int = 40, close: float = 1e-6) -> DataFrame:
    """``members`` with a rate. Targets are shares of ``budget`` tokens, by default of all tokens."""
    size = len(names)
    a = [F.col("n_tokens") * F.col(f"p{k}") for k in range(size)]
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(a)]
    sums += [F.sum(a[i] * a[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i + 1)]
    r = members.agg(F.sum("n_tokens").alias("n"), *sums).first()
    total = float(r["n"] or 0)
    if not size or not total:
        return members.withColumn("rate", F.lit(1.0))
    gram = np.array([[r[f"g{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)], float)
    inverse = np.linalg.pinv(gram + np.eye(size) * 1e-12 * np.trace(gram), hermitian=True)
    budget = total if budget is None else float(budget)
    whole = sum(targets.get(d, 0.0) for d in names)
    if whole <= 0:
        raise ValueError(f"no target for any of the domains {names}")
    goal = np.array([targets.get(d, 0.0) / whole * budget for d in names])
    start = budget / total
    moves: list[list[float]] = []

    def rate() -> Column:
        if not moves:
            return F.lit(start)
        vectors = F.array(*[F.array(*map(F.lit, v)) for v in moves])

        def step(w, v):
            return F.greatest(F.lit(0.0), w - sum((a[k] * v[k] for k in range(size)), F.lit(0.0)))

        return F.aggregate(vectors, F.lit(start), step)

    for _ in range(steps):
        rated = members.withColumn("rate", rate())
        now = rated.agg(*[F.sum(F.col("rate") * a[k]).alias(f"t{k}") for k in range(size)]).first()
        wrong = np.array([now[f"t{k}"] for k in range(size)]) - goal
        if np.abs(wrong).max() <= close * budget:
            break
        moves.append([float(x) for x in inverse @ wrong])
    return members.withColumn("rate", rate())


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float], budget: float | None = None, doc_id: str = "doc_id", text: str = "text", most_labelled: int = 20_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (likeliest), posteriors (domain -> share), rate."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))
    names, priors, weights = classifier(rows, domains, most_labelled)
    members = stored(posteriors(rows, names, priors, weights), "members")
    rated = fitted(members, names, targets, budget)
    if not names:
        empty = F.create_map().cast("map<string,double>")
        return rated.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), empty.alias("posteriors"), "rate")
    likeliest = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(names)]))["d"]
    shares = F.create_map(*[x for k, d in enumerate(names) for x in (F.lit(d), F.col(f"p{k}"))])
    return rated.select("doc_id", "n_tokens", likeliest.alias("domain"), shares.alias("posteriors"), "rate")


def mixed(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents as often as their rate says: its whole part, and once more with its fraction's chance.

    The chance is a hash of the id, so the mixture is the same in every run.
    """
    some = stored(rates.select(F.col("doc_id").alias("rated"), "rate"), "rates")
    # The table's columns travel in a struct, so that none can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("key"))
    extra = (unit_hash(F.col("key").cast("string"), F.lit("mixed")) < F.col("rate") - F.floor("rate")).cast("int")
    both = joined(rows, some, rows["key"].eqNullSafe(some["rated"])).withColumn("times", (F.floor("rate") + extra).cast("int"))
    return both.filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
