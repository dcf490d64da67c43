"""Quality classifier: a document's own evidence and the posteriors of its host and path, by empirical Bayes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.session import cut

FIT_ROWS, THRESHOLD = 20_000, 0.5
EDGE = 1e-4


def features(text: Column) -> list[Column]:
    """Shares and means that do not depend on the language; all 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n  # noqa: E731  of what the pattern leaves
    words = F.split(text, r"\s+")
    count = F.greatest(F.size(words), F.lit(1))
    filled = text != ""
    return [
        F.when(filled, c).otherwise(0.0).cast("double").alias(name)
        for name, c in (
            ("upper", 1 - share("[A-Z]+")),
            ("symbol", 1 - share(r"[!#$%&*+/<=>@\\^_`{|}~]+")),
            ("digit", 1 - share("[0-9]+")),
            ("word", F.least(n / count, F.lit(40.0)) / 10),
            ("distinct", F.size(F.array_distinct(words)) / F.sqrt(count)),
            ("repeated", 1 - F.size(F.array_distinct(words)) / count),
            ("length", F.log1p(n)),
        )
    ]


NAMES = ["upper", "symbol", "digit", "word", "distinct", "repeated", "length"]


def evidence(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), *features(text))


def fit(seen: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on at most ``rows`` labelled documents (those of smallest id
    hash), by Newton steps with a ridge. Null labels and labels without document do not count; a document with
    several labels counts with each distinct one. Without both classes all documents count as good."""
    known = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null").distinct()
    sample = seen.join(known, "id").orderBy(F.xxhash64("id"), "id", "label", *NAMES).limit(rows).select(*NAMES, "label").collect()
    x, y = np.array([r[:-1] for r in sample], float).reshape(-1, len(NAMES)), np.array([r[-1] for r in sample], float)
    if len(set(y)) < 2:
        return np.zeros(len(NAMES)), 5.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(len(NAMES), 1.0), 1e-3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def probability(model: tuple[np.ndarray, float]) -> Column:
    weights, constant = model
    z = sum((F.col(n) * float(w) for n, w in zip(NAMES, weights)), F.lit(float(constant)))
    return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(EDGE)), F.lit(1 - EDGE))


def _strength(n: float, mean: float, spread: float, own: float) -> float:
    """Pseudo-observations of a Beta prior, by moments; ``own`` is the variance that finite groups show anyway."""
    between = max(spread - own, 1e-6)
    return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e4)) if n else 1.0


def posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Per (host, path) the sums and counts of path and host; the global mean and the strengths of both priors.

    Grouped sums only, with map-side aggregation: a host of a third of all rows is one row per task. Three numbers
    come to the driver. The variance among hosts around the global mean, and among paths around their host, each
    less its sampling part, give the priors; sparse hosts and paths are shrunk toward host and global mean."""
    paths = cut(scored.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count(F.lit(1)).alias("path_n")))
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    both = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    total = both.agg(F.sum("path_sum").alias("s"), F.sum("path_n").alias("n")).first()
    mean = float(np.clip((total["s"] or 0.0) / max(total["n"] or 0, 1), EDGE, 1 - EDGE))
    path_rate, host_rate = F.col("path_sum") / F.col("path_n"), F.col("host_sum") / F.col("host_n")
    moments = both.agg(
        (F.sum(F.col("path_n") * (host_rate - mean) ** 2) / F.sum("path_n")).alias("host_spread"),
        (F.sum(F.col("path_n") / F.col("host_n")) * mean * (1 - mean) / F.sum("path_n")).alias("host_own"),
        (F.sum(F.col("path_n") * (path_rate - host_rate) ** 2) / F.sum("path_n")).alias("path_spread"),
        (F.count(F.lit(1)) * mean * (1 - mean) / F.sum("path_n")).alias("path_own"),
    ).first()
    strong = [_strength(total["n"] or 0, mean, moments[f"{x}_spread"] or 0.0, moments[f"{x}_own"] or 0.0) for x in ("host", "path")]
    return both, mean, strong[0], strong[1]


def combined(df: DataFrame, groups: tuple[DataFrame, float, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds host_posterior, path_posterior, score, keep to rows with host, path and p. A document's own evidence is
    taken out of its groups first, so that it counts once."""
    both, mean, k_host, k_path = groups
    both = both.withColumnsRenamed({"host": "g_host", "path": "g_path"})
    joined = df.join(both, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")), "left")
    host = (k_host * mean + F.col("host_sum") - F.col("p")) / (k_host + F.col("host_n") - 1)
    path = (k_path * host + F.col("path_sum") - F.col("p")) / (k_path + F.col("path_n") - 1)
    inside = lambda c: F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    logit = lambda c: F.log(c / (1 - c))
    z = logit(F.col("p")) + logit(inside(path)) - F.lit(float(np.log(mean / (1 - mean))))
    score = 1 / (1 + F.exp(-z))
    return joined.withColumns({"host_posterior": inside(host), "path_posterior": inside(path), "score": score, "keep": score >= threshold}).drop("g_host", "g_path", "path_sum", "path_n", "host_sum", "host_n")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: id, doc_probability, host_posterior, path_posterior, score, keep.

    score is the posterior probability of good quality: the log-odds of the document's features plus those of its
    path's posterior less the global ones. A path is (host, path). Null or empty text has features 0; a null host
    or path is a group of its own; repeated rows count each; an empty table gives no rows. ``fit_rows`` bounds the
    labelled sample; sums and priors cover all documents.
    """
    seen = cut(evidence(docs, id_col, text_col, host_col, path_col))
    scored = seen.select("id", "host", "path", probability(fit(seen, labels, rows=fit_rows)).alias("p"))
    out = combined(scored, posteriors(scored), threshold)
    return out.select(F.col("id").alias(id_col), F.col("p").alias("doc_probability"), "host_posterior", "path_posterior", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that classify keeps. The texts are not shuffled while the group table is
    small enough for Spark to broadcast by its own limit."""
    seen = cut(evidence(docs, id_col, text_col, host_col, path_col))
    model = fit(seen, labels, rows=fit_rows)
    groups = posteriors(seen.select("id", "host", "path", probability(model).alias("p")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), *features(text))
    scored = rows.select("row", "host", "path", probability(model).alias("p"))
    return combined(scored, groups, threshold).where("keep").select("row.*")
