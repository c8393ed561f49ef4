"""Quality classifier with hierarchical empirical Bayes over sites.

1. A logistic regression on features of the whole text gives each document's evidence, the
   log odds of being good.
2. Grouped sums of the documents' probabilities give each site a posterior, shrunk toward the
   global prior, and each section of a site (path level) one shrunk toward its site.  The
   strength of shrinking is estimated from the spread between groups, so groups with few
   documents stay near their prior.
3. A document's final log odds are its evidence plus how far its section's posterior, without
   the document itself, lies from the global prior.

``documents`` has no urls: its ``source`` is the site and ``lang`` the section.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.settle import settle

FEATURES = ("distinct", "adjacent", "upper", "digit", "mark", "symbol", "word_length", "log_words", "bare_mark", "marked_end")
#: Labelled rows used to fit, at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
_EPSILON = 1e-6

_LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _SPACE, _HIGH = range(7)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL)
    out[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
    out[list(b"0123456789")] = _DIGIT
    out[list(b".,;:'\"?-()")] = _MARK
    out[list(b" \t\n\r\x0b\x0c")] = _SPACE
    out[128:] = _HIGH
    return out


_CLASSES = _byte_classes()


def text_features(text: str | None) -> list[float]:
    """FEATURES of one text; all zero for a null or wordless one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    classes = np.bincount(_CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 7)
    shown = classes.sum() - classes[_SPACE]
    ends = _CLASSES[np.fromiter((w[-1] for w in words), np.uint8, n)]
    return [
        len(set(words)) / n**0.9,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        classes[_UPPER] / shown,
        classes[_DIGIT] / shown,
        classes[_MARK] / shown,
        classes[_SYMBOL] / shown,
        float(shown / n),
        float(np.log1p(n)),
        sum(len(w) == 1 and _CLASSES[w[0]] == _SYMBOL for w in words) / n if classes[_SYMBOL] else 0.0,
        float((ends == _SYMBOL).sum()) / n,
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([text_features(t.as_py()) for t in b.column("text")], np.float64).reshape(-1, len(FEATURES))
        columns = [b.column("id"), b.column("site"), b.column("section"), *(pa.array(values[:, i]) for i in range(len(FEATURES)))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "site", "section", *FEATURES])


@dataclass(frozen=True)
class Logistic:
    """Coefficients on the features as they are."""

    intercept: float
    weights: tuple[float, ...]

    def log_odds(self) -> Column:
        terms = [F.col(f) * w for f, w in zip(FEATURES, self.weights, strict=True)]
        return sum(terms, F.lit(self.intercept))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Logistic:
    """Ridge-penalised logistic regression by Newton steps on standardised features; without both labels, only the smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Logistic(float(np.log(rate / (1 - rate))), (0.0,) * x.shape[1])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    beta[0] = np.log(rate / (1 - rate))
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / scale
    return Logistic(float(beta[0] - weights @ mean), tuple(weights.tolist()))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EPSILON)), F.lit(1 - _EPSILON))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> DataFrame:
    """One row: pseudo-count of the prior, by moments over groups with columns n, total and the given prior.

    The spread of group rates beyond what binomial noise explains is the spread of true
    rates; a wide spread means weak shrinking.  Between 1 and 1e6.
    """
    rate = F.col("total") / F.col("n")
    noise = prior * (1 - prior)
    sums = groups.agg(
        F.sum(F.col("n") * (rate - prior) ** 2 - noise).alias("excess"), F.sum("n").alias("weight"), F.sum(F.col("n") * noise).alias("noise"), F.count(F.lit(1)).alias("groups")
    )
    between = F.col("excess") / F.greatest(F.col("weight") - F.col("groups"), F.lit(1.0))
    raw = F.col("noise") / F.col("weight") / F.greatest(between, F.lit(1e-12)) - 1
    return sums.select(F.coalesce(F.least(F.greatest(raw, F.lit(1.0)), F.lit(1e6)), F.lit(1e6)).alias("strength"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", section_col: str = "lang",
    label_col: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per document row: id, p_document, site_posterior, section_posterior, p_quality, kept.

    Fitted on at most ``fit_rows`` labelled rows (null labels count as unlabelled; without any
    labels every document has even odds); all statistics cover all documents.  A null site or
    section is a group of its own.  Null and empty texts have zero features.  Repeated rows
    are judged each; an empty table gives none.  ``kept`` is p_quality >= threshold.
    """
    bounded_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), name(site_col).alias("site"), name(section_col).alias("section"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, site string, section string, " + ", ".join(f"{f} double" for f in FEATURES)
    features = settle(rows.mapInArrow(_featured, schema))

    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    labelled = settle(features.join(marked, "id").select(F.xxhash64("id", "label").alias("order"), "label", *FEATURES))
    # A little more than the share of rows that is wanted, by hash; the rest is cut after sorting.
    share = min(1.0, 1.1 * fit_rows / max(labelled.count(), 1))
    drawn = labelled.where(F.shiftrightunsigned("order", 11) <= F.lit(int(share * (1 << 53)))).collect()
    data = np.array(sorted(drawn)[:fit_rows], np.float64).reshape(-1, len(FEATURES) + 2)[:, 1:]
    model = fit_logistic(data[:, 1:], data[:, 0])

    scored = features.select("id", "site", "section", model.log_odds().alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sections = settle(scored.groupBy("site", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")))
    one = sections.agg((F.sum("total") / F.sum("n")).alias("global_prior"))  # one row, like the strengths
    sites = sections.groupBy("site").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(F.broadcast(one))
    sites = sites.join(F.broadcast(_strength(sites, F.col("global_prior")))).withColumn(
        "site_posterior", (F.col("total") + F.col("strength") * F.col("global_prior")) / (F.col("n") + F.col("strength"))
    )
    sites = settle(sites.select("site", "global_prior", "site_posterior"))
    nested = sections.join(sites, "site")
    nested = settle(nested.join(F.broadcast(_strength(nested, F.col("site_posterior")))))

    rest = F.greatest(F.col("total") - F.col("p"), F.lit(0.0)) + F.col("strength") * F.col("site_posterior")
    posterior = rest / (F.col("n") - 1 + F.col("strength"))
    judged = scored.join(nested, ["site", "section"]).withColumn("section_posterior", posterior)
    log_odds = F.col("evidence") + _logit(F.col("section_posterior")) - _logit(F.col("global_prior"))
    return judged.withColumn("p_quality", 1 / (1 + F.exp(-log_odds))).select(
        F.col("id").alias(id_col), F.col("p").alias("p_document"), "site_posterior", "section_posterior", "p_quality", (F.col("p_quality") >= threshold).alias("kept")
    )


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
