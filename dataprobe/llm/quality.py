"""Quality classifier: document evidence combined with site priors by hierarchical empirical Bayes.

A document's evidence comes from two logistic models, one for low quality and one for toxic text, over shape
features (symbols, capitals, repetition, compressibility) and learned word weights. Word weights are log odds of
document counts in the labelled rows, shrunk towards none. The probability of a good document is that neither holds.

Sites are two levels, host and path. The mean of a host is pulled towards the global mean, that of a path towards
its host's, by Beta priors whose strengths come from how much hosts (paths) really differ (method of moments over
grouped sums). A document's posterior adds the log odds of its path to its own evidence.

Fitting uses at most ``sample`` labelled rows, those with the smallest hashes; everything else covers all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import column, encode, free_names, portions, tokens, words
from dataprobe.scratch import materialise

SAMPLE = 20_000
LEXICON = 2_000
MIN_DOCS = 5
MIN_Z = 4.0
SHRINK = 5.0
THRESHOLD = 0.5
#: hosts and paths that are sent to every task; more are joined by shuffle
FEW_SITES = 100_000
#: how strongly a site may differ at most: prior strength is at least this many documents
MIN_STRENGTH = 20.0

_SYMBOLS = b"#$%&*|<>{}~^=\\@_"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
NAMES = ("length", "symbols", "capitals", "marks", "digits", "most", "variety", "echo", "word_length", "lines", "packed", "low_max", "low_mean", "toxic_max", "toxic_sum")


@dataclass
class Model:
    low: dict[bytes, float] = field(default_factory=dict)
    toxic: dict[bytes, float] = field(default_factory=dict)
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(NAMES)))
    w_low: np.ndarray = field(default_factory=lambda: _never())
    w_toxic: np.ndarray = field(default_factory=lambda: _never())

    def good(self, x: np.ndarray) -> np.ndarray:
        """Probability that neither low quality nor toxic text holds, for rows of features."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        z = np.hstack([z, np.ones((len(z), 1))])
        return (1 - _logistic(z @ self.w_low)) * (1 - _logistic(z @ self.w_toxic))


def _never() -> np.ndarray:
    """Weights of a model that has seen no labels: nothing is low or toxic."""
    return np.append(np.zeros(len(NAMES)), -9.0)


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def features(text: str | None, low: dict[bytes, float], toxic: dict[bytes, float]) -> list[float]:
    raw = encode(text)
    ws = tokens(text)
    n, size = max(len(ws), 1), max(len(raw), 1)
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    count = Counter(ws)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    known = set(words(text))
    found_low = [low[w] for w in known & low.keys()]
    found_toxic = [toxic[w] for w in known & toxic.keys()]
    return [
        math.log1p(len(ws)), share(_SYMBOLS), share(_UPPER), share(b"!?"), share(_DIGITS), max(count.values(), default=0) / n, len(count) / n,
        sum(map(bytes.__eq__, ws, ws[1:])) / n, sum(map(len, ws)) / n, 1 - len(set(lines)) / max(len(lines), 1), len(zlib.compress(raw, 1)) / size,
        max(found_low, default=0.0), sum(found_low) / n, max(found_toxic, default=0.0), sum(x for x in found_toxic if x > 0),
    ]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; x already has a column of ones at the end."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], penalty)
    pull[-1] = 1e-6
    for _ in range(50):
        p = _logistic(x @ w)
        grad = x.T @ (p - y) + pull * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_odds(rows: list, kind: str, n_yes: int, n_no: int, most: int) -> dict[bytes, float]:
    """Words whose document counts differ between the classes beyond chance, with log odds shrunk as if ``SHRINK``
    more documents held the word at the overall rate."""
    if not n_yes or not n_no:
        return {}
    out = []
    for r in rows:
        a, b = r[kind], r["n"] - r[kind]
        z = (math.log((a + 0.5) / (n_yes - a + 0.5)) - math.log((b + 0.5) / (n_no - b + 0.5))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if abs(z) >= MIN_Z:
            p = n_yes / (n_yes + n_no)
            value = math.log((a + SHRINK * p) / (b + SHRINK * (1 - p))) - math.log(p / (1 - p))
            out.append((-abs(z), r["word"], value))
    return {bytes(w): v for _, w, v in sorted(out)[:most]}


def _word_counts(train: DataFrame) -> DataFrame:
    """word, n, low, toxic: labelled documents that hold a word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, low, toxic = Counter(), Counter(), Counter()
            for text, is_low, is_toxic in zip(column(b, "text"), column(b, "low"), column(b, "toxic")):
                ws = set(words(text))
                n.update(ws)
                if is_low:
                    low.update(ws)
                if is_toxic:
                    toxic.update(ws)
            ws = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([n[w] for w in ws], pa.int64()), pa.array([low[w] for w in ws], pa.int64()), pa.array([toxic[w] for w in ws], pa.int64())], ["word", "n", "low", "toxic"])

    counts = train.select("text", "low", "toxic").mapInArrow(scan, "word binary, n long, low long, toxic long")
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """The document model from at most ``sample`` labelled rows. Without labelled rows every document is good."""
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg((F.min("quality") == 0).alias("low"), (F.max("toxic") == 1).alias("toxic"))
    chosen = known.fillna(False, ["low", "toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most ``sample`` rows of an id and two flags: the texts need no shuffle to find them
    train = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "low", "toxic"]).persist()
    total = train.agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.count_if("toxic").alias("toxic")).first()
    model = Model()
    if total["n"] == 0:
        train.unpersist()
        return model
    # the words of a bounded sample; those kept are at most 2 * lexicon
    rows = _word_counts(train).filter(F.col("n") >= MIN_DOCS).filter((_z("low", total) >= MIN_Z) | (_z("toxic", total) >= MIN_Z)).collect()
    model.low = _log_odds(rows, "low", total["low"], total["n"] - total["low"], lexicon)
    model.toxic = _log_odds(rows, "toxic", total["toxic"], total["n"] - total["toxic"], lexicon)
    low_words, toxic_words = model.low, model.toxic

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, low_words, toxic_words) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "low", "toxic"])

    got = sorted(train.select("text", "low", "toxic").mapInArrow(scan, "x array<double>, low boolean, toxic boolean").collect())
    train.unpersist()
    x = np.array([r["x"] for r in got])
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.clip((x - model.centre) / model.scale, -8, 8), np.ones((len(x), 1))])
    model.w_low = _fit(z, np.array([r["low"] for r in got], float))
    model.w_toxic = _fit(z, np.array([r["toxic"] for r in got], float))
    return model


def _z(kind: str, total) -> Column:
    """The size of a word's log odds in standard errors, as in ``_log_odds``."""
    yes, no = total[kind], total["n"] - total[kind]
    a, b = F.col(kind), F.col("n") - F.col(kind)
    value = F.log((a + 0.5) / (F.lit(yes) - a + 0.5)) - F.log((b + 0.5) / (F.lit(no) - b + 0.5))
    return F.abs(value / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))) + F.lit(1e-9)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "_good") -> DataFrame:
    """All columns of ``docs`` and ``name``, the document's own probability of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in portions(batches, text):
            x = np.array([features(t, m.low, m.toxic) for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(m.good(x), 1e-6, 1 - 1e-6))], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{schema}, `{name}` double")


def _strength(rows: DataFrame, total: Column, n: Column, parent: Column) -> Column:
    """Prior strength (in documents) of a level: within-site variance over the variance between sites."""
    mean = total / n
    spread = F.sum(n * (mean - parent) * (mean - parent))
    noise = F.sum(n * parent * (1 - parent) / n)
    weight = F.sum(n) - F.sum(n * n) / F.sum(n)
    between = F.greatest((spread - noise) / F.greatest(weight, F.lit(1.0)), F.lit(1e-9))
    within = F.sum(n * parent * (1 - parent)) / F.sum(n)
    return F.greatest(within / between, F.lit(MIN_STRENGTH))


def site_priors(scored: DataFrame, host: str = "_host", path: str = "_path") -> DataFrame:
    """One row per host and path: ``_host, _path, prior`` and ``overall`` (the global mean)."""
    paths = scored.groupBy(host, path).agg(F.sum("_good").alias("s"), F.count("*").cast("double").alias("n"))
    overall = paths.agg((F.sum("s") / F.sum("n")).alias("overall"))
    hosts = paths.groupBy(host).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")).crossJoin(F.broadcast(overall))  # one row
    strength = hosts.agg(_strength(hosts, F.col("hs"), F.col("hn"), F.col("overall")).alias("k1"))
    hosts = hosts.crossJoin(F.broadcast(strength)).withColumn("hm", (F.col("hs") + F.col("k1") * F.col("overall")) / (F.col("hn") + F.col("k1")))
    both = paths.join(hosts.select(host, "hm", "overall"), host)
    strength = both.agg(_strength(both, F.col("s"), F.col("n"), F.col("hm")).alias("k2"))
    both = both.crossJoin(F.broadcast(strength))
    return both.select(host, path, ((F.col("s") + F.col("k2") * F.col("hm")) / (F.col("n") + F.col("k2"))).alias("_prior"), F.col("overall").alias("_overall"))


def _posterior(good: str, prior: str, overall: str) -> Column:
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    return 1 / (1 + F.exp(-(odds(good) + odds(prior) - odds(overall))))


def _with_posterior(scored: DataFrame, priors: DataFrame) -> DataFrame:
    return scored.join(priors, ["_host", "_path"]).withColumn("_posterior", _posterior("_good", "_prior", "_overall"))


def _site(c: str | None) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c else F.lit("")


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str | None = "source", path: str | None = "lang", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per row: doc_id, document (its own probability), prior (its path's), posterior, keep.

    Null texts are empty, null hosts and paths are the site ''. Repeated rows count and are judged each; an empty
    table gives no rows; without labels every document stays.
    """
    model = model or fit(docs, labels, doc_id=doc_id, text=text)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), _site(host).alias("_host"), _site(path).alias("_path"))
    scored = materialise(score(base, model).drop("text"), "quality")
    out = _with_posterior(scored, site_priors(scored))
    return out.select("doc_id", F.col("_good").alias("document"), F.col("_prior").alias("prior"), F.col("_posterior").alias("posterior"), (F.col("_posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str | None = "source", path: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever these are called.

    Every text is scored once; the rows are written with their own probability, the sites' priors come from that
    table, and the rows are not shuffled where the sites are few enough to send to every task. Null texts are empty,
    null hosts and paths the site ''; repeated rows are judged alike; an empty table gives no rows; without labels
    every document stays.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text)
    good, at_host, at_path, prior, overall, other_host, other_path = free_names(docs, "_good", "_host", "_path", "_prior", "_overall", "_host2", "_path2")
    scored = materialise(score(docs.withColumns({at_host: _site(host), at_path: _site(path)}), model, text=text, name=good), "quality")
    judged = site_priors(scored.select(F.col(at_host).alias("_host"), F.col(at_path).alias("_path"), F.col(good).alias("_good")))
    sites = materialise(judged.select(F.col("_host").alias(other_host), F.col("_path").alias(other_path), F.col("_prior").alias(prior), F.col("_overall").alias(overall)), "sites")
    sites = F.broadcast(sites) if sites.count() <= FEW_SITES else sites
    both = scored.join(sites, (F.col(at_host) == F.col(other_host)) & (F.col(at_path) == F.col(other_path)))
    return both.filter(_posterior(good, prior, overall) >= threshold).select(*[f"`{c}`" for c in docs.columns])
