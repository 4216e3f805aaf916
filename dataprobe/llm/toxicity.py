"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text, the beginnings of its words and three figures (length, share and number of
telling words). What is telling is chosen by how much more often it stands in documents labelled toxic. Labels often
blame the mere mention of a group, because hostile texts mention groups more. So every labelled sentence that names
one is written again with each identity term swapped for others of its kind, a neutral word among them, and the fit
adds a penalty on the squared change of the score between the two. Words for groups can then add to a score only what
their whole kind, neutral words included, adds: nothing.

Learning uses at most ``sample`` labelled rows and ``sentences`` pairs of sentences, those with the smallest
hashes, from the given part of the labels only; scoring covers every whole text and sees nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import column, encode, words
from dataprobe.scratch import materialise

SAMPLE = 20_000
SENTENCES = 20_000
TELLING = 800
MIN_DOCS = 5
#: twice the log likelihood ratio that a telling feature reaches at least; 16 is four standard errors
MIN_RATIO = 16.0
#: strength of the penalty on score changes, relative to the loss of all training rows
COUNTERFACTUAL = 10.0
#: swaps of each sentence
SWAPS = 3
#: lengths in bytes of the word beginnings; longer words only, the whole word stands for itself
STEMS = (4, 5, 6, 7, 8)
HELD_OUT_OF = 5

# identity terms by kind; the first of each kind are neutral words
IDENTITY = {
    "gender": "people person persons women woman men man girls girl boys boy females males female male trans transgender mothers fathers wives husbands leute frauen frau männer mann mädchen jungen gente mujeres mujer hombres hombre chicas chicos gens femmes femme hommes homme filles garçons",
    "faith": "people believers muslims muslim jews jew jewish christians christian catholics catholic hindus hindu buddhists buddhist atheists atheist islamic leute muslime juden christen katholiken gente musulmanes judíos cristianos católicos gens musulmans juifs chrétiens catholiques",
    "origin": "people neighbours immigrants immigrant migrants migrant refugees refugee foreigners foreigner blacks black whites white asians asian africans african arabs arab latinos latino mexicans mexican chinese indians indian americans american europeans european natives gypsies roma leute ausländer flüchtlinge einwanderer schwarze weiße afrikaner araber gente inmigrantes refugiados extranjeros negros blancos africanos árabes gens immigrés réfugiés étrangers noirs blancs africains arabes",
    "orientation": "people couples gays gay lesbians lesbian straight homosexuals homosexual heterosexual bisexuals bisexual queer leute schwule lesben gente homosexuales lesbianas gens homosexuels lesbiennes",
    "body": "people patients disabled deaf blind autistic elderly old young leute behinderte taube blinde alte junge gente discapacitados sordos ciegos ancianos jóvenes gens handicapés sourds aveugles vieux jeunes",
}
_DENSE = 3
_SENTENCE = re.compile(rb"[.!?\n]+")


def _swaps() -> dict[bytes, list[bytes]]:
    """Each term with its counterparts, spread over the list of its kind and the neutral word first."""
    out: dict[bytes, list[bytes]] = {}
    for listed in IDENTITY.values():
        kind = [w.encode() for w in listed.split()]
        for i, w in enumerate(kind):
            others = [kind[0]] + [kind[(i + 1 + k * max(1, len(kind) // SWAPS)) % len(kind)] for k in range(SWAPS - 1)]
            out.setdefault(w, [o for o in others if o != w])
    return out


COUNTERPARTS = _swaps()


@dataclass
class Model:
    """``place`` of each feature, its weight, and centre and scale of the dense figures, which come first."""

    place: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.append(np.zeros(_DENSE), -9.0))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(_DENSE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(_DENSE))
    terms: frozenset[bytes] = frozenset()

    def __post_init__(self) -> None:
        self.whole = {w for w in self.place if not w.endswith(b"*")}
        self.stems = {k: {w[:-1] for w in self.place if w.endswith(b"*") and len(w) == k + 1} for k in STEMS}

    def found(self, ws: list[bytes]) -> tuple[list[int], list[float]]:
        """Places of the features of a list of words, and the raw dense figures. Identity terms are no telling words."""
        seen = set(ws)
        hit = seen & self.whole
        places = [self.place[w] for w in hit]
        telling = hit - self.terms
        for k, stems in self.stems.items():
            if stems:
                longer = [w for w in seen if len(w) > k and w[:k] in stems]
                places += {self.place[w[:k] + b"*"] for w in longer}
                telling.update(longer)
        n = sum(1 for w in ws if w in telling) if telling else 0
        return places, [math.log1p(len(ws)), n / (len(ws) + 10), math.log1p(n)]

    def logit(self, places: list[int], dense: list[float]) -> float:
        z = np.clip((np.array(dense) - self.centre) / self.scale, -8, 8)
        return float(z @ self.weights[:_DENSE] + self.weights[places].sum() + self.weights[-1])

    def score(self, ws: list[bytes]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(*self.found(ws))))))


def swapped(ws: list[bytes]) -> Iterator[list[bytes]]:
    """The words with every identity term replaced by its first, second, ... counterpart."""
    if any(w in COUNTERPARTS for w in ws):
        for i in range(SWAPS):
            yield [COUNTERPARTS[w][i % len(COUNTERPARTS[w])] if w in COUNTERPARTS else w for w in ws]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % HELD_OUT_OF == 0, F.lit(False))


def _features(text: str | None) -> set[bytes]:
    """Words and word beginnings; beginnings end in *, which no word holds."""
    seen = set(words(text))
    return seen | {w[:k] + b"*" for k in STEMS for w in seen if len(w) > k}


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic`` of at most ``sample`` different rows, written once."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    # ids first, at most ``sample`` of them, so that finding their rows needs no shuffle; then rows, since ids may repeat
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    kept = rows.select("doc_id", "_row").distinct().orderBy("_row", "doc_id").limit(sample)
    rows = rows.join(F.broadcast(kept), ["doc_id", "_row"])
    return materialise(rows.dropDuplicates(["doc_id", "_row"]).select("text", "toxic"), "toxic-labelled")


def _telling(train: DataFrame, yes: int, no: int, most: int) -> list[bytes]:
    """The features that stand in clearly more toxic documents than chance, and every identity term that occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bad = Counter(), Counter()
            for text, toxic in zip(column(b, "text"), column(b, "toxic")):
                found = _features(text)
                n.update(found)
                if toxic:
                    bad.update(found)
            names = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n[w] for w in names], pa.int64()), pa.array([bad[w] for w in names], pa.int64())], ["w", "n", "bad"])

    counts = train.mapInArrow(scan, "w binary, n long, bad long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    # likelihood ratio of "toxic documents hold it more often" over "all hold it alike": a feature without any clean document counts fully
    part = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    y, c = F.lit(yes), F.lit(no)
    ratio = 2 * (part(a) + part(b) + part(y - a) + part(c - b) - part(F.col("n")) - part(y + c - F.col("n")) - part(y) - part(c) + part(y + c))
    named = F.col("w").isin([bytearray(w) for w in COUNTERPARTS])
    above = (a * no > b * yes) & (F.col("n") >= MIN_DOCS) & ~named
    top = counts.withColumn("ratio", ratio).filter(above & (F.col("ratio") >= MIN_RATIO)).orderBy(F.col("ratio").desc(), "w").limit(most)
    # two bounded lists: the chosen features and the terms of the fixed lists
    return [bytes(r["w"]) for r in top.select("w").collect()] + sorted(bytes(r["w"]) for r in counts.filter(named).select("w").collect())


def _fit(x: np.ndarray, y: np.ndarray, gaps: np.ndarray, penalty: float, counterfactual: float) -> np.ndarray:
    """Newton steps for the logistic loss, a ridge and the squared score changes of the sentence pairs (rows of ``gaps``)."""
    pull = np.full(x.shape[1], penalty)
    pull[-1] = 1e-6
    square = gaps.T @ gaps * (counterfactual * len(x) / max(len(gaps), 1)) + np.diag(pull)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + square, x.T @ (p - y) + square @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sentences: int = SENTENCES, telling: int = TELLING, counterfactual: float = COUNTERFACTUAL, penalty: float = 1.0) -> Model:
    """The model from labelled rows whose checksum leaves them in. Without labels of both kinds nothing is toxic.

    Rows with a null id or label and labels without a document teach nothing; contradicting labels of an id count as
    toxic; repeated rows count once.
    """
    train = _training(_base(docs, doc_id, text), labels, sample)
    total = train.agg(F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no")).first()
    if not total["yes"] or not total["no"]:
        return Model()
    features = _telling(train, total["yes"], total["no"], telling)
    raw = Model({w: _DENSE + i for i, w in enumerate(features)}, np.zeros(_DENSE + len(features) + 1), terms=frozenset(COUNTERPARTS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [raw.found(words(t)) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(r[0]) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array(column(b, "toxic"))], ["places", "dense", "toxic"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in column(b, "text"):
                for part in _SENTENCE.split(encode(t)):
                    ws = words(part.decode("utf-8", "replace"))
                    out += [(b" ".join(ws), *raw.found(ws), *raw.found(other)) for other in swapped(ws)]
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[i]) for c, i in zip(cols, (0, 1, 2, 1, 2))], ["s", "a", "da", "b", "db"])

    got = sorted(train.mapInArrow(scan, "places array<int>, dense array<double>, toxic boolean").collect())
    changed = train.mapInArrow(pairs, "s binary, a array<int>, da array<double>, b array<int>, db array<double>").distinct()
    changed = changed.orderBy(F.xxhash64("s"), "s", "b").limit(sentences).collect()
    dense = np.array([r["dense"] for r in got])
    raw.centre, raw.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)

    def matrix(places: list, figures: list) -> np.ndarray:
        x = np.zeros((len(places), len(raw.weights)), np.float32 if len(places) > 1000 else np.float64)
        if len(places):
            x[:, :_DENSE] = np.clip((np.array(figures) - raw.centre) / raw.scale, -8, 8)
            x[np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate([np.array(p, np.int64) for p in places])] = 1
        x[:, -1] = 1
        return x

    y = np.array([r["toxic"] for r in got], float)
    gaps = matrix([r["a"] for r in changed], [r["da"] for r in changed]) - matrix([r["b"] for r in changed], [r["db"] for r in changed])
    weights = _fit(matrix([r["places"] for r in got], dense), y, gaps, penalty, counterfactual)
    return Model(raw.place, weights, raw.centre, raw.scale, raw.terms)


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out (its label was not learnt from), score, predicted (score of 0.5 or more), mentions
    (identity terms in the text) and swap_gap (the largest change of the score when they are swapped).

    Null texts are empty and are scored like any other; repeated rows are scored each; a null id is not held out;
    an empty table gives no rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores, mentions, gaps = [], [], []
            for t in column(b, "text"):
                ws = words(t)
                scores.append(m.score(ws))
                named = COUNTERPARTS.keys() & set(ws)
                mentions.append(sum(1 for w in ws if w in named) if named else 0)
                gaps.append(max((abs(m.score(o) - scores[-1]) for o in swapped(ws)), default=0.0) if named else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(mentions, pa.int64()), pa.array(gaps, pa.float64())], ["doc_id", "held_out", "score", "predicted", "mentions", "swap_gap"])

    base = _base(docs, doc_id, text)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int, mentions long, swap_gap double")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``score`` with the model learnt from the same table and its labels, unless one is given."""
    return score(docs, model or fit(docs, labels, doc_id=doc_id, text=text), doc_id=doc_id, text=text)
