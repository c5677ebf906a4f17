"""Operator 2: toxicity by weak supervision.

1. Voters. Every word, and every word beginning of 4 to 6 letters, is a possible lexicon
   voter; those that lean most to labelled toxic documents are kept. Pattern voters look at
   shape: shouting, repeated exclamation marks, stretched letters, masked words.
2. Label model. A generative model takes each voter and the given label as noisy signs of
   a hidden true label. It estimates how often each fires on toxic and on clean documents
   by expectation-maximisation, estimates correlations of voters within the classes, and
   discounts voters by them, so that one word seen through five voters counts about once.
3. Classifier. A ridge-penalised logistic regression learns the posterior labels.

The model is fit on a bounded sample of labelled rows (SAMPLE, by a hash of the id); all
documents are scored. Scoring ships VOTERS words with their weights to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .base import bounded, whole_row, written

#: Most labelled rows a model is fit on (rows, not ids), and most lexicon voters it keeps.
SAMPLE, VOTERS = 20_000, 300
#: A lexicon voter fires in this many toxic sample documents at least.
SUPPORT = 4
#: One row in FOLDS is held out.
FOLDS = 5
#: Rows of the sample that a step of the fit holds as doubles.
ROWS = 2048

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p) for p in (r"\b[A-Z]{4,}(?:\s+[A-Z]{4,})+\b", r"[!?]{3,}", r"([A-Za-z])\1{3,}", r"\b\w+[*#@$]{2,}\w*")]
_PREFIXES = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def voters_of(text: str) -> set[str]:
    """The lexicon voters that fire on a text: its words, and ^beginnings of its words."""
    words = set(_WORD.findall(text.lower()))
    for n in _PREFIXES:
        words |= {"^" + w[:n] for w in words if len(w) > n and w[0] != "^"}
    return words


def patterns_of(text: str) -> list[int]:
    return [i for i, p in enumerate(_PATTERNS) if p.search(text)]


@dataclass
class Model:
    """Voter columns (lexicon words, then patterns), their weights, and the other weights."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(_PATTERNS)))
    hits: float = 0.0
    density: float = 0.0
    bias: float = -20.0

    def fired(self, text: str) -> tuple[list[int], int, int]:
        """Columns of the voters that fire, word occurrences that a lexicon voter covers, and all words."""
        words = Counter(_WORD.findall(text.lower()))
        found, hits, column = set(), 0, self.lexicon.get
        for w, n in words.items():
            own = [c for c in (column(w), *(column("^" + w[:k]) for k in _PREFIXES if len(w) > k)) if c is not None]
            if own:
                found.update(own)
                hits += n
        return sorted(found) + [len(self.lexicon) + i for i in patterns_of(text)], hits, sum(words.values())

    def score(self, text: str) -> float:
        found, hits, words = self.fired(text)
        z = self.bias + float(self.weights[found].sum()) + self.hits * np.log1p(hits) + self.density * hits / (words + 20)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold. Written out.

    Rows that agree in id and text are one. The rows are chosen by a hash of the id, from ids
    and digests alone; texts are read only of those chosen.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.md5("text").alias("th"), "text")
    known = rows.join(given, "doc_id").select("doc_id", "th", "toxic").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(sample)
    return written(rows.join(chosen, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("text", "toxic"))


def _vote_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(voters_of(text))
        words = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["voter", "toxic", "clean"])


def _fired_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.fired(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
                ["toxic", "votes", "hits", "words"],
            )

    return run


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probability of toxic for each row, from 0/1 votes and the noisy given label.

    A voter that fires speaks with log P(fire | toxic) - log P(fire | clean), one that stays
    silent with the complement. Each voice is divided by one plus its correlations, within
    the classes, with the other voters.
    """
    posterior, share = np.where(label > 0, 0.95, 0.05), 1 / len(votes)
    for _ in range(rounds):
        p, q = posterior, 1 - posterior
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        fire_t = (sum(p[s] @ v for s, v in _blocks(votes)) + 0.5) / (p.sum() + 1)
        fire_c = (sum(q[s] @ v for s, v in _blocks(votes)) + 0.5) / (q.sum() + 1)
        centred = (v - p[s, None] * fire_t - q[s, None] * fire_c for s, v in _blocks(votes))
        covariance = sum(c.T @ c for c in centred) * share
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        related = np.clip(covariance / scale[:, None] / scale, 0, 1)
        np.fill_diagonal(related, 0)
        related[related < 0.1] = 0
        voice = 1 / (1 + related.sum(axis=1))
        right = np.clip(((p @ label) + 1) / (p.sum() + 2), 0.51, 0.99), np.clip(((q @ (1 - label)) + 1) / (q.sum() + 2), 0.51, 0.99)
        fires, silent = voice * np.log(fire_t / fire_c), voice * np.log((1 - fire_t) / (1 - fire_c))
        z = np.log(prior / (1 - prior)) + np.concatenate([v @ fires + (1 - v) @ silent for _, v in _blocks(votes)])
        z += np.where(label > 0, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        now = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if np.abs(now - posterior).max() < 1e-4:
            break
        posterior = now
    return now


def _blocks(*columns: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the rows, each with the columns of its rows side by side, as doubles."""
    for lo in range(0, len(columns[0]), ROWS):
        rows = slice(lo, lo + ROWS)
        yield rows, np.column_stack([c[rows] for c in columns]).astype(np.float64, copy=False)


def logistic(x: tuple[np.ndarray, ...], y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels y; x are columns, of which the last is not penalised."""
    w = np.zeros(sum(c.shape[1] if c.ndim > 1 else 1 for c in x))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        slope, bend = penalty * w, np.diag(penalty)
        for s, v in _blocks(*x):
            p = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
            slope += v.T @ (p - y[s])
            bend += (v * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ v
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    """A model from the labelled rows of docs (doc_id, text) outside the held-out fold.

    Without both toxic and clean labelled rows the model scores every text near 0.
    """
    rows = labelled(docs, labels, sample)
    n = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = sum(v for k, v in n.items() if k), n.get(0, 0)
    if not toxic or not clean:
        return Model()
    counts = rows.mapInArrow(_vote_counts, "voter string, toxic long, clean long").groupBy("voter").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where(F.col("toxic") >= SUPPORT).withColumn("odds", odds).where((F.col("odds") > 1.5) & (sure > 3)).orderBy(F.desc(F.col("odds") * F.col("toxic")), "voter").limit(voters)
    model = Model({r["voter"]: i for i, r in enumerate(best.collect())})
    fired = rows.mapInArrow(_fired_rows(model), "toxic int, votes array<int>, hits int, words int").toArrow()
    size = len(model.lexicon) + len(_PATTERNS)
    votes = np.zeros((len(fired), size), np.uint8)
    lists = fired["votes"].combine_chunks()
    votes[np.repeat(np.arange(len(fired)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    posterior = label_model(votes, (fired["toxic"].to_numpy() > 0).astype(np.float32))
    hits, words = fired["hits"].to_numpy(), fired["words"].to_numpy()
    w = logistic((votes, np.log1p(hits), hits / (words + 20), np.ones(len(fired))), posterior)
    model.weights, (model.hits, model.density, model.bias) = w[:size], w[size:].tolist()
    return model


def _score_rows(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text_col)
            scores = pa.array([model.score(str(t.as_py() or "")) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), scores], ["row", "held_out", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(row, held_out, score, predicted), one row for each row of docs.

    ``row`` is a struct of the given columns of docs (all by default), whatever their names.
    Scores depend on the text alone; null and empty texts get the score of a text without words. A null id is in
    the held-out fold and is never learnt from; an id labelled twice counts as toxic if one
    of its labels is. Rows of labels without a document, and null labels, are not used. An
    empty table gives an empty result.
    """
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    model = fit(docs.select(ident.alias("doc_id"), text.alias("text")), labels, **limits)
    columns = columns or docs.columns
    rows = bounded(docs).select(whole_row(columns), held_out(ident).alias("held_out"), *([] if text_col in columns else [text.alias("text")]))
    schema = StructType([*rows.schema.fields[:2], StructField("score", DoubleType())])
    out = rows.mapInArrow(_score_rows(model, text_col), schema)
    return out.select("row", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
