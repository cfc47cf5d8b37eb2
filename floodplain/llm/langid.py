"""Language ID in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are hashed character n-grams (one to four bytes of the text, A-Z
lower-cased) over the whole text, as shares of all its n-grams. Training takes
at most about `per_language` texts of each language (and `max_texts` of all), chosen by a hash of
doc_id; that bound is the only sampling, and prediction reads whole texts.

The family of a language is a fixed table (FAMILY); a language that it
doesn't hold is a family of its own. Families are told apart by one-versus-one
linear SVMs too; votes decide, and ties fall to the larger sum of margins.

Score: the product over both steps of 1 / (1 + exp(-4 margin)) for the smallest
margin of the winner (0.5 to 1 when it wins all its machines).

Defined cases: a null text or one without a letter is `und` with score 0.
Rows without lang or doc_id are never learned from. Without any labelled row,
every text is `und`; with one language only, each text with a letter is of it
with score 1. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, chunked, flat, pieces
from .state import fresh

#: ISO 639-1 codes by family.
FAMILY = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {lang: family for family, langs in FAMILY.items() for lang in langs.split()}

BITS = 13
GRAMS = (1, 2, 3, 4)
STEP = 0x9E3779B1
SLOPE = 4.0


def gram_slots(data: np.ndarray) -> list[np.ndarray]:
    """For each n in GRAMS, the hashed slot of the n-gram that starts at each byte (shorter near the end)."""
    low = LOWER[data].astype(np.uint32)
    rolling, out = np.zeros(len(low), np.uint32), []
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling * np.uint32(STEP)
        rolling[: max(0, len(low) - n + 1)] += low[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            h = rolling ^ (rolling >> np.uint32(15))
            out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def features(data: np.ndarray) -> np.ndarray:
    """Shares of the slots in one text."""
    counts = np.zeros(1 << BITS)
    for k, slots in enumerate(gram_slots(data)):
        inside = slots[: max(0, len(data) - GRAMS[k] + 1)]
        counts += np.bincount(inside, minlength=1 << BITS)
    return counts / max(1.0, counts.sum())


def segment_means(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row, the mean of table[slot] (slots x machines) over its n-grams; those over a row's end don't count."""
    rows, k = len(offs) - 1, table.shape[1]
    total, number = np.zeros((rows, k)), np.zeros(rows)
    if not len(data):
        return total
    for n, slots in zip(GRAMS, gram_slots(data), strict=True):
        ends = np.maximum(offs[:-1], offs[1:] - n + 1)
        for j in range(k):
            sums = np.r_[0.0, np.cumsum(table[:, j][slots])]
            total[:, j] += sums[ends] - sums[offs[:-1]]
        number += ends - offs[:-1]
    return total / np.maximum(number, 1)[:, None]


def train_svm(x: np.ndarray, y: np.ndarray, passes: int = 60, c: float = 10.0) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss by dual coordinate descent; y is -1 or 1, rows have unit length."""
    rng, alpha, w = np.random.default_rng(7), np.zeros(len(y)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + 0.5 / c
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Contest:
    """One-versus-one machines between `names`; column j of the table is for pairs[j]."""

    names: tuple[str, ...]
    first: int

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.names)), 2))

    def winners(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its score) for each row of all machines' margins."""
        n, rows = len(self.names), len(margins)
        votes, sums, least = np.zeros((rows, n)), np.zeros((rows, n)), np.full((rows, n), np.inf)
        for j, (a, b) in enumerate(self.pairs, self.first):
            m = margins[:, j]
            for who, own in ((a, m), (b, -m)):
                votes[:, who] += own > 0
                sums[:, who] += own
                least[:, who] = np.minimum(least[:, who], own)
        best = np.lexsort((sums.T, votes.T), axis=0)[-1] if n > 1 else np.zeros(rows, int)
        return best, 1 / (1 + np.exp(-np.clip(SLOPE * least[np.arange(rows), best], -50, 50)))


@dataclass(frozen=True)
class Model:
    families: Contest
    inside: tuple[Contest, ...]
    table: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> Model:
        """x: shares of slots by text. Weights are kept as float32, with the scale to unit length inside."""
        scale = np.sqrt((x * x).sum(axis=1, keepdims=True))
        mean_scale = float(np.mean(scale)) if len(x) else 1.0
        unit = (x / np.float32(mean_scale)).astype(np.float32)
        family = np.array([FAMILY_OF.get(v, v) for v in langs], object)
        columns: list[np.ndarray] = []

        def contest(names: list[str], labels: np.ndarray) -> Contest:
            made = Contest(tuple(names), len(columns))
            for a, b in made.pairs:
                rows = np.flatnonzero((labels == names[a]) | (labels == names[b]))
                columns.append(train_svm(unit[rows], np.where(labels[rows] == names[a], 1.0, -1.0)) / mean_scale)
            return made

        top = contest(sorted(set(family)), family)
        inside = tuple(contest(sorted({v for v in langs if FAMILY_OF.get(v, v) == f}), langs) for f in top.names)
        return cls(top, inside, (np.stack(columns, axis=1) if columns else np.zeros((1 << BITS, 0))).astype(np.float32))

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        langs, scores = np.full(len(text), "und", object), np.zeros(len(text))
        letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.families.names:
            return langs, scores
        for a, b, data, offs in chunked(text):
            margins = segment_means(self.table, data, offs)
            family, score = self.families.winners(margins)
            for f, contest in enumerate(self.inside):
                mine = np.flatnonzero((family == f) & letters[a:b])
                if len(mine):
                    lang, inner = contest.winners(margins[mine])
                    langs[a + mine] = np.array(contest.names, object)[lang]
                    scores[a + mine] = score[mine] * inner
        return langs, scores


def train(labelled: DataFrame, per_language: int = 300, max_languages: int = 500, max_texts: int = 6000) -> Model:
    """A model from (doc_id, text, lang): about `per_language` texts of each language at most, fewer where all languages together would
    have more than `max_texts`. More than `max_languages` languages are an error.

    Texts are chosen by a hash of doc_id; a text's features are made on the executors, so the
    driver gets at most per_language * languages sparse vectors.
    """
    rows = labelled.where("lang is not null and doc_id is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model.fit(np.zeros((0, 1 << BITS)), np.array([], object))
    each = max(1, min(per_language, max_texts // len(sizes)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in sizes], "lang string, share double")
    share = F.col("share")
    chosen = rows.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offs = flat(batch.column("text"))
            slots, values = [], []
            for i in range(len(batch)):
                x = features(data[offs[i] : offs[i + 1]])
                at = np.flatnonzero(x)
                slots.append(at.astype(np.int32).tobytes())
                values.append(x[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "lang", "slots", "shares"])

    found = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "doc_id string, lang string, slots binary, shares binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for i, (slots, values) in enumerate(zip(found.column("slots").to_pylist(), found.column("shares").to_pylist(), strict=True)):
        x[i, np.frombuffer(slots, np.int32)] = np.frombuffer(values, np.float32)
    return Model.fit(x, np.array(found.column("lang").to_pylist(), object))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), and last the predicted language and score."""
    keep = docs.columns if keep is None else keep
    lang, score, text = fresh(docs, "lang_pred", "score", "_text")
    source = docs.select(*[docs[c] for c in keep], docs["text"].alias(text))
    schema = docs.select(*[docs[c] for c in keep]).withColumns({lang: F.lit(""), score: F.lit(0.0)}).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            langs, scores = model.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(langs, pa.string()), pa.array(scores)], names)

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """What op9 returns: learned from documents that aren't held out, predicted for all."""
    model = train(docs.where(~held_out()), per_language)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("lang_pred"), F.col("score"))
