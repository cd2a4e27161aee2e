"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .tokens import slices

#: Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la lb oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd",
    "malayic": "id jv ms su tl",
    "sinitic": "zh",
}
DIMS = 1 << 13
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), f"only-{lang}")


def grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every byte position (two orders), and where each text's positions begin; feature 0 stands for nothing.

    ASCII letters are lower-cased, other ASCII bytes are blanks, and every text has a blank before and after it.
    """
    m = len(off) - 1
    row = np.repeat(np.arange(m), np.diff(off))
    text = np.full(len(data) + 2 * m, 32, dtype=np.uint32)
    text[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    begin = off + 2 * np.arange(m + 1)
    out = []
    for n, seed in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        key = np.zeros(len(text), dtype=np.uint32)
        for k in range(n):
            key[: len(text) - k] |= text[k:] << np.uint32(8 * (n - 1 - k))
        feature = (key * np.uint32(seed)) >> np.uint32(32 - 13)
        feature[(text == 32) & (np.append(text[1:], 32) == 32)] = 0
        for k in range(1, n):  # runs that would reach into the next text
            feature[np.maximum(begin[1:] - k, begin[:-1])] = 0
        out.append(feature)
    return out[0], out[1], begin[:-1]


def vectors(texts: pa.Array) -> np.ndarray:
    """Shares of each feature among a text's runs, one row a text."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for lo, hi, off, data in slices(texts):
        a, b, begin = grams(off, data)
        row = np.repeat(np.arange(hi - lo), np.diff(np.append(begin, len(a))))
        for f in (a, b):
            out[lo:hi] += np.bincount(row * DIMS + f, minlength=(hi - lo) * DIMS).reshape(-1, DIMS).astype(np.float32)
    out[:, 0] = 0
    return out / np.maximum(1, out.sum(axis=1, keepdims=True))


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 200, cost: float = 0.02) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear SVM (hinge loss, subgradient steps, averaged) on rows x with y of -1 or 1.

    The slope turns a margin into a probability by a logistic curve fitted to the training margins.
    """
    w, mean, bias, mean_bias = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for t in range(1, rounds + 1):
        wrong = y * (x @ w + bias) < 1
        step = np.float32(1 / (cost * (t + 10)))
        pull = weight * y * wrong
        w -= step * (np.float32(cost) * w - pull @ x)
        bias += 0.01 * step * cost * pull.sum()
        if t > rounds // 2:
            mean, mean_bias = mean + w, mean_bias + bias
    w, bias = mean / (rounds - rounds // 2), mean_bias / (rounds - rounds // 2)
    margin, slope = y * (x @ w + bias), 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(np.minimum(50, slope * margin)))
        slope = float(np.clip(slope + (weight * margin * p).sum() / max(1e-9, (weight * margin**2 * p * (1 - p)).sum()), 0.05, 8))
    return w.astype(np.float32), float(bias), slope


@dataclass
class Model:
    families: list[str]
    langs: list[list[str]]  # of each family
    pairs: list[tuple[int, int, int]]  # family, two of its languages
    weights: np.ndarray  # one column a machine: families first, then pairs
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, off, data in slices(texts):
            a, b, begin = grams(off, data)
            if not len(a):
                continue
            some = np.add.reduceat((a > 0).astype(np.float32), begin) + np.add.reduceat((b > 0).astype(np.float32), begin)
            z = np.stack([(np.add.reduceat(w[a], begin) + np.add.reduceat(w[b], begin)) / np.maximum(1, some) for w in self.weights])
            p = 1 / (1 + np.exp(-np.clip((z + self.bias[:, None]) * self.slope[:, None], -50, 50)))
            n = len(self.families)
            share = p[:n] / np.maximum(1e-12, p[:n].sum(axis=0))
            top = p[:n].argmax(axis=0)
            votes = [np.zeros((len(x), len(begin))) for x in self.langs]
            for (f, i, j), q in zip(self.pairs, p[n:]):
                votes[f][i] += (q >= 0.5) + 1e-3 * q
                votes[f][j] += (q < 0.5) + 1e-3 * (1 - q)
            best = np.stack([v.argmax(axis=0) for v in votes])
            sure = np.ones((n, len(begin)))
            for (f, i, j), q in zip(self.pairs, p[n:]):
                sure[f] = np.where(best[f] == i, np.minimum(sure[f], q), np.where(best[f] == j, np.minimum(sure[f], 1 - q), sure[f]))
            at = np.arange(len(begin))
            names += [self.langs[f][best[f, k]] for k, f in enumerate(top)]
            scores.append((share[top, at] if n > 1 else p[0]) * sure[top, at])
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    found = sorted(set(langs))
    families = sorted({family(s) for s in found})
    inside = [[s for s in found if family(s) == f] for f in families]
    of, lang = np.array([family(s) for s in langs]), np.array(langs)
    scale = np.float32(100)  # shares of a text's runs are small numbers
    x *= scale
    machines = [svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(DIMS, np.float32), 50.0, 1.0) for f in families]
    pairs = []
    for f, names in enumerate(inside):
        for i, j in combinations(range(len(names)), 2):
            on = (lang == names[i]) | (lang == names[j])
            machines.append(svm(x[on], np.where(lang[on] == names[i], 1.0, -1.0)))
            pairs.append((f, i, j))
    return Model(families, inside, pairs, np.stack([m[0] for m in machines]) * scale, np.array([m[1] for m in machines]), np.array([m[2] for m in machines]))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = vectors(batch.column("text"))
        some = [np.flatnonzero(r) for r in x]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([i.astype(np.uint16).tobytes() for i in some], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(x, some)], pa.binary())], ["lang", "at", "share"])


def train(docs: DataFrame, per_language: int = 400, seed: int = 5) -> Model | None:
    """Fit on about per_language labelled texts of each language (whole texts; chosen by a hash of doc_id), None without labels.

    Rows whose crc32(doc_id as text) mod 5 is 0, and those without a doc_id, are never used.
    """
    rows = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & text_of().rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003
    got = rows.filter(unit < share).select("lang", "text").mapInArrow(_sampled, "lang string, at binary, share binary").orderBy("lang", F.xxhash64("at")).collect()
    if not got:
        return None
    x = np.zeros((len(got), DIMS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["share"], np.float32)
    langs = [r["lang"] for r in got]
    del got
    return fit(x, langs)


def identify_language(spark: SparkSession, docs: DataFrame, per_language: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text, and the columns in keep.

    Null texts and texts without a letter are `und` with score 0, as are all texts if no row is labelled. The
    score is the family's share times the least sure of the chosen language's machines. Repeated rows give a row
    each, an empty table none. The model is fitted on a bounded sample (per_language); prediction sees text only.
    """
    model = train(docs, per_language)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            names, scores = model.predict(batch.column("text")) if model else (["und"] * len(letters), np.zeros(len(letters)))
            cols = {c: batch.column(c) for c in batch.schema.names if c != "_letters"}
            cols |= {"lang_pred": pa.array([n if ok else "und" for n, ok in zip(names, letters)], pa.string()), "score": pa.array(np.where(letters, scores, 0.0).astype(float))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), *(c for c in keep if c not in ("doc_id", "text")), "text", text_of().rlike(r"\p{L}").alias("_letters"))
    kept = rows.drop("_letters").schema
    out = rows.mapInArrow(predict, kept.add("lang_pred", "string").add("score", "double"))
    return out if "text" in keep else out.drop("text")
