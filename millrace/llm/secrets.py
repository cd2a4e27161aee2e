"""Secret scans: fixed patterns, and a randomness test battery under length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import bounds, rows_of, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones cannot hide longer ones
KINDS = ("assign", "access", "hex", "random")
WORDS = ("password", "passwd", "secret", "token", "api")
#: Candidates are maximal runs of letters, digits and + / _ =, of MIN_RUN bytes at least: with fewer, chi-squared cells
#: would expect less than one symbol each, and the test says nothing.
MIN_RUN = 16
_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[[*b"0123456789"]] = True
_LETTER = _RUN & ~_DIGIT
_LETTER[[*b"+/_="]] = False
#: Encodings a run may be in, by what it holds: digits; hexadecimal; digits and letters of one case; letters of one case;
#: letters of both; digits and letters of both; any of these and marks.
ENCODINGS = ("digits", "hex", "base36", "letters", "both cases", "base62", "base64")
SIZES = np.array([10, 16, 36, 26, 52, 62, 66])
#: Lengths that have a null of their own: every one up to 64, then coarser.
BANDS = (*range(16, 65), 72, 80, 96, 128, 192)
#: Scores are 20 * -log10(p), cut at BINS - 1: bin 0 is perfectly random.
BINS = 400


def _alphabet() -> np.ndarray:
    """Each byte's place in digits, lower case, upper case, marks: 0-9, 10-35, 36-61, 62-65."""
    place = np.zeros(256, dtype=np.int64)
    for i, c in enumerate(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_="):
        place[c] = i
    return place


_PLACE = _alphabet()


def log_sf_normal(z: np.ndarray) -> np.ndarray:
    """log10 of the upper tail of a standard normal, also far out."""
    z = np.asarray(z, dtype=float)
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = -z * z / 2 / np.log(10) + np.log10(np.maximum(poly, 1e-300) / np.sqrt(2 * np.pi))
    return np.where(z >= 0, tail, np.log10(np.maximum(1 - 10 ** np.minimum(tail, 0), 1e-300)))


def battery(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-log10 p, place of the encoding) of every run, p for "drawn uniformly from its alphabet".

    The encoding is inferred from the bytes seen. Tests: chi-squared uniformity of its alphabet in up to 16 equal cells
    (Wilson-Hilferty), runs above and below the alphabet's middle, and lag-one serial correlation; the smallest p
    counts three times.
    """
    n = (ends - starts).astype(float)
    row = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.repeat(starts, ends - starts)
    sym = _PLACE[data[at]]
    some = lambda on: np.bincount(row[on], minlength=len(starts)) > 0
    digit, low, up, mark = some(sym < 10), some((sym >= 10) & (sym < 36)), some((sym >= 36) & (sym < 62)), some(sym >= 62)
    past_f = some(((sym >= 16) & (sym < 36)) | (sym >= 42))
    encoding = np.where(mark, 6, np.where(low & up, np.where(digit, 5, 4), np.where(~digit, 3, np.where(low | up, np.where(past_f, 2, 1), 0))))
    size = SIZES[encoding].astype(float)
    # symbols counted from 0 within the alphabet that was inferred
    rank = sym - np.where(up & ~low & ~mark, 26, 0)[row] * (sym >= 36) - np.where(digit | mark, 0, 10)[row]
    cells = np.minimum(16, size)
    cell = (rank * (cells / size)[row]).astype(np.int64)
    # cells hold unequal numbers of symbols where the alphabet is no multiple of 16
    edge = np.arange(17)[None, :]
    upto = np.minimum(np.ceil(edge * (size / cells)[:, None] - 1e-9), size[:, None])
    share = np.diff(upto, axis=1) / size[:, None]
    count = np.bincount(row * 16 + np.minimum(cell, 15), minlength=16 * len(starts)).reshape(-1, 16)
    want = share * n[:, None]
    chi = np.where(want > 0, (count - want) ** 2 / np.where(want > 0, want, 1), 0).sum(axis=1)
    df = cells - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    high = (rank >= (size / 2)[row]).astype(np.int64)
    same = row[1:] == row[:-1]
    turns = np.bincount(row[1:][same & (high[1:] != high[:-1])], minlength=len(starts))
    z_runs = np.abs(turns - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    x = rank / (size - 1)[row] - 0.5
    var = ((size + 1) / (12 * (size - 1))) + 1e-12
    serial = np.bincount(row[1:][same], weights=(x[1:] * x[:-1])[same], minlength=len(starts))
    z_serial = np.abs(serial) / (var * np.sqrt(n - 1))
    worst = np.minimum(log_sf_normal(z_chi), np.log10(2) + np.minimum(log_sf_normal(z_runs), log_sf_normal(z_serial)))
    return np.maximum(0, -worst - np.log10(3)), encoding


def _runs(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = bounds(off, _RUN[data])
    long = ends - starts >= MIN_RUN
    return starts[long], ends[long]


def written(off: np.ndarray, data: np.ndarray, digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What secrets must be told from, dealt into runs of every band's length in turn.

    Either the letters (in one case) of whatever is no candidate, without what is between them, or all digits: those
    of long numbers too, as account and card numbers look random without being secret.
    """
    ordinary = (_DIGIT if digits else _LETTER)[data]
    if not digits:
        depth = np.zeros(len(data) + 1, dtype=np.int64)
        for place, by in zip(_runs(off, data), (1, -1)):
            depth[place] += by
        ordinary &= np.cumsum(depth[:-1]) == 0
    symbols = data[ordinary] if digits else data[ordinary] | 0x20
    lengths = np.tile(BANDS, len(symbols) // sum(BANDS) + 1)
    ends = np.cumsum(lengths)
    lengths, ends = lengths[ends <= len(symbols)], ends[ends <= len(symbols)]
    return symbols, ends - lengths, ends


def _bins(score: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(BANDS, length, "right") - 1, np.minimum(BINS - 1, (score * 20).astype(np.int64))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by encoding, band and bin of candidates, and of written letters and digits (written true): one row each a task.

    Letters and digits are gathered from all texts of a slice, so that short texts make long runs too.
    """
    total = np.zeros((len(ENCODINGS), len(BANDS), BINS, 2), dtype=np.int64)
    for batch in batches:
        for _, _, off, data in slices(batch.column(0)):
            for null, (bytes_, starts, ends) in ((0, (data, *_runs(off, data))), (1, written(off, data, False)), (1, written(off, data, True))):
                if len(starts):
                    score, encoding = battery(bytes_, starts, ends)
                    np.add.at(total[..., null], (encoding, *_bins(score, ends - starts)), 1)
    encoding, band, at, null = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(encoding), pa.array(band), pa.array(at), pa.array(null == 1), pa.array(total[encoding, band, at, null])], ["encoding", "band", "bin", "written", "n"])


def discoveries(counts: np.ndarray, rate: float) -> np.ndarray:
    """The largest bin that counts as random for each encoding and band, -1 for none, from counts[encoding, band, bin, written].

    A candidate's p-value is the share of written runs of its band's length that score at least as random: letters for
    all encodings with letters, digits for digits. Short runs can't be told from text, long ones can. Then
    Benjamini-Hochberg over all candidates of an encoding, of whatever length.
    """
    out = np.full(counts.shape[:2], -1)
    for e in range(len(ENCODINGS)):
        null = np.cumsum(counts[0 if e == 0 else 3, :, :, 1], axis=1)
        p, seen = (1 + null) / (1 + null[:, -1:]), counts[e, :, :, 0]
        order = np.argsort(p, axis=None, kind="stable")
        upto = np.cumsum(seen.ravel()[order])
        # equal p-values stand or fall together
        good = np.flatnonzero((seen.ravel()[order] > 0) & (p.ravel()[order] * upto[-1] <= rate * np.maximum(upto, 1)))
        if len(good):
            limit = p.ravel()[order][good[-1]]
            out[e] = (p <= limit).sum(axis=1) - 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(limits: np.ndarray) -> Callable:
    names = ("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            out: list[list] = [[] for _ in names[1:]]
            for lo, hi, off, data in slices(texts):
                more: dict[int, list[tuple[int, int]]] = {}
                starts, ends = _runs(off, data)
                if len(starts):
                    score, encoding = battery(data, starts, ends)
                    band, at = _bins(score, ends - starts)
                    hit = at <= limits[encoding, band]
                    rows = rows_of(off, starts)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                    for i in np.flatnonzero(hit):
                        more.setdefault(int(rows[i]), []).append((int(points[starts[i]] - points[off[rows[i]]]), int(ends[i] - starts[i])))
                for i in range(lo, hi):
                    text = texts[i].as_py() or ""
                    spans = base_spans(text)
                    base = _joined(spans)
                    spans.sort()
                    reach = list(accumulate((e for _, _, e in spans), max))
                    extra = []
                    for s, length in more.get(i - lo, ()):
                        before = bisect_left(spans, (s + length,))
                        if not before or reach[before - 1] <= s:
                            extra.append((s, 3, s + length))
                    for k, v in enumerate((*(sum(x[1] == kind for x in spans) for kind in range(3)), len(extra), hashlib.sha256(base.encode()).hexdigest(), _joined(spans + extra))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in out[:4]), *(pa.array(v, pa.string()) for v in out[4:])], names)

    return scan


def scan_secrets(spark: SparkSession, docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Secrets in every whole text: the fixed patterns' spans, and runs that the battery cannot tell from random ones.

    rate: the false-discovery rate of the added spans of each encoding, over all documents. Runs of fewer than MIN_RUN
    symbols are found by the fixed patterns only. Nulls are empty texts, which have no spans; repeated rows give a row
    each; an empty table gives none; other columns are ignored. Two passes: the first brings the driver at most
    encodings x bands x bins x 2 counts, whatever the input, the second marks.
    """
    counts = np.zeros((len(ENCODINGS), len(BANDS), BINS, 2), dtype=np.int64)
    found = docs.select("text").mapInArrow(_histogram, "encoding long, band long, bin long, written boolean, n long").groupBy("encoding", "band", "bin", "written").agg(F.sum("n").alias("n"))
    for r in found.collect():
        counts[r.encoding, r.band, r.bin, int(r.written)] = r.n
    return docs.select("doc_id", "text").mapInArrow(_scan(discoveries(counts, rate)), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
