"""Hierarchical Pitman-Yor language model: bigram restaurants that share a unigram parent, their tables sampled by Gibbs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parts
from .tokens import mix, slices, words

#: Hashes that stand for the end of a text and for what precedes its first word.
END, BEGIN = np.uint64(1), np.uint64(2)
#: Stands for a missing doc_id inside blocks.
NO_ID = -(1 << 63)
#: Tokens that a task holds before it sends them on.
HELD = 600_000
#: Tokens of a bucket, on average, beyond which there are more buckets than one and a half for each shuffle partition.
BUCKET = 8_000_000
#: Largest count of a dish whose tables are drawn from their exact conditional; parts a larger one is moved in.
EXACT, PARTS = 256, 16
#: Dishes of a context that are drawn between two looks at the context's number of tables: one in so many.
TURNS = 8


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * n
    for code, length in head:
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, int(length), at))
        at += int(length) * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds all values."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of contexts that follow one in 2000 of the batch's tokens or more."""
    for batch in batches:
        for lo, hi, off, data in slices(batch.column(0)):
            word, n = np.unique(np.maximum(words(off, data)[3], np.uint64(3)), return_counts=True)
            word, n = np.append(word, BEGIN), np.append(n, hi - lo)
            some = 2000 * n >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[some].view(np.int64), 0)), pa.array(np.append(n[some], n.sum()))], ["word", "n"])


def _send(buckets: int, hot: np.ndarray) -> Callable:
    def flush(block: int, ids: np.ndarray, train: np.ndarray, u: np.ndarray, w: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        """One row for the documents (bucket -1) and one for each bucket of contexts: bigrams, and who has them."""
        yield -1 - block % buckets, block, pack(ids, np.bincount(doc, minlength=len(ids)), train.astype(np.uint8))
        to = (mix(u) % np.uint64(buckets)).astype(np.int64)
        if len(hot):  # what follows a very common context is dealt to all buckets
            split = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
            to[split] = (mix(u[split] ^ mix(w[split])) % np.uint64(buckets)).astype(np.int64)
        word = np.unique(np.concatenate([np.unique(u), np.unique(w)]))
        ui, wi = np.searchsorted(word, u), np.searchsorted(word, w)
        key = (to * len(word) + ui) * len(word) + wi if buckets * len(word) ** 2 < 1 << 62 else None
        order = np.argsort(key) if key is not None else np.lexsort((wi, ui, to))
        to, ui, wi, doc = to[order], ui[order], wi[order], doc[order]
        cut = np.searchsorted(to, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            s = slice(cut[b], cut[b + 1])
            x, y, d = ui[s], wi[s], doc[s]
            new = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            many = np.diff(np.append(new, len(x)))
            seen = np.add.reduceat(train[d].astype(np.int64), new)
            heads, runs = np.unique(x[new], return_counts=True)
            tails, tail = np.unique(y[new], return_inverse=True)
            yield int(b), block, pack(word[heads], small(runs), word[tails], small(tail), small(many), small(seen), small(d))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        tokens = docs = blocks = 0

        def rows() -> pa.RecordBatch:
            ids, train, u, w, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            got = list(flush(first + blocks, ids, train, u, w, doc))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["bucket", "block", "body"])

        for batch in batches:
            ids, train = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for lo, hi, off, data in slices(batch.column("text")):
                _, _, row, h = words(off, data)
                h = np.maximum(h, np.uint64(3))
                n = np.bincount(row, minlength=hi - lo)
                ends = np.cumsum(n + 1) - 1
                w = np.full(len(h) + hi - lo, END, dtype=np.uint64)
                w[np.setdiff1d(np.arange(len(w)), ends, assume_unique=True)] = h
                u = np.empty_like(w)
                u[1:] = w[:-1]
                u[ends - n] = BEGIN
                held.append((ids[lo:hi], train[lo:hi], u, w, docs + np.repeat(np.arange(hi - lo), n + 1)))
                tokens, docs = tokens + len(w), docs + hi - lo
                if tokens >= HELD:
                    yield rows()
                    tokens, docs, blocks = 0, 0, blocks + 1
        if held:
            yield rows()

    return send


def _gather(hot: np.ndarray) -> Callable:
    def gather(table: pa.Table) -> pa.Table:
        """Join the blocks of one bucket: its distinct bigrams with training counts, and each block's occurrences of them.

        hot: which contexts here are parts of very common ones (place here, place in the list), with the part's guests and tables.
        """
        schema = pa.schema([("bucket", pa.int32()), ("ones", pa.int64()), ("twos", pa.int64()), ("state", pa.binary()), ("hot", pa.binary()), ("events", pa.list_(pa.binary())), ("blocks", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary())])
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # lists of documents pass through
            return pa.Table.from_pylist([{"bucket": bucket, "ones": 0, "twos": 0, "state": b"", "hot": b"", "events": [b.as_py() for b in table.column("body")], "blocks": table.column("block").to_pylist(), "words": b"", "counts": b""}], schema=schema)
        table = table.sort_by("block")
        got = [unpack(b.as_py()) for b in table.column("body")]
        heads, tails = np.unique(np.concatenate([g[0] for g in got])), np.unique(np.concatenate([g[2] for g in got]))
        key = np.concatenate([np.searchsorted(heads, g[0]).repeat(g[1]) * len(tails) + np.searchsorted(tails, g[2])[g[3]] for g in got])
        pairs, entry = np.unique(key, return_inverse=True)
        counts = np.bincount(entry, weights=np.concatenate([g[5] for g in got])).astype(np.int64)
        ui, wi = pairs // len(tails), pairs % len(tails)
        upto = np.cumsum([0, *(len(g[3]) for g in got)])
        events = [pack(small(np.diff(entry[upto[i] : upto[i + 1]], prepend=0)), g[4], g[6]) for i, g in enumerate(got)]
        per_word = np.bincount(wi, weights=counts, minlength=len(tails)).astype(np.int64)
        per_context = np.bincount(wi, weights=counts > 0, minlength=len(tails)).astype(np.int64)
        at = np.flatnonzero(np.isin(heads, hot))
        here = pack(at, np.searchsorted(hot, heads[at]), np.bincount(ui, weights=counts, minlength=len(heads)).astype(np.int64)[at], np.bincount(ui, weights=counts > 0, minlength=len(heads)).astype(np.int64)[at])
        row = {"bucket": bucket, "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()), "state": pack(small(np.bincount(ui, minlength=len(heads))), small(wi), small(counts)), "hot": here, "events": events, "blocks": table.column("block").to_pylist(), "words": tails.tobytes(), "counts": pack(small(per_word), small(per_context))}
        return pa.Table.from_pylist([row], schema=schema)

    return gather


def _hot_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, guests, tables) of a bucket's parts of very common contexts."""
    for batch in batches:
        for body in batch.column(0):
            if body.as_py():
                *_, place, guests, tables = unpack(body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (place, guests, tables)], ["place", "guests", "tables"])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, word, training count, tables) of every word that a bucket has; at first every context has one table."""
    for batch in batches:
        for bucket, body, counts in zip(*(batch.column(c) for c in ("bucket", "words", "counts"))):
            if bucket.as_py() >= 0:
                word = np.frombuffer(body.as_py(), np.int64)
                count, tables = unpack(counts.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), bucket.as_py(), np.int32)), pa.array(word), pa.array(count.astype(np.int64)), pa.array(tables.astype(np.int64))], ["bucket", "word", "count", "tables"])


def stirling(d: float, top: int = EXACT) -> np.ndarray:
    """[c, t]: the logarithm of the generalised Stirling number S(c, t): in how many ways, weighted, c guests sit at t tables."""
    s = np.full((top + 1, top + 1), -np.inf)
    s[0, 0] = 0
    for c in range(1, top + 1):
        stay = np.full(c, -np.inf)
        stay[: c - 1] = s[c - 1, 1:c] + np.log(c - 1 - d * np.arange(1, c))
        s[c, 1 : c + 1] = np.logaddexp(s[c - 1, :c], stay)
    return s


def drawn(c: np.ndarray, rest: np.ndarray, p: np.ndarray, theta: float, d: float, numbers: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tables of dishes with c guests (at most EXACT), each given the other dishes' tables in its restaurant (rest) and its chance p in the parent.

    All guests of a dish are reseated at once: the chance of t tables is S(c, t) p**t (theta + d rest)(theta + d (rest + 1))...,
    t factors. numbers: uniform ones, one a dish.
    """
    out = np.ones(len(c), dtype=np.int64)
    for n, rows in by_count(c):
        for at in range(0, len(rows), max(1, 2_000_000 // n)):
            i = rows[at : at + max(1, 2_000_000 // n)]
            weight = table[n, 1 : n + 1] + np.cumsum(np.log((theta + d * (rest[i, None] + np.arange(n))) * p[i, None]), axis=1)
            chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[i] += (chance < numbers[i, None] * chance[:, -1:]).sum(axis=1)
    return out


def by_count(c: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Where each count of two or more is."""
    order = np.argsort(c, kind="stable")
    found, first = np.unique(c[order], return_index=True)
    return [(int(n), rows) for n, rows in zip(found, np.split(order, first[1:])) if n > 1]


def moved(c: np.ndarray, t: np.ndarray, draw: Callable[[], np.ndarray], d: float, opens: Callable[[np.ndarray], np.ndarray | float]) -> np.ndarray:
    """Tables of dishes with more guests than EXACT after each guest has left and been seated again, in PARTS parts.

    Of many guests the share d * (t - 1) / c are alone at their table; within a part the weight of a new table (opens, given
    the tables) is held, and the numbers of tables that close and open are rounded at random by draw.
    """
    t = t.astype(float)
    for _ in range(PARTS):
        new = opens(t)
        t = np.clip(t + np.floor(c / PARTS * new / (new + c - d * t) + draw()) - np.floor(d * (t - 1) / PARTS + draw()), 1, c)
    return t.astype(np.int64)


def parent_tables(word: np.ndarray, guests: np.ndarray, opens: float, d: float, turn: int, seed: int = 0, round_: int = 0) -> np.ndarray:
    """The parent restaurant's tables for each word, from numbers drawn by the word, the seed, the round and the turn, so that every bucket sees the same.

    opens: the weight of a new table, held for all words, as no word has much of all tables.
    """
    step = ((seed << 12) + (round_ << 6) + turn) << 20

    def draw() -> np.ndarray:
        nonlocal step
        step += 1
        return (mix(key + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) / (1 << 53)

    t = (guests > 0).astype(np.int64)
    some, many = np.flatnonzero((guests > 1) & (guests <= EXACT)), guests > EXACT
    key, table = word.view(np.uint64)[some], stirling(d)
    numbers, seated = draw(), np.ones(len(some), dtype=np.int64)
    for n, at in by_count(guests[some]):
        chance = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(opens)
        chance = np.cumsum(np.exp(chance - chance.max()))
        seated[at] += np.searchsorted(chance, numbers[at] * chance[-1])
    t[some] = seated
    if many.any():
        key, c = word.view(np.uint64)[many], guests[many]
        first = np.maximum(1, np.minimum(c, (opens * (c / opens) ** d).astype(np.int64)))
        for _ in range(3):
            first = moved(c, first, draw, d, lambda _: opens)
        t[many] = first
    return t


def _root(scale: dict, turns: int) -> Callable:
    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parent's tables in each turn; a word counts once over all buckets that have it."""
        for batch in batches:
            word, guests, copies = (batch.column(c).to_numpy() for c in ("word", "guests", "copies"))
            first = np.flatnonzero(np.diff(word, prepend=~word[:1]))  # equal words follow each other
            share = np.diff(np.append(first, len(word))) / copies[first]
            total = [float((parent_tables(word[first], guests[first], scale["opens"], scale["d0"], k, scale["seed"], scale["round"]) * share).sum()) for k in range(turns)]
            yield pa.RecordBatch.from_arrays([pa.array(range(turns), pa.int32()), pa.array(total)], ["turn", "seats"])

    return root


def _sample(scale: dict, final: bool) -> Callable:
    """Sample a bucket's contexts given the parent: tables for the parent, or the averaged predictions' sums by document."""
    d, theta = scale["d1"], scale["theta1"]

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = left.column("bucket")[0].as_py()
        out_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("body", pa.binary()), ("hot", pa.binary())])
        if bucket < 0:
            rows = [{"bucket": bucket, "block": k, "words": b"", "body": e.as_py(), "hot": b""} for k, e in zip(left.column("blocks")[0].as_py(), left.column("events")[0])] if final else []
            return pa.Table.from_pylist(rows, schema=out_schema)
        runs, wi, count = (x.astype(np.int64) for x in unpack(left.column("state")[0].as_py()))
        tails = np.frombuffer(left.column("words")[0].as_py(), np.uint64)
        place = np.searchsorted(tails, right.column("word").to_numpy().view(np.uint64))
        total, guests = (np.zeros(len(tails), dtype=np.int64) for _ in range(2))
        for into, name in ((total, "total"), (guests, "guests")):
            into[place] = right.column(name).to_numpy()
        ui = np.repeat(np.arange(len(runs)), runs)
        first = np.concatenate([[0], np.cumsum(runs)[:-1]])
        guests_u = np.add.reduceat(count, first)
        elsewhere = np.zeros(len(runs))
        at, hot, own_guests, own_tables = unpack(left.column("hot")[0].as_py())
        if len(at):  # parts of very common contexts: guests of all parts, and the other parts' tables as they were
            guests_u[at] = scale["hot_guests"][hot]
            elsewhere[at] = scale["hot_tables"][hot] * (1 - own_tables / np.maximum(1, scale["hot_first"][hot]))
        rng = np.random.default_rng([scale["seed"], scale["round"], bucket])
        t = (count > 0).astype(np.int64)
        some = np.flatnonzero(count > 1)
        turn_of = (some - first[ui[some]]) % TURNS
        turns = [(some[(turn_of == k) & (count[some] <= EXACT)], some[(turn_of == k) & (count[some] > EXACT)]) for k in range(TURNS)]
        table, tables_u = stirling(d), np.add.reduceat(t, first) + elsewhere

        def put(i: np.ndarray, new: np.ndarray) -> None:
            np.add.at(tables_u, ui[i], new - t[i])
            t[i] = new

        def parent(turn: int) -> np.ndarray:
            seats = parent_tables(tails, guests, scale["opens"], scale["d0"], turn, scale["seed"], scale["round"])
            return (guests - scale["d0"] * seats + (scale["theta0"] + scale["d0"] * scale["seats"][turn]) / scale["cells0"]) / (scale["theta0"] + scale["guests"])

        def sweep(p: np.ndarray) -> None:
            """Every dish once; what a context's other dishes have is looked up again after each of TURNS parts of them."""
            for i, q in turns:
                put(i, drawn(count[i], tables_u[ui[i]] - t[i], p[wi[i]], theta, d, rng.random(len(i)), table))
                if len(q):
                    far, chance = tables_u[ui[q]] - t[q], p[wi[q]]
                    put(q, moved(count[q], t[q], lambda: rng.random(len(q)), d, lambda now: (theta + d * (far + now)) * chance))

        mean, p = np.zeros(len(count)), parent(0)
        for _ in range(scale["burn"]):
            sweep(p)
        for k in range(scale["samples"] if final else 0):
            if k * scale["draws"] % scale["samples"] < scale["draws"]:
                p = parent(k * scale["draws"] // scale["samples"])
            sweep(p)
            mean += (count - d * t + (theta + d * tables_u[ui]) * p[wi]) / (theta + guests_u[ui])
        if not final:
            sent = pack(small(np.bincount(wi, weights=count, minlength=len(tails)).astype(np.int64)), small(np.bincount(wi, weights=t, minlength=len(tails)).astype(np.int64)))
            return pa.Table.from_pylist([{"bucket": bucket, "block": 0, "words": tails.tobytes(), "body": sent, "hot": pack(at, hot, own_guests, np.add.reduceat(t, first)[at])}], schema=out_schema)
        # a context without guests leaves all to the parent: theta * p / theta
        log_p = np.log10(mean / scale["samples"])
        log_base = np.log10((total[wi] + 1) / scale["cells"])
        known = (total[wi] > 0).astype(float)
        rows = []
        for k, e in zip(left.column("blocks")[0].as_py(), left.column("events")[0]):
            step, many, doc = unpack(e.as_py())
            at = np.repeat(np.cumsum(step.astype(np.int64)), many)
            who, at_who = np.unique(doc, return_inverse=True)
            rows.append({"bucket": bucket, "block": k, "words": b"", "hot": b"", "body": pack(small(who), np.bincount(at_who, weights=log_p[at]).astype(np.float32), np.bincount(at_who, weights=log_base[at]), small(np.bincount(at_who, weights=known[at]).astype(np.int64)))})
        return pa.Table.from_pylist(rows, schema=out_schema)

    return sample


def _score(tokens: int) -> Callable:
    def score(table: pa.Table) -> pa.Table:
        """Sum the parts of one block's documents."""
        bucket = table.column("bucket").to_numpy()
        body = table.column("body")
        ids, n, train = unpack(body[int(np.flatnonzero(bucket < 0)[0])].as_py())
        log_p, log_base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for i in np.argsort(bucket):
            if bucket[i] >= 0:
                who, a, b, k = unpack(body[int(i)].as_py())
                log_p[who] += a
                log_base[who] += b
                known[who] += k
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "held_out": pa.array(train == 0), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), tokens)), "base_score": pa.array(log_base), "score": pa.array(log_p), "perplexity": pa.array(10 ** np.minimum(300, -log_p / n))})

    return score


def score_documents(spark: SparkSession, docs: DataFrame, rounds: int = 2, burn: int = 2, samples: int = 6, draws: int = 3, seed: int = 23) -> DataFrame:
    """log10 probability of every whole text under a hierarchical Pitman-Yor bigram model, with a smoothed unigram base score.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. Training texts are
    those whose crc32(doc_id as text) mod 7 is not 2 (and those without a doc_id). Null texts are empty: one end token. Repeated rows are
    scored (and learned) each; an empty table gives no rows; other columns are ignored.

    Contexts are dealt to buckets by hash, what follows a very common one by both words; bigrams are counted in tasks
    before they are sent. In each round the parent's guests are summed over all buckets by word, and every bucket
    sweeps over its contexts given the parent. A sweep draws the number of tables of every dish anew from its
    conditional, exactly for up to EXACT guests, beyond that guest by guest in PARTS parts. In the last round the
    predictions are averaged over samples, during which the parent's tables are drawn draws times. Three things are held
    for a while: the parent's guests within a round, a context's tables while one in TURNS of its dishes is drawn (so
    contexts of up to TURNS dishes are exact), and the tables of a very common context's parts in other buckets
    within a round. Discounts and strengths are not sampled: the contexts' discount is estimated once from how many
    bigrams come once and twice, the parent's is one half, both strengths are 1. Buckets keep which documents have which bigrams.
    """
    scratch = Scratch(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(spark) * 3 // 2, size // (6 * BUCKET))
    # which contexts are common decides where bigrams go, not what is learnt from them, so one document in 64 tells
    often = docs.filter(F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(64)) == 0, F.lit(False))).select("text").mapInArrow(_common, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = {r.word: r.n for r in often.orderBy(F.desc("n")).limit(1 + 4 * buckets).collect()}
    least = often.pop(0, 0) / (4 * buckets)
    hot = np.sort(np.array([w for w, n in often.items() if n >= least], dtype=np.int64).view(np.uint64))
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    sent = docs.select("doc_id", "text", train.alias("train")).mapInArrow(_send(buckets, hot), "bucket int, block long, body binary")
    gathered = scratch.bucketed(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_gather(hot), "bucket int, ones long, twos long, state binary, hot binary, events array<binary>, blocks array<long>, words binary, counts binary"), buckets, "bucket")
    ones, twos = gathered.agg(F.sum("ones"), F.sum("twos")).first()
    if ones is None:
        return docs.select("doc_id", F.lit(False).alias("held_out"), *(F.lit(0).cast(k).alias(c) for c, k in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("perplexity", "double"))))

    def shared(parts_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Guests and tables of the very common contexts, over all buckets: at most four for each bucket."""
        out = np.zeros((2, len(hot)), dtype=np.int64)
        for r in parts_.select("hot").mapInArrow(_hot_parts, "place long, guests long, tables long").groupBy("place").agg(F.sum("guests").alias("g"), F.sum("tables").alias("t")).collect() if len(hot) else ():
            out[:, r.place] = r.g, r.t
        return out[0], out[1]

    scale = {"d1": float(np.clip(ones / max(1, ones + 2 * twos), 0.3, 0.95)), "d0": 0.5, "theta1": 1.0, "theta0": 1.0, "burn": burn, "samples": samples, "draws": min(draws, samples), "seed": seed}
    scale["hot_guests"], scale["hot_first"] = shared(gathered)
    scale["hot_tables"] = scale["hot_first"]
    messages = gathered.select("bucket", "words", "counts").mapInArrow(_messages, "bucket int, word long, count long, tables long")
    seats = None
    for k in range(rounds):
        by_word = Window.partitionBy("word")
        summed = messages.select("bucket", "word", F.sum("count").over(by_word).alias("total"), F.sum("tables").over(by_word).alias("guests"), F.count(F.lit(1)).over(by_word).alias("copies"))
        summed = scratch.table(summed)
        last = k == rounds - 1
        share = 1 / F.col("copies")
        tokens, kinds, guests, dishes = summed.agg(F.sum(F.col("total") * share), F.sum(F.when(F.col("total") > 0, share)), F.sum(F.col("guests") * share), F.sum(F.when(F.col("guests") > 0, share))).first()
        tokens, kinds, guests, dishes = (round(x or 0) for x in (tokens, kinds, guests, dishes))
        # tables are drawn by the weight that the last round's tables give, at first one for each dish
        scale |= {"round": k, "guests": guests, "cells": tokens + kinds + 1, "cells0": kinds + 1, "opens": (scale["theta0"] + scale["d0"] * (seats or dishes)) / (kinds + 1)}
        turns = scale["draws"] if last else 1
        found = {r.turn: r.s for r in summed.mapInArrow(_root(dict(scale), turns), "turn int, seats double").groupBy("turn").agg(F.sum("seats").alias("s")).collect()}
        scale["seats"] = [found.get(i, 0.0) for i in range(turns)]
        seats = scale["seats"][0]
        parents = summed.select("bucket", "word", "total", "guests").repartition(buckets, "bucket")
        # only the last round looks at who has which bigrams
        state = gathered if last else gathered.filter("bucket >= 0").select("bucket", "state", "hot", "words")
        run = state.groupBy("bucket").cogroup(parents.groupBy("bucket")).applyInArrow(_sample(dict(scale), last), "bucket int, block long, words binary, body binary, hot binary")
        if not last:
            told = scratch.table(run)
            scratch.drop(summed)
            scale["hot_tables"] = shared(told)[1]
            messages = told.select("bucket", "words", F.col("body").alias("counts")).mapInArrow(_messages, "bucket int, word long, count long, tables long")
    return run.select("bucket", "block", "body").groupBy("block").applyInArrow(_score(tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
