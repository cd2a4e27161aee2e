"""Languages by a multinomial model of characters, and token counts by public vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many runs of characters at most are sent to all tasks; a larger model is joined by run.
SENT = 200_000
#: A run counts as one that is not known if it comes fewer times in all labelled texts.
LEAST = 3
#: What is added to each count.
ADDED = 0.5
#: Labelled texts that the score is calibrated on, at most, about.
JUDGED = 4000


#: A run's three characters are the 63 bits of its number.
BITS = 21


def plain(text: Column) -> Column:
    """Letters in lower case, anything else as one blank, one before and after the text."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs of three characters of plain texts, and the text that each is of."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = of[2:] == of[:-2]
    return ((points[:-2] << 2 * BITS) | (points[1:-1] << BITS) | points[2:])[whole], of[2:][whole]


def named(number: Column) -> Column:
    """A run's characters."""
    one = lambda k: F.decode(F.unhex(F.lpad(F.hex(F.shiftright(number, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1))), 8, "0")), "UTF-32")
    return F.concat(one(2), one(1), one(0))


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many bytes of the column _plain at most; a longer text is one of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("_plain")).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def counted_runs(df: DataFrame, by: str, text: str) -> DataFrame:
    """(by, number, n): how often texts of each value of by hold each run; a batch's runs are counted before they leave it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, of = runs(batch.column("_plain"))
            values, index = np.unique(np.asarray(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            for i, value in enumerate(values):
                number, n = np.unique(found[index[of] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(number), pa.string()), pa.array(number), pa.array(n)], [by, "number", "n"])

    rows = df.select(F.col(by).cast("string").alias(by), plain(F.col(text)).alias("_plain")).mapInArrow(count, f"{by} string, number long, n long")
    return rows.groupBy(by, "number").agg(F.sum("n").alias("n"))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class LanguageModel:
    """Languages, a table of runs with a column a language (the logarithm of how likely it is there), and the sharpness that makes scores chances."""

    langs: list[str]
    table: DataFrame
    sharpness: float
    small: bool

    def means(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key and the mean logarithm for each language over the known runs of each text that has any; rows of one key are one text."""
        rows, wide = df.filter(has_letter(F.col(text))).select(key, plain(F.col(text)).alias("_plain")), range(len(self.langs))
        kind = rows.schema[key].dataType.simpleString()
        if self.small:
            known = self.table.select("number", *(f"l{i}" for i in wide)).toPandas()
            numbers, logs = known["number"].to_numpy(), known.drop(columns="number").to_numpy(dtype=float)

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                place = pd.Index(numbers)
                for batch in slices(batches):
                    found, of = runs(batch.column("_plain"))
                    at = place.get_indexer(found)
                    of, at = of[at >= 0], at[at >= 0]
                    each = [np.bincount(of, logs[at, i], batch.num_rows).astype(float) for i in wide]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, minlength=batch.num_rows)), *map(pa.array, each)], [key, "n", *(f"l{i}" for i in wide)])

            added = rows.mapInArrow(sums, ", ".join([f"{key} {kind}", "n long", *(f"l{i} double" for i in wide)])).filter("n > 0")
        else:
            def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches):
                    found, of = runs(batch.column("_plain"))
                    order = np.lexsort((found, of))
                    found, of = found[order], of[order]
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 0) | (np.diff(of) != 0)])) if len(found) else np.array([], dtype=int)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first])), pa.array(found[first]), pa.array(np.diff(np.append(first, len(found))))], [key, "number", "n"])

            each = rows.mapInArrow(single, f"{key} {kind}, number long, n long").join(self.table, "number")
            added = each.select(key, "n", *((F.col("n") * F.col(f"l{i}")).alias(f"l{i}") for i in wide))
        return added.groupBy(key).agg(*((F.sum(f"l{i}") / F.sum("n")).alias(f"l{i}") for i in wide))

    def scored(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, lang, score) of every row, keys being unique: the likeliest language and its chance; `und` and 0 for texts without letters or known runs."""
        if not self.langs:
            return df.select(key, F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
        means = self.means(df, key, text)
        best = F.greatest(*(F.col(f"l{i}") for i in range(len(self.langs)))) if len(self.langs) > 1 else F.col("l0")
        which = F.coalesce(*(F.when(F.col(f"l{i}") == best, F.lit(s)) for i, s in enumerate(self.langs)))
        total = sum((F.exp(self.sharpness * (F.col(f"l{i}") - best)) for i in range(len(self.langs))), F.lit(0.0))
        found = means.select(F.col(key).alias("_key"), which.alias("_lang"), (1 / total).alias("_score"))
        return df.select(key).join(found, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("_lang", F.lit("und")).alias("lang"), F.coalesce("_score", F.lit(0.0)).alias("score"))


def sharpness_of(means: np.ndarray, true: np.ndarray) -> float:
    """The factor of mean logarithms at which the true languages' chances are largest."""
    if not len(means):
        return 50.0
    loss = {}
    for s in np.geomspace(1, 1000, 40):
        z = s * (means - means.max(axis=1, keepdims=True))
        loss[s] = -(z[np.arange(len(z)), true] - np.log(np.exp(z).sum(axis=1))).mean()
    return float(min(loss, key=loss.get))


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count the runs of all labelled texts by language; a tenth of the keys, by hash, are kept out and tell how sharp the scores are to be."""
    rows = docs.filter(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    apart = F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(10)) == 0
    counts = counted_runs(rows.filter(~apart), "_lang", "_text").checkpoint()
    langs = sorted(r["_lang"] for r in counts.select("_lang").distinct().collect())
    if not langs:
        return LanguageModel([], counts, 1.0, True)
    wide = counts.groupBy("number").agg(*(F.sum(F.when(F.col("_lang") == s, F.col("n")).otherwise(0)).alias(f"n{i}") for i, s in enumerate(langs))).filter(sum((F.col(f"n{i}") for i in range(len(langs))), F.lit(0)) >= LEAST)
    sums = wide.agg(F.count(F.lit(1)).alias("v"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs)))).first()
    size = sums["v"]
    table = wide.select("number", named(F.col("number")).alias("g"), *(F.log((F.col(f"n{i}") + ADDED) / ((sums[f"n{i}"] or 0) + ADDED * size)).alias(f"l{i}") for i in range(len(langs)))).checkpoint()
    model = LanguageModel(langs, table, 1.0, size <= SENT)
    held = rows.filter(apart)
    share = min(1.0, JUDGED / max(1, held.count()))
    held = held.filter(F.pmod(F.xxhash64(F.lit(4), "_key"), F.lit(1_000_003)) < share * 1_000_003).dropDuplicates(["_key"])
    got = model.means(held, "_key", "_text").join(held.select("_key", "_lang"), "_key").filter(F.col("_lang").isin(*langs)).drop("_key").toPandas()
    true = got["_lang"].map({s: i for i, s in enumerate(langs)}).to_numpy(dtype=int)
    model.sharpness = sharpness_of(got[[f"l{i}" for i in range(len(langs))]].to_numpy(dtype=float), true)
    return model


def language_filter(docs: DataFrame, model: LanguageModel, wanted: tuple[str, ...] = (), least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a wanted language (any, if none is named) with a score of at least `least`."""
    found = model.scored(docs, key, text).filter((F.col("score") >= least) & (F.col("lang").isin(*wanted) if wanted else F.col("lang") != "und"))
    return docs.join(found.select(key), key, "left_semi")


def token_count(vocabulary: str, at_once: int = 32) -> object:
    """A pandas UDF that counts a text's tokens by the vocabulary file at that path (the driver's): of the kind that the tokenizers library reads. Null texts have none."""
    rules = Path(vocabulary).read_text()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(rules)
        coder.encode_special_tokens = True
        for texts in batches:
            plain = ["" if t is None or t != t else t for t in texts]
            yield pd.Series([len(e) for i in range(0, len(plain), at_once) for e in coder.encode_batch_fast(plain[i : i + at_once], add_special_tokens=False)], dtype="int64")

    return count
