"""Operators by name, chains of them, and the table of what a chain did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anonymize, chunk, dedup, filters, normalize, select

FAILURE = T.StructType([T.StructField(n, T.StringType()) for n in ("op_name", "error_code", "reason")])
SAMPLE = T.StructType(
    [T.StructField("fileId", T.StringType()), T.StructField("fileName", T.StringType()), T.StructField("fileType", T.StringType()), T.StructField("filePath", T.StringType()), T.StructField("fileSize", T.LongType()), T.StructField("text", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("failed_reason", FAILURE)]
)
MODALITIES = ("text", "image", "audio", "video", "multimodal")


@dataclass(frozen=True)
class Operator:
    """kind: "map" (text -> text), "filter" (frame -> frame) or "slice" (frame -> more rows). fails: a null result for a text means failure."""

    name: str
    kind: str
    run: Callable
    inputs: str = "text"
    outputs: str = "text"
    defaults: dict = field(default_factory=dict)
    fails: bool = False


REGISTRY: dict[str, Operator] = {}


def register(name: str, kind: str, run: Callable, inputs: str = "text", outputs: str = "text", fails: bool = False, **defaults: object) -> Operator:
    if not name.isidentifier() or kind not in ("map", "filter", "slice") or not {inputs, outputs} <= set(MODALITIES):
        raise ValueError(f"bad operator {name!r}")
    REGISTRY[name] = Operator(name, kind, run, inputs, outputs, defaults, fails)
    return REGISTRY[name]


for _name, _run in {
    "unicode_spaces": normalize.unicode_spaces, "extra_spaces": normalize.extra_spaces, "full_width": normalize.full_width, "invisible": normalize.invisible, "garble": normalize.garble,
    "emoji": normalize.emoji, "html_tags": normalize.html_tags, "legends": normalize.legends, "contents_table": normalize.contents_table, "xml_values": normalize.xml_values, "kb_text": normalize.kb_text,
    "punctuation": normalize.punctuation, "links": normalize.links, "html_text": normalize.html_text, "copyright_notice": normalize.copyright_notice, "long_words": normalize.long_words,
    "bad_substrings": normalize.bad_substrings, "specific_chars": normalize.specific_chars, "chinese_only": normalize.chinese_only, "replaced": normalize.replaced, "table_text": normalize.table_text,
    "repeated_sentences": normalize.repeated_sentences, "tex_comments": normalize.tex_comments, "tex_header": normalize.tex_header, "tex_bibliography": normalize.tex_bibliography, "tex_macros": normalize.tex_macros,
    "urls": anonymize.urls, "emails": anonymize.emails, "phones": anonymize.phones, "ids": anonymize.ids, "cards": anonymize.cards, "ips": anonymize.ips,
}.items():
    register(_name, "map", _run, fails=_name == "xml_values")
register("distinct_lines", "map", filters.distinct_lines, least=5)
register("lexicon_masked", "map", lambda c, lexicon: filters.lexicon_masked(tuple(lexicon))(c))
register("by_length", "filter", filters.by_length, least=10, most=10_000_000)
register("by_special_chars", "filter", filters.by_special_chars, limit=0.3)
register("by_repeated_char", "filter", filters.by_repeated_char, limit=0.5)
register("by_repeated_phrase", "filter", filters.by_repeated_phrase, limit=0.5)
register("exact", "filter", lambda df, key="doc_id": dedup.exact(df, F.col("text"), key), key="doc_id")
register("greedy_kept", "filter", dedup.greedy_kept, limit=0.5)
register("by_lexicon", "filter", lambda df, lexicon, limit=0.01: df.filter(filters.lexicon_share(tuple(lexicon))(F.col("text")) < limit), limit=0.01)
register("top_k", "filter", select.top_k, key="doc_id")
register("by_frequency", "filter", select.by_frequency)
register("by_range", "filter", select.by_range)
register("by_hash", "filter", select.by_hash, key="doc_id")
register("tagged", "filter", select.tagged)
register("split_text", "slice", lambda df, size=800, overlap=100: chunk.chunks(df, chunk.split_text(size, overlap)(F.col("text"))), size=800, overlap=100)
register("windows", "slice", lambda df, size=800, overlap=100: chunk.chunks(df, chunk.windows(F.col("text"), size, overlap)), size=800, overlap=100)


def check(names: list[str]) -> list[str]:
    """What is wrong with a chain: unknown operators, or outputs that the next one doesn't take (multimodal takes and gives all)."""
    wrong = [f"unknown operator {n}" for n in names if n not in REGISTRY]
    known = [REGISTRY[n] for n in names if n in REGISTRY]
    return wrong + [f"{a.name} gives {a.outputs}, {b.name} takes {b.inputs}" for a, b in zip(known, known[1:]) if a.outputs != b.inputs and "multimodal" not in (a.outputs, b.inputs)]


class Pipeline:
    """A chain of (name, parameters). All column operators between two filters become one projection."""

    def __init__(self, steps: list[tuple[str, dict]]):
        if wrong := check([n for n, _ in steps]):
            raise ValueError("; ".join(wrong))
        self.steps = steps

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """What the chain leaves: rows whose text has become empty go, null texts count as empty.

        Where an operator of the chain can fail, a column failed_reason is added: rows that one failed on stay to the
        end with an empty text and the first failure, past all filters; slices leave them out.
        """
        capture, pending = any(REGISTRY[n].fails for n, _ in self.steps), False
        if capture and "failed_reason" not in df.columns:
            df = df.withColumn("failed_reason", F.lit(None).cast(FAILURE))
        for name, given in self.steps:
            op, params = REGISTRY[name], REGISTRY[name].defaults | given
            if op.kind == "map":
                value = op.run(F.coalesce(F.col(text), F.lit("")), **params)
                df, pending = guarded(df, name, value, text) if op.fails else df.withColumn(text, value), True
                continue
            df, pending = (once(df, text) if pending else df), False
            if not capture:
                df = op.run(df, **params)
            elif op.kind == "filter":
                df = op.run(df.filter("failed_reason IS NULL"), **params).unionByName(df.filter("failed_reason IS NOT NULL"))
            else:
                df, capture = op.run(df.filter("failed_reason IS NULL"), **params), False
        if text not in df.columns:
            return df
        df = once(df, text) if pending else df
        return df.filter((F.length(text) > 0) | F.col("failed_reason").isNotNull()) if capture else df.filter(F.length(text) > 0)

    def results(self, before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row an input: sizes before and after, COMPLETED, FAILED (with a failed_reason) or FILTERED."""
        a = before.select(key, F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("src_size"))
        failed = F.col("failed_reason").isNotNull() if "failed_reason" in after.columns else F.lit(False)
        b = after.select(key, F.octet_length(text).alias("dest_size"), failed.alias("_failed"))
        out = a.join(b, key, "left")
        status = F.when(F.col("dest_size").isNull(), "FILTERED").when(F.col("_failed"), "FAILED").otherwise("COMPLETED")
        return out.select(key, "src_size", F.coalesce("dest_size", F.lit(0)).alias("dest_size"), status.alias("status"))


def once(df: DataFrame, column: str) -> DataFrame:
    """df with a column computed before any later filter: such a filter would otherwise be pushed below the projection and repeat what made the column."""
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column)).select(*df.columns)


def guarded(df: DataFrame, op_name: str, value: Column, into: str = "text") -> DataFrame:
    """Put value into a column; where it is null though the old value was not, keep the row and say which operator failed."""
    failed = value.isNull() & F.col(into).isNotNull()
    reason = F.struct(F.lit(op_name).alias("op_name"), F.lit("82000").alias("error_code"), F.lit("no result").alias("reason"))
    old = F.col("failed_reason") if "failed_reason" in df.columns else F.lit(None).cast(FAILURE)
    return df.withColumns({"failed_reason": F.coalesce(old, F.when(failed, reason)), into: F.coalesce(value, F.when(failed, F.lit("")))})
