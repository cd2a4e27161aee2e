"""Sentences, with abbreviations learned from how words of the corpus take a full stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import let

#: A score of this or more makes an abbreviation (Kiss and Strunk, 2006).
LEAST = 0.3
#: So many abbreviations at most are sent to all tasks; more are joined by word.
SENT = 100_000
#: What may stand before a word, and after its full stop.
BEFORE, AFTER = "[\"'(\\[{“‘«]*", "[\"')\\]}”’»]*"
#: The same as characters to be trimmed.
OPENING, CLOSING = "\"'([{“‘«", "\"')]}”’»"


def tokens(text: Column) -> Column:
    """What stands between blanks; the other blanks become spaces, at which a text is cut without a pattern."""
    for blank in "\t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_type(token: Column) -> Column:
    """A token in lower case without what opens and closes around it, and without its last full stop or other mark.

    A token of such characters only is a type without letters, whichever; ends are trimmed, as words are many.
    """
    closed = F.rtrim(F.ltrim(F.lower(token), F.lit(OPENING)), F.lit(CLOSING))
    return let(closed, lambda t: F.when(F.right(t, F.lit(1)).isin(*".,;:!?"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def dotted(token: Column) -> Column:
    """Whether a token ends with a single full stop, and what closes after it."""
    return let(F.rtrim(token, F.lit(CLOSING)), lambda t: t.endswith(".") & ~t.endswith("..") & (t != "."))


def abbreviations(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, dotted, plain, score): word types that hold a letter and came with a full stop, and how likely that stop is part of the word.

    The score is Dunning's log-likelihood of the stop following the word in 99 of 100 cases against its following as
    any word, times exp(-length), the number of full stops in the word and its own, and length ** -(times without).
    Types are counted in each task first.
    """
    each = df.select(F.explode(tokens(F.col(text))).alias("t")).select(word_type(F.col("t")).alias("word"), dotted(F.col("t")).alias("d"))
    counts = each.groupBy("word").agg(F.count_if("d").alias("dotted"), F.count_if(~F.col("d")).alias("plain"))
    total = counts.agg(F.sum(F.col("dotted") + F.col("plain")).alias("_all"), F.sum("dotted").alias("_stops"))
    n, k, stop = F.col("dotted") + F.col("plain"), F.col("dotted"), F.col("_stops") / F.col("_all")
    likely = k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01)) - k * F.log(stop) - F.when(n > k, (n - k) * F.log(1 - stop)).otherwise(0.0)
    length = F.length(F.replace("word", F.lit("."), F.lit("")))
    weight = F.exp(-length.cast("double")) * (F.length("word") - length + 1) * F.pow(length.cast("double"), -F.col("plain").cast("double"))
    # one condition: letters asked for below the counting would make it another than the totals', and both would be done
    named = F.when(F.col("dotted") > 0, F.col("word").rlike(r"\p{L}")).otherwise(False)
    scored = counts.filter(named).join(F.broadcast(total))  # one row
    return scored.select("word", "dotted", "plain", (2 * likely * weight).alias("score"))


def ends_sentence(token: Column, after: Column, known: Column) -> Column:
    """Whether a sentence ends with a token; `after` is the next one, known the abbreviations among the text's words."""
    stop = dotted(token) & ~F.array_contains(known, word_type(token)) & ~word_type(token).rlike(r"^\p{L}$") & ~after.rlike(rf"^{BEFORE}\p{{Ll}}")
    return token.rlike(rf"[!?。！？…]{AFTER}$|\.\.+{AFTER}$") | stop


def split_sentences(df: DataFrame, found: DataFrame | None = None, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, at, sentence) of every text. found: abbreviations(...) of a corpus, by default of df itself.

    A full stop ends a sentence unless its word is an abbreviation or a single letter, or what follows is in lower
    case; other end marks always do. Runs of blanks become one space. Null and blank texts have no sentences.
    """
    short = (abbreviations(df, text) if found is None else found).filter(F.col("score") >= least).select("word").checkpoint()
    rows = df.select(key, tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    if short.count() <= SENT:
        listed = short.agg(F.array_sort(F.collect_list("word")).alias("known"))
        rows = rows.join(F.broadcast(listed))
    else:
        mine = rows.select(key, F.explode(F.array_distinct(F.transform(F.filter("w", dotted), word_type))).alias("word")).join(short, "word")
        rows = rows.join(mine.groupBy(key).agg(F.collect_list("word").alias("known")), key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    last = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == F.size("w")) | ends_sentence(F.get("w", i - 1), F.get("w", i), F.col("known")))
    start = lambda ends, i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    # sentences are put together before they become rows, or else each would carry its whole text
    found = let(last, lambda ends: F.transform(ends, lambda to, i: F.array_join(F.slice("w", start(ends, i) + 1, to - start(ends, i)), " ")))
    return rows.select(key, F.posexplode(found).alias("at", "sentence"))
