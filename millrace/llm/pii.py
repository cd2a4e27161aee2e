"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Columns and SQL only: every span is found, described, scored and replaced by DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as given, with possessive repeats and a rule where runs may begin, so that Java's matcher
#: neither tries a run again from each of its characters nor recurses: the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: what people write instead. They overlap each other and the base spans; of spans of which one
#: holds the other the longer is chosen. Local parts and labels of any length; the 127 labels of a domain name and the
#: digits of an address part, a card or a number's groups are what these formats allow, not cuts. Groups of one and two
#: digits between colons are times and ratios; an address has a letter or a longer group.
WIDE = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[\p{L}0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[\p{L}0-9-]++){1,126}"),
    ("ip", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*?(?:[A-Fa-f]|[0-9]{3}))(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20./-]{0,2}\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
)
SPAN = "array<struct<start:int,end:int,hit:string>>"
#: Small integers each candidate is described by; the trees split on them.
FEATURES = ("kind", "digits", "letters", "marks", "length", "spaces", "before", "after", "luhn", "big_part", "cue")
ROUNDS, RATE, CHUNK = 8, 0.6, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """Start, end (code points) and text of the leftmost matches that don't overlap.

    Matches and the gaps between them alternate, so positions are running sums of lengths; these are made in
    chunks, as appending to one array would copy it for each match.
    """
    none = F.array().cast(SPAN)

    def walk(parts: Column, at: Column) -> Column:
        start = lambda acc, x: acc["at"] + x["gap"]
        step = lambda acc, x: F.struct((start(acc, x) + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))).alias("out"))
        return F.aggregate(parts, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def place(parts: Column) -> Column:
        count = F.ceil(F.size(parts) / CHUNK).cast("int")
        chunk = lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK))
        length = lambda i: F.aggregate(chunk(i), F.lit(0), lambda s, x: s + x["gap"] + F.length(x["hit"]))
        starts = F.aggregate(F.transform(F.sequence(F.lit(0), count - 1), length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.transform(starts, lambda at, i: walk(chunk(i), at)))

    def build(x: Column) -> Column:
        gaps = F.split(x, pattern, -1)
        return let(gaps, lambda g: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda h, i: F.struct(F.length(F.get(g, i)).alias("gap"), h.alias("hit"))))

    return let(let(text, build), lambda parts: F.when(F.size(parts) > 0, place(parts)).otherwise(none))


def only(condition: Column, found: Column) -> Column:
    """found where a cheap test passes, else no spans."""
    return F.when(condition, found).otherwise(F.array().cast(SPAN))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits of a hit pass the checksum."""
    def total(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")
        add = lambda s, i: s + let(digit(i), lambda v: F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits(hit), lambda d: F.when(F.length(d).between(1, 32), total(d) % 10 == 0).otherwise(False))


def passes(kind: str, hit: Column) -> Column:
    """The base patterns' further tests."""
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255")))
        return F.forall(F.split(hit, r"\."), part)
    if kind == "card":
        return F.length(digits(hit)).between(14, 19) & luhn(hit)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """_raw: every base match, with ok for those that pass; _wide: the generators' spans; each with its kind's place."""
    text, numbers = F.col("_text"), F.col("_numbers")
    some = {"email": text.contains("@"), "ip": numbers, "card": numbers, "phone": numbers & text.contains("+")}
    wide_some = some | {"email": text.contains("@") | text.rlike(r"[(\[]at[)\]]"), "phone": numbers}
    rows = docs.select(*keep, text_of().alias("_text")).withColumn("_numbers", text.rlike("[0-9]"))

    def tagged(kind: str, found: Column, ok: Column | None = None) -> Column:
        i = KINDS.index(kind)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"), (passes(kind, s["hit"]) if ok is None else ok).alias("ok")))

    raw = F.concat(*(tagged(k, only(some[k], spans(text, p))) for k, p in BASE.items()))
    wide = F.concat(*(tagged(k, only(some["phone"] if p.startswith(r"\+") else wide_some[k], spans(text, p)), F.lit(False)) for k, p in WIDE))
    return rows.withColumn("_raw", raw).withColumn("_wide", wide)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def char_class(c: Column) -> Column:
    """0 none, 1 blank, 2 digit, 3 letter, 4 sign."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)


def described(text: Column, raw: Column, wide: Column) -> Column:
    """Each candidate with its features and label: 1 at an accepted base span of its kind, 0 at one of another kind or where a base match of its own kind failed, else null.

    A failed match tells of a candidate only if it holds the candidate and the same digits: the base pattern then
    judged the same number. Matches of a part of it, or of a longer run, and failures of other kinds say nothing.
    The plus that base phones begin with is hidden from the features, and a phone without its country's code is a
    candidate of its own, so that what is learnt from base phones holds for those written without either.
    """
    def one(s: Column) -> Column:
        hit = s["hit"]
        ahead = lambda n: F.when(s["start"] >= n, F.substring(text, s["start"] - n + 1, F.lit(1))).otherwise("")
        near = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])))
        count = lambda p: F.regexp_count(hit, F.lit(p))
        cap = lambda c, n: F.least(F.lit(n), c)
        values = {
            "kind": s["kind"],
            "digits": cap(count("[0-9]"), 20),
            "letters": cap(count(r"\p{L}"), 15),
            "marks": cap(count(r"[^\p{L}0-9\s+]"), 8),
            "length": cap(F.floor(F.length(F.replace(hit, F.lit("+"), F.lit(""))) / 4).cast("int"), 15),
            "spaces": cap(count(r"\s"), 8),
            "before": char_class(F.when(ahead(1) == "+", ahead(2)).otherwise(ahead(1))),
            "after": char_class(F.substring(text, s["end"] + 1, F.lit(1))),
            "luhn": luhn(hit).cast("int"),
            "big_part": (~hit.contains(":") & F.exists(F.regexp_extract_all(hit, F.lit("[0-9]{3}"), F.lit(0)), lambda p: p > "255")).cast("int"),
            "cue": near.rlike(r"mail|tel|phone|call|fax|mobile|card|visa|server|host|address|contact").cast("int"),
        }
        same = F.exists(raw, lambda r: r["ok"] & (r["kind"] == s["kind"]) & overlaps(r, s))
        judged = lambda r: (r["kind"] == s["kind"]) & (r["start"] <= s["start"]) & (r["end"] >= s["end"]) & (digits(r["hit"]) == digits(hit))
        other = F.exists(raw, lambda r: F.when(r["ok"], overlaps(r, s)).otherwise(judged(r)))
        label = F.when(same, 1).when(other, 0)
        return F.struct(s["start"].alias("start"), s["kind"].alias("place"), s["end"].alias("end"), label.alias("label"), *(v.cast("int").alias(k) for k, v in values.items()))

    return F.transform(wide, one)


def tree_score(trees: list[tuple], value: Callable[[str], Column]) -> Column:
    """The sum of the trees' leaves: (feature, split, (feature, split, leaf, leaf), (feature, split, leaf, leaf)), left if value <= split."""
    out = F.lit(0.0)
    for f, v, left, right in trees:
        leaf = lambda node: F.when(value(node[0]) <= node[1], node[2]).otherwise(node[3])
        out = out + F.when(value(f) <= v, leaf(left)).otherwise(leaf(right))
    return out


def boost(combos: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Newton boosting of depth-two trees for the logistic loss over counted feature combinations (FEATURES, label, held, n), but those held out.

    A round sums gradients by feature and value in Spark, once for the root and once for its two sides; the driver
    picks splits from at most the sum of the features' values.
    """
    trees: list[tuple] = []
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES)))

    def sums(side: Column) -> dict[int, dict[str, list[tuple]]]:
        p = 1 / (1 + F.exp(-tree_score(trees, F.col)))
        rows = combos.filter("NOT held").select(side.alias("side"), (F.col("n") * (F.col("label") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), long.alias("x")).groupBy("side", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        out: dict = {}
        for r in sorted(rows.collect(), key=lambda r: (r.x.feature, r.x.value)):
            out.setdefault(r.side, {}).setdefault(r.x.feature, []).append((r.x.value, r.g, r.h))
        return out

    def split(by: dict[str, list[tuple]] | None) -> tuple:
        """(feature, value, left leaf, right leaf) of the largest gain."""
        best = (-1.0, FEATURES[0], 0, 0.0, 0.0)
        for f in FEATURES if by else ():
            g_all, h_all = sum(x[1] for x in by[f]), sum(x[2] for x in by[f])
            g = h = 0.0
            for v, dg, dh in by[f]:
                g, h = g + dg, h + dh
                gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, v, rate * g / (h + 1), rate * (g_all - g) / (h_all - h + 1))
        return best[1:]

    for _ in range(rounds):
        top = split(sums(F.lit(0)).get(0))
        two = sums(F.when(F.col(top[0]) <= top[1], 0).otherwise(1))
        trees.append((top[0], top[1], split(two.get(0)), split(two.get(1))))
    return trees


def thresholds(combos: DataFrame, trees: list[tuple], precision: float) -> dict[int, float]:
    """For each kind the lowest score from which on labelled candidates that the trees have not seen are right with at least this precision.

    Scores are cut into tenths; a bin's precision counts one wrong candidate besides those seen, so a kind needs about
    1 / (1 - precision) right ones before any of it is added.
    """
    rows = combos.filter("held").select("kind", F.floor(tree_score(trees, F.col) * 10).alias("bin"), (F.col("n") * F.col("label")).alias("good"), "n").groupBy("kind", "bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    out = {}
    for k in range(len(KINDS)):
        good = all_ = 0
        for r in sorted((r for r in rows if r.kind == k), key=lambda r: -r.bin):
            good, all_ = good + r.good, all_ + r.n
            if r.bin >= 0 and good / (all_ + 1) >= precision:
                out[k] = r.bin / 10
    return out


def find_personal_data(spark: SparkSession, docs: DataFrame, precision: float = 0.98, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, _text (null as empty), base and extra: arrays of (start, kind, end), code points, end exclusive.

    Base spans are the fixed patterns'. Extra ones are candidates of the wide generators that the base patterns
    have not judged (described) and that score above their kind's threshold; one inside a longer one is left out.
    The trees learn from judged candidates of one half of the texts (by a hash), thresholds are set on those of the
    other half. All candidates of all texts are counted, as combinations of small features. Nothing is added where
    no candidate was judged wrong, or too few right. Null texts are empty; an empty table gives no rows; repeated
    rows a row each; other columns are ignored.
    """
    scratch = Scratch(spark)
    found = with_spans(docs, ())
    counted = found.filter(F.size("_wide") > 0).select((F.pmod(F.xxhash64("_text"), F.lit(2)) == 0).alias("held"), F.explode(described(F.col("_text"), F.col("_raw"), F.col("_wide"))).alias("c")).select("held", "c.*").filter("label IS NOT NULL")
    combos = scratch.table(counted.groupBy(*FEATURES, "label", "held").agg(F.count(F.lit(1)).alias("n"))).cache()
    labels = {r.label for r in combos.select("label").distinct().collect()}
    trees = boost(combos) if labels == {0, 1} else []
    limits = thresholds(combos, trees, precision) if trees else {}
    combos.unpersist()
    rows = with_spans(docs, keep)
    base = F.array_sort(F.transform(F.filter("_raw", lambda r: r["ok"]), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"))))
    extra = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if limits:
        limit = lambda k: F.element_at(F.array(*(F.lit(float(limits.get(i, math.inf))) for i in range(len(KINDS)))), k + 1)
        good = lambda c: c["label"].isNull() & (tree_score(trees, lambda f: c[f]) >= limit(c["kind"]))
        chosen = F.transform(F.filter(described(F.col("_text"), F.col("_raw"), F.col("_wide")), good), lambda c: F.struct(c["start"].alias("start"), c["place"].alias("kind"), c["end"].alias("end")))
        holds = lambda d, c: (d["start"] <= c["start"]) & (d["end"] >= c["end"]) & (d["end"] - d["start"] > c["end"] - c["start"])
        longest = let(chosen, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: holds(d, c))))
        extra = F.when(F.size("_wide") > 0, F.array_sort(longest)).otherwise(extra)
    return rows.select(*keep, "_text", base.alias("base"), extra.alias("extra"))


def joined(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of find_personal_data."""
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    both = F.concat("base", "extra")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(both)).alias("spans"), F.size("extra").cast("long").alias("n_added"), F.size(both).cast("long").alias("n_spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping ones, replaced by its first kind in angle brackets."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), name(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    return F.when(F.size(found) == 0, text).otherwise(let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text)))))
