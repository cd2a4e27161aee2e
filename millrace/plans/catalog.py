"""Catalogue and statistics queries: datasets, files, tags, tasks, operators, mixing and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered


def search(df: DataFrame, keyword: str | None = None, fields: tuple[str, ...] = (), **equal: object) -> DataFrame:
    """Rows that hold the keyword in some field (any case) and have the given values; null or blank conditions don't hold."""
    if keyword and keyword.strip():
        found = F.lit(False)
        for f in fields:
            found = found | F.lower(f).contains(keyword.lower())
        df = df.filter(found)
    for name, value in equal.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def status_of(executor_failed: Column, done: Column, failed: Column) -> Column:
    return F.when(executor_failed, "FAILED").when((done > 0) & (failed > 0), "PARTIAL_SUCCESS").when(done > 0, "COMPLETED").otherwise("FAILED")


def progress(done: Column, failed: Column, total: Column) -> tuple[Column, Column]:
    """Percent of all and of those ended that are done, two places, half to even; 0 for none."""
    percent = lambda a, b: F.when(b > 0, F.bround(a * 100 / b, 2)).otherwise(0.0)
    return percent(done, F.greatest(total, done + failed)), percent(done, done + failed)


def distribution(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(field, F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def in_every_group(pairs: DataFrame, key: str, category: str, groups: list[list]) -> DataFrame:
    """Keys with a category of every group."""
    has = [F.sum(F.col(category).isin(*g).cast("int")).alias(f"_g{i}") for i, g in enumerate(groups)]
    out = pairs.groupBy(key).agg(*has)
    for i in range(len(groups)):
        out = out.filter(F.col(f"_g{i}") > 0)
    return out.select(key)


def listed(df: DataFrame, key: str, value: Column, order: list[Column], separator: str = ",") -> DataFrame:
    """Values of a key as one string, in order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.cast("string").alias("_v")))), lambda x: x["_v"]), separator).alias("listed"))


def expired(created: Column, retention_days: Column, now: Column) -> Column:
    return (retention_days > 0) & (F.date_add(created.cast("date"), retention_days.cast("int")) < now.cast("date"))


def has_tag(tags: Column, name: str) -> Column:
    """Whether a JSON array of tag objects has one of the name; anything but an array counts as none."""
    parsed = F.from_json(F.when(F.trim(tags).startswith("["), tags).otherwise("[]"), "array<struct<name:string>>")
    return F.coalesce(F.exists(parsed, lambda t: t["name"] == name), F.lit(False))


def flat_tags(tags: Column) -> Column:
    """(label, value) of full tags: the values under their lower-cased type."""
    kind = "array<struct<from_name:string,to_name:string,type:string,values:map<string,array<string>>>>"
    return F.flatten(F.transform(F.coalesce(F.from_json(tags, kind), F.array().cast(kind)), lambda t: F.transform(F.coalesce(F.try_element_at(t["values"], F.lower(t["type"])), F.array().cast("array<string>")), lambda v: F.struct(t["from_name"].alias("label"), v.alias("value")))))


def full_tags(tags: Column, controls: dict[str, str]) -> Column:
    """Simple tags (from_name or fromName, to_name or toName, values) in full form; unknown controls and missing names go, full tags stay."""
    kind = "array<struct<id:string,from_name:string,fromName:string,to_name:string,toName:string,type:string,values:string>>"
    types = F.create_map(*(x for k, v in controls.items() for x in (F.lit(k), F.lit(v))))

    def one(t: Column) -> Column:
        source, target = F.coalesce(t["from_name"], t["fromName"]), F.coalesce(t["to_name"], t["toName"])
        name = F.coalesce(t["type"], F.try_element_at(types, source))
        values = F.when(t["values"].startswith("{"), F.from_json(t["values"], "map<string,array<string>>")).otherwise(F.create_map(name, F.from_json(t["values"], "array<string>")))
        made = F.coalesce(t["id"], F.md5(F.concat_ws("|", source, target, t["values"])))
        return F.struct(made.alias("id"), source.alias("from_name"), target.alias("to_name"), name.alias("type"), values.alias("values"))

    known = lambda t: t["type"].isNotNull() | (F.coalesce(t["from_name"], t["fromName"]).isin(*controls) & F.coalesce(t["to_name"], t["toName"]).isNotNull())
    return F.transform(F.filter(F.from_json(tags, kind), known), one)


def merged_tags(old: Column, new: Column) -> Column:
    """New tags put into a list one after another: each takes the place of the last tag of its id, or else of its (from, to, type), (from, to) or from, and keeps what it lacks; others are appended."""
    def place(acc: Column, t: Column) -> Column:
        same = [lambda x: x["id"] == t["id"], lambda x: (x["from_name"] == t["from_name"]) & (x["to_name"] == t["to_name"]) & (x["type"] == t["type"]), lambda x: (x["from_name"] == t["from_name"]) & (x["to_name"] == t["to_name"]), lambda x: x["from_name"] == t["from_name"]]
        last = [F.array_max(F.filter(F.transform(acc, _at(f)), lambda i: i.isNotNull())) for f in same]
        at = F.coalesce(*last)
        fill = lambda x: F.struct(*(F.coalesce(t[n], x[n]).alias(n) for n in ("id", "from_name", "to_name", "type")), t["values"].alias("values"))
        return F.when(at.isNull(), F.concat(acc, F.array(t))).otherwise(F.transform(acc, lambda x, i: F.when(i == at, fill(x)).otherwise(x)))

    return F.aggregate(new, old, place)


def _at(same):
    return lambda x, i: F.when(F.coalesce(same(x), F.lit(False)), i)


def boxes(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A pixel box in percent of its image, each 0..100; a size of 0 counts as 1."""
    of = lambda v, whole: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v * 100.0 / F.when(whole > 0, whole).otherwise(1.0)))
    return F.struct(of(x, width).alias("x"), of(y, height).alias("y"), of(w, width).alias("width"), of(h, height).alias("height"))


def lineage(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, graph_id) of every node of edges (a, b): the smallest node that edges lead to. Each round contracts edges to the smallest neighbour."""
    edges = edges.select("a", "b").filter("a != b").distinct().checkpoint()
    maps = []
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).toDF("id", "near")
        step = ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("root")).checkpoint()
        maps.append(step)
        a, b = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = edges.join(a, "a").join(b, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().checkpoint()
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("graph_id"))
    found = maps.pop()
    while maps:
        found = maps.pop().join(found.toDF("root", "last"), "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    return found.toDF("id", "graph_id")


def ratio_mix(files: DataFrame, counts: dict[str, int], status: str | None = "ACTIVE", seed: str = "7", source: str = "dataset_id", key: str = "id", path: str = "file_path", also: Column | None = None) -> DataFrame:
    """At most counts[dataset] eligible files of each dataset by seeded md5, datasets in the order given; a path that an earlier one took is not replaced.

    also: a further condition on files (eligible makes one). Counts must be there and positive.
    """
    from ..operators.select import per_source

    if not counts or any(n < 1 for n in counts.values()):
        raise ValueError("counts must be positive")
    ok = (F.lit(True) if status is None else F.col("status") == status) & (F.lit(True) if also is None else also)
    chosen = per_source(files, source, counts, key, seed, ok)
    place = F.create_map(*(x for i, s in enumerate(counts) for x in (F.lit(s), F.lit(i))))
    once = Window.partitionBy(path).orderBy(F.element_at(place, F.col(source)), key)
    return chosen.withColumn("_turn", F.row_number().over(once)).filter("_turn = 1").drop("_turn")


def eligible(date_range: tuple[str, str] | None = None, label: str | None = None, value: str | None = None, updated: str = "tags_updated_at", tags: str = "tags") -> Column:
    """Files a mix may take: updated within the range (a missing time passes), and with a tag of the label and value where these are given."""
    ok = F.lit(True)
    if date_range:
        ok = F.col(updated).isNull() | F.col(updated).cast("timestamp").between(*(F.lit(d).cast("timestamp") for d in date_range))
    if label or value:
        ok = ok & F.coalesce(F.exists(flat_tags(F.col(tags)), lambda t: (F.lit(not label) | (t["label"] == (label or ""))) & (F.lit(not value) | (t["value"] == (value or "")))), F.lit(False))
    return ok


def unique_names(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names made unique within their folder: stem_1.ext, stem_2.ext and so on after the first in order."""
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    turned = numbered(df, [folder, name], [order], "_turn").withColumn("_turn", F.col("_turn") - 1)
    return turned.withColumn(name, F.when(F.col("_turn") > 0, F.concat(stem, F.lit("_"), F.col("_turn").cast("string"), ext)).otherwise(F.col(name))).drop("_turn")


def placed(df: DataFrame, first: Column, name: str, out: str = "place") -> DataFrame:
    """Number rows from 1, those with first before the others, then by name, without sorting all in one task."""
    return numbered(df.withColumn("_last", ~first), [], ["_last", name], out).withColumn(out, F.col(out).cast("int")).drop("_last")


def bounding(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The box around each polygon's points."""
    return points.groupBy(key).agg(F.min(x).alias("left"), F.min(y).alias("top"), F.max(x).alias("right"), F.max(y).alias("bottom"))


def parsed_questions(answer: Column, most: int = 0) -> Column:
    """The questions of a model's answer: the JSON array of strings between its first and last bracket, blank ones left out; none where there is no such array."""
    found = F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<string>"), F.array().cast("array<string>"))
    kept = F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.length(q) > 0)
    return F.slice(kept, 1, most) if most else kept


def alpaca(question: Column, answer: Column) -> Column:
    return F.to_json(F.struct(question.alias("instruction"), answer.alias("output")))


def sharegpt(question: Column, answer: Column, context: Column | None = None) -> Column:
    """A conversation of two turns, after a system turn where there is a context."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    turns = F.array(turn("human", question), turn("gpt", answer))
    if context is not None:
        turns = F.when(F.length(context) > 0, F.concat(F.array(turn("system", context)), turns)).otherwise(turns)
    return F.to_json(F.struct(turns.alias("conversations")))


def question_count(chunk: Column, per_thousand: int = 5) -> Column:
    return F.greatest(F.floor(F.length(chunk) / 1000 * per_thousand), F.lit(1))


def filled(template: str, **values: Column) -> Column:
    """A prompt with {name} placeholders replaced."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def verdicts(answer: Column) -> Column:
    """Y or N marks of an evaluator's answer as booleans."""
    return F.transform(F.regexp_extract_all(answer, F.lit("结果[:：] ?([YN])"), F.lit(1)), lambda v: v == "Y")


def weighted_scores(df: DataFrame, key: str, scores: str = "scores", length: str = "length", dimensions: int = 6) -> DataFrame:
    """Length-weighted means of the chunks' score arrays; chunks with another number of scores don't count."""
    rows = df.filter(F.size(scores) == dimensions).select(key, length, F.posexplode(scores).alias("dimension", "score"))
    return rows.groupBy(key, "dimension").agg((F.sum(F.col("score") * F.col(length)) / F.sum(length)).alias("score"))
