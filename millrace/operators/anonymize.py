"""Masking of personal data as column expressions; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from . import normalize


def urls(c: Column) -> Column:
    """Links as <url>; texts that can hold none are not searched."""
    return normalize.let(c, lambda t: F.when(t.contains("://") | t.contains("www."), F.regexp_replace(t, fixed.URL, "<url>")).otherwise(t))


def emails(c: Column) -> Column:
    """Addresses whose local part and labels are well formed; others stay."""
    edge = f"[{fixed.EMAIL_EDGE}]"
    local = r"[a-zA-Z0-9_+-]+(?:\.[a-zA-Z0-9_+-]+)*"
    label = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
    return F.regexp_replace(c, rf"(?<!{edge}){local}@(?:{label}\.)+(?=[a-zA-Z0-9]*[a-zA-Z])[a-zA-Z0-9]{{2,6}}(?!{edge})", "<email>")


def phones(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<![0-9]){fixed.PHONE}(?![0-9])", "<tel>")


def ids(c: Column) -> Column:
    """Every identity number by form: a failed checksum does not save one."""
    return F.regexp_replace(c, rf"(?<![0-9]){fixed.ID_NUMBER}(?![0-9xX])", "<id>")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def cards(c: Column) -> Column:
    """Numbers of the issuers' forms that pass the checksum: matches and the gaps between them are joined again."""
    pattern = rf"(?<![0-9])(?:{fixed.CARD})(?![0-9])"
    gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    shown = F.transform(hits, lambda h: F.when(luhn(F.regexp_replace(h, "[^0-9]", "")), F.lit("<credit_card_number>")).otherwise(h))
    joined = F.array_join(F.zip_with(gaps, shown, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    return F.when(c.rlike("[0-9]{4}"), joined).otherwise(c)


PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ips(c: Column) -> Column:
    """Addresses by line; a quad of single digits may be a section number, so its line must speak of an IP. Lines are stripped."""
    single = r"(?<![0-9.])[0-9](?:\.[0-9]){3}(?![0-9.])"
    group = "[0-9a-fA-F]{1,4}"
    # a double colon stands for one group or more, so at most seven are written beside it
    short = "|".join(f"(?:{group}:){{{k - 1}}}{group}::(?:(?:{group}:){{0,{6 - k}}}{group})?" for k in range(1, 7))
    six = rf"(?<![0-9a-fA-F:])(?:(?:{group}:){{7}}{group}|{short}|(?:{group}:){{6}}{group}::|::(?:(?:{group}:){{0,6}}{group})?)(?![0-9a-fA-F:])"

    def line(x: Column) -> Column:
        spoken = x.rlike(rf"(?iu){fixed.IP_SPOKEN}{single}")
        return normalize.strip(F.regexp_replace(F.when(spoken, F.regexp_replace(ipv4(x), single, "<ip>")).otherwise(ipv4(x)), six, "<ip>"))

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def ipv4(c: Column) -> Column:
    """Addresses with parts of 0 to 255 without leading zeros, not all single digits."""
    return F.regexp_replace(c, rf"(?<![0-9.])(?![0-9](?:\.[0-9]){{3}}(?![0-9])){PART}(?:\.{PART}){{3}}(?![0-9.])", "<ip>")


def findings(c: Column, least: float = 0.0) -> Column:
    """(entity, score, hit) of every recogniser's matches, best score first; hits of different recognisers may overlap."""
    def of(entity: str, score: float, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(0)), lambda h: F.struct(F.lit(entity).alias("entity"), F.lit(score).alias("score"), h.alias("hit")))

    return F.concat(*(of(*r) for r in fixed.RECOGNISERS if r[1] >= least))


def recognised(c: Column, least: float = 0.0) -> Column:
    """Every recognised span as <ENTITY>; where recognisers overlap the surer one has it."""
    for entity, score, pattern in fixed.RECOGNISERS:
        c = F.regexp_replace(c, "(?U)" + pattern, f"<{entity}>") if score >= least else c
    return c
