"""Cleaning of texts as column expressions; null stays null."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed
from ..functions.chars import char_class, fast_class, range_class

#: What str.strip() of Python removes.
STRIPPED = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """c without the blanks at its ends; only the ends are looked at."""
    return F.btrim(c, F.lit(STRIPPED))


def unicode_spaces(c: Column) -> Column:
    """Unusual spaces become U+0020."""
    return F.regexp_replace(c, fast_class(fixed.UNICODE_SPACES), " ")


def extra_spaces(c: Column) -> Column:
    """Runs of spaces and of blank lines become one; none stay between CJK characters and signs, as which the text's edges count."""
    near = rf"[\x{{4E00}}-\x{{9FA5}}{fast_class(fixed.SPACELESS_CHARS)}]"
    lines = F.array_join(F.transform(F.split(strip(unicode_spaces(c)), "\n"), strip), "\n")
    # what is before a run is looked at where a blank was found, not at every character
    text = F.regexp_replace(F.regexp_replace(lines, " {2,}", " "), rf" (?:(?<={near} )|(?<=\A )) *+(?:(?={near})|\z)", "")
    return F.regexp_replace(text, "[ \n]{2,}", "\n")


def full_width(c: Column) -> Column:
    """Full-width forms become their ASCII counterparts, but for a few punctuation marks."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F) if chr(i) not in fixed.FULL_WIDTH_KEPT)
    return F.translate(c, wide, "".join(chr(ord(w) - 0xFEE0) for w in wide))


def invisible(c: Column) -> Column:
    """Control characters go, and so do bars: the pattern's separators are part of its class."""
    return F.regexp_replace(c, r"[\x00-\x07|\x0E-\x13\x15-\x1F\x7F-\xA0]", "")


def garble(c: Column) -> Column:
    """Characters of ranges taken for garbage go, accented Latin letters among them."""
    return F.regexp_replace(c, range_class(fixed.GARBLE_RANGES), "")


def emoji(c: Column) -> Column:
    return F.regexp_replace(c, range_class(fixed.EMOJI_RANGES), "")


def html_tags(c: Column, remove_tables: bool = False) -> Column:
    """Known tags go and what is between them stays; tags that are left keep colspan and rowspan only."""
    names = "|".join(f"{fixed.HTML_TAGS} {fixed.TABLE_TAGS}".split() if remove_tables else fixed.HTML_TAGS.split())
    text = F.regexp_replace(c, rf"(?i)<(?:{names})(?:\s[^>]*)?>|</(?:{names})>", "")
    tag, attribute = r"<\w+\s[^<>]*>", r'\s*(?!colspan=|rowspan=)(?<!<)\b\w+="[^"<>]+"'
    gaps, tags = F.split(text, tag, -1), F.regexp_extract_all(text, F.lit(tag), F.lit(0))
    bare = lambda gap, hit: F.concat(gap, F.coalesce(F.regexp_replace(hit, attribute, ""), F.lit("")))
    return F.array_join(F.zip_with(gaps, tags, bare), "")


def legends(c: Column) -> Column:
    """Lines that caption a figure or table go."""
    kinds = (f"{prefix} *{number}{end} +" for prefix, number, end in zip(fixed.LEGEND_PREFIXES, fixed.LEGEND_NUMBERS, ("", "[.:]?")))
    text = F.regexp_replace(F.concat(F.lit("\n"), c, F.lit("\n")), rf"(?iuU)(?<=\n)(?:{'|'.join(kinds)})[^\n]*\n", "")
    return let(text, lambda t: F.substring(t, F.lit(2), F.greatest(F.lit(0), F.length(t) - 2)))


def contents_table(c: Column) -> Column:
    """Drop a table of contents: its title line to the last line that looks like an entry, when three in a row don't."""
    title, entry = (F.lit("(?siuU)" + p) for p in (fixed.CONTENTS_TITLE, f"{fixed.CONTENTS_PREFACE}.*{fixed.CONTENTS_END}|{fixed.CONTENTS_MIDDLE}"))

    def step(acc: Column, line: Column) -> Column:
        """begin: lines before the title, at: lines seen, last: lines up to the last entry; three misses end the table."""
        open_, hit = (acc["begin"] >= 0) & (acc["misses"] < 3), F.rlike(line, entry)
        begin = F.when((acc["begin"] < 0) & F.rlike(line, title), acc["at"]).otherwise(acc["begin"])
        return F.struct(begin.alias("begin"), (acc["at"] + 1).alias("at"), F.when(open_ & hit, acc["at"] + 1).otherwise(acc["last"]).alias("last"), F.when(open_ & ~hit, acc["misses"] + 1).when(open_, 0).otherwise(acc["misses"]).alias("misses"))

    def cut(lines: Column) -> Column:
        found = F.aggregate(lines, F.struct(F.lit(-1).alias("begin"), F.lit(0).alias("at"), F.lit(-1).alias("last"), F.lit(0).alias("misses")), step)
        return let(found, lambda f: F.when(f["last"] >= 0, F.array_join(F.filter(lines, lambda _, i: (i < f["begin"]) | (i >= f["last"])), "\n")).otherwise(c))

    return F.when(F.rlike(c, F.lit("(?miuU)" + fixed.CONTENTS_TITLE)), let(F.split(c, "\n"), cut)).otherwise(c)


@F.pandas_udf(StringType())
def xml_values(texts: pd.Series) -> pd.Series:
    """An XML text as indented `key: value` lines; null where it can't be parsed."""
    def show(node: ET.Element, depth: int) -> list[str]:
        value = (node.text or "").strip()
        own = [f"{'  ' * depth}{node.tag}: {value}" if value or not len(node) else f"{'  ' * depth}{node.tag}:"]
        return own + [line for child in node for line in show(child, depth + 1)]

    def read(text: str | None) -> str | None:
        try:
            return "\n".join(show(ET.fromstring(text), 0)) if text else text
        except ET.ParseError:
            return None

    return texts.map(read)


def kb_text(c: Column) -> Column:
    """Text for a knowledge base: no control characters, single spaces, no blank lines."""
    text = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 0), "\n"))


def printable(c: Column) -> Column:
    """Whether anything but white space and control characters is there."""
    return c.rlike(r"[^\s\x00-\x1F\x7F-\xA0]")


def punctuation(c: Column) -> Column:
    one = {k: v for k, v in fixed.PUNCTUATION.items() if len(v) == 1}
    text = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in fixed.PUNCTUATION.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def links(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:https?|ftp)://[^\s]+", "")


#: Entities that are decoded, the ampersand last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "copy": "©", "reg": "®", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "amp": "&"}


def html_text(c: Column) -> Column:
    """HTML as plain text: scripts, styles and comments go with their content, blocks end lines, entities are decoded."""
    text = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n"), r"<[^>]*>", "")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return strip(F.regexp_replace(text, "\n\\s*\n", "\n"))


def html_tables(c: Column) -> Column:
    """All tables of a page, tags and all."""
    return F.regexp_extract_all(c, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))


def copyright_notice(c: Column) -> Column:
    """A leading comment that speaks of copyright goes, or else leading comment lines."""
    block = F.regexp_extract(c, r"^\s*/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", 0)
    lines = r"^(?:\s*(?://|#|--)[^\n]*\n)+"
    return F.when((F.length(block) > 0) & F.lower(block).contains("copyright"), F.substring(c, F.length(block) + 1, F.length(c))).otherwise(F.regexp_replace(c, lines, ""))


def long_words(c: Column, least: int = 1, most: int = 20) -> Column:
    """Words outside the length bounds go; single blanks stay between the rest."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: F.length(w).between(least, most)), " ")


def bad_substrings(c: Column, parts: tuple[str, ...] = ("http", "www", ".com", "href", "//")) -> Column:
    def fine(w: Column) -> Column:
        ok = F.lit(True)
        for p in parts:
            ok = ok & ~w.contains(p)
        return ok

    return F.array_join(F.filter(F.split(c, " "), fine), " ")


def specific_chars(c: Column, chars: str = "◆●■►▼▲▴∆▻▷❖♡□") -> Column:
    return F.translate(c, chars, "")


def chinese_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x{4E00}-\x{9FA5}]", "")


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def table_text(c: Column, least: int = 2, most: int = 20) -> Column:
    """Runs of two lines or more that read as columns go: least to most fields between tabs or two blanks and more."""
    def columns(line: Column) -> Column:
        fields = F.filter(F.split(line, "\t| {2,}"), lambda f: F.length(F.trim(f)) > 0)
        return F.coalesce(F.size(fields).between(least, most), F.lit(False))

    def kept(lines: Column) -> Column:
        near = lambda i: columns(F.get(lines, i - 1)) | columns(F.get(lines, i + 1))
        return F.filter(lines, lambda x, i: ~(columns(x) & near(i)))

    return F.when(c.rlike("\t|  "), F.array_join(F.element_at(F.transform(F.array(F.split(c, "\n")), kept), 1), "\n")).otherwise(c)


def repeated_sentences(c: Column) -> Column:
    """Every sentence stays at its first place only."""
    return F.array_join(F.array_distinct(sentences(c)), " ")


def sentences(c: Column) -> Column:
    """Sentences by a full stop, question or exclamation mark before a blank, and by line ends."""
    marked = F.regexp_replace(c, r"([.!?。！？])\s+", "$1\n")
    return F.filter(F.split(marked, "\n+"), lambda s: F.length(F.trim(s)) > 0)


def tex_comments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^%[^\n]*\n?", ""), r"(?m)([^\\])%[^\n]*$", "$1")


def tex_header(c: Column) -> Column:
    """What precedes the first section heading goes; texts without one become empty."""
    return F.when(c.rlike(r"\\(?:chapter|part|section|subsection|paragraph)\b"), F.regexp_replace(c, r"(?s)^.*?(?=\\(?:chapter|part|section|subsection|paragraph)\b)", "")).otherwise("")


def tex_bibliography(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(?:appendix|begin\{references\}|begin\{thebibliography\}|bibliography\{)[^\n]*.*$", "")


@F.pandas_udf(StringType())
def tex_macros(texts: pd.Series) -> pd.Series:
    """Argument-free \\newcommand and \\def macros are replaced by their bodies."""
    define = re.compile(r"\\(?:newcommand\*?|def)\s*\{?(\\[A-Za-z]+)\}?\s*\{([^{}]*)\}")

    def expand(text: str | None) -> str | None:
        for name, body in define.findall(text or ""):
            kept, _, rest = text.partition(define.search(text)[0]) if define.search(text) else (text, "", "")
            text = kept + re.sub(re.escape(name) + r"(?![A-Za-z])", lambda _: body, rest)  # noqa: B023
        return text

    return texts.map(expand)


def unicode_form(form: str = "NFC"):
    """A pandas UDF: texts in a Unicode normal form."""
    @F.pandas_udf(StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.str.normalize(form)

    return normal
