"""HTML pages as DataFrame functions: noise is cut out with its line ends left, and one fold over the headings keeps the running line."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rest of a tag: ">" in a quoted value doesn't end it, unless a quote is never closed.
_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
#: What is never text: comments, scripts and styles (to the end of the page where one is not closed); the title is text of its own.
NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
TITLE = rf"(?is)<title\b{_REST}(.*?)(?:</title\s*>|\z)"
OPEN, CLOSE = rf"(?is)<h[1-6]\b{_REST}", r"(?is)</h[1-6]\s*>"
#: Tags that begin a new line.
BLOCK = rf"(?i)</?(?:p|div|br|li|tr|td|th|ul|ol|table|section|article|header|footer|blockquote|pre|dd|dt|h[1-6])\b{_REST}"
TAG = rf"</?[A-Za-z!?]{_REST}"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def woven(text: Column, pattern: str, change) -> Column:
    """``text`` with every hit of ``pattern`` changed by a column function."""
    kept, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(kept, hits, lambda a, b: F.concat(a, F.coalesce(change(b), F.lit("")))), "")


def unescaped(text: Column) -> Column:
    """Entities as characters: numeric ones, and those of HTML 4 by name; others stay."""
    named = F.create_map(*(F.lit(x) for name, code in (name2codepoint | {"apos": 39}).items() for x in (name, chr(code))))

    def one(entity: Column) -> Column:
        inner = F.regexp_replace(entity, "[&;]", "")
        digits = F.when(F.rlike(inner, F.lit("^#[xX]")), F.substr(inner, F.lit(3))).when(F.startswith(inner, F.lit("#")), F.conv(F.substr(inner, F.lit(2)), 10, 16))
        number = F.conv(digits, 16, 10).cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")), F.when(digits.isNull(), named[inner]), entity)

    return F.when(F.contains(text, F.lit("&")), woven(text, ENTITY, one)).otherwise(text)


def _newlines(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", "")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def visible(piece: Column) -> Column:
    """The text of a piece of a page: block tags end lines, other tags go, lines are trimmed, and no more than one line in a row is blank."""
    plain = unescaped(F.regexp_replace(F.regexp_replace(piece, BLOCK, "\n"), TAG, ""))
    lines = F.transform(F.split(plain, "\n"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit("\n"))


def body(html: Column) -> Column:
    """A page without noise and title; their line ends stay, so that lines can be counted."""
    return woven(woven(html, NOISE, _newlines), TITLE, _newlines)


def sections(page: Column) -> Column:
    """(line, level, heading, content) of a ``body``: what goes before the first heading, if it has text, as "(intro)" of level 0, then a section per heading; none without headings.

    One fold over the page, cut at the tags that open headings, keeps the running line; ``line`` is that of the heading's tag in the source. A heading ends at the next
    end tag of any heading; one without any before the next heading begins is plain text of the section above.
    """
    pieces = F.zip_with(F.concat(F.array(F.lit("")), F.regexp_extract_all(page, F.lit(OPEN), F.lit(0))), F.split(page, OPEN, -1), lambda o, t: F.struct(o.alias("open"), t.alias("text"), F.regexp_instr(t, F.lit(CLOSE)).alias("at")))
    empty = F.array().cast("array<struct<line:int,level:int,heading:string,content:string>>")
    start = F.struct(empty.alias("done"), F.lit(1).alias("line"), F.struct(F.lit(1).alias("line"), F.lit(0).alias("level"), F.lit("").alias("heading"), F.lit("").alias("content")).alias("now"))
    lines = lambda t: F.char_length(_newlines(t))

    def step(s: Column, x: Column) -> Column:
        heads = (x["open"] != "") & (x["at"] > 0)
        more = F.struct(s["now"]["line"].alias("line"), s["now"]["level"].alias("level"), s["now"]["heading"].alias("heading"), F.concat(s["now"]["content"], F.when(x["open"] != "", "\n").otherwise(""), x["text"]).alias("content"))
        new = F.struct(s["line"].alias("line"), F.substr(x["open"], F.lit(3), F.lit(1)).cast("int").alias("level"), F.substr(x["text"], F.lit(1), x["at"] - 1).alias("heading"), F.substr(x["text"], x["at"]).alias("content"))
        return F.struct(F.when(heads, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), (s["line"] + lines(x["open"]) + lines(x["text"])).alias("line"), F.when(heads, new).otherwise(more).alias("now"))

    title = lambda h: F.coalesce(F.nullif(_squeezed(unescaped(F.regexp_replace(F.regexp_replace(h, BLOCK, " "), TAG, ""))), F.lit("")), F.lit("(heading)"))
    made = F.aggregate(pieces, start, step, lambda s: F.array_append(s["done"], s["now"]))
    own = F.transform(made, lambda x: F.struct(x["line"], x["level"], F.when(x["level"] == 0, "(intro)").otherwise(title(x["heading"])).alias("heading"), visible(x["content"]).alias("content")))
    return F.element_at(F.transform(F.array(own), lambda o: F.when(F.size(o) > 1, F.filter(o, lambda x: (x["level"] > 0) | (x["content"] != ""))).otherwise(F.slice(o, 1, 0))), 1)


def page_title(html: Column) -> Column:
    """The title, else the first heading of level 1, else ""."""
    first = F.regexp_extract(body(html), rf"(?is)<h1\b{_REST}(.*?)</h[1-6]\s*>", 1)
    titled = _squeezed(unescaped(F.regexp_extract(F.regexp_replace(html, NOISE, ""), TITLE, 1)))
    return F.when(titled != "", titled).otherwise(_squeezed(unescaped(F.regexp_replace(first, TAG, ""))))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute; "" without it."""
    raw = F.regexp_extract(tag, rf"(?i)\s{name}{_VALUE}", 1)
    return F.trim(unescaped(F.regexp_replace(raw, "^[\"']|[\"']$", "")))


def references(html: Column) -> Column:
    """The targets of all links, as often as they stand."""
    tags = F.regexp_extract_all(F.regexp_replace(html, NOISE, ""), F.lit(rf"(?i)<a\b{_REST}"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: _attribute(t, "href")), lambda x: x != "")


def pictures(html: Column) -> Column:
    """(src, alt) of all images."""
    tags = F.regexp_extract_all(F.regexp_replace(html, NOISE, ""), F.lit(rf"(?i)<img\b{_REST}"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: F.struct(_attribute(t, "src").alias("src"), _attribute(t, "alt").alias("alt"))), lambda x: x["src"] != "")
