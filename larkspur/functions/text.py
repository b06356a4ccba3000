"""String functions as Columns; NFKC, which Spark lacks, is the one vectorised UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts in browsers see it (beyond ASCII: no-break, ideographic, byte order mark and others).
_SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF\\x0B]"
#: Hiragana and katakana, ideographs with their first extension, half-width katakana.
JAPANESE = "[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, one Arrow batch at a time."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalized_title(title: Column) -> Column:
    """NFKC, without white space, lower case.  Pure ASCII skips the UDF's result only in value, not in cost: use ascii_title there."""
    return F.lower(F.regexp_replace(nfkc(title), _SPACE, ""))


def ascii_title(title: Column) -> Column:
    """normalized_title for text known to be ASCII: JVM only."""
    return F.lower(F.regexp_replace(title, _SPACE, ""))


def contains_either(a: Column, b: Column) -> Column:
    """One of two non-empty titles contains the other."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def has_japanese(text: Column) -> Column:
    return text.rlike(JAPANESE)


def any_japanese(spans: Column) -> Column:
    return F.exists(spans, lambda s: s.rlike(JAPANESE))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null (not '') without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def without_date_suffix(title: Column) -> Column:
    """Drops a trailing date in parentheses (either width), unless nothing would be left."""
    cut = F.regexp_replace(title, rf"{_SPACE}*[(（]{_SPACE}*(?:[0-9]{{4}}[/.年])?[0-9]{{1,2}}[/.月][0-9]{{1,2}}日?[^()（）]*[)）]{_SPACE}*$", "")
    cut = F.regexp_replace(cut, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), title)


def mapped(value: Column, table: dict[str, str] | Column, default: Column | None = None) -> Column:
    """A lookup in a dictionary or a map column; unknown values give the default or null."""
    entries = table if isinstance(table, Column) else F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(entries, value)
    return found if default is None else F.coalesce(found, default)


def storage_key(url: Column, hosts: dict[str, str] | Column) -> Column:
    """Canonical key of an image url: allowed hosts only, under their alias, without query or fragment; else null."""
    host = F.lower(extracted(url, r"^(?:https?:)?//([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^(?:https?:)?//[^/?#]+/*([^?#]*)", 1)
    alias = mapped(host, hosts)
    return F.when(alias.isNotNull() & (path != ""), F.concat_ws("/", alias, path))


def upstream_url(key: Column, hosts: dict[str, str]) -> Column:
    """The url of a key: the inverse of storage_key."""
    alias = F.substring_index(key, "/", 1)
    host = mapped(alias, hosts)
    return F.when(host.isNotNull(), F.concat(F.lit("https://"), host, F.lit("/"), F.substring(key, F.length(alias) + 2, F.length(key))))


def rewritten_src(src: Column, hosts: dict[str, str] | Column, prefix: str = "/img/") -> Column:
    """Local path of an image; urls that are already local, or of other hosts, stay."""
    key = storage_key(src, hosts)
    return F.when(src.startswith(prefix) | key.isNull(), src).otherwise(F.concat(F.lit(prefix), key))


def rewritten_href(href: Column, host: str, kinds: dict[str, str], language: str) -> Column:
    """Article links to local pages: lower-cased id, fragment kept, query dropped; others stay."""
    out = href
    for path, local in kinds.items():
        pattern = rf"^(?:https?:)?//{host}/{path}/([0-9A-Za-z_]+)/?(?:\?[^#]*)?(#.*)?$"
        out = F.when(href.rlike(pattern), F.concat(F.lit(f"/{language}/{local}/"), F.lower(F.regexp_extract(href, pattern, 1)), F.regexp_extract(href, pattern, 2))).otherwise(out)
    return out


#: File extensions of image types.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/svg+xml": "svg"}


def key_with_extension(key: Column, mime: Column) -> Column:
    """The key with its type's extension; an unknown type is an error."""
    extension = mapped(mime, EXTENSIONS)
    checked = F.when(extension.isNull(), F.raise_error(F.concat(F.lit("unknown image type: "), F.coalesce(mime, F.lit("null"))))).otherwise(extension)
    return F.concat(F.regexp_replace(key, r"\.[^./]*$", ""), F.lit("."), checked)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("#", *parts)


def composite_parts(key: Column) -> Column:
    """Array of the part before the first # and the rest."""
    return F.split(key, "#", 2)


def string_hash(text: Column) -> Column:
    """The 31-multiplier 32-bit hash of UTF-16 units, as Java has it; here by code point, equal within the basic plane."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.when(text == "", F.lit(0).cast("long")).when(h >= (1 << 31), h - (1 << 32)).otherwise(h)


def hash_id(prefix: str, text: Column) -> Column:
    """prefix and eight hex digits of the absolute hash (taken as a long, so -2**31 gives 80000000)."""
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(F.abs(string_hash(text)))), 8, "0"))


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escaped_attribute(text: Column) -> Column:
    return F.replace(escaped(text), F.lit('"'), F.lit("&quot;"))


def collapsed_space(text: Column) -> Column:
    """Runs of ASCII white space become one space; ideographic spaces stay."""
    return F.regexp_replace(text, "[ \\t\\r\\n\\f\\x0B]+", " ")


def edge_trimmed(text: Column) -> Column:
    """Trims spaces, ideographic ones too."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


#: Named colours and their hex forms.
COLOURS = {"red": "#FF0000", "blue": "#0000FF", "green": "#008000", "orange": "#FFA500", "yellow": "#FFFF00", "purple": "#800080", "black": "#000000", "white": "#FFFFFF", "gray": "#808080"}


def hex_colour(css: Column) -> Column:
    """#RRGGBB in upper case from hex, named, rgb() or rgba() colours; else null."""
    c = F.lower(F.trim(css))
    channel = lambda k: F.lpad(F.hex(F.least(F.regexp_extract(c, r"^rgba?\( *([0-9]+) *, *([0-9]+) *, *([0-9]+)", k).try_cast("int"), F.lit(255))), 2, "0")
    short = F.upper(F.regexp_replace(c, "^#(.)(.)(.)$", "#$1$1$2$2$3$3"))
    return (
        F.when(c.rlike("^#[0-9a-f]{6}$"), F.upper(c))
        .when(c.rlike("^#[0-9a-f]{3}$"), short)
        .when(c.rlike(r"^rgba?\( *[0-9]+ *, *[0-9]+ *, *[0-9]+"), F.concat(F.lit("#"), channel(1), channel(2), channel(3)))
        .otherwise(mapped(c, COLOURS))
    )


def without_fence(text: Column) -> Column:
    """Drops a code fence around a whole reply."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def without_scaffold(text: Column, tags: list[str]) -> Column:
    """Drops leading tags of a list, as often as they repeat."""
    return F.regexp_replace(text, rf"^(?:\s*</?(?:{'|'.join(tags)})(?:\s[^>]*)?>)+\s*", "")


def page_urls(path: Column, languages: Column) -> Column:
    """The url of a page in each language."""
    return F.transform(languages, lambda lang: F.concat(F.lit("/"), lang, path))


#: Patterns of slugs, language codes and article ids.
SLUG = "^[a-z0-9_]{1,64}$"
LANGUAGE = "^[a-z]{2,3}(-[A-Za-z0-9]{2,8})?$"
ARTICLE_ID = "^[0-9a-f]{32}$"

#: First bytes of image formats.
MAGIC = (("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("52494646........57454250", "image/webp"))


def sniffed_mime(data: Column) -> Column:
    """Image type by first bytes, or null."""
    head = F.hex(F.substring(data, 1, 12))
    out = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC):
        out = F.when(head.rlike(f"^{magic}"), mime).otherwise(out)
    return out


def joined_spans(spans: Column) -> Column:
    return F.array_join(spans, " ")


def glossary_lines(pairs: Column) -> Column:
    """One line for each struct (source, target), or '' without any."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- "), p["source"], F.lit(" → "), p["target"])), "\n")


def progress_text(current: Column, total: Column, kind: Column) -> Column:
    """Null for plain steps; `5…` while the total is unknown; `5/10`."""
    return F.when(kind == "step", None).when(total.isNull(), F.concat(current.cast("string"), F.lit("…"))).otherwise(F.concat(current.cast("string"), F.lit("/"), total.cast("string")))


def first_unfinished(steps: Column) -> Column:
    """Name of the first step (array of structs ord, name, state) that is neither done nor skipped."""
    open_steps = F.filter(F.array_sort(steps), lambda s: ~s["state"].isin("done", "skipped"))
    return F.get(open_steps, 0)["name"]


def resolved_refs(markup: Column, events: Column) -> Column:
    """Numbered event marks with the attributes of the events (array of structs id, start, end; numbers from 1).

    Null where a number is unknown or any event mark has another form: then the whole text counts as void.
    """
    mark = r'<event\s+n="(\d+)"\s*>'

    def attributes(n):
        e = F.get(events, n.cast("int") - 1)
        end = F.coalesce(F.concat(F.lit(' end="'), e["end"], F.lit('"')), F.lit(""))
        return F.concat(F.lit('<event id="'), e["id"], F.lit('" start="'), e["start"], F.lit('"'), end, F.lit(">"))

    tags = F.transform(F.regexp_extract_all(markup, F.lit(mark), F.lit(1)), attributes)
    out = F.array_join(F.zip_with(F.split(markup, mark, -1), tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.when(F.exists(tags, lambda t: t.isNull()) | out.rlike(r'<event\b(?!\s+id=")'), None).otherwise(out)


def without_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
