"""String, URL, bit and id functions as column expressions."""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip_readings(term: Column) -> Column:
    """Readings after '/' leave each '+'-joined part; synonym nodes (s and digits) stay whole."""
    part = lambda x: F.when(x.rlike(r"^s\d+"), x).otherwise(F.split_part(x, F.lit("/"), F.lit(1)))
    return F.array_join(F.transform(F.split(term, r"\+"), part), "+")


def strip_all_readings(term: Column) -> Column:
    """The same, synonym nodes included."""
    return F.array_join(F.transform(F.split(term, r"\+"), lambda x: F.split_part(x, F.lit("/"), F.lit(1))), "+")


def strip_features(term: Column, features: tuple[str, ...] = ("<可能>", "<尊敬>", "<受身>", "<使役>")) -> Column:
    """The first occurrence of each grammatical feature goes."""
    for f in features:
        at = F.instr(term, f)
        term = F.when(at > 0, F.concat(F.substring(term, F.lit(1), at - 1), F.substring(term, at + len(f), F.length(term)))).otherwise(term)
    return term


def narrow(text: Column) -> Column:
    """Full-width ASCII and the ideographic space to their narrow forms."""
    return F.translate(text, WIDE, NARROW)


def widen_upper(text: Column) -> Column:
    return F.translate(F.upper(text), NARROW, WIDE)


def round4(x: Column) -> Column:
    return F.round(x, 4)


def is_blank(text: Column) -> Column:
    return F.trim(text) == ""


def query_key(text: Column) -> Column:
    """URL-escaped, with '%' carried as '@'."""
    return F.replace(F.url_encode(text), F.lit("%"), F.lit("@"))


def restore_percent(text: Column) -> Column:
    return F.replace(text, F.lit("@"), F.lit("%"))


def short_title(title: Column, n: int = 50) -> Column:
    """Control characters out, blanks for underscores, at most n characters and an ellipsis."""
    t = F.replace(F.regexp_replace(title, r"[\x00-\x1F\x7F]", ""), F.lit("_"), F.lit(" "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def unescape_basic(text: Column) -> Column:
    """The five predefined entities; '&amp;' last, so that nothing is decoded twice."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_basic(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All named and numeric references."""
    return text.map(lambda x: None if x is None else _html.unescape(x))


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link relative to its page."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])


def truncate_html(n: int):
    """A Pandas UDF: at most n visible characters, with open tags closed."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        out, seen, stack = [], 0, []
        for m in re.finditer(r"<(/?)(\w+)[^>]*>|([^<]+|<)", x):
            if m[3] is None:
                if m[1]:
                    if stack and stack[-1] == m[2]:
                        stack.pop()
                        out.append(m[0])
                elif seen < n:
                    stack.append(m[2])
                    out.append(m[0])
            elif seen < n:
                out.append(m[3][: n - seen])
                seen += len(m[3])
        return "".join(out) + "".join(f"</{t}>" for t in reversed(stack))

    return F.pandas_udf(lambda s: s.map(one), T.StringType())


def highlight(text: Column, words: list[str], colours: int = 10) -> Column:
    """Each word in a span of its class, longer words first, classes repeating after `colours`."""
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))
    marks = {i: (chr(0xE000 + 2 * i), chr(0xE001 + 2 * i)) for i in order}
    for i in order:  # private-use marks keep later words from matching inside the spans' own text
        text = F.regexp_replace(text, "(?i)" + "".join("\\" + c if not c.isalnum() else c for c in words[i]), f"{marks[i][0]}$0{marks[i][1]}")
    for i in order:
        text = F.replace(F.replace(text, F.lit(marks[i][0]), F.lit(f'<span class="hit{i % colours}">')), F.lit(marks[i][1]), F.lit("</span>"))
    return text


def gmt_to_jst(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss")


def sid_path(sid: Column) -> Column:
    """dir/file of a ten-digit id: the first four digits, then the first six."""
    return F.concat(F.substring(sid, 1, 4), F.lit("/"), F.substring(sid, 1, 6))


def pad_sid(n: Column) -> Column:
    return F.lpad(n.cast("string"), 10, "0")


def strip_version(sid: Column) -> Column:
    return F.regexp_replace(sid, r"-\d+$", "")


def placement(sid: Column, buckets: int = 120, offset: int = 11) -> Column:
    """A host number: digits two by two, h = 137 h + d, modulo the number of hosts."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(sid) / 2).cast("int") - 1)), lambda i: F.substring(sid, 2 * i + 1, F.lit(2)).cast("int"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda h, d: (h * 137 + d) % buckets) + offset


def normalise_url(url: Column) -> Column:
    """The key under which near-duplicate pages fold: host without www, digits as 0, two path parts, upper case."""
    u = F.regexp_replace(url, r"^[a-z]+://", "")
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^www\d*\.", "")
    u = F.regexp_replace(u, r"\d+", "0")
    u = F.regexp_replace(u, r"/+", "/")
    u = F.regexp_replace(u, r"index\.html?$", "")
    return F.upper(F.array_join(F.slice(F.split(F.regexp_replace(u, "/$", ""), "/"), 1, 3), "/"))


def mask_match(feature: Column, mask: Column, bits: int = 511) -> Column:
    """A feature filter: an empty mask keeps everything, else one common bit is enough."""
    return (mask.bitwiseAND(bits) == 0) | (feature.bitwiseAND(mask).bitwiseAND(bits) != 0)


def quantise(score: Column) -> Column:
    """Thousandths, rounded down, as fixed-point storage keeps them."""
    return F.floor(score * 1000) / 1000


def ects_normal(term: Column) -> Column:
    """Senses after ':' and readings after '/' go."""
    return F.regexp_replace(F.regexp_replace(term, r":[^+]*", ""), r"/[^+]*", "")


def cache_key(query: Column, options: Column) -> Column:
    """A digest of a query and its options (a map), whatever order they came in."""
    pairs = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.sha2(F.concat_ws("\x01", query, F.array_join(pairs, "\x02")), 256)
