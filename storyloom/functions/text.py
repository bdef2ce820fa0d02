"""Text expressions: cleaning, hashing, urls, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
_SPACE = r"[\x09-\x0D\x20]+"


def clean(text: Column) -> Column:
    """White space collapsed to single spaces and stripped; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.lower(clean(title)), F.lit("||"), F.lower(clean(content))), 256)


#: Schemes whose urls have a host, even if it is empty.
HOST_SCHEMES = ["http", "https", "ftp", "file", "ws", "wss", "sftp", "git", "svn", "rsync"]
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_parts(url: Column) -> dict[str, Column]:
    """scheme and host, lower-cased, path, params (of the last segment, with their semicolon) and query; empty where missing.

    White space before the url, and tabs and line ends within, don't count. A null url is empty.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda n: F.coalesce(F.regexp_extract(bare, _URL, n), F.lit(""))
    given = part(3)
    params = F.regexp_extract(given, "(;[^/]*)$", 1)
    path = F.substring(given, F.lit(1), F.char_length(given) - F.char_length(params))
    return {"scheme": F.lower(part(1)), "host": F.lower(part(2)), "path": path, "params": params, "query": part(4)}


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, tracking parameters (in any case), fragment and closing slashes dropped, order kept.

    A path of slashes alone stays, and no path becomes one slash. Parameters are decoded and encoded again;
    an empty url stays empty. What has no scheme or no host gets none.
    """
    p = url_parts(url)
    short = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(short != "", short).when(p["path"] != "", p["path"]).otherwise("/")
    kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~F.lower(_decoded(F.substring_index(q, "=", 1))).isin(TRACKING))
    kept = F.transform(kept, lambda q: F.concat(_encoded(F.substring_index(q, "=", 1)), F.lit("="), _encoded(F.when(F.contains(q, F.lit("=")), F.regexp_replace(q, "^[^=]*=", "")).otherwise(""))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    host_like = F.startswith(path, F.lit("//")) | (p["scheme"].isin(HOST_SCHEMES) & F.startswith(path, F.lit("/")))
    place = F.when(p["host"] != "", F.concat(F.lit("//"), p["host"], rooted)).when(host_like, F.concat(F.lit("//"), path)).otherwise(path)
    scheme = F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise("")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(scheme, place, p["params"], tail))


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(_decoded(part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def raw_hash(url: Column, title: Column, content: Column, html: Column) -> Column:
    return F.sha2(F.concat_ws("||", canonical_url(F.coalesce(url, F.lit(""))), clean(title), clean(content), html_to_text(html)), 256)


def html_to_text(html: Column) -> Column:
    """Scripts, styles, frames, drawings and comments dropped, tags as spaces, the commonest entities decoded; null is empty."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg|iframe)\b.*?</(script|style|noscript|svg|iframe)\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[!/A-Za-z][^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean(out)


#: Entities and what they stand for, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _resolved(path: Column, relative: Column) -> Column:
    """A path without its `.` and `..` segments, from the root. Empty segments within a relative path are dropped first."""
    given = F.split(path, "/", -1)
    inner = F.slice(given, F.lit(2), F.size(given) - 2)
    full = F.concat(F.slice(given, F.lit(1), F.lit(1)), F.filter(inner, lambda x: x != ""), F.slice(given, F.size(given), F.lit(1)))
    segments = F.when(relative & (F.size(given) > 1), full).otherwise(given)
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(segments, F.expr("cast(array() AS array<string>)"), step)
    joined = F.concat(F.array_join(kept, "/"), F.when(F.element_at(given, -1).isin(".", ".."), "/").otherwise(""))
    return F.concat(F.lit("/"), F.regexp_replace(joined, "^/", ""))


def absolute_url(base: Column, link: Column) -> Column:
    """The link as seen from the base: whole, without scheme, from the root, a query or fragment, or beside the base's
    path, `.` and `..` followed. An empty or null link is empty."""
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    own, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"([?#].*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", "").when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, _resolved(own, F.lit(False)), tail)).when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link)).otherwise(F.concat(origin, _resolved(F.concat(folder, own), F.lit(True)), tail))
    )


def normalized(text: Column, lowercase: bool = False) -> Column:
    """Cleaned, Arabic folded where more than 0.3 of the characters are Arabic."""
    folded = lambda plain: F.when(arabic_share(plain) > 0.3, fold_arabic(plain)).otherwise(plain)
    out = F.transform(F.array(clean(text)), folded)[0]  # cleaned once, though it is asked for four times
    return F.lower(out) if lowercase else out


def arabic_key(text: Column) -> Column:
    """For matching spellings: lower case, all forms of alef and hamza as alef, tatweel and vowel marks dropped."""
    return F.regexp_replace(F.translate(F.lower(clean(text)), "أإآٱءئؤىةـ", "ااااااايه"), "[\\u064B-\\u0652\\u0670]", "")


def arabic_share(text: Column) -> Column:
    """Share of characters from the Arabic block; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(text, "[\\u0600-\\u06FF]+", ""))) / n).otherwise(0.0)


def fold_arabic(text: Column) -> Column:
    """Alef, ta marbuta and alef maqsura variants folded, vowel marks dropped."""
    return F.regexp_replace(F.translate(text, "أإآةى", "اااهي"), "[\\u064B-\\u0652]", "")


def slug(text: Column, length: int = 120) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, length)


def words(text: Column) -> Column:
    """Lower-cased words parted by white space; none for an empty text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
