"""Enrichment of contents with page text (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as K
from ..functions.scalars import web_eligible

_NOISE = r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->"
_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}


def strategy(content_url, pdf_url=None) -> Column:
    """E1."""
    return F.when(pdf_link(content_url, pdf_url).isNotNull(), "pdf_extract").when(web_eligible(content_url), "web_scrape").otherwise("none")


def pdf_link(url, pdf_url=None) -> Column:
    """The given PDF, a URL that is one, or the PDF of an abstract page."""
    u = F.col(url) if isinstance(url, str) else url
    given = F.lit(None).cast("string") if pdf_url is None else (F.col(pdf_url) if isinstance(pdf_url, str) else pdf_url)
    made = F.when(F.contains(u, F.lit("arxiv.org")) & F.contains(u, F.lit("/abs/")), F.concat(F.replace(u, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")))
    return F.coalesce(given, F.when(F.lower(u).endswith(".pdf"), u), made)


def plain(html) -> Column:
    """Markup out, references of the common kinds decoded, white space squeezed."""
    h = F.col(html) if isinstance(html, str) else html
    text = F.regexp_replace(F.regexp_replace(h, _NOISE, " "), r"<[^>]*>", " ")
    for name, value in _ENTITIES.items():
        if name != "&amp;":
            text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def clean(text) -> Column:
    """Boilerplate and navigation words go anywhere, also inside words."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"(?i)({K.WEB_BOILERPLATE})", ""), f"(?i)({K.WEB_NAVIGATION})", ""))


#: Elements without content, and those that are no page text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset("nav header footer aside".split())


def by_class(name: str) -> str:
    """Tags with this class."""
    return rf"""(?i)^<[^>]*\sclass=["'](?:[^"']*[ \t\n])?{name}(?:[ \t\n][^"']*)?["']"""


#: Patterns of opening tags by field, in the order in which they are asked.
CONTENT = [r"(?i)^<article\b", r"""(?i)^<[^>]*\srole=["']main["']""", *map(by_class, ("post-content", "article-content", "content", "entry-content", "post-body")), r"(?i)^<main\b", r"""(?i)^<[^>]*\sid=["']content["']""", by_class("container")]
TITLE = [r"(?i)^<h1\b", r"(?i)^<title\b", by_class("title"), by_class("headline")]
AUTHOR = [r"""(?i)^<[^>]*\srel=["']author["']""", *map(by_class, ("author", "byline", "writer", "journalist"))]
DATE = [by_class(n) for n in ("published", "date", "timestamp")]
_TOKEN = r"<[^>]*>|[^<]+"


def _decoded(text: Column) -> Column:
    """References of the common kinds decoded, white space squeezed."""
    for name, value in _ENTITIES.items():
        if name != "&amp;":
            text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"[ \t\n\f\r]+", " "))


def _end(tag: Column) -> Column:
    """The token that closes an element, by one fold over the tags behind it: elements of one name nest, others are passed over. Null where nothing closes it."""

    def step(state: Column, x: Column) -> Column:
        depth = state["depth"] + F.when(x["closing"], -1).otherwise(1)
        return F.when((state["depth"] == 0) | (x["name"] != tag["name"]), state).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, x["i"]).alias("at")))

    start = F.struct(F.lit(1).alias("depth"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(F.slice("tags", tag["p"] + 2, F.size("tags")), start, step, lambda state: state["at"])


def _inside(pieces: str, tag: Column) -> Column:
    """The text of an element; a missing one has none."""
    return _decoded(F.array_join(F.slice(pieces, tag["i"] + 2, F.coalesce(_end(tag), F.size(pieces)) - tag["i"] - 1), ""))


def _tokens(pages: DataFrame) -> DataFrame:
    """url, head (tags that carry values), tags (places of paired tags), opens (those that patterns may ask for), pieces and kept (text by token, all and without ``NO_TEXT``)."""
    bare = F.coalesce(F.col("html").cast("string"), F.lit(""))
    for raw in (r"(?s)<!--.*?-->", *(rf"(?is)<{n}\b.*?</{n}\s*>" for n in ("script", "style", "noscript"))):
        bare = F.regexp_replace(bare, raw, " ")
    rows = pages.select("url", bare.alias("h"))
    rows = rows.select("url", F.array_join(F.regexp_extract_all("h", F.lit(r"(?i)<(?:meta|time)\b[^>]*>"), F.lit(0)), "").alias("head"), F.regexp_extract_all("h", F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    tag = lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"), F.startswith(t, F.lit("</")).alias("closing"))
    tags = F.filter(F.transform("tokens", tag), lambda x: (x["name"] != "") & ~x["name"].isin(*sorted(VOID)) & ~F.endswith(x["t"], F.lit("/>")))
    rows = rows.withColumn("tags", F.transform(tags, lambda x, p: F.struct(p.alias("p"), x["i"].alias("i"), x["t"].alias("t"), x["name"].alias("name"), x["closing"].alias("closing"))))
    asked = lambda x: ~x["closing"] & (x["name"].isin("h1", "title", "article", "main", "body") | x["t"].rlike(r"(?i)\s(class|role|id|rel)="))
    noise = F.transform(F.filter("tags", lambda x: ~x["closing"] & x["name"].isin(*sorted(NO_TEXT))), lambda x: F.struct(x["i"].alias("a"), _end(x).alias("b")))
    rows = rows.withColumn("opens", F.filter("tags", asked)).withColumn("noise", noise)
    rows = rows.withColumn("pieces", F.transform("tokens", lambda t: F.when(F.startswith(t, F.lit("<")), " ").otherwise(t)))
    out = lambda i: F.exists("noise", lambda v: (v["a"] <= i) & (v["b"].isNull() | (i < v["b"])))
    return rows.withColumn("kept", F.transform("pieces", lambda t, i: F.when(out(i), " ").otherwise(t)))


def _first(pattern: str) -> Column:
    """The text of the first element whose tag has the pattern."""
    found = F.filter("opens", lambda x: x["t"].rlike(pattern))
    return F.get(F.transform(F.slice(found, 1, 1), lambda x: _inside("pieces", x)), F.lit(0))


def _longest(pattern: str) -> Column:
    """The longest text of the elements whose tags have the pattern."""
    own = F.transform(F.filter("opens", lambda x: x["t"].rlike(pattern)), lambda x: _inside("kept", x))
    return F.aggregate(own, F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))


def _meta(kind: str, value: str) -> str:
    return rf'(?is)<meta[^>]*{kind}="{value}"[^>]*content="([^"]*)"'


def _attribute(*patterns: str) -> list[Column]:
    """The first match of each pattern in the page's tags that carry values."""
    return [F.nullif(plain(F.regexp_extract("head", p, 1)), F.lit("")) for p in patterns]


def page_fields(pages: DataFrame) -> DataFrame:
    """Url, title, author, published_date, description, content, clean_text, word_count of stored pages (url, html).

    A page is cut into tokens once; an element's end is found by a fold over the tags behind it, so elements of one name nest, and what nothing
    closes runs to the page's end. A page costs its tags times the elements that are asked for. No shuffle. A null page has no text.
    """
    title, author, day = ([_first(p) for p in own] for own in (TITLE, AUTHOR, DATE))
    over = lambda x, n: F.when(F.char_length(x) > n, x)
    whole = F.transform(F.slice(F.filter("opens", lambda x: x["name"] == "body"), 1, 1), lambda x: _inside("kept", x))
    rows = _tokens(pages)
    # Texts are columns before they are asked for their lengths, so that each is made once.
    found = {"title": title, "author": author, "day": day, "content": [_longest(p) for p in CONTENT]}
    rows = rows.select("url", "head", *(x.alias(f"{n}{k}") for n, own in found.items() for k, x in enumerate(own)), F.coalesce(F.get(whole, F.lit(0)), _decoded(F.array_join("kept", ""))).alias("body"))
    title, author, day, longest = ([F.nullif(F.col(f"{n}{k}"), F.lit("")) for k in range(len(own))] for n, own in found.items())
    date = F.coalesce(*_attribute(_meta("property", "article:published_time"), _meta("property", "datePublished"), r'(?is)<time[^>]*datetime="([^"]*)"'), *day)
    out = rows.select(
        "url", F.coalesce(*(over(x, 5) for x in (*title, *_attribute(_meta("property", "og:title"), _meta("name", "twitter:title"))))).alias("title"),
        F.coalesce(*author[:3], *_attribute(_meta("property", "article:author"), _meta("name", "author")), *author[3:]).alias("author"), date.alias("date"),
        F.coalesce(*_attribute(_meta("name", "description"), _meta("property", "og:description"), _meta("name", "twitter:description"))).alias("description"),
        F.coalesce(*(over(x, 100) for x in longest), F.col("body")).alias("content"),
    )
    read = F.coalesce(*(F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss")))
    out = out.select("url", "title", "author", read.alias("published_date"), "description", "content", clean("content").alias("clean_text"))
    return out.withColumn("word_count", F.size(F.filter(F.split("clean_text", " "), lambda w: w != "")))


def merge_pages(contents: DataFrame, pages: DataFrame, separator: str = "\n\n--- Enriched Content ---\n\n", key: str = "url") -> DataFrame:
    """Contents joined to fetched pages (url, clean_text, success): text, lengths and ratio; a failure keeps the original.

    key: the column that tells a content's page, its url, or id where pages have one. A content stays one row: of pages of one key the successful one of the greatest text counts.
    """
    text = F.when(F.col("success"), F.nullif("clean_text", F.lit("")))
    one = pages.groupBy(key).agg(F.max(text).alias("clean_text"))
    j = contents.join(one.withColumn("fetched", F.col("clean_text").isNotNull()), key, "left")
    ok = F.coalesce("fetched", F.lit(False)) & (F.coalesce("clean_text", F.lit("")) != "")
    text = F.when(ok, F.concat("content", F.lit(separator), "clean_text")).otherwise(F.col("content"))
    n = F.char_length("content")
    ratio = F.when(~ok, F.lit(1.0)).when(n == 0, F.lit(float("inf"))).otherwise(F.char_length(text) / n)
    return j.select("id", "url", "source_type", text.alias("enriched_content"), n.alias("original_length"), F.char_length(text).alias("enriched_length"), ratio.alias("ratio"), ok.alias("success"), strategy("url").alias("enrichment_type"))


def enrichment_cycle(contents: DataFrame, enriched: DataFrame, pages: DataFrame, most: int | None = None, key: str = "url") -> DataFrame:
    """Contents (id, url, source_type, content, collected_at) that have no row in ``enriched`` (id) yet, the newest first up to ``most``, enriched from fetched pages.

    pages: url (or another ``key`` of contents), clean_text, success, as ``page_fields`` gives them. What failed has a row too, so it is not tried again.
    """
    waiting = contents.join(enriched.select("id"), "id", "left_anti")
    if most is not None:
        waiting = waiting.orderBy(F.desc("collected_at"), "id").limit(most)
    return merge_pages(waiting, pages, key=key)
