"""Metadata of pages and of comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _attribute(html: Column, tag: str, mark: str, value: str) -> Column:
    """The attribute ``value`` of the first tag that has ``mark``, in whatever order its attributes stand; NULL if none has."""
    one = rf"(?is)<{tag}\b(?=[^>]*\b{mark})[^>]*?\b{value}\s*=\s*[\"']([^\"'>]*)[\"']"
    return F.nullif(F.regexp_extract(html, one, 1), F.lit(""))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, first heading, language and counts, by pattern; titles and headings may have attributes."""
    h = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(h, "(?is)<title[^>]*>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, "(?is)<h1[^>]*>([^<]*)</h1>", 1).alias("h1"),
        F.regexp_extract(h, "(?i)<html[^>]* lang=[\"']([^\"']*)", 1).alias("lang"),
        (F.length(h) - F.length(F.replace(h, F.lit("<p>"), F.lit("xx")))).alias("paragraphs"),
        F.size(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1))).alias("links"),
    )


def shared_meta(pages: DataFrame, preview: int = 400) -> DataFrame:
    """What a page says of itself to those who share it, else the plain parts of the page: title, description, address, site,
    heading, number of videos, and the first ``preview`` characters of its text."""
    h = F.coalesce("html", F.lit(""))
    named = lambda name: _attribute(h, "meta", rf"(?:property|name)\s*=\s*[\"']{name}[\"']", "content")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?is)^.*?<body[^>]*>", ""), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "), r"\s+", " ")
    return pages.select(
        "page_id",
        F.coalesce(named("og:title"), F.nullif(F.regexp_extract(h, "(?is)<title[^>]*>([^<]*)</title>", 1), F.lit(""))).alias("title"),
        F.coalesce(named("og:description"), named("description")).alias("description"),
        F.coalesce(named("og:url"), "url").alias("canonical"),
        named("og:site_name").alias("site"),
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract(h, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), F.lit("")).alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<video\b"), F.lit(0))).alias("videos"),
        F.substring(F.trim(body), 1, preview).alias("preview"),
    )


def host_in(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether an address is at one of the hosts, or at a part of one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^(?:[a-z]+:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def ingest_route(url: Column, api: tuple[str, ...], browser: tuple[str, ...]) -> Column:
    """How an address is fetched: by the interface of its host, by a browser, or by a plain download."""
    return F.when(host_in(url, api), "api").when(host_in(url, browser), "browser").otherwise("download")


def item_id(url: Column, marker: str = "/video/") -> Column:
    """The number after a marker in an address; NULL if something else stands there."""
    tail = F.substring_index(F.substring_index(F.regexp_extract(url, "(?s)" + marker.replace("/", r"\/") + "(.*)$", 1), "?", 1), "#", 1)
    return F.regexp_extract(F.regexp_replace(tail, "^/+|/+$", ""), "^([0-9]+)$", 1)


def candidate_urls(url: Column, forms: tuple[str, ...], hosts: tuple[str, ...], marker: str = "/video/") -> Column:
    """The addresses to try for an item, in order and each once: the forms, with {} for its number and {url} for the address
    itself; only the address where it is at none of the hosts or has no number."""
    number = item_id(url, marker)
    made = F.array(*[url if f == "{url}" else F.replace(F.lit(f), F.lit("{}"), number) for f in forms])
    return F.when((number != "") & host_in(url, hosts), F.array_distinct(made)).otherwise(F.array(url))


# Under which names a post may stand in a document, the outer ones first.
_WRAPPERS = ("", "aweme_detail", "detail", "item", "data", "data.aweme_detail", "data.item", "data.detail", "app.detail", "app.videoDetail")


def detail_node(document: Column) -> Column:
    """The first part of a document that has a description and an object of statistics; as JSON.

    Documents are searched where such parts stand: at the root, or under the names that wrap them.
    """
    tree = F.try_parse_json(document)
    paths = [f"${'.' if w else ''}{w}" for w in _WRAPPERS]
    good = lambda p: F.try_variant_get(tree, f"{p}.desc", "string").isNotNull() & F.startswith(F.coalesce(F.try_variant_get(tree, f"{p}.statistics", "string"), F.lit("")), F.lit("{"))
    return F.coalesce(*[F.when(good(p), F.try_variant_get(tree, p, "string")) for p in paths])


def play_urls(detail: Column) -> Column:
    """All addresses of a post's video in a variant document, of every kind and bit rate, each once and in order."""
    lists = [F.try_variant_get(detail, f"$.{root}video.{kind}.url_list", "array<string>") for root in ("aweme_detail.", "") for kind in ("play_addr", "play_addr_h264", "download_addr")]
    rates = [F.transform(F.try_variant_get(detail, f"$.{root}video.bit_rate", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.play_addr.url_list", "array<string>"), F.array().cast("array<string>"))) for root in ("aweme_detail.", "")]
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(x, none) for x in lists], *[F.coalesce(F.flatten(x), none) for x in rates])
    return F.array_distinct(F.filter(every, lambda u: F.startswith(u, F.lit("http"))))


def picked_urls(urls: Column, preferred: str, refused: str = "watermark=1", most: int = 4) -> Column:
    """At most so many addresses: those at the preferred host first, marked ones never, else in order."""
    good = F.filter(urls, lambda u: ~F.contains(u, F.lit(refused)))
    return F.slice(F.concat(F.filter(good, lambda u: F.contains(u, F.lit(preferred))), F.filter(good, lambda u: ~F.contains(u, F.lit(preferred)))), 1, most)


def comment_rows(items: DataFrame, item: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments from variant documents, whatever their fields are called; those without a text are left out."""
    v = F.col(item)
    get = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])
    text = F.trim(get("comment_text_raw", "comment_text", "text"))
    return items.select(
        *keep,
        get("cid", "comment_id").alias("cid"),
        text.alias("text"),
        F.coalesce(F.try_variant_get(v, "$.digg_count", "bigint"), F.lit(0)).alias("likes"),
        get("nickname_raw", "nickname", "user.nickname").alias("author"),
        get("create_time").alias("create_time"),
        F.try_variant_get(v, "$.is_hot", "boolean").alias("is_hot"),
    ).where("text <> ''")


def netscape_cookies(cookies: DataFrame, key: str) -> DataFrame:
    """A cookie file per key, a line each: domain, whether its parts count, path, whether secure, expiry, name, value."""
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    expires = F.coalesce(F.col("expires").try_cast("bigint"), F.lit(0))
    line = F.concat_ws("\t", text("domain", ""), flag(F.startswith(F.coalesce("domain", F.lit("")), F.lit("."))), text("path", "/"), flag(F.coalesce("secure", F.lit(False))), F.greatest(expires, F.lit(0)).cast("string"), "name", text("value", ""))
    rows = cookies.where("name <> ''").select(key, "ord", line.alias("line"))
    return rows.groupBy(key).agg(F.concat(F.lit("# Netscape HTTP Cookie File\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("document"))


def logged_in(cookies: DataFrame, key: str, marks: tuple[str, ...]) -> DataFrame:
    """Whether a key's cookies hold one that only a login sets."""
    return cookies.groupBy(key).agg(F.arrays_overlap(F.collect_set("name"), F.array(*[F.lit(m) for m in marks])).alias("logged_in"))


def largest(files: DataFrame, key: str, pattern: str) -> DataFrame:
    """The largest file of each key whose name matches (the first by name of equal ones)."""
    return files.where(F.col("path").rlike(pattern)).groupBy(key).agg(F.min_by("path", F.struct(-F.col("size"), F.col("path"))).alias("path"), F.max("size").alias("size"))


def url_class(pages: DataFrame) -> DataFrame:
    """Host, class and numeric id of an address."""
    u = F.col("url")
    kind = F.when(u.rlike(r"^https?://m\."), "mobile").when(F.contains(u, F.lit("?")), "query").when(F.contains(u, F.lit("#")), "anchor").otherwise("plain")
    return pages.select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1).alias("host"), kind.alias("class"), F.nullif(F.regexp_extract(u, "/([0-9]+)(?:[?#]|$)", 1), F.lit("")).try_cast("bigint").alias("id"))


def ranked_comments(comments: DataFrame, key: str = "cid", most: int = 30) -> DataFrame:
    """The best comments (cid, text, likes) with a text, one of each key, by likes, then id."""
    first = Window.partitionBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.col("cid").cast("string"))).orderBy(F.desc("likes"), "cid")
    return comments.where("text <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy(F.desc("likes"), "cid").limit(most)


def compact(detail: Column) -> Column:
    """Fields of a post from a variant document, under any of the names they go by."""
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(detail, p, "string"), F.lit("")) for p in paths])
    count = lambda name: F.try_variant_get(detail, f"$.statistics.{name}", "bigint")
    return F.struct(
        get("$.desc", "$.title").alias("description"),
        get("$.author.nickname", "$.author.name").alias("author"),
        count("digg_count").alias("likes"),
        count("comment_count").alias("comments"),
        count("share_count").alias("shares"),
        count("collect_count").alias("collected"),
        F.substring(get("$.desc", "$.body"), 1, 400).alias("preview"),
    )


def cookie_header(cookies: DataFrame, key: str, domain: str) -> DataFrame:
    """A cookie header per key: cookies of a domain in order, the first of each name."""
    own = cookies.where(F.endswith(F.col("domain"), F.lit(domain)))
    first = own.groupBy(key, "name").agg(F.min(F.struct("ord", "value")).alias("v"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("v.ord").alias("ord"), F.concat_ws("=", "name", "v.value").alias("pair")))), lambda x: x["pair"]), "; ").alias("header"))
