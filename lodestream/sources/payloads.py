"""Platform payloads to content rows.

Each platform's public JSON is read with a declared schema (only the fields
used are parsed) and projected to one content row:

    source, external_id, url, author, handle, title, text, published_at,
    hashtags, metrics map<string,double>

Rows that do not parse or lack an id, a text or title, or an http url are
malformed; `normalise` drops them and `stage_counts` counts them per stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text

COLUMNS = ["source", "external_id", "url", "author", "handle", "title", "text", "published_at", "hashtags", "metrics"]


def or_none(x: Column) -> Column:
    """Empty strings are missing."""
    return F.when(F.trim(x) != "", x)


def first_of(*xs: Column) -> Column:
    return F.coalesce(*(or_none(x) for x in xs))


def time(x: Column) -> Column:
    """ISO 8601 with or without zone, or epoch seconds; anything else is missing."""
    return F.coalesce(F.timestamp_seconds(x.try_cast("double")), F.try_to_timestamp(x))


def metrics(**values: Column) -> Column:
    """Present metrics only: missing is no zero."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.try_cast("double").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


@dataclass(frozen=True)
class Platform:
    schema: str
    row: Callable[[], dict[str, Column]]


def c(path: str) -> Column:
    return F.col(f"p.{path}")


def _row(external_id: Column, url: Column, **more: Column) -> dict[str, Column]:
    return {"external_id": external_id.cast("string"), "url": url} | more


#: One entry a platform: the fields read, and the row they make.
PLATFORMS: dict[str, Platform] = {
    "x": Platform(
        "id string, text string, created_at string, user struct<name:string,username:string>, public_metrics struct<like_count:string,retweet_count:string,reply_count:string,quote_count:string,impression_count:string>, entities struct<hashtags:array<struct<tag:string>>>",
        lambda: _row(c("id"), F.concat(F.lit("https://x.com/"), F.coalesce(or_none(c("user.username")), F.lit("i")), F.lit("/status/"), c("id")), author=c("user.name"), handle=c("user.username"), text=c("text"), published_at=time(c("created_at")), hashtags=c("entities.hashtags.tag"),
                     metrics=metrics(likes=c("public_metrics.like_count"), reposts=c("public_metrics.retweet_count"), replies=c("public_metrics.reply_count"), quotes=c("public_metrics.quote_count"), views=c("public_metrics.impression_count"))),
    ),
    "threads": Platform(
        "id string, text string, permalink string, timestamp string, username string",
        lambda: _row(c("id"), c("permalink"), handle=c("username"), text=c("text"), published_at=time(c("timestamp")), hashtags=text.hashtags(c("text"))),
    ),
    "telegram": Platform(
        "id string, message string, date string, views string, forwards string, replies string, channel struct<username:string,title:string>, reactions array<struct<count:bigint>>",
        lambda: _row(F.concat(c("channel.username"), F.lit("/"), c("id")), F.concat(F.lit("https://t.me/"), c("channel.username"), F.lit("/"), c("id")), author=c("channel.title"), handle=c("channel.username"), text=c("message"), published_at=time(c("date")), hashtags=text.hashtags(c("message")),
                     metrics=metrics(views=c("views"), forwards=c("forwards"), replies=c("replies"), reactions=F.when(F.size(c("reactions")) > 0, F.aggregate(c("reactions"), F.lit(0).cast("long"), lambda s, r: s + r["count"])).cast("string"))),
    ),
    "reddit": Platform(
        "id string, title string, selftext string, author string, permalink string, created_utc string, score string, num_comments string",
        lambda: _row(c("id"), F.concat(F.lit("https://www.reddit.com"), c("permalink")), author=c("author"), handle=c("author"), title=c("title"), text=first_of(c("selftext"), c("title")), published_at=time(c("created_utc")), metrics=metrics(score=c("score"), comments=c("num_comments"))),
    ),
    "bluesky": Platform(
        "uri string, author struct<handle:string,displayName:string>, record struct<text:string,createdAt:string,facets:array<struct<features:array<struct<tag:string>>>>>, likeCount string, repostCount string, replyCount string, quoteCount string",
        lambda: _row(c("uri"), F.concat(F.lit("https://bsky.app/profile/"), c("author.handle"), F.lit("/post/"), F.element_at(F.split(c("uri"), "/"), -1)), author=c("author.displayName"), handle=c("author.handle"), text=c("record.text"), published_at=time(c("record.createdAt")),
                     hashtags=F.filter(F.flatten(F.transform(c("record.facets"), lambda f: F.transform(f["features"], lambda x: x["tag"]))), lambda t: t.isNotNull()), metrics=metrics(likes=c("likeCount"), reposts=c("repostCount"), replies=c("replyCount"), quotes=c("quoteCount"))),
    ),
    "hacker_news": Platform(
        "objectID string, title string, story_title string, story_text string, comment_text string, url string, author string, created_at string, points string, num_comments string",
        lambda: _row(c("objectID"), F.coalesce(or_none(c("url")), F.concat(F.lit("https://news.ycombinator.com/item?id="), c("objectID"))), author=c("author"), handle=c("author"), title=first_of(c("title"), c("story_title")), text=text.strip_tags(F.coalesce(first_of(c("story_text"), c("comment_text"), c("title"), c("story_title")), F.lit(""))), published_at=time(c("created_at")), metrics=metrics(points=c("points"), comments=c("num_comments"))),
    ),
    "github": Platform(
        "id string, html_url string, full_name string, title string, description string, body string, updated_at string, created_at string, stargazers_count string, forks_count string, comments string, owner struct<login:string>, user struct<login:string>",
        lambda: _row(c("id"), c("html_url"), handle=first_of(c("owner.login"), c("user.login")), author=first_of(c("owner.login"), c("user.login")), title=first_of(c("title"), c("full_name")), text=first_of(c("body"), c("description"), c("title"), c("full_name")), published_at=time(first_of(c("created_at"), c("updated_at"))), metrics=metrics(stars=c("stargazers_count"), forks=c("forks_count"), comments=c("comments"))),
    ),
    "gdelt": Platform(
        "url string, title string, seendate string, domain string, language string",
        lambda: _row(F.sha2(c("url"), 256), c("url"), author=c("domain"), title=c("title"), text=c("title"), published_at=F.try_to_timestamp(c("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))),
    ),
    "rss": Platform(
        "guid string, link string, title string, description string, pubDate string, creator string",
        lambda: _row(first_of(c("guid"), c("link")), c("link"), author=c("creator"), title=text.strip_tags(F.coalesce(c("title"), F.lit(""))), text=text.strip_tags(F.coalesce(first_of(c("description"), c("title")), F.lit(""))), published_at=F.coalesce(F.try_to_timestamp(F.regexp_replace(c("pubDate"), "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c("pubDate")))),
    ),
    "youtube": Platform(
        "id struct<videoId:string,channelId:string,playlistId:string>, snippet struct<title:string,description:string,channelTitle:string,publishedAt:string>, statistics struct<viewCount:string,likeCount:string,commentCount:string>",
        lambda: _row(first_of(c("id.videoId"), c("id.channelId"), c("id.playlistId")), F.when(c("id.videoId").isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), c("id.videoId"))).when(c("id.channelId").isNotNull(), F.concat(F.lit("https://www.youtube.com/channel/"), c("id.channelId"))).otherwise(F.concat(F.lit("https://www.youtube.com/playlist?list="), c("id.playlistId"))),
                     author=c("snippet.channelTitle"), title=c("snippet.title"), text=first_of(c("snippet.description"), c("snippet.title")), published_at=time(c("snippet.publishedAt")), metrics=metrics(views=c("statistics.viewCount"), likes=c("statistics.likeCount"), comments=c("statistics.commentCount"))),
    ),
    "mastodon": Platform(
        "id string, url string, content string, created_at string, account struct<acct:string,display_name:string>, tags array<struct<name:string>>, favourites_count string, reblogs_count string, replies_count string, reblog struct<id:string,url:string,content:string,created_at:string,account:struct<acct:string,display_name:string>,tags:array<struct<name:string>>,favourites_count:string,reblogs_count:string,replies_count:string>",
        lambda: (lambda m: _row(first_of(m("url"), m("id")), m("url"), author=m("account.display_name"), handle=m("account.acct"), text=text.strip_tags(F.coalesce(m("content"), F.lit(""))), published_at=time(m("created_at")), hashtags=m("tags.name"), metrics=metrics(likes=m("favourites_count"), reposts=m("reblogs_count"), replies=m("replies_count"))))(
            lambda f: F.when(c("reblog.id").isNotNull(), c(f"reblog.{f}")).otherwise(c(f))
        ),
    ),
    "instagram": Platform(
        "id string, permalink string, caption string, timestamp string, like_count string, comments_count string",
        lambda: _row(c("id"), c("permalink"), text=c("caption"), published_at=time(c("timestamp")), hashtags=text.hashtags(c("caption")), metrics=metrics(likes=c("like_count"), comments=c("comments_count"))),
    ),
    "tiktok": Platform(
        "id string, username string, video_description string, create_time string, view_count string, like_count string, comment_count string, share_count string, hashtag_names array<string>",
        lambda: _row(c("id"), F.concat(F.lit("https://www.tiktok.com/@"), c("username"), F.lit("/video/"), c("id")), handle=c("username"), text=c("video_description"), published_at=time(c("create_time")), hashtags=c("hashtag_names"), metrics=metrics(views=c("view_count"), likes=c("like_count"), comments=c("comment_count"), shares=c("share_count"))),
    ),
}
#: Platforms without a public search: known, never queried.
RESTRICTED = ["facebook", "linkedin"]


def parsed(payloads: DataFrame, platform: str, column: str = "payload") -> DataFrame:
    """One row a payload: the content row (nulls where it did not parse) and `valid`; texts may be of any length."""
    spec = PLATFORMS[platform]
    rows = payloads.select(F.from_json(column, spec.schema, {"mode": "PERMISSIVE", "maxStringLen": str(2**31 - 1)}).alias("p"))
    made = spec.row()
    kinds = {"published_at": "timestamp", "hashtags": "array<string>", "metrics": "map<string,double>"}
    columns = {"source": F.lit(platform)} | {k: made.get(k, F.lit(None)).cast(kinds.get(k, "string")) for k in COLUMNS[1:]}
    rows = rows.select(*(v.alias(k) for k, v in columns.items()))
    return rows.withColumn("valid", F.coalesce((F.trim("external_id") != "") & (first_of(F.col("title"), F.col("text")).isNotNull()) & F.col("url").rlike("^https?://[^/]+"), F.lit(False)))


def normalise(payloads: DataFrame, platform: str, column: str = "payload") -> DataFrame:
    return parsed(payloads, platform, column).filter("valid").drop("valid")


def stage_counts(payloads: DataFrame, platform: str, words: list[str], since: Column | None = None, column: str = "payload") -> DataFrame:
    """One row: raw, schema_valid, query_match and time_eligible payloads, and malformed ones."""
    rows = parsed(payloads, platform, column)
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    own = text.tokens(F.concat_ws(" ", "title", "text"))
    match = F.col("valid") & (F.size(F.array_except(wanted, own)) == 0)
    eligible = match & (F.col("published_at").isNull() | (F.col("published_at") >= since)) if since is not None else match
    n = F.count_if
    return rows.agg(F.count(F.lit(1)).alias("raw"), n(F.col("valid")).alias("schema_valid"), n(match).alias("query_match"), n(eligible).alias("time_eligible"), n(~F.col("valid")).alias("malformed"))


#: What is read of a feed: the items of a channel (or beside it), or the entries of an Atom feed.
_ITEM = "array<struct<guid:string,link:string,title:string,description:string,author:string,pubDate:string>>"
_ENTRY = "array<struct<id:string,link:struct<_VALUE:string,_href:string>,title:string,summary:string,content:string,author:struct<name:string>,published:string,updated:string>>"
_FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}"


def feed_payloads(feeds: DataFrame, column: str = "payload") -> DataFrame:
    """payload: an rss payload for each item or entry of XML feeds, one feed a row.

    A feed that is no XML, null or empty gives no rows.
    """
    p = feeds.select(F.from_xml(F.col(column), _FEED, {"mode": "PERMISSIVE"}).alias("p"))
    none = F.array().cast("array<struct<guid:string,link:string,title:string,description:string,creator:string,pubDate:string>>")

    def of_item(i: Column) -> Column:
        return F.struct(i["guid"].alias("guid"), i["link"].alias("link"), i["title"].alias("title"), i["description"].alias("description"), i["author"].alias("creator"), i["pubDate"].alias("pubDate"))

    def of_entry(e: Column) -> Column:
        return F.struct(e["id"].alias("guid"), first_of(e["link"]["_VALUE"], e["link"]["_href"]).alias("link"), e["title"].alias("title"), first_of(e["summary"], e["content"]).alias("description"), e["author"]["name"].alias("creator"), first_of(e["published"], e["updated"]).alias("pubDate"))

    lists = (F.transform(c("channel.item"), of_item), F.transform(c("item"), of_item), F.transform(c("entry"), of_entry))
    return p.select(F.explode(F.concat(*(F.coalesce(x, none) for x in lists))).alias("one")).select(F.to_json("one").alias("payload"))


#: What may be kept of an embed answer: never its markup (fixed values).
EMBED_KEYS = ["author_name", "author_url", "provider_name", "provider_url", "title", "type"]


def embed_metadata(payload: Column) -> Column:
    """map<string,string> of the allowed keys whose values are text, numbers or truth values; null where the answer is no JSON object."""
    v = F.try_parse_json(payload)
    pairs = []
    for key in EMBED_KEYS:
        one = F.try_variant_get(v, f"$.{key}", "variant")
        plain = ~F.schema_of_variant(one).rlike("^(OBJECT|ARRAY|VOID)")
        pairs.append(F.when(plain, F.struct(F.lit(key).alias("key"), F.try_variant_get(v, f"$.{key}", "string").alias("value"))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.map_from_entries(F.array_compact(F.array(*pairs))))


def with_authors(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with the user each names, where the response carries users apart."""
    return posts.join(users.select(F.col("id").alias("author_id"), "name", "username").dropDuplicates(["author_id"]), "author_id", "left")


def mock(spark: SparkSession, query: str, n: int = 5) -> DataFrame:
    """n deterministic fixture rows for a query."""
    key = F.sha2(F.lit(query), 256)
    rows = spark.range(n)
    return rows.select(F.lit("mock").alias("source"), F.concat(F.substring(key, 1, 12), F.lit("-"), F.col("id")).alias("external_id"), F.concat(F.lit("https://example.org/mock/"), F.col("id")).alias("url"), F.concat(F.lit(query + " result "), F.col("id")).alias("title"), F.concat(F.lit("A fixture about " + query + " number "), F.col("id")).alias("text"))


def captures(index: DataFrame, url: str, limit: int) -> DataFrame:
    """Archive index rows (url, timestamp yyyyMMddHHmmss, status) of exactly one canonical url, newest first."""
    same = text.canonical_url(F.col("url")) == text.canonical_url(F.lit(url))
    return index.filter(same).withColumn("captured_at", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))).orderBy(F.col("captured_at").desc()).limit(limit)


def discovered(results: DataFrame) -> DataFrame:
    """Web-index results (variant, round, position, url, title, engines) as one observation an engine."""
    return results.select(text.canonical_url(F.col("url")).alias("key"), "title", "variant", "round", F.explode("engines").alias("engine"), F.col("position").alias("rank"))


def classify(url: Column) -> Column:
    """POST, COMMENT, PROFILE, COMMUNITY or OTHER for urls of x, threads and reddit; null for other hosts."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:@?#]+)", 1)), r"^(www|mobile|old|new)\.", "")
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    x = F.when(path.rlike(r"^/[A-Za-z0-9_]+/status/\d+"), "POST").when(path.rlike(r"^/[A-Za-z0-9_]{1,15}/?$"), "PROFILE")
    threads = F.when(path.rlike(r"^/@[\w.]+/post/[\w-]+"), "POST").when(path.rlike(r"^/@[\w.]+/?$"), "PROFILE")
    reddit = F.when(path.rlike(r"^/r/\w+/comments/\w+/[^/]*/\w+"), "COMMENT").when(path.rlike(r"^/r/\w+/comments/\w+"), "POST").when(path.rlike(r"^/r/\w+/?$"), "COMMUNITY").when(path.rlike(r"^/u(ser)?/[\w-]+/?$"), "PROFILE")
    other = F.lit("OTHER")
    return F.when(host.isin("x.com", "twitter.com"), F.coalesce(x, other)).when(host.isin("threads.net", "threads.com"), F.coalesce(threads, other)).when(host == "reddit.com", F.coalesce(reddit, other))


def registry(spark: SparkSession) -> DataFrame:
    """source, category, searchable for every known platform."""
    from lodestream.functions.numbers import SOCIAL

    rows = [(k, "social" if k in SOCIAL else "news" if k in ("rss", "gdelt") else "community", True) for k in PLATFORMS] + [(k, "social", False) for k in RESTRICTED]
    return spark.createDataFrame(rows, "source string, category string, searchable boolean")
