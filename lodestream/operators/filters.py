"""Filters of a request, and urls under an allowed base: predicates that Catalyst pushes as far down as it can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content type that each type of record counts as, others count as themselves (fixed values).
CONTENT_TYPES = {
    "post": "posts",
    "video": "videos",
    "channel": "channels",
    "thread": "threads",
    "issue": "issues",
    "pull_request": "issues",
    "news": "news",
    "article": "news",
}
#: Media types that are text alone (fixed values).
PLAIN = ["post", "text", "record"]


def content_type(source_type: Column) -> Column:
    """The content type of a record; a missing type is a record."""
    kind = F.coalesce(source_type, F.lit("record"))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair)), kind), kind)


def has_media(media_type: Column) -> Column:
    return F.coalesce((media_type != "") & ~media_type.isin(PLAIN), F.lit(False))


def has_links(text: Column, attachment: Column) -> Column:
    """A link in the text or attached to it."""
    return F.coalesce(text.contains("http://") | text.contains("https://"), F.lit(False)) | F.coalesce(attachment != "", F.lit(False))


def request_filter(content_types: Sequence[str] = (), media: bool | None = None, links: bool | None = None, hashtags: Sequence[str] = ()) -> Column:
    """Rows of (source_type, media_type, text, link, hashtags) that a request wants.

    An empty list and None ask for nothing.  Types, media and links of null
    columns are a plain record without links; null tags match no wanted tag.
    """
    wanted = F.lit(True)
    if content_types:
        wanted = wanted & content_type(F.col("source_type")).isin(list(content_types))
    if media is not None:
        wanted = wanted & (has_media(F.col("media_type")) == media)
    if links is not None:
        wanted = wanted & (has_links(F.col("text"), F.col("link")) == links)
    if hashtags:
        tags = F.array(*(F.lit(t.lower()) for t in hashtags))
        wanted = wanted & F.coalesce(F.arrays_overlap(F.transform("hashtags", F.lower), tags), F.lit(False))
    return wanted


def _parts(url: Column) -> tuple[Column, Column, Column]:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme, F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def under(url: Column, base: Column) -> Column:
    """Whether url has the base's scheme and host and lies at its path or below; a null url does not."""
    (scheme, host, path), (base_scheme, base_host, base_path) = _parts(url), _parts(base)
    root = F.regexp_replace(base_path, "/+$", "")
    inside = (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))
    return F.coalesce((scheme == base_scheme) & (host == base_host) & inside, F.lit(False))
