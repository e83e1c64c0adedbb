"""Text functions as column expressions.

Spark has no compatibility normalisation, full case folding or HTML parser;
those parts are Arrow UDFs, which get the texts that need them and nulls for
the rest.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestream.functions import numbers

WORD = r"[\p{L}\p{N}_\u0600-\u06FF]+"
#: Texts of these characters alone are in compatibility form, and lower case with ss for ß is their full case folding.
PLAIN = "^[\\x00-\\x1B\\x20-\\x7E¡«¿»À-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž–—‘’“”„€]*$"
CONTROLS = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2069\\uFEFF]"
#: Tracking parameters dropped from urls, besides utm_* (fixed values).
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
#: Arabic letters folded together, and digits (fixed values).
ARABIC_FROM, ARABIC_TO = "أإآٱىؤئةـ", "اااايويه"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
DIACRITICS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]"


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROLS, "")


def normalise_arabic(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, DIACRITICS, ""), ARABIC_FROM, ARABIC_TO)


@F.pandas_udf(StringType())
def normalise_exact(s: pd.Series) -> pd.Series:
    """Compatibility form without control characters, digits and Arabic letters folded, case folded, white space collapsed; null is empty."""
    return s.map(_normal)


_CONTROLS, _DIACRITICS = (regex.compile(x.encode().decode("unicode_escape")) for x in (CONTROLS, DIACRITICS))
_FOLDED = str.maketrans(dict(zip(ARABIC_FROM, ARABIC_TO)) | {"ـ": None} | dict(zip(DIGITS_FROM, DIGITS_TO)))


def _normal(x: str | None) -> str:
    if not x:
        return ""
    x = _CONTROLS.sub("", unicodedata.normalize("NFKC", x)).strip()
    return " ".join(_DIACRITICS.sub("", x).translate(_FOLDED).casefold().split())


def folded(x: Column) -> Column:
    """As normalise, but for the white space of plain texts: what words are taken from."""
    x = F.coalesce(x, F.lit(""))
    plain = x.rlike(PLAIN)
    return F.when(plain, F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))).otherwise(normalise_exact(F.when(~plain, x)))


def normalise(x: Column) -> Column:
    """Compatibility form, control characters out, digits and Arabic letters folded, case folded, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(folded(x), r"\s+", " "))


def normalise_all(xs: Column) -> Column:
    """Each element of an array normalised; null is the empty array."""
    joined = normalise(F.array_join(xs, "\x01"))
    return F.when(F.size(F.coalesce(xs, F.array().cast("array<string>"))) > 0, F.split(joined, "\x01")).otherwise(F.array().cast("array<string>"))


#: Letters with a diacritic and the bare ones.
BASE = {chr(c): d[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.combining(d[1])}


def without_marks(x: Column) -> Column:
    """Latin letters without their diacritics, as a full-text index folds them."""
    bare = F.regexp_replace(F.call_function("translate", x, F.lit("".join(BASE)), F.lit("".join(BASE.values()))), r"\p{Mn}", "")
    return F.when(F.length(x) == F.octet_length(x), x).otherwise(bare)


def tokens(x: Column) -> Column:
    """Words of a text in order, after normalisation."""
    return F.regexp_extract_all(folded(x), F.lit(WORD), F.lit(0))


def index_tokens(x: Column) -> Column:
    """Words of a text as a full-text index holds them: without diacritics."""
    return F.regexp_extract_all(without_marks(folded(x)), F.lit(WORD), F.lit(0))


_NOT_PLAIN = re.compile("[^" + PLAIN[2:-2])  # the class of PLAIN, negated
_ANY_WORD, _PLAIN_WORD, _MARK = regex.compile(WORD), re.compile(r"\w+"), regex.compile(r"\p{Mn}")
_BARE = str.maketrans(BASE)


def words_of(x: str | None) -> tuple[list[str], list[str]]:
    """The words of `tokens` and of `index_tokens`, inside of tasks."""
    if x and _NOT_PLAIN.search(x):
        x = _normal(x)
        words = _ANY_WORD.findall(x)
        return words, words if x.isascii() else _ANY_WORD.findall(_MARK.sub("", x.translate(_BARE)))
    x = (x or "").lower().replace("ß", "ss")
    words = _PLAIN_WORD.findall(x)
    # plain letters stay letters without their diacritics, and there are no marks of their own
    return words, words if x.isascii() else [w if w.isascii() else w.translate(_BARE) for w in words]


def language(x: Column) -> Column:
    """und without letters, ar from three tenths Arabic letters on, else en."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(x, "[^\\u0600-\\u06FF]", ""))
    return F.when(letters == 0, "und").when(arabic / F.greatest(letters, F.lit(1)) >= 0.3, "ar").otherwise("en")


def language_label(label: Column, x: Column) -> Column:
    """Primary subtag of a two or three letter label; the text's language where there is none."""
    primary = F.element_at(F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[-_]"), 1)
    known = F.when(primary.isin("arabic", "ara"), "ar").when(primary.isin("english", "eng"), "en").otherwise(primary)
    return F.when(known.rlike("^[a-z]{2,3}$") & ~known.isin("und", "unk"), known).otherwise(language(x))


def script_shares(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(x, "[^\\u0600-\\u06FF]", ""))
    latin = F.length(F.regexp_replace(x, "[^A-Za-z\\u00C0-\\u024F]", ""))
    share = lambda n: numbers.rounded(F.coalesce(F.try_divide(n, letters), F.lit(0.0)), 3)
    return F.struct(share(arabic).alias("arabic"), share(latin).alias("latin"), share(letters - arabic - latin).alias("other"))


#: A query that is a url or starts with a host name.
URL_QUERY = r"(?i)^https?://|^[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}(?:/|$)"


def query_intent(x: Column, exact_phrase: bool = False) -> Column:
    """struct(intent, exact, normalised, tokens, class) of a query text.

    Quotes around the query make it exact; intents are decided in the order
    hashtag, handle, url, mixed_language, exact_phrase, organization_phrase (two
    to five words, one with an upper-case letter), keywords.
    """
    bare = F.trim(x)
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    inner = F.when(quoted, F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    words = F.array_distinct(tokens(inner))
    exact = quoted | F.lit(exact_phrase)
    n = F.size(words)
    intent = (
        F.when(bare.startswith("#") & (n > 0), "hashtag").when(bare.startswith("@") & (n > 0), "handle").when(inner.rlike(URL_QUERY), "url")
        .when(inner.rlike("[\\u0600-\\u06FF]") & inner.rlike("[A-Za-z]"), "mixed_language").when(exact, "exact_phrase")
        .when((n > 1) & (n <= 5) & bare.rlike(r"\p{Lu}"), "organization_phrase").otherwise("keywords")
    )
    kind = (
        F.when(intent == "hashtag", "HASHTAG").when(intent == "handle", "HANDLE").when(intent == "url", "URL").when(exact, "EXACT_PHRASE")
        .when(intent == "mixed_language", "MIXED_LANGUAGE").when(n == 1, "SHORT_AMBIGUOUS").when(intent == "organization_phrase", "RARE_ENTITY").otherwise("MULTI_TERM_TOPIC")
    )
    return F.struct(intent.alias("intent"), exact.alias("exact"), normalise(inner).alias("normalised"), words.alias("tokens"), kind.alias("class"))


def query_class(x: Column) -> Column:
    """HASHTAG, HANDLE, URL, EXACT_PHRASE, MIXED_LANGUAGE, SHORT_AMBIGUOUS, RARE_ENTITY or MULTI_TERM_TOPIC."""
    return query_intent(x)["class"]


def article_variant(words: Column) -> Column:
    """The words joined, those of an Arabic query over four letters without the article."""
    return F.array_join(F.transform(words, lambda w: F.when(w.startswith("ال") & (F.length(w) > 4), F.substring(w, F.lit(3), F.length(w))).otherwise(w)), " ")


#: Identifier patterns of queries.
IDENTIFIERS = {
    "cve": r"(?i)\bCVE-[0-9]{4}-[0-9]{4,}\b",
    "ghsa": r"(?i)\bGHSA(-[a-z0-9]{4}){3}\b",
    "cwe": r"(?i)\bCWE-[0-9]+\b",
    "commit": r"\b[0-9a-f]{7,40}\b",
    "url": r"https?://[^ ]+",
    "domain": r"\b[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|org|net|io|dev)\b",
    "handle": r"(^| )@[A-Za-z0-9_.-]+",
    "hashtag": r"(^| )#[\p{L}\p{N}_]+",
    "year": r"\b(19|20)[0-9]{2}\b",
    "quoted": r'"[^"]+"',
}


def has_identifier(x: Column, kind: str) -> Column:
    return x.rlike(IDENTIFIERS[kind])


def hashtags(x: Column) -> Column:
    """Ordered distinct #tags; null without any."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_]+)"), F.lit(1)))
    return F.when(F.contains(x, F.lit("#")) & (F.size(found) > 0), found)


def mentions(x: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\p{N}_])@([\p{L}\p{N}_.-]+)"), F.lit(1)))
    return F.when(F.size(found) > 0, found)


def contains_run(words: Column, run: Column) -> Column:
    """Whether the words hold the run as a contiguous stretch; an empty run never."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(run) > 0) & F.contains(pad(words), pad(run))


def places_of(words: Column, wanted: list[str], offset: Column | int = 0) -> Column:
    """array<struct(term, pos)> of the wanted words in order, places counted from offset."""
    one = lambda w, i: F.when(w.isin(wanted), F.struct(w.alias("term"), (i + offset).alias("pos")))
    return F.filter(F.transform(words, one), lambda h: h.isNotNull())


def runs_among(hits: Column, run: list[str]) -> Column:
    """How often the run of words stands in a row among the places of its words."""
    if not run:
        return F.lit(0)

    def here(h: Column, i: Column) -> Column:
        found = h["term"] == run[0]
        for j, word in enumerate(run[1:], 1):
            other = F.get(hits, i + j)
            found = found & F.coalesce((other["term"] == word) & (other["pos"] == h["pos"] + j), F.lit(False))
        return found

    return F.size(F.filter(hits, here))


def cover_among(hits: Column, wanted: list[str]) -> Column:
    """Number of wanted words over the shortest stretch that holds them all, from their places; 0 if one is missing."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return F.lit(0.0)
    start = F.struct(F.array(*[F.lit(-1)] * len(wanted)).alias("last"), F.lit(2147483647).alias("best"))

    def step(s, h):
        last = F.array(*(F.when(h["term"] == q, h["pos"]).otherwise(s["last"][i]) for i, q in enumerate(wanted)))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(s["best"], h["pos"] - low + 1)).otherwise(s["best"]).alias("best"))

    return F.aggregate(hits, start, step, lambda s: F.when(s["best"] == 2147483647, 0.0).otherwise(F.least(F.lit(1.0), F.lit(float(len(wanted))) / s["best"])))


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def proximity(words: Column, wanted: list[str]) -> Column:
    """Number of wanted words over the shortest stretch that holds them all; 0 if one is missing.

    One fold over the words keeps where each wanted one was last seen.
    """
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return F.lit(0.0)
    start = F.struct(F.array(*[F.lit(0)] * len(wanted)).alias("last"), F.lit(0).alias("p"), F.lit(2147483647).alias("best"))

    def step(s, w):
        p = s["p"] + 1
        last = F.array(*(F.when(w == q, p).otherwise(s["last"][i]) for i, q in enumerate(wanted)))
        low = F.array_min(last)
        return F.struct(last.alias("last"), p.alias("p"), F.when((low > 0) & w.isin(wanted), F.least(s["best"], p - low + 1)).otherwise(s["best"]).alias("best"))

    return F.aggregate(words, start, step, lambda s: F.when(s["best"] == 2147483647, 0.0).otherwise(F.least(F.lit(1.0), F.lit(float(len(wanted))) / s["best"])))


def spam_penalty(title: Column, text: Column, url: Column) -> Column:
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    capitals = F.length(F.regexp_replace(both, r"[^\p{Lu}]", ""))
    short = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 40, 5.0).otherwise(0.0)
    loud = F.when(F.length(F.regexp_replace(both, "[^!]", "")) >= 5, 6.0).otherwise(0.0)
    shouted = F.when(capitals / F.greatest(F.lit(1), F.length(both)) > 0.45, 5.0).otherwise(0.0)
    tracked = F.when(F.size(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("utm_"), F.lit(0))) > 1, 2.0).otherwise(0.0)
    return F.least(F.lit(20.0), short + loud + shouted + tracked)


def canonical_url(x: Column) -> Column:
    """Lower-cased scheme and host, no user, default port or fragment, collapsed slashes, tracking out, sorted query."""
    x = F.trim(F.regexp_replace(x, "#.*$", ""))
    x = F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("https://"), x))
    scheme = F.lower(F.regexp_extract(x, "^([^:]+)://", 1))
    rest = F.regexp_extract(x, "^[^:]+://(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@", ""))
    port = F.regexp_extract(host, ":(.*)$", 1)
    name = F.regexp_replace(host, ":.*$", "")
    keep = port.rlike("^[0-9]{1,5}$") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^utm_") & ~F.element_at(F.split(F.lower(p), "="), 1).isin(TRACKING))
    joined = F.array_join(F.array_sort(parts), "&")
    return F.concat(scheme, F.lit("://"), name, F.when(keep, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def content_fingerprint(title: Column, text: Column) -> Column:
    return F.sha2(F.regexp_replace(normalise(F.concat_ws(" ", title, text)), r"[^\p{L}\p{N}_\s]", ""), 256)


def snippet(text: Column, terms: list[str], width: int = 360, lead: int = 90) -> Column:
    """struct(snippet, ranges): `width` characters around the first term found, ... where text is cut, and where terms stand in it.

    Terms count in either case; ranges that touch are one.  Without a match the
    snippet begins with the text.  A null text gives nulls.
    """
    terms = sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    return F.arrow_udf(_snippets(terms, width, lead), "struct<snippet:string,ranges:array<struct<start:int,end:int>>>", F.ArrowUDFType.SCALAR)(text)


def _snippets(terms: list[str], width: int, lead: int):
    """Snippets of texts, inside of tasks: white space is collapsed, and each term's matches are taken left to right."""
    first, each = (re.compile("|".join(map(re.escape, terms)), re.I) if terms else None), [re.compile(re.escape(t), re.I) for t in terms]

    def run(texts: pa.Array) -> pa.Array:
        whole, ends, spans = [], [0], []
        for x in texts.to_pylist():
            if x is None:
                whole.append(None)
                ends.append(len(spans))
                continue
            flat = " ".join(x.split())
            hit = first.search(flat) if first else None
            begin = min(max(0, hit.start() - lead) if hit else 0, max(0, len(flat) - width))
            body, before = flat[begin : begin + width], "..." if begin else ""
            whole.append(before + body + ("..." if begin + width < len(flat) else ""))
            last = None
            for start, end in sorted(m.span() for pattern in each for m in pattern.finditer(body)):
                start, end = start + len(before), end + len(before)
                if last and start <= last[1]:
                    last[1] = max(last[1], end)
                else:
                    spans.append(last := [start, end])
            ends.append(len(spans))
        missing = pa.array([w is None for w in whole], pa.bool_())
        places = pa.StructArray.from_arrays([pa.array([s[k] for s in spans], pa.int32()) for k in (0, 1)], ["start", "end"])
        ranges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places, mask=missing)
        return pa.StructArray.from_arrays([pa.array(whole, pa.string()), ranges], ["snippet", "ranges"])

    return run


def spreadsheet_safe(x: Column) -> Column:
    return F.when(F.ltrim(x).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def label(x: Column, limit: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, limit)


def stable_id(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


@F.pandas_udf(StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    """The character data of a page, entities decoded, white space collapsed."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Text()
        p.feed(x)
        p.close()
        return " ".join(" ".join(p.parts).split())

    return s.map(one)


def strip_tags(x: Column) -> Column:
    """Tags out, the five basic entities decoded: the fast path for simple markup."""
    out = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
