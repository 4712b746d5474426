"""Columns derived from addresses, dates and texts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import wordlists as L


def _first_match(text: Column, table: list[tuple[str, str]], other: Column) -> Column:
    out = None
    for pattern, label in table:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def has_url(url: Column) -> Column:
    return url.isNotNull() & (url != "")


def valid_url(url: Column) -> Column:
    """Whether ``url`` is an http address; null for null."""
    return url.rlike("^https?://.+")


def authority(url: Column) -> Column:
    """User, host and port as written, empty without a scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def source_domain(url: Column) -> Column:
    """The authority of http addresses, else null."""
    return F.when(valid_url(url), authority(url))


def source_type(url: Column) -> Column:
    """The family of a site by its host; 'Unknown' for null and empty addresses."""
    host = F.regexp_replace(F.lower(authority(url)), r"www\.|\.com|\.org|\.net|\.co\.[a-z]{2}|\.gov|\.edu", "")
    first = F.split_part(host, F.lit("."), F.lit(1))
    other = F.when(F.char_length(first) > 2, F.concat(F.lit("Other - "), F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1000))).otherwise("Other")
    return F.when(has_url(url), _first_match(host, L.SOURCE_TYPES, other)).otherwise("Unknown")


def source_outlet(url: Column) -> Column:
    """The outlet whose domain the address contains, else 'Other'."""
    out = None
    for part, label in L.OUTLETS:
        out = F.when(url.contains(part), label) if out is None else out.when(url.contains(part), label)
    return out.otherwise("Other")


def category(content: Column) -> Column:
    """The first category whose words occur anywhere in ``content``, else 'General'."""
    return _first_match(content, L.CATEGORIES, F.lit("General"))


def word_count(content: Column) -> Column:
    """Parts between white space: 0 for null, 1 for an empty text."""
    return F.when(content.isNull(), 0).otherwise(F.size(F.split(content, r"\s+")))


def parse_date(text: Column) -> Column:
    """The date that ``text`` writes in one of the known formats, the first that fits; null if none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in L.DATE_FORMATS])


def url_date(url: Column) -> Column:
    """The date in an address, as /2024/1/5/ or /20240105/; null if there is none or no such day."""
    parts = [F.regexp_extract(url, r"[/_-](\d{4})[/_-](\d{1,2})[/_-](\d{1,2})[/_-]", k) for k in (1, 2, 3)]
    whole = [F.regexp_extract(url, r"[/_-](\d{4})(\d{2})(\d{2})[/_-]", k) for k in (1, 2, 3)]
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(parts[0] != "", day(*parts)).when(whole[0] != "", day(*whole))


PROJECT = r"(?i)(?:Project|Basin|Field|Platform|Terminal|Plant|Block)\s+([A-Z][-a-zA-Z0-9\s]*[a-zA-Z0-9])"


def project_names(content: Column) -> Column:
    """What follows a project word up to the next sign, each once; null for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(PROJECT), F.lit(1)), lambda s: F.trim(s)))


ENTITY = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
_NAME = r"[A-Z][a-zA-Z'-]+"
ORGANISATION = (
    rf"{_NAME}(?: (?:of|and|for|the|&|{_NAME}))* (?:Corporation|Corp|Company|Co|Incorporated|Inc|Limited|Ltd|Berhad|Bhd|Group|Holdings|Bank|Ministry|Authority|Council|Board|University"
    rf"|Agency|Department|Association|Union|Institute|Commission)\b"
)
PLACE = rf"\b(?:in|at|near|from|outside|off) ((?:{_NAME})(?: {_NAME})*)"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = rf"\b(?:\d{{1,2}} {_MONTH}(?: \d{{4}})?|{_MONTH}(?: \d{{1,2}}\b)?(?:,? \d{{4}})?|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})"
MONEY = r"(?:RM|US\$|\$)\s?[0-9][0-9,.]*(?: (?:million|billion))?"


def first_unique(values: Column, n: int = 10) -> Column:
    return F.slice(F.array_distinct(values), 1, n)


def proper_names(text: Column, n: int = 10) -> Column:
    """The first ``n`` different runs of two or more capitalised words: a stand-in where no entity model is at hand."""
    return first_unique(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), n)


def organisations(text: Column, n: int = 10) -> Column:
    """The first ``n`` different runs of capitalised words that end in a company's or a public body's word."""
    return first_unique(F.regexp_extract_all(text, F.lit(ORGANISATION), F.lit(0)), n)


def places(text: Column, n: int = 10) -> Column:
    """The first ``n`` different capitalised names behind a word of place, or with a word of place in front."""
    return first_unique(F.regexp_extract_all(text, F.lit(PLACE), F.lit(1)), n)


def dates(text: Column, n: int = 10) -> Column:
    """The first ``n`` different days, months and numeric dates."""
    return first_unique(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), n)


def money(text: Column, n: int = 10) -> Column:
    """The first ``n`` different amounts of money."""
    return first_unique(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), n)


def sentiment_label(score: Column, null_label: str = "negative") -> Column:
    return F.when(score > 0, "positive").when(score == 0, "neutral").when(score < 0, "negative").otherwise(null_label)


#: The classes of the teacher's labels.
TEACHER_CLASSES = {"very negative": 1, "negative": 2, "neutral": 3, "positive": 4, "very positive": 5}


def teacher_class(label: Column) -> Column:
    """The class 1..5 of a teacher's label in any case; 3 for others and for null."""
    known = F.create_map(*[F.lit(x) for pair in TEACHER_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(label)), F.lit(3))


def score_of_prediction(prediction: Column) -> Column:
    """Classes 1..5 as scores -2..2; null stays null."""
    return prediction.cast("int") - 3


def article_class(mean: Column) -> Column:
    return F.when(mean.isNull(), "Unknown").when(mean > 0.1, "Positive").when(mean < -0.1, "Negative").otherwise("Neutral")


def pub_day(published: Column) -> Column:
    """The text before the 'T', trimmed."""
    return F.split_part(F.trim(published), F.lit("T"), F.lit(1))


def source_short_name(domain: Column) -> Column:
    return F.split_part(F.replace(domain, F.lit("www."), F.lit("")), F.lit("."), F.lit(1))


def post_id(url: Column) -> Column:
    return F.concat(F.lit("post_"), F.sha2(url, 256))
