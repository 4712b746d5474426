"""Queries over cleaning, splitting and enrichment, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import enrich as E
from tidewire.functions import text as T
from tidewire.functions import wordlists as L
from tidewire.tables import table


def _messages(columns):
    """Columns over the messages; made when the query runs, as a column needs a session."""
    return lambda spark, sf: table(spark, sf, "kafka_schema").select("msg_id", *columns())


def _sentences(of):
    """One row per sentence; rows without any vanish."""

    def query(spark, sf):
        cleaned = table(spark, sf, "kafka_schema").select("msg_id", T.clean_text(F.col("content")).alias("cleaned"))  # once, before the split
        parts = F.explode_outer(of(F.col("cleaned"))).alias("sentence")  # explode would evaluate them twice, to filter empty lists
        return cleaned.select("msg_id", parts).filter("sentence IS NOT NULL")

    return query


def _clean_page(spark, sf):
    return table(spark, sf, "pipeline_task1").select("record_id", T.clean_page(F.col("content")).alias("cleaned"))


def _boilerplate(spark, sf):
    """Pages without the sentences of boilerplate words."""
    return table(spark, sf, "pipeline_task1").select("record_id", T.without_keyword_sentences(F.col("content"), L.NON_ARTICLE + L.NON_ARTICLE_PAGES).alias("kept"))


def _exploded(spark, sf):
    """Sentences of the raw content, one a row, with the number of sentences of their message; null contents vanish."""
    parts = T.sentences_stream(F.col("content"))
    found = table(spark, sf, "kafka_schema").select("msg_id", F.size(parts).alias("of"), F.posexplode_outer(parts).alias("number", "sentence"))
    return found.filter("sentence IS NOT NULL")


#: Labels of a teacher by score -2..2, in mixed case, the first of them unknown.
_TEACHER = ["Very Negative", "negative", "NEUTRAL", "positive", "Very Positive"]


def _teacher(spark, sf):
    """The teacher's classes of its labels; the labels are spelled out from the stored scores, null ones are no label."""
    label = F.element_at(F.array(*[F.lit(x) for x in [*_TEACHER, "mixed"]]), F.coalesce(F.col("Sentiment_Result"), F.lit(3)) + 3)
    return table(spark, sf, "enriched_sentences").select("sentence_id", E.teacher_class(label).alias("class"))


c = F.col
QUERIES = {
    "remove_boilerplate": _boilerplate,
    "explode_sentences": _exploded,
    "filter_valid_url": lambda spark, sf: table(spark, sf, "kafka_schema").filter(E.has_url(c("url")) & E.valid_url(c("url"))).select("msg_id", "url"),
    "filter_not_null": lambda spark, sf: table(spark, sf, "pipeline_task1").filter("title IS NOT NULL AND content IS NOT NULL").select("record_id", "title"),
    "filter_min_length": lambda spark, sf: table(spark, sf, "kafka_schema").filter(F.char_length("content") >= 20).select("msg_id"),
    "fillna_text": lambda spark, sf: table(spark, sf, "kafka_schema").select("msg_id", "content").fillna({"content": ""}),
    "coalesce_text": _messages(lambda: [T.best_text(c("content"), c("title"), c("description")).alias("best_text")]),
    "clean_text": _messages(lambda: [T.clean_text(c("content")).alias("cleaned")]),
    "clean_page": _clean_page,
    "sentences_train": _sentences(T.sentences_train),
    "sentences_stream": _sentences(T.sentences_stream),
    "source_type": _messages(lambda: [E.source_type(c("url")).alias("source_type")]),
    "source_outlet": _messages(lambda: [E.source_outlet(c("url")).alias("outlet")]),
    "source_domain": _messages(lambda: [E.source_domain(c("url")).alias("domain"), E.source_short_name(E.source_domain(c("url"))).alias("short_name")]),
    "category": _messages(lambda: [E.category(c("content")).alias("category")]),
    "word_count": _messages(lambda: [E.word_count(c("content")).alias("words")]),
    "parse_dates": _messages(lambda: [E.parse_date(c("publishedAt")).alias("day")]),
    "url_date": _messages(lambda: [E.url_date(c("url")).alias("day")]),
    "project_names": _messages(lambda: [E.project_names(c("content")).alias("projects")]),
    "entities_regex": _messages(lambda: [E.proper_names(c("content")).alias("names"), E.money(c("content")).alias("amounts")]),
    "entities_gazetteer": _messages(lambda: [E.organisations(c("content")).alias("organizations"), E.places(c("content")).alias("places"), E.dates(c("content")).alias("dates")]),
    "teacher_class": _teacher,
    "sentiment_label": lambda spark, sf: table(spark, sf, "enriched_sentences").select("sentence_id", E.sentiment_label(c("Sentiment_Result")).alias("label"), E.sentiment_label(c("Sentiment_Result"), "unknown").alias("strict_label")),
    "score_map": lambda spark, sf: table(spark, sf, "enriched_sentences").select("sentence_id", E.score_of_prediction((c("Sentiment_Result") + 3).cast("double")).alias("score")),
    "pub_day": _messages(lambda: [E.pub_day(c("publishedAt")).alias("day")]),
    "post_id": _messages(lambda: [E.post_id(c("url")).alias("post_id")]),
}


def _cases(column: str, table_: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{v}'" for p, v in table_) + f" ELSE {other} END"


_Q = lambda s: s.replace("'", "''")
_PLAIN = T.alternation(L.NON_ARTICLE, dotted=False)
_DOTTED = T.alternation(L.NON_ARTICLE, dotted=True)
_CLEAN = "regexp_replace(coalesce(content, ''), '[^\\x00-\\x7F]+', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '{'|'.join(L.LEGAL)}', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '[^a-zA-Z0-9\\s\\x0b.,?!;:()''\"-]', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)[^.?!]*\\b(?:{_PLAIN})\\b[^.?!]*[.?!]', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)[^.?!]*\\b(?:{_DOTTED})\\b[^.?!]*[.?!]', '', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '(?i)\\b(?:{T.alternation(L.FAQ)})\\b', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_PAGE = f"regexp_replace(content, '(?i)[^.?!]*\\b(?:{T.alternation(L.NON_ARTICLE + L.NON_ARTICLE_PAGES, dotted=False)})\\b[^.?!]*[.?!]', '', 'g')"
_PAGE = f"regexp_replace({_PAGE}, '(?i)[^.?!]*\\b(?:{T.alternation(L.NON_ARTICLE + L.NON_ARTICLE_PAGES, dotted=True)})\\b[^.?!]*[.?!]', '', 'g')"
_KEPT = _PAGE
for _s in L.STATEMENTS:
    _PAGE = f"replace({_PAGE}, '{_s}', '')"
_PAGE = f"regexp_replace({_PAGE}, '(?i)\\b(?:{T.alternation(L.FAQ)})\\b', '', 'g')"
_PAGE = f"regexp_replace({_PAGE}, '(?i)\\b(?:{'|'.join(L.LEGAL)})\\b', '', 'g')"
_PAGE = f"trim(regexp_replace(regexp_replace({_PAGE}, '[^\\x00-\\x7F]+', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_DOMAIN = f"CASE WHEN regexp_matches(url, '^https?://.+') THEN {_AUTHORITY} END"
_HOST = f"regexp_replace(lower({_AUTHORITY}), 'www\\.|\\.com|\\.org|\\.net|\\.co\\.[a-z][a-z]|\\.gov|\\.edu', '', 'g')"
_OTHER = "CASE WHEN length(split_part(host, '.', 1)) > 2 THEN 'Other - ' || upper(split_part(host, '.', 1)[1]) || split_part(host, '.', 1)[2:] ELSE 'Other' END"
_DAYS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y", "%Y%m%d", "%m-%d-%Y", "%d/%m/%Y", "%Y/%m/%d", "%d.%m.%Y", "%b %d, %Y", "%d %b %Y", "%Y-%m-%dT%H:%M:%SZ"]
_URL_DAY = """CASE WHEN regexp_extract(url, '[/_-](\\d{4})[/_-](\\d{1,2})[/_-](\\d{1,2})[/_-]', 1) <> '' THEN
  try_strptime(regexp_extract(url, '[/_-](\\d{4})[/_-](\\d{1,2})[/_-](\\d{1,2})[/_-]', 1) || '-' || lpad(regexp_extract(url, '[/_-](\\d{4})[/_-](\\d{1,2})[/_-](\\d{1,2})[/_-]', 2), 2, '0') || '-' || lpad(regexp_extract(url, '[/_-](\\d{4})[/_-](\\d{1,2})[/_-](\\d{1,2})[/_-]', 3), 2, '0'), '%Y-%m-%d')::DATE
  WHEN regexp_extract(url, '[/_-](\\d{4})(\\d{2})(\\d{2})[/_-]', 1) <> '' THEN try_strptime(substr(regexp_extract(url, '[/_-](\\d{8})[/_-]', 1), 1, 8), '%Y%m%d')::DATE END"""
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _each(expression: str, alias: str) -> str:
    return f"SELECT msg_id, {expression} AS {alias} FROM kafka_schema"


SQL = {
    "remove_boilerplate": f"SELECT record_id, {_KEPT} AS kept FROM pipeline_task1",
    "explode_sentences": """WITH t AS (SELECT msg_id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
        lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))), lambda x: length(x) > 10) AS l FROM kafka_schema)
        SELECT msg_id, len(l)::INTEGER AS of, (unnest(range(len(l))))::INTEGER AS number, unnest(l) AS sentence FROM t""",
    "filter_valid_url": "SELECT msg_id, url FROM kafka_schema WHERE url <> '' AND regexp_matches(url, '^https?://.+')",
    "filter_not_null": "SELECT record_id, title FROM pipeline_task1 WHERE title IS NOT NULL AND content IS NOT NULL",
    "filter_min_length": "SELECT msg_id FROM kafka_schema WHERE length(content) >= 20",
    "fillna_text": _each("coalesce(content, '')", "content"),
    "coalesce_text": _each("CASE WHEN content <> '' THEN content WHEN title <> '' AND description <> '' THEN title || '. ' || description ELSE title END", "best_text"),
    "clean_text": _each(_CLEAN, "cleaned"),
    "clean_page": f"SELECT record_id, CASE WHEN length(c) > 0 AND len(string_split(c, ' ')) >= 15 THEN c END AS cleaned FROM (SELECT record_id, {_PAGE} AS c FROM pipeline_task1)",
    "sentences_train": f"""WITH t AS (SELECT msg_id, list_filter(list_transform(regexp_split_to_array({_CLEAN}, '[.?!]\\s+|\\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM kafka_schema),
        u AS (SELECT msg_id, unnest({_UNIQUE.format('p')}) AS s FROM t),
        w AS (SELECT msg_id, array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: NOT regexp_matches(x, '[0-9]')), ' ') AS sentence FROM u)
        SELECT msg_id, sentence FROM w WHERE len(regexp_split_to_array(sentence, '\\s+')) >= 3""",
    "sentences_stream": f"""WITH t AS (SELECT msg_id, unnest(string_split(regexp_replace({_CLEAN}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence FROM kafka_schema)
        SELECT msg_id, trim(sentence) AS sentence FROM t WHERE length(trim(sentence)) > 10""",
    "source_type": f"SELECT msg_id, CASE WHEN url <> '' THEN {_cases('host', L.SOURCE_TYPES, _OTHER)} ELSE 'Unknown' END AS source_type FROM (SELECT msg_id, url, {_HOST} AS host FROM kafka_schema)",
    "source_outlet": _each("CASE " + " ".join(f"WHEN contains(url, '{p}') THEN '{v}'" for p, v in L.OUTLETS) + " ELSE 'Other' END", "outlet"),
    "source_domain": f"SELECT msg_id, d AS domain, split_part(replace(d, 'www.', ''), '.', 1) AS short_name FROM (SELECT msg_id, {_DOMAIN} AS d FROM kafka_schema)",
    "category": _each(_cases("content", L.CATEGORIES, "'General'"), "category"),
    "word_count": _each("CASE WHEN content IS NULL THEN 0 ELSE len(regexp_split_to_array(content, '\\s+')) END::INTEGER", "words"),
    "parse_dates": _each("coalesce(" + ", ".join(f"try_strptime(publishedAt, '{f}')" for f in _DAYS) + ")::DATE", "day"),
    "url_date": _each(_URL_DAY, "day"),
    "project_names": f"WITH t AS (SELECT msg_id, list_transform(regexp_extract_all(content, '{_Q(E.PROJECT)}', 1), lambda x: trim(x)) AS p FROM kafka_schema) SELECT msg_id, {_UNIQUE.format('p')} AS projects FROM t",
    "entities_regex": f"""WITH t AS (SELECT msg_id, regexp_extract_all(content, '{E.ENTITY}') AS n, regexp_extract_all(content, '{E.MONEY}') AS m FROM kafka_schema)
        SELECT msg_id, {_UNIQUE.format('n')}[1:10] AS names, {_UNIQUE.format('m')}[1:10] AS amounts FROM t""",
    "entities_gazetteer": f"""WITH t AS (SELECT msg_id, regexp_extract_all(content, '{_Q(E.ORGANISATION)}') AS o, regexp_extract_all(content, '{_Q(E.PLACE)}', 1) AS p, regexp_extract_all(content, '{_Q(E.DATE)}') AS d FROM kafka_schema)
        SELECT msg_id, {_UNIQUE.format('o')}[1:10] AS organizations, {_UNIQUE.format('p')}[1:10] AS places, {_UNIQUE.format('d')}[1:10] AS dates FROM t""",
    "teacher_class": "SELECT sentence_id, (coalesce(Sentiment_Result, 0) + 3)::INTEGER AS class FROM enriched_sentences",
    "sentiment_label": """SELECT sentence_id, CASE WHEN Sentiment_Result > 0 THEN 'positive' WHEN Sentiment_Result = 0 THEN 'neutral' ELSE 'negative' END AS label,
        CASE WHEN Sentiment_Result > 0 THEN 'positive' WHEN Sentiment_Result = 0 THEN 'neutral' WHEN Sentiment_Result < 0 THEN 'negative' ELSE 'unknown' END AS strict_label FROM enriched_sentences""",
    "score_map": "SELECT sentence_id, Sentiment_Result AS score FROM enriched_sentences",
    "pub_day": _each("split_part(trim(publishedAt), 'T', 1)", "day"),
    "post_id": _each("'post_' || sha256(url)", "post_id"),
}
