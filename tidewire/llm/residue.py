"""Template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.session import cut

#: Short quoted words are mentions, not leftovers: a text may tell of a "[name]" or a "404 not found".
QUOTED = r'"[^"\n{}]{0,60}"|“[^”\n]{0,60}”'

#: Placeholders that a template engine or an editor leaves, whole or broken off at the end.
PLACEHOLDERS = "|".join(
    [
        r"\{\{[^{}\n]*(?:\}\}|$)", r"[$#]\{[^{}\n]*(?:\}|$)", r"\{%[^%\n]*(?:%\}|$)", r"<%[^%\n]*(?:%>|$)",
        r"\[\[[^\[\]\n]*(?:\]\]|$)", r"<<\w[^<>\n]*(?:>>|$)", r"@@\w+(?:@@|$)", r"%[A-Za-z][A-Za-z_]*[0-9]*%", r"__[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*__",
        r"\[[A-Z][A-Z0-9'-]+(?: [A-Z0-9'-]+)*\]", r"\(null\)", r"\[object Object\]", r"\bundefined\b", r"\bNaN\b",
    ]
)

#: Stems of the usual pseudo-Latin filler, whatever their endings.
LATIN = "lorem ipsum dolor sita? amet consect adipis elit sedu? eiusm tempor incid labor magna magni aliqu enim minim venia quis nostr exerc ullam nisi commod duis autem irur repreh volupt velit esse cillu fugiat nulla paria except sint occaec cupid".split()
#: Words that people type to fill a field.
TYPED = ["test", "xxx+", "blah", "foo", "bar", "(?:asdf)+", "qwerty", "dummy", "TKTK", "TK", "XXXX+", "[Nn]n+", "[Aa]bc", r"0+\.0+"]
_LATIN_WORD = "(?:" + "|".join(LATIN) + r")[a-z]{0,6}"
FILLER = "|".join(
    [
        rf"(?i:\b{_LATIN_WORD}(?:[ ,.]+{_LATIN_WORD}){{3,}})",
        r"(?:^|[\s.])(?:" + "|".join(TYPED) + r")(?:[ ,.]+(?:" + "|".join(TYPED) + r"))+(?:[\s.]|$)",
        r"(?m:^\s*(?:TKTK|TK|XXXX+)\s*$)",
        r"(?i:\b(?:dummy|sample|placeholder|filler) (?:article|paragraph|text|body|copy|headline|sentence)\b)",
        r"(?i:\b(?:text|caption|copy|headline|story|title|content) (?:goes|begins|starts) here\b)",
        r"(?i:\b(?:type|add|insert|write|put|enter) (?:the|a|an|your) (?:\w+ ){1,4}here\b)",
        r"(?i:\breplace this (?:copy|text|line|paragraph)\b)",
    ]
)

_SCRIPT = r"(?:java ?script|js|scripts|(?:active )?scripting|cookies)"
#: Notices that scripts, another browser or a check are needed.
NOTICES = "|".join(
    [
        rf"\b(?:enable|turn on|activate|allow|aktifkan|switch on)\b[^.\n]{{0,20}}\b{_SCRIPT}\b[^.\n]{{0,30}}\b(?:browser|pelayar|continue|view|read|use|load)\b",
        rf"\b{_SCRIPT} (?:is|are) (?:disabled|blocked|switched off|turned off|required)\b",
        rf"\b(?:page|site|app|view|website) (?:needs|requires|depends on) [^.\n]{{0,20}}{_SCRIPT}\b",
        rf"\b{_SCRIPT} (?:could not be loaded|did not (?:start|load|run))\b",
        rf"\bbrowser is out of date\b|\bblocks {_SCRIPT}\b",
        r"\bchecking your browser\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bwhile we check your connection\b",
    ]
)

#: A status of a request in words.
_STATUS = r"(?:not found|forbidden|gone|bad gateway|internal server error|service unavailable|too many requests|gateway time-?out|unauthorized)"
#: Messages of servers and sites about a failed request.
ERRORS = "|".join(
    [
        r"\bdoes not exist or has been moved\b|\btry again in \d+ (?:seconds?|minutes?)\b|\btoo many requests\b",
        r"\bcould not connect to the (?:database|server|origin)\b|\bunhandled exception\b|\bdo not have permission to (?:open|view|access)\b",
        r"\bsession (?:has )?expired\b|^something went wrong\b|^oops!",
        r"\berror code: ?\w|\brequest id [0-9a-f]{6}|\breference: ?[0-9a-f]{6,}\.[0-9]|\bedge/\d|\bnginx\b|<h1>|\{\"(?:status|error|code)\": ?\d",
        r"^\s*(?:access denied|page (?:unavailable|not found)|(?:temporarily )?down for maintenance|halaman tidak dijumpai|(?:that|this) link has expired)\b",
        r"^\s*we (?:can't|cannot|could not|couldn't) find (?:that|this|the) page\b",
        rf"^\s*(?:(?:error|http) [45]\d\d\b|[45]\d\d[ :-]+{_STATUS})|^\s*[^.\n:]{{2,50}}: {_STATUS}\b",
    ]
)

#: A response counts only if it stands under at least so many different addresses.
LEAST_URLS = 3
#: Records with fewer words than this, beside a line that repeats the title, have little information.
LITTLE = 40
#: How often a record with a canned response has no term of its title, slug or description and little information, no
#: term but more information, a term and little, both: log odds are taken against the same figures of its host.
CANNED = (0.55, 0.35, 0.05, 0.05)
#: A host's figures count as so many addresses more with the figures of all hosts.
SMOOTH = 10
#: A detector's hit stands unless the evidence of its response is below this: then articles tell of it.
DENIED = -6.0
#: Up to this many responses (16 MB) travel to the tasks; more are joined.
MOST_CODES = 1_000_000

EVIDENCE = "code bigint, host bigint, link bigint, cell int, hit boolean"


def _bare(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, QUOTED, '""')


def placeholders(texts: pa.Array) -> pa.Array:
    """Whether each text holds a placeholder that isn't quoted; null for null."""
    return pc.match_substring_regex(_bare(texts), PLACEHOLDERS)


def messages(units: pa.Array) -> pa.Array:
    """Whether each sentence or line holds filler, an error message or a notice that isn't quoted; null for null."""
    bare = _bare(units)
    hit = pc.or_(pc.match_substring_regex(bare, FILLER), pc.match_substring_regex(bare, "(?i)" + NOTICES))
    return pc.or_(hit, pc.or_(pc.match_substring_regex(bare, "(?i)" + ERRORS), pc.match_substring_regex(units, r"^\s*\{\"(?:status|error|code)\": ?\d")))


def detected(texts: pa.Array) -> pa.Array:
    """Whether each text holds a placeholder, or a sentence or line with a message; null for null."""
    hit = placeholders(texts)
    units, row = _sentences(texts)
    some = np.bincount(row[messages(units).fill_null(False).to_numpy(zero_copy_only=False)], minlength=len(texts)) > 0
    return pc.or_(hit, pa.array(some, pa.bool_()))


def covered(lines: pa.Array) -> pa.Array:
    """Whether each line is made only of residue: it holds an error message or a notice, or each of its sentences is
    filler or has no word beside its placeholders. False for null and blank lines."""
    bare = _bare(lines)
    whole = pc.or_(pc.match_substring_regex(bare, "(?i)" + NOTICES), pc.match_substring_regex(lines, "(?i)" + ERRORS))
    sentences, row = _sentences(bare)
    rest = pc.replace_substring_regex(sentences, PLACEHOLDERS, " ")
    words = pc.match_substring_regex(rest, r"[\pL\pN]{2,}").to_numpy(zero_copy_only=False)
    filler = pc.match_substring_regex(sentences, FILLER).to_numpy(zero_copy_only=False)
    changed = pc.not_equal(rest, sentences).to_numpy(zero_copy_only=False)
    other = np.bincount(row[words & ~filler], minlength=len(lines)) > 0
    some = np.bincount(row[filler | changed & ~words], minlength=len(lines)) > 0
    return pa.array(whole.fill_null(False).to_numpy(zero_copy_only=False) | some & ~other)


def _sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Sentences and lines of texts, and the text of each."""
    marked = pc.replace_substring_regex(texts, r"([.!?])[ \n]+|\n+", "\\1\n")
    parts = pc.split_pattern(marked, "\n")
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(parts), np.repeat(np.arange(len(texts)), n)


def _in_row(words: K.Words, others: K.Words) -> np.ndarray:
    """Whether each word is one of the other text's words of the same row."""

    def keyed(w: K.Words) -> np.ndarray:
        return K.mix(w.code ^ K.mix(w.row.astype(np.uint64) + np.uint64(11)))

    return np.isin(keyed(words), keyed(others))


def unit_codes(units: pa.Array) -> np.ndarray:
    """A hash of each sentence's or line's words, all numbers being equal and all names too; 0 for under two words."""
    plain = pc.replace_substring_regex(units, r"^\W*[A-Z][\w'’-]*(?:\s+[A-Z][\w'’-]*)+", "Nn")
    plain = pc.replace_substring_regex(plain, r"([^\s\"“(]\s+)[A-Z][\w'’.-]*(?:\s+[A-Z][\w'’-]*)*", r"\1Nn")
    words = K.word_codes(*K.text_bytes(plain))
    n = np.bincount(words.row, minlength=words.rows)
    ends = np.cumsum(n)
    place = (np.arange(len(words.code)) - (ends - n)[words.row]).astype(np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(K.mix(words.code + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)]
    return np.where(n >= 2, K.mix(total[ends] - total[ends - n]), np.uint64(0)).view(np.int64)


_COMMON = np.array([K.word_code(w) for w in "after about from have been will were with they this that which when their them then there than into more said what over http https html example test".split()])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each record its responses with the record's cell of CANNED, and the record itself under code 0."""
    for batch in K.by_size(batches, "content"):
        units, row = _sentences(batch.column("content"))
        code = unit_codes(units)
        own = code != unit_codes(pc.fill_null(batch.column("title"), ""))[row] if len(row) else np.empty(0, bool)
        words = K.word_codes(*K.text_bytes(units))
        at = row[words.row] if len(row) else words.row
        told = K.word_codes(*K.text_bytes(batch.column("told")))
        common = np.isin(told.code, _COMMON)
        found = _in_row(K.Words(words.code, at, len(batch)), K.Words(told.code[~common], told.row[~common], len(batch)))
        mine = own[words.row] if len(row) else np.empty(0, bool)
        on_topic = np.bincount(at[found & mine], minlength=len(batch)) > 0
        enough = np.bincount(at[mine], minlength=len(batch)) >= LITTLE
        cell = (2 * on_topic + enough).astype(np.int32)
        hit = messages(units).fill_null(False).to_numpy(zero_copy_only=False)
        keep = (code != 0) & own
        rows = np.r_[np.arange(len(batch)), row[keep]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(len(batch), np.int64), code[keep]]), *(batch.column(c).take(pa.array(rows)) for c in ("host", "link")), pa.array(cell[rows]), pa.array(np.r_[np.zeros(len(batch), bool), hit[keep]])],
            ["code", "host", "link", "cell", "hit"],
        )


def _cells() -> list[Column]:
    return [F.count_if(F.col("cell") == k).alias(f"c{k}") for k in range(4)]


def responses(*tables: DataFrame, least_urls: int = LEAST_URLS, denied: float = DENIED) -> DataFrame:
    """(code, canned): sentences and lines that are canned responses, and detector hits that articles tell of.

    Each record of ``tables`` is compared with what its address and title tell of it: whether its text, beside a line
    that repeats the title, has a term of the title, the address slug or the description (which a table may lack), and
    whether it has little information. A sentence or line under many addresses has, for each address, the log odds of
    these two facts between canned responses (CANNED) and the records of the same host (the site part of the address)
    and table; the sum over all hosts and both tables is its evidence. One under ``least_urls`` addresses or more is
    canned if its evidence exceeds the logarithm of the number of such sentences, so that chance gives about one. One
    that a detector hits, but whose evidence is below ``denied``, is told of in articles.

    An address counts once in a table, by the fact that speaks most against, however often it was delivered. All counts
    combine on the map side; a host or a sentence with a third of all rows is spread by address. Null and blank contents
    don't count; a null address is one address without host. Other columns are ignored.
    """
    slug = F.regexp_extract("url", r"([^/]*)/?$", 1)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]*)", 1)
    parts = []
    for number, rows in enumerate(tables):
        told = F.regexp_replace(F.concat_ws(" ", "title", slug, *[c for c in ("description",) if c in rows.columns]), r"\b\w{1,3}\b", " ")
        keys = [F.xxhash64(F.lit(number), host).alias("host"), F.xxhash64("url").alias("link")]
        parts.append(rows.filter(F.col("content").rlike(r"\S")).select("content", F.col("title").cast("string").alias("title"), told.alias("told"), *keys))
    once = functools.reduce(DataFrame.unionAll, parts).mapInArrow(_evidence, EVIDENCE)
    once = once.groupBy("code", "host", "link").agg(F.max("cell").alias("cell"), F.max("hit").alias("hit"))
    counted = cut(once.groupBy("code", "host").agg(*_cells(), F.max("hit").alias("hit")))

    hosts = counted.filter("code = 0")
    all_hosts = hosts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(4)]).first()
    total = sum(all_hosts) or 1
    rate = [(F.col(f"h{k}") + SMOOTH * (all_hosts[k] + 1) / (total + 4)) / (F.col("h0") + F.col("h1") + F.col("h2") + F.col("h3") + SMOOTH) for k in range(4)]
    rates = hosts.select("host", *[F.col(f"c{k}").alias(f"h{k}") for k in range(4)]).select("host", *[(F.lit(math.log(CANNED[k])) - F.log(rate[k])).alias(f"r{k}") for k in range(4)])
    gain = functools.reduce(lambda a, b: a + b, [F.col(f"c{k}") * F.col(f"r{k}") for k in range(4)])
    urls = F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")
    judged = counted.filter("code <> 0").join(rates, "host").groupBy("code").agg(F.sum(gain).alias("evidence"), F.sum(urls).alias("urls"), F.max("hit").alias("hit"))
    judged = cut(judged.filter((F.col("urls") >= least_urls) | F.col("hit")))
    need = math.log(max(judged.filter(F.col("urls") >= least_urls).count(), 1))
    canned = (F.col("urls") >= least_urls) & (F.col("evidence") >= need)
    told_of = F.col("hit") & (F.col("evidence") < denied)
    return judged.filter(canned | told_of).select("code", canned.alias("canned"))


class Known:
    """The codes of ``responses`` as two sorted arrays, for use in tasks."""

    def __init__(self, canned: np.ndarray, denied: np.ndarray):
        self.canned, self.denied = canned, denied

    @classmethod
    def of(cls, found: DataFrame, most: int = MOST_CODES) -> Known | None:
        """None if there are more than ``most``; a code stands for a template, so their number isn't that of rows."""
        rows = found.limit(most + 1).collect()
        if len(rows) > most:
            return None
        return cls(*(np.sort(np.array([r.code for r in rows if r.canned == side], np.int64)) for side in (True, False)))

    def hits(self, content: pa.Array, detectors: bool = True) -> np.ndarray:
        """Whether each text holds residue: a placeholder, a canned response, or a detector's hit that isn't denied;
        false for null. Without ``detectors`` only canned responses count."""
        units, row = _sentences(content)
        code = unit_codes(units)
        unit = np.isin(code, self.canned)
        hit = np.zeros(len(content), bool)
        if detectors:
            unit |= messages(units).fill_null(False).to_numpy(zero_copy_only=False) & ~np.isin(code, self.denied)
            hit = placeholders(content).fill_null(False).to_numpy(zero_copy_only=False)
        return hit | (np.bincount(row[unit], minlength=len(content)) > 0)


def residue(rows: DataFrame, found: DataFrame, key: str = "row_id", detectors: bool = True, most: int = MOST_CODES) -> DataFrame:
    """(key): rows whose ``content`` holds residue: a placeholder, a canned response of ``found``, or a message that a
    detector hits and that ``found`` doesn't deny.

    Up to ``most`` responses are looked up where a row is read; more are joined by code. Null and blank contents are
    none; other columns are ignored; empty input gives empty output.
    """
    known = Known.of(found, most)
    rows = rows.select(key, "content").filter(F.col("content").rlike(r"\S"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.by_size(batches, "content"):
            hit = known.hits(batch.column("content"), detectors)
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(hit))], [key])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.by_size(batches, "content"):
            sentences, row = _sentences(batch.column("content"))
            hit = messages(sentences).fill_null(False).to_numpy(zero_copy_only=False) & detectors
            sure = np.flatnonzero(placeholders(batch.column("content")).fill_null(False).to_numpy(zero_copy_only=False) & detectors)
            ids = batch.column(key).take(pa.array(np.r_[sure, row]))
            code = pa.array(np.r_[np.zeros(len(sure), np.int64), unit_codes(sentences)])
            yield pa.RecordBatch.from_arrays([ids, code, pa.array(np.r_[np.ones(len(sure), bool), hit])], [key, "code", "hit"])

    if known:
        return rows.mapInArrow(inside, f"{key} bigint")
    judged = rows.mapInArrow(units, f"{key} bigint, code bigint, hit boolean").join(found, "code", "left")
    return judged.filter(F.coalesce("canned", "hit")).select(key).distinct()


def without_residue(rows: DataFrame, found: DataFrame, key: str, most: int = MOST_CODES) -> DataFrame:
    """``rows`` without those that ``residue`` gives; null and blank contents stay. Rows are judged where they are read;
    only if the responses must be joined, an anti join by ``key`` takes them out."""
    known = Known.of(found, most)
    if not known:
        return rows.join(residue(rows, found, key, most=most), key, "left_anti")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.by_size(batches, "content"):
            yield batch.filter(pa.array(~known.hits(batch.column("content"))))

    return rows.mapInArrow(clean, rows.schema)
