"""Values that were cut before the end of their last sentence or line."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm import residue
from tidewire.session import cut, stored

#: A text that ends like a sentence.
ENDED = r"[.!?][\"'”’)\]]*\s*$"
#: What a cut leaves at the end: a mark with a link or a count, a broken escape, entity, tag or character.
MARKED = (
    r"(?i)(?:…|\.\.+)\s*(?:continue reading|read more|\(more\)|»|\[\+\d+ chars\])\s*$|\[(?:…|\.\.\.)\]\s*$|\[\+\d+ chars\]\s*$"
    r"|(?-i:\\u[0-9a-f]{0,3}|&#?[A-Za-z0-9]{0,6}|</?[A-Za-z]{0,8}|\x{fffd})\s*$"
)
#: An ellipsis, which also ends some whole sentences.
DOTS = r"(?:…|\.\.+)[\"'”’)]*\s*$"
MARK_TAIL = r"(?i)\s*,?\s*(?:(?:…|\.\.+)\s*(?:continue reading|read more|\(more\)|»|\[\+\d+ chars\])?|\[(?:…|\.\.\.)\]|\[\+\d+ chars\]|\\u[0-9a-f]{0,3}|&#?[A-Za-z0-9]{0,6}|</?[A-Za-z]{0,8}|\x{fffd}+)\s*$"
_MARK_TAIL = re.compile(MARK_TAIL.replace(r"\x{fffd}", "\ufffd"))
WORD = re.compile(r"[\w'’-]+")
PART = re.compile(r"\w+")
LAST = re.compile(r"\n|(?<=[.!?])[\"'”’)\]]*\s+(?=\S)")
CAPITALS = re.compile(r"(?<=\s)[A-Z][\w'’-]*(?: [A-Z][\w'’-]*)*")

#: A closing in distinct values of so many in a message (and at least LEAST of them) is one that authors use.
SHARE = 0.0005
LEAST = 3
#: Of the sentences that begin like a closing line, at least this share must be unended.
UNENDED = 0.9
#: A closing has several words or begins with a sign; one bare word is the beginning of a cut sentence.
SEVERAL = r"\w\W+\w"
#: MinHash bands and hashes in each: pairs of similarity 0.8 meet in a band with probability 0.985, of 0.1 with 0.0008.
BANDS, ROWS = 8, 4
SHINGLE = 5
SIMILAR = 0.8
#: Words at the end of a value that an alignment may find changed behind the last equal shingle.
CHANGED = 10
#: Up to this many text hashes (about 40 MB) are broadcast to fetch the texts of candidates; more are joined.
BROADCAST_TEXTS = 1_000_000

# What one reading of the messages finds, parted by kind: values that don't end like a sentence, openings of all
# sentences, the MinHash bands of each text, openings of titles, words of titles.
OPEN, BEGUN, TEXTS, TITLES, ENDS = range(5)
FACTS = pa.schema(
    [("kind", pa.int32()), ("msg_id", pa.int64()), ("field_name", pa.string()), ("source_name", pa.string()), ("h", pa.int64()), ("state", pa.string()), ("form", pa.int64()), ("several", pa.bool_()), ("opening", pa.string()), ("last_word", pa.string()), ("single", pa.bool_())]
    + [("text_hash", pa.int64()), ("words", pa.int32()), ("open", pa.bool_()), ("n", pa.int64()), ("ends", pa.int64())]
    + [(f"b{k}", pa.int64()) for k in range(BANDS)]
)
FACTS_DDL = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'boolean' if f.type == pa.bool_() else 'string'}" for f in FACTS)


def opening(sentences: pa.Array) -> pa.Array:
    """The first two words of sentences, numbers and capitalised second words being equal."""
    out = pc.replace_substring_regex(sentences, r"^\s*(\S+)(?:\s+(\S+))?(?s:.*)$", r"\1 \2")
    out = pc.replace_substring_regex(out, r" [A-Z]\S*$", " N")
    out = pc.replace_substring_regex(out, r"^([(\[#*-]+)[A-Z][^ :]*", r"\1N")
    return pc.utf8_lower(pc.replace_substring_regex(out, r"[0-9][0-9.,]*", "9"))


def _split(texts: pa.Array) -> pa.Array:
    marked = pc.replace_substring_regex(texts, r"([.!?][\"'”’)\]]*)\s+|\n+", "\\1\n")
    return pc.list_flatten(pc.split_pattern(marked, "\n"))


def _facts(kind: int, rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(rows, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in FACTS], schema=FACTS)


def _counted(kind: int, sentences: pa.Array) -> pa.RecordBatch:
    found = pc.value_counts(opening(sentences))
    return _facts(kind, len(found), opening=found.field("values"), n=found.field("counts"))


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a hash of its words (numbers being equal), their number, and its MinHash bands."""
    words = K.words(text)
    n = np.bincount(words.row, minlength=words.rows)
    ends = np.cumsum(n)
    place = (np.arange(len(words.code)) - (ends - n)[words.row]).astype(np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(K.mix(words.code + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)]
    h = K.mix(total[ends] - total[ends - n] + n.astype(np.uint64))
    return h.view(np.int64), n, K.bands(K.min_hashes(K.shingles(words, SHINGLE), BANDS * ROWS), BANDS).view(np.int64)


def _open_values(batch: pa.RecordBatch, state: pa.Array, h: np.ndarray) -> pa.RecordBatch:
    """What is known of values that don't end like a sentence."""
    forms, several, last_words, single, lasts = [], [], [], [], []
    for value in batch.column("text").to_pylist():
        parts = LAST.split(value.rstrip())
        last = parts[-1].strip()
        lasts.append(last)
        form = re.sub(r"[0-9][0-9.,]*", "9", CAPITALS.sub("N", last)).lower()
        forms.append(xxhash.xxh3_64_intdigest(form))
        several.append(bool(re.search(SEVERAL, form)))
        words = WORD.findall(_MARK_TAIL.sub("", last))
        last_words.append(words[-1].lower() if words else "")
        single.append(len(parts) == 1)
    return _facts(
        OPEN, len(batch), **{c: batch.column(c) for c in ("msg_id", "field_name", "source_name", "text_hash")}, h=pa.array(h), state=state, form=pa.array(np.array(forms, np.uint64).view(np.int64)), several=pa.array(several, pa.bool_()),
        opening=opening(pa.array(lasts, pa.string())), last_word=pa.array(last_words, pa.string()), single=pa.array(single, pa.bool_()),
    )


def _title_words(titles: pa.Array) -> pa.RecordBatch:
    """How often each word occurs in titles, and how often as the last one."""
    words, ends = Counter(), Counter()
    for title in titles.to_pylist():
        found = WORD.findall(title.lower())
        words.update(found)
        ends.update(found[-1:])
    return _facts(ENDS, len(words), last_word=pa.array(list(words), pa.string()), ends=pa.array([ends[w] for w in words], pa.int64()), n=pa.array(list(words.values()), pa.int64()))


def _values(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The contents and then the descriptions of a batch that aren't blank."""
    parts = []
    for field in ("content", "description"):
        n = len(batch)
        columns = [batch.column("msg_id"), pa.array([field] * n, pa.string()), batch.column("source_name"), batch.column(field), batch.column(f"{field}_hash")]
        part = pa.RecordBatch.from_arrays(columns, ["msg_id", "field_name", "source_name", "text", "text_hash"])
        parts.append(part.filter(pc.fill_null(pc.match_substring_regex(part.column("text"), r"\S"), False)))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(map(len, parts)) else parts[0]


def _read(known: residue.Known | None):
    """The facts of messages by Arrow batches; open contents with residue of ``known`` are left out of OPEN."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            titles = rows.column("title").filter(pc.fill_null(pc.match_substring_regex(rows.column("title"), r"\S"), False))
            yield _counted(TITLES, _split(titles))
            yield _title_words(titles)
            for batch in K.by_size(iter([_values(rows)]), "text"):
                text = batch.column("text")
                yield _counted(BEGUN, _split(text.filter(pc.invert(residue.placeholders(text)))))
                marked, dots, ended = (pc.match_substring_regex(text, p) for p in (MARKED, DOTS, ENDED))
                state = pc.if_else(marked, "marked", pc.if_else(dots, "dots", "open"))
                opened = pc.or_(pc.or_(marked, dots), pc.invert(ended)).to_numpy(zero_copy_only=False)
                bare = pc.if_else(pa.array(opened), pc.replace_substring_regex(text, MARK_TAIL, ""), text)
                h, n, bands = signatures(bare)
                first = np.unique(np.stack([h, opened.astype(np.int64)]), axis=1, return_index=True)[1]
                first = first[n[first] > SHINGLE]
                at = pa.array(first)
                yield _facts(TEXTS, len(first), h=pa.array(h[first]), text_hash=batch.column("text_hash").take(at), words=pa.array(n[first]), open=pa.array(opened[first]), **{f"b{k}": pa.array(bands[first, k]) for k in range(BANDS)})
                if known:
                    content = pc.equal(batch.column("field_name"), "content").to_numpy(zero_copy_only=False)
                    check = np.flatnonzero(opened & content)
                    opened[check[known.hits(text.take(pa.array(check)))]] = False
                keep = pa.array(opened)
                yield _open_values(batch.filter(keep), state.filter(keep), h[opened])

    return read


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(re.sub(r"\d+", "0", m.group().lower()), m.start(), m.end()) for m in PART.finditer(text)]


def ends_early(short: str, long: str) -> tuple[bool, bool]:
    """Whether ``long`` is a near-copy of ``short`` that goes on in the same line where ``short`` ends, and whether it
    goes on inside a word.

    The five-word shingles must have a Jaccard similarity of SIMILAR. The alignment follows the last shingle of ``short``
    that ``long`` has, too; up to CHANGED words behind it are compared one by one, of which half may be changed but not
    the last. Earlier changes don't matter.
    """
    a, b = _words(short), _words(long)
    if len(a) <= SHINGLE or len(b) < len(a):
        return False, False
    x = [tuple(w for w, _, _ in a[k : k + SHINGLE]) for k in range(len(a) - SHINGLE + 1)]
    where: dict[tuple, list[int]] = {}
    for k in range(len(b) - SHINGLE + 1):
        where.setdefault(tuple(w for w, _, _ in b[k : k + SHINGLE]), []).append(k)
    common = len(set(x) & where.keys())
    if common < SIMILAR * (len(set(x)) + len(where) - common):
        return False, False
    at = next((i for i in range(len(x) - 1, max(len(x) - 1 - CHANGED, -1), -1) if x[i] in where), None)
    if at is None:
        return False, False
    rest = [w for w, _, _ in a[at + SHINGLE :]]
    for j in where[x[at]]:
        other = [w for w, _, _ in b[j + SHINGLE : j + SHINGLE + len(rest)]]
        last = j + SHINGLE + len(rest) - 1
        if len(other) < len(rest):
            continue
        mine, its = a[-1][0], b[last][0]
        inside = mine != its and its.startswith(mine)
        if (mine == its or inside) and sum(p != q for p, q in zip(rest[:-1], other[:-1])) * 2 <= len(rest):
            after = long[b[last][2] :].lstrip(" \t")
            if inside or after and not after.startswith("\n") and not re.search(r"[.!?][\"'”’)\]]*\s*$", short):
                return True, inside
    return False, False


def witnesses(texts: DataFrame, messages: DataFrame) -> DataFrame:
    """(h, inside): open texts that a near-copy continues in the same line, and whether inside a word.

    ``texts`` has one row or more for each hash of a text's words; they become one, so that copies and texts that differ
    in numbers alone, however many, count once. Every text has BANDS MinHash buckets of its five-word shingles. An open
    text meets every other text of its buckets that is at least as long and short enough for SIMILAR; adaptive execution
    splits a hot bucket. The texts of such pairs are read once more by their hash, and each pair is aligned.
    """
    sizes = [F.max(c).alias(c) for c in ("words", "open", *[f"b{k}" for k in range(BANDS)])]
    texts = texts.groupBy("h").agg(F.min("text_hash").alias("text_hash"), F.min(F.when(F.col("open"), F.col("text_hash"))).alias("open_hash"), *sizes)
    banded = cut(texts).withColumn("bucket", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])))
    own = banded.filter("open").select("bucket", "h", F.col("open_hash").alias("short"), "words")
    other = banded.select("bucket", F.col("h").alias("other"), F.col("text_hash").alias("long"), F.col("words").alias("other_words"))
    fits = (F.col("other") != F.col("h")) & (F.col("other_words") >= F.col("words")) & (F.col("words") - SHINGLE + 1 >= SIMILAR * (F.col("other_words") - SHINGLE + 1))
    pairs = cut(own.join(other, "bucket").filter(fits).select("h", "short", "long").distinct())

    wanted = pairs.select(F.explode(F.array("short", "long")).alias("text_hash")).distinct()
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    fields = F.array(*[F.struct(F.xxhash64(c).alias("text_hash"), F.col(c).alias("text")) for c in ("content", "description")])
    read = messages.select(F.explode(fields).alias("v")).select("v.*").join(wanted, "text_hash", "left_semi")
    read = read.groupBy("text_hash").agg(F.first("text").alias("text"))
    both = pairs.join(read.withColumnsRenamed({"text_hash": "short", "text": "short_text"}), "short").join(read.withColumnsRenamed({"text_hash": "long", "text": "long_text"}), "long")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ends_early(_MARK_TAIL.sub("", s), x) for s, x in zip(batch.column("short_text").to_pylist(), batch.column("long_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([f for f, _ in found], pa.bool_()), pa.array([i for _, i in found], pa.bool_())], ["h", "found", "inside"])

    aligned = both.select("h", "short_text", "long_text").mapInArrow(align, "h bigint, found boolean, inside boolean")
    return aligned.filter("found").groupBy("h").agg(F.max("inside").alias("inside"))


def truncated(messages: DataFrame, responses: DataFrame, most: int = residue.MOST_CODES) -> DataFrame:
    """(msg_id, field_name, source_name, evidence) of values of ``content`` and ``description`` that were cut.

    Evidence is 'copy' (a near-copy goes on where the value's alignment ends), 'mark' (what a cut leaves behind) or
    'closing' (the last words aren't ones that end a text). A copy that goes on after a whole closing or headline is a
    longer version, not evidence, unless it goes on inside a word. A value that ends like a sentence is whole. An unended
    one without a copy is whole only if its closing is one that authors use: an ellipsis sentence or a closing line
    (credit, source, table, quote) of a form that a share of all values have and whose beginning is hardly ever ended,
    or, for a description of one sentence, a headline: it begins like a title of the table and its last word ends titles.
    All figures are over the values of the whole table, which is read once for them (values with placeholders begin no
    closings) and once for the texts of candidate copies. Contents with residue (by ``responses`` of residue.py) are no cases. Null and blank values are no cases;
    equal values get equal verdicts. Empty input gives empty output.
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("title", "source_name", "content", "description")]
    hashes = [F.xxhash64(c).alias(f"{c}_hash") for c in ("content", "description")]
    known = residue.Known.of(responses, most)
    facts = stored(messages.select("msg_id", *columns, *hashes).mapInArrow(_read(known), FACTS_DDL), "kind")
    part = lambda kind: facts.filter(F.col("kind") == kind)
    opened = part(OPEN)
    if not known:
        left = residue.residue(messages, responses, "msg_id", most=most).withColumn("field_name", F.lit("content"))
        opened = opened.join(left, ["msg_id", "field_name"], "left_anti")
    need = max(LEAST, messages.count() * SHARE)
    distinct = opened.select("text_hash", "state", "form", "several", "opening").distinct()

    dotted = distinct.filter("state = 'dots' AND several").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    dotted = dotted.filter(F.col("n") >= need).select("form", F.lit(True).alias("used_form"))

    begun = part(BEGUN).groupBy("opening").agg(F.sum("n").alias("begun"))
    closing = distinct.filter(F.col("state") == "open").groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    unended = opened.filter(F.col("state") == "open").groupBy("opening").agg(F.count(F.lit(1)).alias("unended"))
    closing = closing.join(unended, "opening").filter(F.col("n") >= need).join(begun, "opening")
    closing = closing.filter((F.col("unended") >= F.col("begun") * UNENDED) & F.col("opening").rlike(SEVERAL + r"|^\W")).select("opening", F.lit(True).alias("used_closing"))

    title_opening = part(TITLES).groupBy("opening").agg(F.sum("n").alias("n"))
    title_opening = title_opening.filter(F.col("n") >= 2).select("opening", F.lit(True).alias("title_opening"))
    ends = part(ENDS).groupBy("last_word").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    ends = ends.filter((F.col("ends") >= 2) & (F.col("ends") >= F.col("n") * 0.05)).select("last_word", F.lit(True).alias("title_end"))

    copies = witnesses(part(TEXTS), messages).withColumn("copied", F.lit(True))
    judged = (
        opened.join(copies, "h", "left").join(dotted, "form", "left").join(closing, "opening", "left")
        .join(title_opening, "opening", "left").join(ends, "last_word", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    headline = (F.col("field_name") == "description") & F.col("single") & yes("title_opening") & yes("title_end")
    whole = headline | yes("used_closing")
    evidence = (
        F.when(yes("copied") & (yes("inside") | ~(whole & (F.col("state") == "open"))), "copy")
        .when(F.col("state") == "marked", "mark")
        .when((F.col("state") == "dots") & ~yes("used_form"), "mark")
        .when((F.col("state") == "open") & ~whole, "closing")
    )
    return judged.select("msg_id", "field_name", "source_name", evidence.alias("evidence")).filter(F.col("evidence").isNotNull())


def rates(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(source_name, field_name, n_values, n_cut, share) of the non-blank values of each source: two small counts joined."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).rlike(r"\S").alias("there")) for c in ("content", "description")]))
    there = messages.select("source_name", fields.alias("f")).filter("f.there").groupBy("source_name", "f.field_name").agg(F.count(F.lit(1)).alias("n_values"))
    n_cut = found.groupBy(F.col("source_name").alias("_source"), F.col("field_name").alias("_field")).agg(F.count(F.lit(1)).alias("n_cut"))
    same = F.col("source_name").eqNullSafe(F.col("_source")) & (F.col("field_name") == F.col("_field"))
    out = there.join(n_cut, same, "left").select("source_name", "field_name", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_values"))
