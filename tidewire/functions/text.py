"""Cleaning and splitting of texts, as native column expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import wordlists as L

#: Splits a text after every sentence end, so that the parts join to the text again.
PARTS = r"(?<=[.?!])"
TRAIN_SPLIT = r"[.?!]\s+|\n+"
#: The ASCII signs other than letters, digits, white space and .,?!;:()'"- one by one, which Java matches by a bit set.
ODD = "[" + "".join(f"\\x{c:02X}" for c in [*range(9), *range(14, 32), *b"#$%&*+/<=>@[\\]^_`{|}~", 127]) + "]"
STREAM_SPLIT = r"(?<=[.!?])\s+(?=[A-Z])"


def alternation(words: list[str], dotted: bool | None = None) -> str:
    """One pattern for all words, in order; ``dotted`` takes those with or without a sentence end inside."""
    chosen = [w for w in words if dotted is None or bool(re.search(r"[.?!]", w)) == dotted]
    return "|".join(re.sub(r"([.()?!,&])", r"\\\1", w) for w in chosen)


def prefix_tree(words: list[str]) -> str:
    """A pattern for the same words as their alternation, with common beginnings tried once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        options = [re.sub(r"([.()?!,&+*])", r"\\\1", c) + pattern(rest) for c, rest in node.items() if c]
        if not options:
            return ""
        inner = options[0] if len(options) == 1 and "" not in node else f"(?:{'|'.join(options)})"
        return inner + ("?" if "" in node else "")

    return pattern(tree)


def without_keyword_sentences(text: Column, words: list[str]) -> Column:
    """``text`` without the sentences that hold one of ``words`` as a whole word, in any case.

    A removed sentence ends at a sentence end, so removals don't touch each other and one pass over the parts equals
    one removal after the other. Words with a sentence end inside, which no part holds, are removed by pattern, but
    only from texts that contain them. A last part without a sentence end stays.
    """
    keyword = rf"\b{prefix_tree([w.lower() for w in words if not re.search(r'[.?!]', w)])}\b"
    keep = lambda t: F.filter(F.split(t, PARTS), lambda p: ~(F.lower(p).rlike(keyword) & p.rlike(r"[.?!]$")))
    out = once(text, lambda t: F.when(F.lower(t).rlike(keyword), F.array_join(keep(t), "")).otherwise(t))
    dotted = [w for w in words if re.search(r"[.?!]", w)]
    inner = alternation(dotted)
    return replaced(out, rf"(?i)(?<![^.?!])[^.?!]*\b(?:{inner})\b[^.?!]*[.?!]", dotted) if inner else out


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def replaced(text: Column, pattern: str, words: list[str]) -> Column:
    """``text`` without the matches of ``pattern``, each of which holds one of ``words`` in some case. Texts that contain
    none, which plain search tells fast, aren't matched at all."""

    def guarded(t: Column, lower: Column) -> Column:
        return F.when(functools.reduce(lambda a, b: a | b, [lower.contains(w.lower()) for w in words]), F.regexp_replace(t, pattern, "")).otherwise(t)

    return once(text, lambda t: once(F.lower(t), lambda lower: guarded(t, lower)))


def _white(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def clean_text(text: Column) -> Column:
    """A message's text: ASCII, without legal phrases, odd signs, non-article sentences and question words.

    Null gives an empty text.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]+", "")
    out = replaced(out, "|".join(L.LEGAL), L.LEGAL)
    out = F.regexp_replace(out, ODD, "")
    out = without_keyword_sentences(out, L.NON_ARTICLE)
    return _white(replaced(out, rf"(?i)\b{prefix_tree(L.FAQ)}\b", L.FAQ))


def clean_page(text: Column, least_words: int = 15) -> Column:
    """A page's text, cleaned; null if fewer than ``least_words`` words are left, or for null."""
    out = without_keyword_sentences(text, L.NON_ARTICLE + L.NON_ARTICLE_PAGES)
    for statement in L.STATEMENTS:
        out = F.replace(out, F.lit(statement), F.lit(""))
    out = replaced(out, rf"(?i)\b{prefix_tree(L.FAQ)}\b", L.FAQ)
    out = replaced(out, rf"(?i)\b(?:{'|'.join(L.LEGAL)})\b", L.LEGAL)
    out = _white(F.regexp_replace(out, r"[^\x00-\x7F]+", ""))
    return F.when((out != "") & (F.size(F.split(out, " ")) >= least_words), out)


def sentences_train(text: Column) -> Column:
    """Sentences for training: split at ends, trimmed, each once, without words that hold a digit, of three words or more."""
    parts = F.array_distinct(F.filter(F.transform(F.split(text, TRAIN_SPLIT), lambda s: F.btrim(s)), lambda s: s != ""))
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: ~w.rlike("[0-9]"))
    return F.filter(F.transform(parts, lambda s: F.array_join(words(s), " ")), lambda s: F.size(F.split(s, r"\s+")) >= 3)


def sentences_stream(text: Column, least_chars: int = 10) -> Column:
    """Sentences for the stream: split before a capital after a sentence end, trimmed, of over ``least_chars`` characters."""
    parts = F.transform(F.split(text, STREAM_SPLIT), _white)
    return F.filter(parts, lambda s: F.char_length(s) > least_chars)


def best_text(content: Column, title: Column, description: Column) -> Column:
    """The content, else title and description, else the title; empty texts count as missing."""
    there = lambda c: c.isNotNull() & (c != "")
    return F.when(there(content), content).when(there(title) & there(description), F.concat(title, F.lit(". "), description)).otherwise(title)
