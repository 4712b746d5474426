"""The language of texts by their function words, where no language model is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words by language. Words that two languages share count for both.
WORDS = {
    "en": "the of and to in a is that for was on with as by at from it said be has not are this he they his their which had have were been but or an will would after before into about over more than also when what there no",
    "ms": "yang dan di ke dari untuk dengan ini itu pada tidak akan telah oleh dalam adalah ada juga kata mereka beliau sebagai kepada atau lebih lagi boleh dapat sudah kerana antara selepas sebelum menurut tanpa melalui semula selama bagi para tersebut supaya sejak hingga setiap semua",
    "fr": "le la les des du et un une est que qui dans pour pas sur avec au ce cette il elle se sont plus ou",
    "de": "der die das und ist den von zu mit sich auf für nicht ein eine dem des auch es im werden aus hat dass",
    "es": "el la los las de que y en un una se no por con para su lo como más pero del está son al",
}
#: A text is in a language only if at least this share of its words are function words of it.
LEAST = 0.05
#: The share that the language gate asks of English.
GATE = 0.12


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}']+"), lambda w: w != "")


def share(text: Column, language: str = "en") -> Column:
    """The share of words that are function words of ``language``; null for null, 0 for a text without words."""
    words = _words(text)
    hits = F.size(F.filter(words, lambda w: w.isin(*WORDS[language].split())))
    return F.when(text.isNotNull(), F.coalesce(hits / F.nullif(F.size(words), F.lit(0)), F.lit(0.0)))


def language(text: Column, least: float = LEAST) -> Column:
    """The language with the greatest share of function words, the first of WORDS among equals; null if none has
    ``least``, and for null."""
    shares = F.array(*[F.struct(share(text, k).alias("share"), F.lit(-n).alias("order"), F.lit(k).alias("language")) for n, k in enumerate(WORDS)])
    best = F.array_max(shares)
    return F.transform(F.array(best), lambda b: F.when(b["share"] >= least, b["language"]))[0]


def is_english(text: Column, least: float = GATE) -> Column:
    """Whether ``text`` is English with a share of ``least``; null for null."""
    return F.when(text.isNotNull(), F.coalesce(language(text, least) == "en", F.lit(False)))
