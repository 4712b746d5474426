"""Variant spellings of people and organisations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.components import connected_components
from tidewire.session import cut

#: Usual short forms of given names; a short form may stand for several.
NICKNAMES = {
    "abby": "abigail", "al": "albert alexander alan", "alex": "alexander alexandra", "andy": "andrew", "art": "arthur", "bart": "bartholomew",
    "bea": "beatrice", "becky": "rebecca", "becca": "rebecca", "ben": "benjamin", "benny": "benjamin", "bernie": "bernard", "bert": "albert herbert", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chuck": "charles",
    "chris": "christopher christine", "cindy": "cynthia lucinda", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah",
    "dick": "richard", "dom": "dominic", "dolly": "dorothy", "dot": "dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "fred": "frederick",
    "fran": "frances", "frank": "francis", "gerry": "gerald", "greg": "gregory", "gwen": "gwendolyn", "hal": "henry", "hank": "henry", "harry": "henry harold harriet",
    "hattie": "harriet", "iggy": "ignatius", "izzy": "isabella", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jamie": "james", "jen": "jennifer",
    "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan",
    "josh": "joshua", "josie": "josephine", "jo": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kenny": "kenneth",
    "kim": "kimberly", "larry": "lawrence", "len": "leonard", "leo": "leonard leopold leonardo", "liz": "elizabeth", "lenny": "leonard", "lucy": "lucinda", "maggie": "margaret",
    "peggy": "margaret", "meg": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "millie": "millicent", "nat": "nathaniel natalie", "nate": "nathaniel",
    "nick": "nicholas", "norm": "norman", "ollie": "oliver olivia", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "penny": "penelope",
    "pete": "peter", "phil": "philip", "pip": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "ros": "rosalind",
    "roz": "rosalind", "sam": "samuel samantha", "sandy": "alexander alexandra", "sol": "solomon", "steve": "stephen steven", "sue": "susannah susan", "susie": "susannah susan", "suzy": "susannah",
    "ted": "edward theodore", "teddy": "theodore", "terry": "teresa terence", "tess": "teresa", "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas",
    "tommy": "thomas", "tony": "anthony", "val": "valentina valerie", "vicky": "victoria", "tori": "victoria", "vince": "vincent", "vinny": "vincent", "wally": "walter",
    "walt": "walter", "will": "william", "winnie": "winifred", "xav": "xavier", "zach": "zachary", "zack": "zachary", "nell": "eleanor", "nora": "eleanor",
    "drew": "andrew", "bella": "isabella", "flo": "florence", "kit": "christopher", "humph": "humphrey", "gabby": "gabriel gabrielle gabriella", "yas": "yasmin", "mel": "melissa melanie", "fi": "fiona", "ursie": "ursula", "rosie": "rosalind",
}
TITLES = set("sir mr mrs ms miss dr prof professor dato datuk datin tan sri tun tunku puan encik haji hajah lord lady dame madam hon rev capt captain ir ts".split())
SUFFIXES = set("jr sr ii iii phd md mp".split())
#: Legal forms and how they are shortened.
LEGAL = {
    "company": "co", "co": "co", "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc", "limited": "ltd", "ltd": "ltd",
    "berhad": "bhd", "bhd": "bhd", "plc": "plc", "llc": "llc", "gmbh": "gmbh", "ag": "ag",
}
#: A private company's mark before its legal form.
PRIVATE = {"sendirian", "sdn", "private", "pte"}
SMALL = {"of", "and", "the", "for", "&", "dan", "in"}
CLASSES = str.maketrans({**dict.fromkeys("bpfv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6", **dict.fromkeys("aeiouyhw", None)})

#: Jaro-Winkler similarity that two spellings of one word have at least, one mistyped letter apart.
ALIKE = 0.88
#: A code that words of more spellings of organisations have doesn't tell one with the first letters of the other words
#: alone; there a second word or its abbreviations are looked up.
FREQUENT = 50
#: Words of more letters than this look for their abbreviations by the first letter and one other.
LONG = 24


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def phonetic(word: str) -> str:
    """The first letter and the classes of the consonants after it in order, repeats as one."""
    return word[:1] + re.sub(r"(.)\1+", r"\1", re.sub(r"[^1-6]", "", word[1:].translate(CLASSES)))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for j, c in enumerate(b) if used[j]]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter was left out, added, doubled, changed or swapped with the next."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def mistyped(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 4 and one_slip(a, b) and jaro_winkler(a, b) >= ALIKE


@dataclass(frozen=True)
class Name:
    """A parsed spelling: its whole words in order, initials, legal form, and the letters of an acronym."""

    words: tuple[str, ...]
    initials: str = ""
    legal: str = ""
    acronym: str = ""


@lru_cache(maxsize=200_000)
def parse(kind: str, spelling: str) -> Name:
    text = plain(" ".join(spelling.split()))
    if kind == "person":
        if text.count(",") == 1:
            last, first = text.split(",")
            text = f"{first} {last}"
        words = re.findall(r"[^\W_](?:[\w'’-]*[^\W_])?", text)
        while len(words) > 1 and words[0] in TITLES:
            words = words[1:]
        while len(words) > 1 and words[-1] in SUFFIXES:
            words = words[:-1]
        return Name(tuple(w for w in words if len(w) > 1), "".join(w for w in words if len(w) == 1))
    letters = re.fullmatch(r"(?:[A-Z]\.?){3,8}", spelling.strip())
    if letters:
        return Name((), acronym=plain(re.sub(r"\W", "", spelling)))
    words = [w for w in re.findall(r"[\w&'’]+", text.replace("'s", "s")) if w]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    legal = ""
    if len(words) > 1 and words[-1] in LEGAL:
        legal = LEGAL[words.pop()]
    while len(words) > 1 and words[-1] in PRIVATE:
        words.pop()
    return Name(tuple(words), legal=legal)


def given(word: str) -> set[str]:
    """The names that a given name may stand for."""
    return set(NICKNAMES.get(word, "").split()) | {word}


def shortened(a: str, b: str) -> bool:
    """Whether one word is a usual abbreviation of the other: its beginning, or its consonants."""
    a, b = sorted((a, b), key=len)
    if a == b or len(a) < 2 or a[0] != b[0]:
        return a == b
    if b.startswith(a) and len(b) - len(a) >= 2:
        return True
    rest = iter(b)
    inside = all(c in rest for c in a)
    return inside and len(b) - len(a) >= 2 and (len(a) >= 3 and not set(a[1:]) & set("aeiou") or len(a) >= 5 and a[:3] == b[:3])


def _assigned(fits: list[list[bool]]) -> bool:
    """Whether each row can have a column of its own that fits it, by augmenting paths."""
    row_of: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, fit in enumerate(fits[i]):
            if fit and j not in tried:
                tried.add(j)
                if j not in row_of or place(row_of[j], tried):
                    row_of[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(fits)))


def same(kind: str, a: Name, b: Name) -> bool:
    """Whether two parsed spellings are of one entity: the same words, turned round (people) or in any order
    (organisations), with nicknames, abbreviations, and at most one mistyped word on each side. Organisations have one
    word that agrees at least: a mistyped one, or one whose codes agree but for a letter."""
    if len(a.words) != len(b.words) or not a.words or a.acronym or b.acronym:
        return False
    if kind == "organization":
        if a.legal and b.legal and a.legal != b.legal:
            return False
        near = [[shortened(x, y) for y in b.words] for x in a.words]
        agree = [(i, j) for i, x in enumerate(a.words) for j, y in enumerate(b.words) if (_slips(x) & _slips(y) if near[i][j] else mistyped(x, y))]
        return any(_assigned([[c for k, c in enumerate(row) if k != j] for h, row in enumerate(near) if h != i]) for i, j in agree)
    if len(a.words) < 2:
        return False

    def match(x: tuple[str, ...], y: tuple[str, ...]) -> bool:
        slips = [(p, q) for p, q in zip(x, y, strict=True) if not given(p) & given(q)]
        return len(slips) <= 1 and all(mistyped(p, q) for p, q in slips)

    turns = [b.words[k:] + b.words[:k] for k in range(len(b.words))]
    return any(match(a.words, t) for t in turns)


@lru_cache(maxsize=100_000)
def _slips(word: str) -> frozenset[str]:
    """Phonetic codes of a word and of what is left without each of its letters.

    Words one slip apart are equal without one letter each, or one is the other without a letter, so they share a code;
    leaving out a code instead of a letter isn't enough, since repeats collapse.
    """
    return frozenset({phonetic(word)} | {phonetic(word[:k] + word[k + 1 :]) for k in range(len(word))})


def blocks(kind: str, name: Name) -> set[tuple[str, str | None]]:
    """Keys that spellings of one entity share: phonetic codes of all sorted words, one of them with a letter left out.

    Two spellings with a slip in one word meet in a key of that word. Words of organisations may be abbreviated, so there
    a key has the codes of two words, one with a letter left out, and the first letters of the others; and, for
    organisations with an abbreviation beside the slip, the code of one word and the first letters of all others. The
    second part of a key is the code that stands alone in it, else None: a code that many organisations have tells
    nothing with first letters alone, and ``candidates`` has ``_further_keys`` instead of such keys. For these, a single
    word has keys with itself and without each of its letters.
    """
    if kind == "person":
        if len(name.words) < 2:
            return set()
        out = set()
        options = [{phonetic(g) for g in given(w)} for w in name.words]
        for k, word in enumerate(name.words):
            rest = [""]
            for j, other in enumerate(options):
                if j != k:
                    rest = [f"{r} {c}" for r in rest for c in other]
            out |= {("p:" + " ".join(sorted([*r.split(), less])), None) for r in rest for less in options[k] | _slips(word)}
        return out
    out = set()
    for k, word in enumerate(name.words):
        others = [(w, "".join(sorted(x[0] for j, x in enumerate(name.words) if j not in (k, at)))) for at, w in enumerate(name.words) if at != k]
        letters = "".join(sorted(w[0] for j, w in enumerate(name.words) if j != k))
        for less in _slips(word):
            out.add((f"o:{less}:{letters}", less))
            out |= {(_two(less, phonetic(w), rest), None) for w, rest in others}
            if not others:
                out.add((f"o1:{less}:{word}", None))
        if not others:
            out |= {(f"o1:{w}", None) for w in (word, *(word[:k] + word[k + 1 :] for k in range(len(word))))}
    return out


def _two(less: str, code: str, rest: str) -> str:
    return "o:" + " ".join(sorted([less, code])) + f":{rest}"


def _subsequences(letters: str, most: int) -> set[str]:
    """The different strings of 2 to ``most`` letters that are in ``letters`` in their order."""
    of: list[set[str]] = [{""}, *(set() for _ in range(most))]
    for c in letters:
        for n in range(most, 0, -1):
            of[n] |= {s + c for s in of[n - 1]}
    return set().union(*of[2:])


def short_keys(word: str) -> set[str]:
    """Keys of an abbreviation, of which each word that it shortens (``shortened``, two letters more at least) has one in
    ``long_keys``."""
    if len(word) < 2:
        return set()
    keys = {f"={word}", f"x{word[:2]}"}
    if len(word) >= 3 and not set(word[1:]) & set("aeiou"):
        keys.add(f"c{word[:4]}")
    if len(word) >= 5:
        keys.add(f"l{word[:5]}")
    return keys


def long_keys(word: str) -> set[str]:
    """Keys of a word that may be abbreviated: its beginnings, and its first letters with others in their order."""
    if len(word) < 4:
        return set()
    if len(word) > LONG:
        return {f"x{word[0]}{c}" for c in set(word[1:])}
    keys = {f"={word[:k]}" for k in range(2, len(word) - 1)}
    keys |= {f"c{word[0]}{s}" for s in _subsequences("".join(c for c in word[1:] if c not in "aeiou"), 3)}
    return keys | {f"l{word[:3]}{s}" for s in _subsequences(word[3:], 2)}


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, names = (batch.column(c).to_pylist() for c in ("kind", "name"))
        rows = [(k, key, alone) for k, (kind, name) in enumerate(zip(kinds, names, strict=True)) for key, alone in blocks(kind, parse(kind, name))]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [batch.column(c).take(at) for c in ("kind", "name", "id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["kind", "name", "id", "key", "alone"])


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of each organisation's words, whole and without a letter."""
    for batch in batches:
        names = [parse(kind, name) for kind, name in zip(batch.column("kind").to_pylist(), batch.column("name").to_pylist(), strict=True) if kind == "organization"]
        yield pa.RecordBatch.from_arrays([pa.array([c for n in names for c in frozenset().union(*map(_slips, n.words))], pa.string())], ["alone"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each organisation."""
    for batch in batches:
        kinds, names = (batch.column(c).to_pylist() for c in ("kind", "name"))
        rows = [(k, word) for k, (kind, name) in enumerate(zip(kinds, names, strict=True)) if kind == "organization" for word in set(parse(kind, name).words)]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("kind", "name", "id")), pa.array([r[1] for r in rows], pa.string())], ["kind", "name", "id", "word"])


def _abbreviations(words: DataFrame) -> DataFrame:
    """(word, short): all pairs of different ``words`` (word) of which the second is a usual abbreviation of the first."""

    def keyed(keys: Callable[[str], set[str]], column: str) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(w, key) for w in batch.column("word").to_pylist() for key in keys(w)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], [column, "key"])

        return words.mapInArrow(each, f"{column} string, key string")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, short = batch.column("word").to_pylist(), batch.column("short").to_pylist()
            yield batch.filter(pa.array([len(x) > len(y) and shortened(y, x) for x, y in zip(long, short, strict=True)], pa.bool_()))

    met = keyed(long_keys, "word").join(keyed(short_keys, "short"), "key").select("word", "short")
    return met.mapInArrow(verified, "word string, short string").distinct()


def _further_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two-word keys that organisations would have with ``short`` instead of their ``word``; ``alone`` is the other
    word's code in them."""
    for batch in batches:
        rows = []
        for k, (name, long, short) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "word", "short")), strict=True)):
            words, code = parse("organization", name).words, phonetic(short)
            if len(words) == 1:
                rows += [(k, f"o1:{less}:{short}", less) for less in _slips(long)]
            elif code != phonetic(long):
                at = words.index(long)
                for i, word in enumerate(words):
                    if i != at:
                        rest = "".join(sorted(w[0] for j, w in enumerate(words) if j not in (i, at)))
                        rows += [(k, _two(less, code, rest), less) for less in _slips(word)]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [batch.column(c).take(at) for c in ("kind", "name", "id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["kind", "name", "id", "key", "alone"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, a, b = (batch.column(c).to_pylist() for c in ("kind", "name_a", "name_b"))
        yield batch.filter(pa.array([same(k, parse(k, x), parse(k, y)) for k, x, y in zip(kinds, a, b, strict=True)], pa.bool_()))


def _short_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys by which short forms meet whole names: a surname's code and an initial, or the letters of an acronym.

    ``short`` tells the short forms; ``word`` is the surname itself; ``form`` is a short form without its points and order.
    """
    schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("short", pa.bool_()), ("key", pa.string()), ("word", pa.string()), ("form", pa.string())])
    for batch in batches:
        out = []
        for kind, name, node in zip(*(batch.column(c).to_pylist() for c in ("kind", "name", "id")), strict=True):
            n = parse(kind, name)
            if kind == "organization":
                if n.acronym:
                    out.append((kind, node, True, n.acronym, "", n.acronym))
                elif len(n.words) >= 3:
                    key = "".join(w[0] for w in n.words if w not in SMALL)
                    out += [(kind, node, False, k, "", "") for k in {key, key + n.legal[:1]}]
            elif len(n.words) == 1 and n.initials:
                out += [(kind, node, True, f"{c}|{n.initials[0]}", n.words[0], f"{n.initials} {n.words[0]}") for c in _slips(n.words[0])]
            elif len(n.words) > 1:
                for at, other in ((-1, 0), (0, -1)):
                    first = {g[0] for g in given(n.words[other])}
                    out += [(kind, node, False, f"{c}|{i}", n.words[at], "") for c in _slips(n.words[at]) for i in first]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def spellings(entities: DataFrame) -> DataFrame:
    """Distinct (kind, name) of the people and organisations mentioned, without blanks and tabs at both ends."""
    parts = []
    for kind, column in (("person", "people_mentioned"), ("organization", "organizations_mentioned")):
        trimmed = F.transform(column, lambda x: F.btrim(x, F.lit(" \t")))
        parts.append(entities.select(F.lit(kind).alias("kind"), F.explode(trimmed).alias("name")))
    return parts[0].unionByName(parts[1]).filter(F.col("name") != "").distinct()


def candidates(names: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(kind, id_a, name_a, id_b, name_b): spellings of ``names`` (kind, name, id) that share a block, id_a < id_b, once
    each.

    Organisations whose shared code is in more than ``frequent`` spellings meet only where a second word agrees, too, or
    is abbreviated. Every pair that is the ``same`` is among the candidates, whatever ``frequent`` is: one of its words
    agrees, and each of its other words has the code of its counterpart or is short for it.
    """
    schema = "kind string, name string, id bigint, key string, alone string"
    counted = names.mapInArrow(_word_codes, "alone string").groupBy("alone").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counted.filter(F.col("n") > frequent).select("alone"))
    keyed = names.mapInArrow(_keys, schema).join(often, "alone", "left_anti").withColumn("key", F.xxhash64("key"))
    words = names.mapInArrow(_words, "kind string, name string, id bigint, word string")
    further = words.join(_abbreviations(words.select("word").distinct()), "word").mapInArrow(_further_keys, schema)
    further = further.join(often, "alone", "left_semi").withColumn("key", F.xxhash64("key")).dropDuplicates(["id", "key"])

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        left, right = (d.select("key", "kind", F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}")) for d, s in ((x, "a"), (y, "b")))
        return left.join(right.drop("kind"), "key")

    pairs = met(keyed, keyed).filter("id_a < id_b")
    turned = met(further, keyed).filter("id_a <> id_b")
    first = F.col("id_a") < F.col("id_b")
    ordered = [F.when(first, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{s}") for s, t in ("ab", "ba") for c in ("id", "name")]
    pairs = pairs.select("kind", "id_a", "name_a", "id_b", "name_b").unionByName(turned.select("kind", *ordered))
    return pairs.dropDuplicates(["id_a", "id_b"])


def groups(names: DataFrame) -> DataFrame:
    """(kind, name, entity): spellings that belong together have one ``entity``, the least spelling among them.

    Distinct spellings meet in blocks of phonetic codes of their sorted words and are compared word by word (Jaro-Winkler
    and one slip, nicknames, abbreviations); accepted pairs form connected components over 64-bit ids of the spellings.
    Short forms (a surname with initials, an acronym) then join the one component that they fit; those that fit several
    stay apart, so that namesakes don't merge. Writings of one short form are together in any case; as they fit the same
    components, joining merges no two of these. Spellings without a partner have no row. Names are compared by distinct
    spelling only, so the work grows with the spellings, not with how often one occurs. Null and empty names are left
    out before.
    """
    names = cut(names.select("kind", "name", F.xxhash64("kind", "name").alias("id")))
    edges = candidates(names).mapInArrow(_verified, "kind string, id_a bigint, name_a string, id_b bigint, name_b string")
    whole = connected_components(edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumnRenamed("node", "id")

    forms = cut(names.mapInArrow(_short_forms, "kind string, id bigint, short boolean, key string, word string, form string"))
    known = forms.filter("not short").join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = known.select("kind", "key", F.col("word").alias("known_word"), "component").distinct()
    written = forms.filter("short").select("kind", "form", "key", "word").distinct()
    met = written.join(known, ["kind", "key"]).select("kind", "form", "word", "known_word", "component").distinct()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("word").to_pylist(), batch.column("known_word").to_pylist()
            level = [2 if x == y else 1 if mistyped(x, y) else 0 for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "form", "component")), pa.array(level, pa.int32())], ["kind", "form", "component", "level"])

    fits = met.mapInArrow(close, "kind string, form string, component bigint, level int").filter("level > 0")
    per = fits.groupBy("kind", "form", "level").agg(F.count_distinct("component").alias("n"), F.min("component").alias("component"))
    best = per.groupBy("kind", "form").agg(F.max(F.struct("level", "n", "component")).alias("b")).filter("b.n = 1")
    short = forms.filter("short").select("kind", "form", "id").distinct()
    joined = short.join(best.select("kind", "form", F.col("b.component").alias("fit")), ["kind", "form"], "left")
    own = F.xxhash64(F.lit("form"), "kind", "form")  # a component of its own for writings that fit none
    joined = joined.select("id", F.coalesce("fit", own).alias("component"))
    lone = joined.join(names.select(F.col("id").alias("component")), "component").select(F.col("component").alias("id"), "component")
    members = cut(whole.unionByName(joined).unionByName(lone).distinct().join(names, "id"))
    entities = members.groupBy("component").agg(F.min("name").alias("entity"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(entities, "component").select("kind", "name", "entity")


def variant_pairs(grouped: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) of all pairs of spellings in a group, name_a < name_b by code point."""
    left, right = (grouped.select("kind", "entity", F.col("name").alias(f"name_{s}")) for s in "ab")
    return left.join(right, ["kind", "entity"]).filter("name_a < name_b").select("kind", "name_a", "name_b")
