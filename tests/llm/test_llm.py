"""The numbered operators on small rows and against brute force."""

import random
import re
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import body_text, cooccurrence, kernels, leakage, names, repeated_lines, residue, subjects, tokens, truncation

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# Kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB1 9é-\n", max_size=30), max_size=8))
def test_word_codes_equal_words(texts):
    words = kernels.word_codes(*kernels.text_bytes(pa.array(texts, pa.string())))
    want = [(k, re.sub(r"[0-9]+", "0", w.lower())) for k, t in enumerate(texts) for w in re.findall(r"[A-Za-z0-9]+", t)]
    assert words.row.tolist() == [k for k, _ in want]
    by = {}
    for code, (_, w) in zip(words.code.tolist(), want, strict=True):
        assert by.setdefault(w, code) == code
    assert len(set(by.values())) == len(by)


def test_words_of_any_script():
    texts = ["Café 12 au-lait", "CAFE\u0301 7 AU LAIT", "Привет, мир!", "привет мир", "日本", "日 本", "plain words", None, "“Quoted” — dash"]
    words = kernels.words(pa.array(texts))
    rows = [words.code[words.row == k].tolist() for k in range(len(texts))]
    assert rows[0] == rows[1] and len(rows[0]) == 4 and rows[2] == rows[3] and len(rows[2]) == 2 and rows[4] == rows[5] and len(rows[4]) == 2
    assert rows[6] == kernels.word_codes(*kernels.text_bytes(pa.array(["plain words"]))).code.tolist() and rows[7] == [] and len(rows[8]) == 2


def test_min_hashes_estimate_similarity():
    rng = random.Random(1)
    base = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    changed = [w if rng.random() > 0.02 else "x" + w for w in base]
    grams = kernels.shingles(kernels.word_codes(*kernels.text_bytes(pa.array([" ".join(base), " ".join(changed), ""]))), 5)
    sets = [set(grams.code[grams.row == k].tolist()) for k in (0, 1)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    sig = kernels.min_hashes(grams, 256)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1
    assert (sig[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


# 1. Names


def keys_of(kind, name):
    return {key for key, _ in names.blocks(kind, name)}


@pytest.mark.parametrize("a,b", [
    ("Anthony Wabogadus", "Wabogadus, Tony"), ("Anthony Wabogadus", "ANTHONY WABOGADUS"), ("Josephine Kohavumir", "Josephine Kohavuimr"), ("Josephine Kohavumir", "Josephiine Kohavumir"),
    ("Farid Waibagaifais", "Sir Farid Waibagaifais"), ("Natalie Zokirebin", "Zokirebin Natalie"), ("Chandra Kuvamarais", "Chandra K. Kuvamarais"), ("Renée Mokegeda", "renee mokegeda"),
    ("Mei Fong Wigukumair", "Wigukumair, Mei Fong K."),
])
def test_people_match(a, b):
    x, y = names.parse("person", a), names.parse("person", b)
    assert names.same("person", x, y) and keys_of("person", x) & keys_of("person", y)


@pytest.mark.parametrize("a,b", [("Chandra Kuvamarais", "Teresa Kuvamarais"), ("Farid Waibagaifais", "Theodore Waibagaifais"), ("Walter Vedaidubai", "Vincent Vedaidubai"), ("A. B.", "A. B.")])
def test_people_differ(a, b):
    assert not names.same("person", names.parse("person", a), names.parse("person", b))


@pytest.mark.parametrize("a,b,same", [
    ("Johaizopar Logistics Company", "Johaizopar Log.", True), ("Jaimagibi Plantations Berhad", "JAIMAGIBI PLANTATIONS BHD", True), ("Kadetuhas Offshore Services Corporation", "Kadetuhas Offshore Svcs", True),
    ("Vadihaigis Steel Berhad", "Vadihaigis - Steel Berhad", True), ("Wapaiwaima Offshore Services Company", "Wapaiwaima (Offshore Services) Co", True), ("The Nobejowe Media Company", "Nobejowe Media", True),
    ("Jaimagibi Water Berhad", "Jaimagibi Plantations Berhad", False), ("Legaidisin Mining Limited", "Legaidisin Mining Berhad", False), ("Zehafijun Energy Sendirian Berhad", "Zehafijun Energy Bhd", True),
])
def test_organisations(a, b, same):
    assert names.same("organization", names.parse("organization", a), names.parse("organization", b)) is same


def test_jaro_winkler():
    assert abs(names.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3 and names.jaro_winkler("abc", "xyz") == 0 and names.jaro_winkler("", "") == 1
    assert names.one_slip("abcd", "abdc") and names.one_slip("abc", "abbc") and not names.one_slip("abc", "cba")


def one_slip_words(word):
    """Every word that ``one_slip`` takes for ``word``, with a few letters to add or change to."""
    out = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + word[k : k + 2][::-1] + word[k + 2 :] for k in range(len(word) - 1)}
    for k in range(len(word) + 1):
        out |= {word[:k] + c + word[k:] for c in "abdgjklmrsvz"} | {word[:k] + c + word[k + 1 :] for c in "abdgjklmrsvz"}
    return {w for w in out if len(w) >= 4 and w != word and names.one_slip(w, word)}


@pytest.mark.parametrize("kind,before,after", [("person", "Anthony ", ""), ("person", "", " Lee"), ("organization", "", " Plantations Berhad"), ("organization", "Harbour ", " Svcs")])
def test_every_slip_meets_in_a_block(kind, before, after):
    for word in ("vukaibujir", "josewezal", "gimukedir", "vojabugin", "bafovezu", "sinaizojas"):
        keys = keys_of(kind, names.parse(kind, before + word + after))
        lost = [w for w in one_slip_words(word) if not keys & keys_of(kind, names.parse(kind, before + w + after))]
        assert not lost


def test_a_slip_beside_an_abbreviation_meets_in_a_block():
    for a, b in (("Kadetuhas Offshore Services", "Kadetuhas Ofshore Svcs"), ("Kadetuhas Offshore", "Kadetuhas Iffshore"), ("Bafovezu Offshore Services", "Basovezu Offshore Svcs")):
        x, y = names.parse("organization", a), names.parse("organization", b)
        assert keys_of("organization", x) & keys_of("organization", y)


def test_candidates_of_frequent_words(spark):
    """A word of many organisations leads to no pair by first letters alone, but by a second word, and copies stay whole."""
    firms = [f"{w} Services" for w in ("Kadetuhas", "Kadituhes", "Kelomarun", "Kozubinav", "Kadonepul", "Kiheborun")] + ["Kadetuhas Svcs", "Kadetuhas Servces", "Iadetuhas Services"]
    df = spark.createDataFrame([("organization", f, k) for k, f in enumerate(firms)], "kind string, name string, id bigint")
    pairs = {tuple(sorted((r.name_a, r.name_b))) for r in names.candidates(df, frequent=4).collect()}
    assert {("Kadetuhas Services", f) if f > "Kadetuhas Services" else (f, "Kadetuhas Services") for f in firms[6:]} <= pairs
    assert not {p for p in pairs if set(p) <= set(firms[2:6])} and len(names.candidates(df).collect()) > len(pairs)


def test_no_pair_of_a_frequent_word_is_lost(spark):
    """Whatever word is frequent, the candidates have every pair that a comparison of all pairs accepts."""
    rest = ["Services", "Svcs", "Servces", "International", "Intl", "Internatinal", "Development", "Dev", "Devlp", "Management", "Mgmt", "Энергетика", "Энр", "Х" + "ы" * 30, "Хыыыы"]
    firms = rest + [f"{a} {b}" for a in ("Kadetuhas", "Kadituhes", "Iadetuhas", *rest) for b in rest] + [f"{a} {b} {c}" for a in ("Kadetuhas", "Kad") for b in rest[:8] for c in rest[3:13]] + ["K Services", "K Servces", "K Svcs"]
    parsed = {f: names.parse("organization", f) for f in firms}
    accepted = {(a, b) for a, b in combinations(sorted(firms), 2) if names.same("organization", parsed[a], parsed[b])}
    df = spark.createDataFrame([("organization", f, k) for k, f in enumerate(firms)], "kind string, name string, id bigint")
    for frequent in (0, 20):
        found = names.candidates(df, frequent=frequent).select("name_a", "name_b").collect()
        assert len(found) == len(set(found)) and accepted <= {tuple(sorted(r)) for r in found}


def test_short_and_long_keys_meet():
    words = ["svcs", "services", "intl", "international", "int", "devlp", "development", "co", "company", "x" * 30, "xxx", "ab", "a", "b&q", "бнк", "банковский", "interprovincialadministration", "interpr", "ntl", "interadm"]
    pairs = [(a, b) for a in words for b in words if len(a) < len(b) and names.shortened(a, b)]
    assert len(pairs) > 8 and all(names.short_keys(a) & names.long_keys(b) for a, b in pairs)


def test_groups_of_frequent_words(spark):
    """Over 50 organisations have the word; its own slips and the abbreviations beside it still belong together."""
    others = [f"{a}{b}{c}{d} Services" for a, b, c, d in product(("Ka", "Zo", "Mu", "Pe"), ("va", "di", "lo", "ru"), ("ba", "gi", "fo", "nu"), ("mir",))]
    pairs = [("International Services", "Intl Services"), ("Offshore Services", "Offshr Servces"), ("Services", "Servces"), ("Management Services", "Mgmt Srvices")]
    df = spark.createDataFrame([([], others + [x for p in pairs for x in p])], "people_mentioned array<string>, organizations_mentioned array<string>")
    assert len(others) > names.FREQUENT
    assert set(rows_of(names.variant_pairs(names.groups(names.spellings(df))))) >= {("organization", *sorted(p)) for p in pairs}


def test_groups(spark):
    people = ["Anthony Wabogadus", "A. Wabogadus", "\tWabogadus, Tony ", "Andrew Zed", "Alice Zed", "Zed, A.", "", None, "Anthony Wabogadus"]
    firms = ["United Jeposorin Harbour Dredging Authority", "UJHDA", "U.J.H.D.A.", "Lone Firm"]
    df = spark.createDataFrame([(1, people, firms), (2, None, [])], "id int, people_mentioned array<string>, organizations_mentioned array<string>")
    got = rows_of(names.variant_pairs(names.groups(names.spellings(df))))
    trio, firm = sorted(["Anthony Wabogadus", "A. Wabogadus", "Wabogadus, Tony"]), sorted(firms[:3])
    assert got == sorted([("person", *p) for p in combinations(trio, 2)] + [("organization", *p) for p in combinations(firm, 2)])
    assert names.groups(names.spellings(df.limit(0))).count() == 0


def test_reordered_organisations_and_writings_of_one_short_form(spark):
    firms = ["Jaimagibi Steel Works Berhad", "Works Jaimagibi Stel Bhd", "I.T.F.Q.B.", "ITFQB", "Steel Water Works Berhad"]
    people = ["A Bafovezu", "A. Bafovezu", "Zed, A.", "A. Zed", "Andrew Zed", "Alice Zed"]
    df = spark.createDataFrame([(people, firms)], "people_mentioned array<string>, organizations_mentioned array<string>")
    got = rows_of(names.variant_pairs(names.groups(names.spellings(df))))
    pairs = [("organization", *sorted(firms[:2])), ("organization", *sorted(firms[2:4])), ("person", *people[:2]), ("person", "A. Zed", "Zed, A.")]
    assert got == sorted(pairs)


# 2. Residue

RESIDUE = ["{{ title }}", "Text with ${city} inside.", "By [REPORTER NAME] in town.", "%HEADLINE% goes", "(null)", "Lorem ipsum dolor sit amet.", "test test asdf qwerty", "404 Not Found", "Error code: X1", "Please enable JavaScript in your browser to continue.", "Your browser is out of date or blocks scripts.", "Dummy article body.", "Access denied", "Site: not found", "<h1>Bad Gateway</h1>", "TKTK 00.00 XXXXX", "The [[company]] said", "cut off at {{na"]
CLEAN = [None, "", "   ", 'They saw a "404 not found" notice on Monday.', 'It turns "[name]" into a name.', "The course teaches JavaScript to 4 pupils.", "Access to the quay was denied to 2 lorries.", "Service was unavailable for 3 minutes.", "A cookie factory will open.", "It costs 5% of 20% today.", "[The firm did not reply]", "Undefined terms remain in the law."]


def test_residue_detectors():
    assert all(residue.detected(pa.array(RESIDUE)).to_pylist())
    assert not any(residue.detected(pa.array(CLEAN, pa.string())).to_pylist())
    assert residue.covered(pa.array(["{{a}} - ${b}", "By {{a}} in town today.", "Dummy article body. Text goes here.", "", None, "Plain text."])).to_pylist() == [True, False, True, False, False, False]


RECORD = "id bigint, content string, title string, url string, description string"


def test_residue_rows(spark):
    df = spark.createDataFrame([(k, t, "t", "u", None) for k, t in enumerate(RESIDUE + CLEAN)], RECORD).withColumn("code", F.lit("clash")).withColumn("hit", F.lit(1))
    found = residue.responses(df)
    want = [(k,) for k in range(len(RESIDUE))]
    assert rows_of(residue.residue(df, found, "id")) == want
    assert rows_of(residue.residue(df, found, "id", most=-1)) == want  # joined, as beyond a million responses
    kept = [(k,) for k in range(len(RESIDUE), len(RESIDUE + CLEAN))]
    assert rows_of(residue.without_residue(df, found, "id").select("id")) == kept and rows_of(residue.without_residue(df, found, "id", most=-1).select("id")) == kept
    assert residue.residue(df.limit(0), found, "id").count() == 0 and residue.responses(df.limit(0)).count() == 0


def article(k, host, extra="", short=False):
    """A record on its topic, with words of its title."""
    rest = "" if short else " The members spoke for a long time about roads, schools, water, the price of rice, new ferries and other matters of the year, and then they went home by the last boat of the evening."
    return (k, f"The budget of ward {k} passed in the second round. {extra}{rest}", f"Budget number {k} passed", f"http://{host}/{k}/budget-passed-{k}", None)


def canned(k, host, text):
    return (k, text, f"Budget number {k} passed", f"http://{host}/{k}/budget-passed-{k}", None)


def test_canned_responses_are_found_by_the_evidence_of_hosts(spark):
    """A sentence that no detector knows: on two hosts, in both tables, in records that say nothing of their address."""
    odd = [canned(k, "ab.example" if k % 2 else "www.cd.example", "Zorb flange is resting now.") for k in range(12)]
    real = [article(k + 100, "ab.example" if k % 2 else "cd.example") for k in range(200)]
    messages, pages = spark.createDataFrame(odd[:6] + real, RECORD), spark.createDataFrame(odd[6:] + real, RECORD).drop("description")
    found = residue.responses(messages, pages)
    assert rows_of(residue.residue(messages, found, "id", detectors=False)) == [(k,) for k in range(6)]
    assert rows_of(residue.residue(pages, found, "id")) == [(k,) for k in range(6, 12)]


def test_one_address_delivered_again_is_no_evidence(spark):
    again = [canned(k % 2, "ab.example", "Quux panel waits here.") for k in range(30)]
    df = spark.createDataFrame(again + [article(k + 100, "ab.example") for k in range(100)], RECORD)
    assert residue.responses(df).count() == 0


def test_sentences_of_articles_are_no_responses(spark):
    """Sentences that many articles share, and a message that articles tell of, stay; one that replaces articles goes."""
    told = [article(k, f"h{k % 5}.example", "The portal said too many requests came in. The talks go on.") for k in range(60)]
    gone = [canned(k + 1000, f"h{k % 5}.example", "Too many requests came from this place.") for k in range(10)]
    df = spark.createDataFrame(told + gone, RECORD)
    found = residue.responses(df)
    assert {r.canned for r in found.collect()} == {True, False}
    for most in (residue.MOST_CODES, -1):
        assert rows_of(residue.residue(df, found, "id", most=most)) == [(k + 1000,) for k in range(10)]


# 3. Truncation


def test_truncated(spark):
    whole = "The board met on Monday in the old town hall. It raised the budget for the harbour works after a long vote by all its members."
    filler = [(100 + k, f"Story {k}", f"The board approved plan number {k} today.\n(ends)", None) for k in range(30)]
    rows = [
        (1, "t", whole, "The board met"), (2, "t", whole[:-25], "A whole sentence here."), (3, "t", "It was said […]", None), (4, "t", "More text here… [+39 chars]", ""),
        (5, "t", "All is fine.", None), (6, "t", "Ends with &am", None), (7, "t", "What was it for? Nobody kn", None), (8, None, None, "  "), (9, "t", "{{residue}} cut of", None), (10, "t", '"We are done," he said. "Yes."', None),
    ]
    df = spark.createDataFrame([(i, t, c, d, f"u{i}", "s") for i, t, c, d in rows + filler], "msg_id bigint, title string, content string, description string, url string, source_name string")
    canned = residue.responses(df)
    got = truncation.truncated(df, canned)
    assert {(r.msg_id, r.field_name) for r in got.collect()} == {(1, "description"), (2, "content"), (3, "content"), (4, "content"), (6, "content"), (7, "content")}
    rates = {r.field_name: (r.n_values, r.n_cut) for r in truncation.rates(df, got).collect()}
    assert rates == {"content": (39, 5), "description": (2, 1)}
    assert rows_of(truncation.truncated(df, canned, most=-1)) == rows_of(got)  # residue taken out by a join
    assert truncation.truncated(df.limit(0), canned).count() == 0


INTRO = " ".join(f"Paragraph {w} of the long report lists what the {w} office spent on its own {w} buildings." for w in "north south east west upper lower inner outer first last".split())
STORY = INTRO + " The board of the harbour met on Monday in the old town hall and raised the budget for the works after a long vote by all its {} members, who had asked for a report on the cost of the {} quay and the new ferry line since the spring of last year."


def test_alignment_of_near_copies():
    whole = STORY.format(12, "northern")
    cut_off = whole[: whole.index("since the") + len("since the sp")]
    assert truncation.ends_early(cut_off, whole) == (True, True) and truncation.ends_early(cut_off[: -len(" sp")], whole) == (True, False)
    assert truncation.ends_early(cut_off.replace("Monday", "Tuesday").replace("old", "new"), whole) == (True, True)  # words changed far from the end
    assert truncation.ends_early(cut_off.replace("ferry", "boat"), whole) == (True, True)  # and near it
    assert truncation.ends_early(cut_off, STORY.format(7, "northern")) == (True, True)  # numbers are equal
    assert truncation.ends_early(whole, whole) == (False, False) and truncation.ends_early(cut_off, cut_off + "\nNext line") == (False, False)
    assert truncation.ends_early(whole[:600], whole) == (False, False)  # too little of it for 0.8
    assert truncation.ends_early("", whole) == (False, False) and truncation.ends_early("a b", "a b c") == (False, False)


def test_copies_are_found_beside_longer_revisions_and_in_hot_families(spark):
    """A cut value whose bucket's longest text is another revision, among many texts that differ in numbers alone."""
    whole = STORY.format(12, "northern")
    cut_off = whole[: whole.index("since the") + len("since the")]
    longer = whole + " " + " ".join(f"Line {k} of the later revision says more about it." for k in range(2))
    family = [(k, "t", STORY.format(k, "northern"), None, f"u{k}", "s") for k in range(100, 400)]
    rows = [(1, "t", cut_off.replace("Monday", "Friday"), None, "u1", "s"), (2, "t", whole, None, "u2", "s"), (3, "t", longer, None, "u3", "s"), *family]
    df = spark.createDataFrame(rows, "msg_id bigint, title string, content string, description string, url string, source_name string").withColumn("kind", F.lit(9)).withColumn("h", F.lit("clash"))
    got = truncation.truncated(df, residue.responses(df))
    assert [(r.msg_id, r.field_name, r.evidence) for r in got.collect()] == [(1, "content", "copy")]


# 4. Repeated lines


def brute_lines(rows, least=3, one_in=25):
    urls, on = {}, {}
    for _, source, url, content in rows:
        if source in (None, "N/A"):
            continue
        urls.setdefault(source, set()).add(url)
        for line in (content or "").split("\n"):
            line = re.sub(r"[0-9]+", "#", " ".join(line.split()).lower())
            if line and url is not None and content is not None:
                on.setdefault((source, line), set()).add(url)
    return sorted(k for k, v in on.items() if len(v) >= least and len(v) * one_in >= len(urls[k[0]] - {None}))


def page_rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = rng.choice(["A", "A", "A", "B", "C", "N/A", None])
        lines = [f"Unique text number {k} of {rng.random()}", rng.choice(["Share this  page", "SHARE THIS PAGE", " share this page "]), f"By Jane Doe {rng.randint(1, 30)}", "", f"© {rng.randint(2000, 2030)} {source}"]
        lines += [f"rare line {rng.randint(1, 40)} {chr(97 + rng.randint(0, 25))}"]
        rng.shuffle(lines)
        out.append((k, source, rng.choice([f"u{k}", f"u{k}", "shared", None]), rng.choice(["\n".join(lines)] * 8 + [None, ""])))
    return out


def test_repeated_lines_equal_brute_force(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "record_id bigint, source_name string, url string, content string").withColumn("bucket", F.lit(1)).withColumn("line", F.lit("clash"))
    found = repeated_lines.repeated_lines(df)
    assert rows_of(found.select("source_name", "line")) == brute_lines(rows)
    kept = {r.record_id: r for r in repeated_lines.without_lines(df, found).collect()}
    known = set(brute_lines(rows))
    for k, source, _, content in rows:
        want = None if content is None else "\n".join(x for x in content.split("\n") if (source, re.sub(r"[0-9]+", "#", " ".join(x.split()).lower())) not in known)
        assert kept[k].content == want
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


# 5. Co-occurrence


def brute_pairs(records, least, share):
    n, count, both = len(records), {}, {}
    for items in records.values():
        for x in items:
            count[x] = count.get(x, 0) + 1
        for p in combinations(sorted(items), 2):
            both[p] = both.get(p, 0) + 1
    return sorted((a, b, count[a], count[b], c, n) for (a, b), c in both.items() if c >= least and c >= n * share)


def test_pairs_equal_brute_force_with_a_wide_record(spark):
    rng = random.Random(5)
    records = {f"r{k}": {f"i{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))} for k in range(200)}
    records["wide"] = {f"i{k}" for k in range(60)} | {f"z{k}" for k in range(600)}
    records["wide2"] = {f"z{k}" for k in range(600)}
    rows = [(r, x) for r, items in records.items() for x in [*items, None]]
    got = cooccurrence.together(spark.createDataFrame(rows, "record string, item string"), least=2, least_share=0.0)
    assert sorted((r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab, r.n_records) for r in got.collect()) == brute_pairs(records, 2, 0)


def test_the_block_pairs_of_one_record_are_in_many_tasks(spark):
    coded = spark.range(20_000).select(F.struct(F.lit(7).alias("a"), F.lit(1).alias("b")).alias("record"), F.col("id").cast("int").alias("id"), F.lit(20_000).cast("bigint").alias("k"))
    blocks = -(-20_000 // cooccurrence.BLOCK)
    paired = cooccurrence.blocks_paired(coded, blocks * (blocks + 1) // 2).select("low", "high", F.size("a").alias("x"), F.size("b").alias("y"), F.spark_partition_id().alias("task"))
    rows = paired.collect()
    assert sorted((r.low, r.high) for r in rows) == [(i, j) for i in range(blocks) for j in range(i, blocks)]
    assert sum(r.x * r.y if r.low < r.high else r.x * (r.x - 1) // 2 for r in rows) == 20_000 * 19_999 // 2
    per = {}
    for r in rows:
        per[r.task] = per.get(r.task, 0) + 1
    assert len(per) > 100 and max(per.values()) < 3 * cooccurrence.BLOCK_PAIRS


def test_numbered_items(spark):
    df = spark.createDataFrame([(x, 1) for x in "z b é a B 10 9 日".split()], "item string, c int").repartition(5)
    got = {r.item: r.id for r in cooccurrence.numbered(df).collect()}
    assert got == {x: k for k, x in enumerate(sorted(got))}
    assert cooccurrence.numbered(df.limit(0)).count() == 0


def test_mentions(spark):
    rows = [(1, "u", [" A ", "A", "", None], None, ["P\t"]), (2, "u", ["B"], [], None), (3, None, ["A"], None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "entity_row_id bigint, url string, people_mentioned array<string>, organizations_mentioned array<string>, locations_mentioned array<string>")
    got = [tuple(r) for r in cooccurrence.mentions(df).filter("item is not null").collect()]
    assert sorted(got) == [("r:3", "people:A"), ("u:u", "locations:P"), ("u:u", "people:A"), ("u:u", "people:B")]
    assert cooccurrence.mentions(df).filter("item is null").count() == 3
    assert cooccurrence.together(cooccurrence.mentions(df.limit(0))).count() == 0


def test_all_pairs_are_counted_however_seldom(spark):
    from tests.oracle import SF, check
    from tidewire.llm import queries

    check(spark, queries.QUERIES["p5_all_pairs"], queries.SQL["p5_all_pairs"])
    got = queries.QUERIES["p5_all_pairs"](spark, SF)
    assert got.filter("n_ab = 1").count() > 0
    frequent = got.filter("n_ab >= 5 and n_ab * 500 >= n_records").select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_records")
    assert rows_of(frequent) == rows_of(queries.QUERIES["p5_pairs"](spark, SF).select(*frequent.columns))


# 7. Body text


@pytest.fixture(scope="module")
def classifier(spark):
    return body_text.train(spark)


def test_body_lines(spark, classifier):
    held = body_text.labelled_pages()[:60]
    other = body_text.train(spark, body_text.labelled_pages()[60:])
    df = spark.createDataFrame([(k, p["title"], p["content"]) for k, p in enumerate(held)], "record_id bigint, title string, content string")
    got = {(r.record_id, r.line_no) for r in body_text.body_lines(df, *other).collect()}
    want, every = set(), 0
    for k, p in enumerate(held):
        numbers = [i for i, line in enumerate(p["content"].split("\n")) if line.strip()]
        every += len(numbers)
        want |= {(k, i) for i, c in zip(numbers, p["labels"], strict=True) if c == "1"}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.95


def test_body_edges(spark, classifier):
    df = spark.createDataFrame([(1, None, None), (2, "t", ""), (3, "t", " \n\t"), (4, "Head", "Head\n{{a}} ${b}\nThe board of the harbour approved the budget after a long vote, the chairman said."), (5, None, "x" * 200_000)], "record_id bigint, title string, content string").withColumn("line", F.lit("clash"))
    got = {(r.record_id, r.line_no) for r in body_text.body_lines(df, *classifier).collect()}
    assert not {k for k, _ in got} & {1, 2, 3} and (4, 0) not in got and (4, 1) not in got
    assert body_text.body_texts(df.limit(0), *classifier).count() == 0


PAGE = [
    "We use cookies to give you the best experience on our site.", "Home > Business > Shipping", "Harbour board raises toll for lorries", "by Farid Waibagaifais, Selandar Daily",
    "The harbour board raised the toll for lorries by a tenth on Monday, after two years without a change, its chairman said.", "",
    "Hauliers said they would pass the cost on to their customers before the end of the month, and asked for a later start.", " \t",
    "READ MORE: Ferry operators ask for lower fees", "Share this article", "reader17572: Why no word on the northern quay?", "© 2024 Selandar Daily. All rights reserved.",
]
PARAGRAPHS = {4, 6}


def test_p7_found_gives_the_lines_outside_the_body(spark, tmp_path):
    """The registered query on a page written by hand: furniture comes, paragraphs and white space don't."""
    from tidewire.llm import queries

    rows = [(k, PAGE[2], "\n".join(PAGE)) for k in (7, 8)] + [(9, None, None), (10, "t", ""), (11, "t", " \n\t\n")]
    spark.createDataFrame(rows, "record_id bigint, title string, content string").withColumn("line_no", F.lit(5)).write.parquet(str(tmp_path / "pipeline_task1.parquet"))
    outside = {k for k, line in enumerate(PAGE) if line.strip()} - PARAGRAPHS
    got = rows_of(queries.QUERIES["p7_found"](spark, str(tmp_path)))
    assert got == sorted((page, k) for page in (7, 8) for k in outside)
    bodies = {r.record_id: r.body for r in queries.QUERIES["p7_bodies"](spark, str(tmp_path)).collect()}
    assert bodies == {page: "\n".join(PAGE[k] for k in sorted(PARAGRAPHS)) for page in (7, 8)}


def test_p7_lines_are_inside_or_outside(spark, classifier):
    from tests.oracle import SF

    pages = spark.read.parquet(f"{SF}/pipeline_task1.parquet")
    inside, outside = body_text.body_lines(pages, *classifier), body_text.other_lines(pages, *classifier)
    assert inside.join(outside, ["record_id", "line_no"]).count() == 0
    lines = pages.select("record_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"\S"))
    assert rows_of(inside.unionAll(outside).select("record_id", "line_no")) == rows_of(lines.select("record_id", "line_no"))


# 8. Tokens

HARD = ["a" * 3000, " " * 2000, " " * 2000 + "x", "1" * 3000, "." * 2000 + "!" * 50, "ு" * 1000, "😀" * 1500, "don't we'll I've " * 200, "\n\n\t  " * 400, "日本語" * 800 + "abc", "<|endoftext|>" * 50]


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_tree_equals_whole(text):
    whole = tokens._tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids
    for piece, window in ((64, 2), (200, 16), (37, 1)):
        parts = [tokens.Encoded.of(x, VOCABULARY) for x in tokens.cut_text(text, piece, piece // 2)]
        assert tokens.tree(parts, VOCABULARY, window).ids.tolist() == whole


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abst' .\n1é日😀-", min_size=1, max_size=400), st.integers(5, 60))
def test_tree_equals_whole_on_any_text(text, piece):
    parts = [tokens.Encoded.of(x, VOCABULARY) for x in tokens.cut_text(text, piece, piece // 2)]
    assert "".join(tokens.cut_text(text, piece, piece // 2)) == text
    assert tokens.tree(parts, VOCABULARY, 1).ids.tolist() == tokens._tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_encode_ids(spark):
    t = tokens._tokenizer(VOCABULARY)
    long = "".join(random.Random(2).choice("abc de.\n'st1") for _ in range(5000))
    texts = [None, "", " ", "Hello world", long, "x" * 3000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    for spread in (0, 4_000, tokens.SPREAD):  # pieces of all, of the longest, of no text are spread over tasks
        got = {r.doc_id: r.ids for r in tokens.encode_ids(df, VOCABULARY, piece=500, window=2, spread=spread).collect()}
        assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert t.decode(got[4]) == long
    assert tokens.encode_ids(df.limit(0), VOCABULARY).count() == 0


def test_p8_ids_equal_the_library_on_all_documents(spark):
    """The registered query with its own parameters, whose long texts go through the tree."""
    from tests.oracle import SF
    from tidewire.llm import queries

    t = tokens._tokenizer(VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.QUERIES["p8_ids"](spark, SF).collect()}
    assert got == {k: t.encode(x, add_special_tokens=False).ids for k, x in texts.items()}
    assert sum(len(x) > 2 * tokens.PIECE for x in texts.values()) > 0


# 9. Leakage


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(12)] + [(12, None), (13, "too short"), (14, "")]
    docs = []
    for k in range(60):
        base = [word() for _ in range(rng.randint(0, 60))]
        piece = rng.choice(items[:12])[1].split()
        size, start = rng.choice([5, 11, 12, 20]), rng.randint(0, 8)
        part = [w.upper() if k % 2 else w + "," for w in piece[start : start + size]]
        if k % 5 == 0 and len(part) > 6:
            part[6] = "changed"
        docs.append((k, " ".join(base[:20] + part + base[20:])))
    docs += [(60, None), (61, ""), (62, items[0][1] + " " + items[1][1]), (63, items[0][1])]
    ds, its = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    spans = lambda t: {tuple(w[k : k + 12]) for w in [leakage.words(t)] for k in range(len(w) - 11)}
    want = sorted((d, i) for d, x in docs for i, y in items if spans(x) & spans(y))
    found = leakage.leaks(ds, its)
    assert rows_of(leakage.shared_runs(found)) == want
    assert {r.item_id: r.shared_run for r in found.filter("doc_id = 62").collect()} == {0: 30, 1: 30}
    joined = leakage.leaks(ds, its, index_bytes=0)  # the windows of too many items for an index
    assert rows_of(joined) == rows_of(found) and leakage.leaks(ds, its.limit(0), index_bytes=-1).count() == 0
    assert leakage.leaks(ds.limit(0), its).count() == 0 and leakage.leaks(ds, its.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = leakage.Index(np.arange(300), np.empty(0, np.uint64), np.arange(300), prints, 3)
    near = prints[:50].copy()
    for k in range(50):
        for bit in rng.choice(64, k % 5, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    want = {(i, j) for i in range(50) for j in range(300) if bin(int(near[i] ^ prints[j])).count("1") <= 3}
    assert set(zip(*(x.tolist() for x in index.near(near)), strict=True)) == want


# 10. Subjects


def test_subjects_of_clear_texts(spark):
    words = {"sport": "match goal striker league cup referee penalty stadium", "finance": "bond dividend lender coupon margin equity loan yield", "health": "nurse vaccine ward patient dengue clinic dose surgery"}
    rng = random.Random(9)
    sentence = lambda s: " ".join(rng.choices(words[s].split(), k=7)).capitalize() + "."
    docs, truth = [], {}
    for k in range(240):
        a, b = rng.sample(list(words), 2)
        truth[k] = {a} if k % 4 else {a, b}
        parts = [sentence(a) for _ in range(6)] + [sentence(b) for _ in range(5 if k % 4 == 0 else 0)]
        docs.append((k, " ".join(parts), "en"))
    docs += [(300, None, None), (301, "", None), (302, "  ", None)]
    ds = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("share", F.lit(1))
    areas = spark.createDataFrame([(s, w) for s, w in words.items()], "subject string, description string")
    labels = spark.createDataFrame([(k, s) for k in range(1, 40) for s in truth[k]] + [(999, "unknown")], "doc_id bigint, subject string")
    got = {}
    for r in subjects.subjects(ds, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {300, 301, 302} & set(got)
    assert sum(got.get(k) == v for k, v in truth.items()) / len(truth) > 0.9
    assert subjects.subjects(ds.filter("doc_id >= 300"), areas, labels).count() == 0
    assert subjects.subjects(ds, areas.limit(0), labels).count() == 0


def test_all_areas_count(spark, monkeypatch):
    """Areas late in the alphabet aren't cut off; more than fit a task raise an error."""
    docs = spark.createDataFrame([(k, "Goal penalty striker. Goal keeper saves. Striker penalty goal.", "en") for k in range(3)] + [(k, f"Bond dividend yield{k}x. Lender bond coupon.", "en") for k in range(3, 9)], "doc_id bigint, text string, lang string")
    areas = spark.createDataFrame([(f"a{k:05}", f"nothing{k}") for k in range(300)] + [("zz", "goal penalty striker keeper")], "subject string, description string")
    labels = spark.createDataFrame([(0, "zz")], "doc_id bigint, subject string")
    assert {r.subject for r in subjects.subjects(docs, areas, labels).collect() if r.doc_id < 3} == {"zz"}
    monkeypatch.setattr(subjects, "MOST_AREAS", 300)
    with pytest.raises(ValueError):
        subjects.subjects(docs, areas, labels)


def test_sums_of_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(subjects, "SUMS", 3)

    def partial(batches):
        return np.full((200, 2), float(sum(len(b) for b in batches)))

    got = subjects._summed(spark.range(0, 1000, 1, 14), partial, 200, 2)
    assert got.shape == (200, 2) and (got == 1000).all()
    assert subjects._summed(spark.range(0), partial, 200, 2).sum() == 0


# Registered queries


def test_queries_agree_with_sql(spark):
    from tests.oracle import check
    from tidewire.llm import queries

    for name in ("p4_found", "p4_pages", "p5_found", "p5_pairs", "p9_found", "p9_items"):
        check(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", ["p1_found", "p1_entities", "p2_found", "p2_clean_pages", "p3_found", "p3_rates", "p7_found", "p7_bodies", "p8_ids", "p10_found", "p10_shares"])
def test_query_runs(spark, name):
    from tests.oracle import SF
    from tidewire.llm import queries

    assert queries.QUERIES[name](spark, SF).count() > 0


def test_leaks_in_very_long_documents(spark, monkeypatch):
    """A shared run is whole however long it is and wherever the parts of a document meet."""
    monkeypatch.setattr(leakage, "AT_ONCE", 40)
    words = [f"w{k}x" for k in range(300)]
    items = [(7, " ".join(words[95:120])), (8, " ".join(words[10:290]))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [" ".join(words), " ".join(words[:97]), " ".join(words[100:130])]})
    got = {(r["doc_id"], r["item_id"]): r["shared_run"] for b in leakage._search(items, 12, 3, 0.5)(iter([batch])) for r in b.to_pylist() if r["shared_run"]}
    assert got == {(1, 7): 25, (1, 8): 280, (2, 8): 87, (3, 7): 20, (3, 8): 30}


def test_by_size_keeps_all_rows():
    texts = ["a" * 10, None, "", "b" * 100, "c", "d" * 30]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    for most in (1, 25, 1000):
        parts = list(kernels.by_size(iter([batch]), "t", most))
        assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert len(list(kernels.by_size(iter([batch]), "t", 1000))) == 1
