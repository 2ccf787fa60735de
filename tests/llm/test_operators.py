"""Each operator on small cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random
from collections import Counter
from datetime import datetime
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import groups, languages, leaks, scans, splitting, survivors, tokens, truncation

T = datetime(2024, 1, 1)


# 1. Splitting


@given(st.text(alphabet="ab .\n\t éක", max_size=600), st.integers(4, 60), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_split_properties(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    overlap = min(overlap, limit // 2)
    assert "".join(text[b:c] for _, b, c in pieces) == text
    assert all(c - a <= limit for a, _, c in pieces)
    for (_, _, end), (a, b, _) in zip(pieces, pieces[1:], strict=False):
        assert b == end and b - a == min(overlap, b)


def test_split_is_local():
    rng = random.Random(3)
    text = " ".join(rng.choice(["law", "council", "shall", "fee.", "order"]) for _ in range(4000))
    edited = text[:9000] + "NEW WORDS " + text[9000:]
    a = {text[b:c] for _, b, c in splitting.split(text, 500, 0)}
    b = {edited[b:c] for _, b, c in splitting.split(edited, 500, 0)}
    assert len(a - b) <= 6


def test_split_texts(spark):
    rows = [("a", "unit", "1", "word " * 30, "x"), ("b", None, None, "z" * 90, "x"), ("c", "odd", "2", "short", "x"), ("d", "unit", "3", None, "x"), ("e", "unit", "4", "", "x"), ("a", "unit", "1", "word " * 30, "x")]
    df = spark.createDataFrame(rows, "id string, kind string, label string, text string, limit string")
    limits = spark.createDataFrame([("unit", 40, 5), ("unit", 50, 5), ("*", 30, 0)], "kind string, max_chars int, overlap_chars int")
    out = splitting.split_texts(df, limits).collect()
    how = {r.id: r.how for r in out if r.piece == 1}
    assert how == {"a": "natural", "b": "hard", "c": None, "e": None}
    assert all(r.label is None for r in out if r.piece > 1) and sum(r.id == "a" and r.piece == 1 for r in out) == 2
    assert splitting.split_texts(df.limit(0), limits).count() == 0
    assert splitting.split_texts(df, limits.limit(0)).where("how is not null").count() == 0


# 2. Languages

ENGLISH = "the council shall hear an appeal from the registrar before the end of the year".split()
SINHALA = "පනත රජය සඳහා විසින් අංක ගැසට් දිනය ලේකම් නගර ජල".split()
TAMIL = "சட்டம் வரி காணி நீர் பதிவு இந்த மனு கட்டணம் மற்றும் ஆகும்".split()
ROMAN = "panatha rajaya sandaha visin anka gasat dinaya lekam nagara jala".split()


def sentence(rng, words):
    return " ".join(rng.choices(words, k=9)).capitalize() + "."


def test_languages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words, label = [(ENGLISH, "ENGLISH"), (SINHALA, "SINHALA"), (TAMIL, "TAMIL"), (ROMAN, "SINHALA")][i % 4]
        rows.append((i, label if i % 9 else "TAMIL", None, f'{{"description": "{sentence(rng, words)}"}}', "x"))
    rows += [
        (1000, "english ", "untitled", f'{{"description": "{sentence(rng, ENGLISH)}"}}', "x"),
        (1001, "ENGLISH", None, f'{{"description": "{sentence(rng, ENGLISH)} | {sentence(rng, TAMIL)}"}}', "x"),
        (1002, "SINHALA", None, f'{{"description": "{sentence(rng, ROMAN)}"}}', "x"),
        (1003, "ENGLISH", None, f'{{"description": "{sentence(rng, SINHALA)} (the council shall)"}}', "x"),
        (1004, None, None, None, "x"),
        (1005, "?", "", "not json", "x"),
        (1006, "und", None, f'{{"description": "{sentence(rng, ENGLISH) * 2000}"}}', "x"),
        (1007, None, None, '{"description": "123 / 456."}', "x"),
    ]
    df = spark.createDataFrame(rows, "id long, language string, title string, listing string, segments string")
    told = languages.languages_of(df)
    found = {r.id: r.languages for r in languages.wrong_labels(told).collect()}
    assert {k: v for k, v in found.items() if k >= 1000} == {1001: "ENGLISH+TAMIL", 1003: "SINHALA", 1006: "ENGLISH"}
    assert all(found.get(i) == {0: "ENGLISH", 1: "SINHALA", 3: "SINHALA"}.get(i % 4) for i in range(0, 300, 9) if i % 4 != 2)
    assert all(0 <= s.confidence <= 1 for r in told.collect() for s in r.segments)
    assert languages.languages_of(df.limit(0)).count() == 0


# 3. Survivors

LIST = "id long, source string, listed_key string, title string, date string, date_precision string, language string, last_seen timestamp_ntz, doc_key string"


def test_survivors(spark):
    rows = [
        (1, "a", "Act:01/2000", "untitled", None, None, "ENGLISH", T, "x"),
        (2, "b", "act:1/2000", "A title", "2001", None, "eng ", T, "x"),
        (3, "b", "act: 1/2000", None, "pending", None, "SINHALA", T, "x"),
        (4, "b", "act:2/2000", "T", "2001", None, None, None, "x"),
        (4, "b", "act:2/2000", "T", "2001", None, None, None, "x"),
        (5, "c", "cap:1", "-", "", None, "tamil", T, "x"),
        (6, "c", "cap:01", "", None, None, "TA", T, "x"),
        (7, "c", None, "T", "2001", None, "TA", T, "x"),
    ]
    listings = spark.createDataFrame(rows, LIST)
    sources = spark.createDataFrame([("a", 1, "UTC", "dmy"), ("b", 2, "UTC", "dmy")], "source string, trust int, home_zone string, date_order string")
    documents = spark.createDataFrame([("act:1/2000", " PIN", 3), ("cap:1", "pin", 99), ("cap:1", None, 6), (None, "pin", 5)], "doc_key string, chosen_by string, listing_id long")
    out = {r.doc_key: (r.listing_id, r.title_from, r.date_from) for r in survivors.survivors(listings, sources, documents).collect()}
    assert out == {"act:1/2000": (3, 2, 2), "cap:1": (6, 0, 0)}
    out = {r.doc_key: r.listing_id for r in survivors.survivors(listings, sources, documents.limit(0)).collect()}
    assert out == {"act:1/2000": 1, "cap:1": 6}
    assert survivors.survivors(listings.limit(0), sources.limit(0), documents.limit(0)).count() == 0


def test_survivors_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice("abz"), f"cap:{rng.randrange(30)}", rng.choice([None, "T", "n/a", ""]), rng.choice([None, "2001", "pending"]), None, rng.choice(["ENGLISH", "si", "TAMIL", "?", None]), datetime(2024, 1, rng.randrange(1, 5)), "x") for i in range(1, 300)]
    pins = [(f"cap:{k}", "pin", rng.randrange(1, 300)) for k in range(30)]
    listings = spark.createDataFrame(rows, LIST)
    sources = spark.createDataFrame([("a", 1, "UTC", "dmy"), ("b", 2, "UTC", "dmy")], "source string, trust int, home_zone string, date_order string")
    got = {r.doc_key: (r.listing_id, r.title_from, r.date_from) for r in survivors.survivors(listings, sources, spark.createDataFrame(pins, "doc_key string, chosen_by string, listing_id long")).collect()}
    want = {}
    for key in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == key]
        rank = lambda r: (-((key, "pin", r[0]) in pins), {"ENGLISH": 0, "si": 1, "TAMIL": 2}.get(r[6], 3), {"a": 1, "b": 2}.get(r[1], 99), -r[7].day, -r[0])  # noqa: E731, B023
        own.sort(key=rank)
        if len(own) > 1:
            want[key] = (own[0][0], next((r[0] for r in own if r[3] == "T"), 0), next((r[0] for r in own if r[4] == "2001"), 0))
    assert got == want


def test_truth_discovery(spark):
    said = []
    for k in range(40):
        said += [(f"d{k}", "title", "right", "good"), (f"d{k}", "title", "right", "fair"), (f"d{k}", "title", "wrong", "bad")]
        said += [(f"e{k}", "title", "right", "good"), (f"e{k}", "title", "wrong", "bad")]
    best, known = survivors.truth_discovery(spark.createDataFrame(said, "doc_key string, field string, value string, source string"))
    assert {r.value for r in best.collect()} == {"right"}
    r = {x.source: x.reliability for x in known.collect()}
    assert r["good"] > 0.9 > 0.5 > r["bad"]
    assert survivors.truth_discovery(spark.createDataFrame([], "doc_key string, field string, value string, source string"))[0].count() == 0


def test_truth_discovery_on_planted_truth(spark):
    """Six sources of planted reliability: what is discovered is right more often than a majority, and the sources come out in order."""
    rng = random.Random(21)
    share = {"a": 0.95, "b": 0.9, "c": 0.6, "d": 0.45, "e": 0.4, "f": 0.4}
    said, votes = [], {}
    for k in range(900):
        wrong = [f"w{k}-{i}" for i in range(2)]
        for s in share:
            if rng.random() < 0.85:
                v = f"right{k}" if rng.random() < share[s] else rng.choice(wrong)
                said.append((f"d{k}", "title", v, s))
                votes.setdefault(k, Counter())[v] += 1
    said += [(None, "title", "x", "a"), ("d0", "title", None, "a"), ("d0", "title", "x", None), said[0]]
    best, known = survivors.truth_discovery(spark.createDataFrame(said, "doc_key string, field string, value string, source string"))
    rows = best.collect()
    right = sum(r.value == f"right{r.doc_key[1:]}" for r in rows) / len(rows)
    majority = sum(max(sorted(v), key=v.get) == f"right{k}" for k, v in votes.items()) / len(votes)
    found = {r.source: r.reliability for r in known.collect()}
    assert right > 0.93 and right > majority + 0.03
    assert min(found["a"], found["b"]) > found["c"] > max(found["d"], found["e"], found["f"])
    assert all(abs(found[s] - share[s]) < 0.06 for s in share)


# 5. Scans


def words():
    counts = {w: 3000 for w in "the of an appeal council shall be heard before in and land may section permit inter trust is is over".split()}
    return scans.Words(counts | {"by-law": 500, "harbour": 400, "intra-district": 90, "surveyor-general": 80, "statutory": 200, "commissioner": 200})


@lru_cache(1)
def line_model():
    return scans.fit_lines([], [])


def test_line_model_on_held_out_pages():
    rng = random.Random(77)
    title = "Orchard Keepers (Amendment) Ordinance, No. 7 of 1931"
    right = lines = 0
    for _ in range(300):
        text = " ".join(sentence(rng, ENGLISH) for _ in range(rng.randrange(3, 12)))
        page, labels = scans.printed_page(text, title, rng)
        told = [s for s, _ in line_model().labels(page, title)]
        right += sum(a == b for a, b in zip(told, labels, strict=True))
        lines += len(page)
    assert right / lines > 0.99


@pytest.mark.parametrize(
    ("text", "noise", "mended"),
    [
        ("the coun-\ncil shall be heard", ["hyphen"], "the council shall be heard"),
        ("the coun¬\n  cil shall be", ["hyphen"], "the council shall be"),
        ("the coun- cil shall", ["hyphen"], "the council shall"),
        ("a by-\nlaw shall be", [], "a by-law shall be"),
        ("inter- and intra-district trust", [], "inter- and intra-district trust"),
        ("the Surveyor-\nGeneral may", [], "the Surveyor-General may"),
        ("tbe council sha1l be lieard", ["char"], "the council shall be heard"),
        ("an appeal ofthe council", ["char"], "an appeal of the council"),
        ("Plan No. L1-10-B8 and MN115l of 5A", [], "Plan No. L1-10-B8 and MN115l of 5A"),
        ("the council\nHARBOUR TRUST ACT, NO. 3 OF 1990\nshall be heard", ["header"], "the council shall be heard"),
        ("the council\nHarbour Trust Act    32\nshall be heard", ["header", "page"], "the council shall be heard"),
        ("This may be cited as the\nHarbour Trust Act, No. 3 of 1990.", [], "This may be cited as the Harbour Trust Act, No. 3 of 1990."),
        ("Harbour Trust Act, No. 3 of 1990\nthe council shall", [], "Harbour Trust Act, No. 3 of 1990 the council shall"),
        ("the council\n- 27 -\nshall be", ["page"], "the council shall be"),
        ("the council\n27\nshall be", ["page"], "the council shall be"),
        ("Lots:\n34\n36\n38\nthe council", [], "Lots:\n34\n36\n38 the council"),
        ("(2)\nthe council shall", [], None),
        ("", [], ""),
        ("\n\n", [], ""),
    ],
)
def test_noise(text, noise, mended):
    got, kinds = scans.repair(text, "Harbour Trust Act, No. 3 of 1990", words(), line_model())
    assert kinds == noise
    if mended is not None:
        assert got == mended


def test_repaired(spark):
    text = "the council shall be heard before the appeal of the council. " * 30
    rows = [(f"c{i}", "k", text, "x") for i in range(40)] + [("n", "k", None, "x"), ("e", "k", "", "x"), ("z", None, "the coun-\ncil shall", "x"), ("z", None, "the coun-\ncil shall", "x"), ("l", "k", text * 500, "x"), ("h", "k", "the council\nTrust of the Council\nshall be", "x")]
    chunks = spark.createDataFrame(rows, "id string, doc_key string, text string, rows string")
    docs = spark.createDataFrame([("k", "Trust of the Council"), (None, "t")], "doc_key string, title string")
    out = Counter((r.id, tuple(r.noise)) for r in scans.repaired(chunks, docs).collect() if r.noise)
    assert out == {("z", ("hyphen",)): 2, ("h", ("header",)): 1}
    assert scans.repaired(chunks.limit(0), docs.limit(0)).count() == 0


def test_rare_words_keep_their_counts(spark):
    plain = "the council shall be heard " * 20_000
    rows = [(f"p{i}", "k", plain) for i in range(24)] + [(f"n{i}", "k", "the council of Norvale shall") for i in range(10)]
    rows += [(f"a{i}", "k", "the tarn shall") for i in range(11)] + [(f"m{i}", "k", "the tam shall") for i in range(14)] + [("x", "k", "the council of Norva1e shall")]
    chunks = spark.createDataFrame(rows, "id string, doc_key string, text string")
    docs = spark.createDataFrame([], "doc_key string, title string")
    out = {r.id: (r.text, r.noise) for r in scans.repaired(chunks, docs).where("size(noise) > 0").collect()}
    assert out == {"x": ("the council of Norvale shall", ["char"])}


def test_misreadings_and_heads_in_every_script(spark):
    """Planted in Sinhala and Tamil: a sign usually read for another is learnt from the counts, heads are told by titles of any script."""
    rng = random.Random(12)
    rows, want = [], {}
    for key, words, printed, read in (("s", ["පනත", "නගර", "පදනම", "නියම", "නම", "නිවස", "වන", "රජය"], "න", "ත"), ("t", ["வரி", "வணிகம்", "வனம்", "மனுவை", "வயல்", "சபைவழி", "நீர்", "காடு"], "வ", "ள")):
        title = " ".join(words[:3])
        for i in range(400):
            own = [rng.choice(words) for _ in range(40)]
            lines = [" ".join(own[a : a + 8]) for a in range(0, 40, 8)]
            noise = set()
            if i % 9 == 0:
                at = next(k for k, w in enumerate(own) if printed in w)
                lines[at // 8] = " ".join(own[at // 8 * 8 : at] + [own[at].replace(printed, read, 1)] + own[at + 1 : at // 8 * 8 + 8])
                noise.add("char")
            if i % 7 == 0:
                lines.insert(2, title)
                noise.add("header")
            rows.append((f"{key}{i}", key, "\n".join(lines)))
            if noise:
                want[f"{key}{i}"] = noise
    chunks = spark.createDataFrame(rows, "id string, doc_key string, text string")
    docs = spark.createDataFrame([("s", "පනත නගර පදනම"), ("t", "வரி வணிகம் வனம்")], "doc_key string, title string")
    table = scans.learnt(scans.count_words(chunks), frequent=300)
    assert {k: v for k, v in table.items() if k not in scans.READ_FOR} == {"ත": ["න"], "ள": ["வ"]}
    got = {r.id: set(r.noise) for r in scans.repaired(chunks, docs, frequent=300).where("size(noise) > 0").collect()}
    both = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert both >= 0.95 * sum(map(len, want.values())) and both >= 0.95 * sum(map(len, got.values()))


def test_verdicts_by_joins_are_those_of_all_counts(spark):
    rng = random.Random(9)
    made = ["".join(rng.choices("tbehncuilrmaf1", k=rng.randrange(1, 6))) for _ in range(600)] + ["ofthe", "couucii", "councii", "by-lavv"]
    made += [x for w in made[:600] for x in sorted(scans.options(w, 1)[0])[:2]]
    counts = {w: rng.choice([1, 2, 9, 40, 900, 30_000]) for w in made if w.isalpha()} | {"council": 9000, "councii": 40, "by-law": 800, "of": 9000, "the": 9000}
    tokens = sorted({w for t in made if (w := scans.candidate(t))})
    told = scans.judged(spark.createDataFrame([(w,) for w in tokens * 2], "word string"), spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    words = scans.Words(counts)
    assert {r.word: (r.printed, r.begins) for r in told} == {w: (p, words.begins(w)) for w in tokens if (p := words.printed(w))}
    assert len(told) == len({r.word for r in told}) > 20 and {r.word: r.printed for r in told}["couucii"] == "council"


def test_words_asked_hold_those_of_every_joining():
    rng = random.Random(4)
    for _ in range(500):
        body = "".join(rng.choice(["the", "in", "a", "-\n", "- ", "¬", "-", "0", " ", "/", "\n"]) for _ in range(rng.randrange(2, 30)))
        asked, pairs = scans.asked_of(body)
        for _ in range(8):
            form = scans.BROKEN.sub(lambda m: m[1] + m[5] if rng.random() < 0.5 else scans._unbroken(m), body)
            assert {t for t in scans.TOKEN.findall(form) if scans.candidate(t)} <= asked
        assert {(m[1].lower(), m[5].lower()) for m in scans.BROKEN.finditer(body)} == pairs


# 6. Groups


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
        elif a is not None or b is not None:
            find(a if a is not None else b)
    best = {}
    for x in parent:
        best[find(x)] = min(best.get(find(x), x), x)
    return {x: best[find(x)] for x in parent}


def test_groups(spark):
    rng = random.Random(2)
    pairs = [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(120)]
    pairs += [(f"p{i:03}", f"p{i + 1:03}") for i in range(90)]  # a long chain
    pairs += [("hub", f"s{i}") for i in range(150)]  # a star
    pairs += [("x", "x"), (None, "alone"), ("p000", "p001"), ("p001", "p000"), (None, None)]
    df = spark.createDataFrame([(a, b, "y") for a, b in pairs], "a string, b string, v string")
    got = {r.member: r.group for r in groups.components(df, "a", "b", hot_rows=50).collect()}
    assert got == union_find(pairs)
    assert groups.components(df.limit(0), "a", "b").count() == 0


# 8. Tokens


def encoder(**options):
    return tokens.ChunkEncoder(tokens.TOKENIZERS, "byte_bpe_50k", **options)


def test_chunked_ids_are_the_whole_texts_ids():
    rng = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", "1", "ක", "්", "'s", " the", " ", " ", "‍", "é", "!", "x y z ", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(1500)] + ["", " ", "   ", "a  ", "  a"]
    for modulus, longest in ((1, 1 << 16), (2, 16), (3, 9)):
        own = encoder(modulus=modulus, longest=longest, kept_bytes=20_000)
        raw = [t.encode() for t in texts]
        ids, ends = own.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        assert all(ids[a:b].tolist() == own.plain.encode_ordinary(t) for t, a, b in zip(texts, ends, ends[1:], strict=False))


def test_forced_cuts_change_ids_and_are_repaired():
    rng = random.Random(3)
    changed = 0
    for longest in (5, 12, 40):
        own = encoder(longest=longest)
        for _ in range(120):
            text = "".join(rng.choices(["the\n", "council", "\t", "1990", "පනත", ",", "\n\n", "  ", "'s", "é", "😀", "shall"], k=rng.randrange(20, 120))).lstrip()
            whole = own.plain.encode_ordinary(text)
            changed += np.frombuffer(b"".join(own.cuts(text)), dtype=np.int32).tolist() != whole
            assert np.frombuffer(own.long_ids(text), dtype=np.int32).tolist() == whole
        assert own.repaired > 100
        for text in ("x" * 2000, "\n" * 500 + "x", "x\n" * 300):
            assert np.frombuffer(own.long_ids(text), dtype=np.int32).tolist() == own.plain.encode_ordinary(text)
    assert changed > 300


def test_token_ids(spark):
    long = "word " * 60_000 + "x" * 100_000
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, long, "x"), (1, "a b", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    out = [(r.doc_id, r.ids) for r in tokens.token_ids(df).collect()]
    plain = encoder().plain
    assert sorted((d or 0, len(i)) for d, i in out) == sorted((r.doc_id or 0, len(plain.encode_ordinary(r.text or ""))) for r in df.collect())
    assert next(i for d, i in out if d == 5) == plain.encode_ordinary(long)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_tokens_agree_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    text = "The Act, No. 3 of 1990 — පනත <|endoftext|> சட்டம்  12A."
    assert other.encode(text, add_special_tokens=False).ids == encoder().plain.encode_ordinary(text)


# 9. Leaks


def test_leaks(spark):
    passage = "When a junior delegate dissolves some emergency roll even in a caretaker term, that sealed session binds the suspended speaker for 12 days."
    own = passage.split()
    filler = "nothing of the kind is written here at all today and so on"
    texts = {
        1: f"{filler} {passage} {filler}",
        2: f"{filler} " + " ".join(own[3:16]).upper().replace(" ", " - ") + f" {filler}",
        3: f"{filler} " + " ".join(own[3:15]) + f" {filler}",
        4: None,
        5: "",
        6: (filler + " ") * 20_000 + " ".join(own[-13:]),
        7: f"{filler} " + passage.replace("12", "35"),
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(1, texts[1], "x"), (None, texts[1], "x")], "doc_id long, text string, hash string")
    items = spark.createDataFrame([(10, passage, 1), (10, passage, 1), (11, None, 1), (12, "too short", 1), (None, passage, 1)], "item_id long, passage string, id int")
    found = leaks.leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(found).collect()}
    assert got == {(1, 10), (2, 10), (6, 10), (7, 10)} and found.count() == 4
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(leaks.leaks(docs, items, most=0)).collect()} == got
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["The", "council", "12", "days,", "acres", "Norvale", "trust", "3/4", "-", "of", "an", "FEE", "නීතිය", "x."]
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [phrase(rng.randrange(10, 40)) for _ in range(30)]
    docs = []
    for k in range(200):
        own = rng.choice(passages).split()
        at = rng.randrange(len(own))
        docs.append(f"{phrase(rng.randrange(20))} {' '.join(own[at : at + rng.randrange(8, 30)])} {phrase(rng.randrange(20))}")
    words = lambda t: [w for x in t.split() if (w := leaks.clean(x))]
    grams = lambda t: {tuple(w[i : i + 13]) for w in [words(t)] for i in range(len(w) - 12)}
    held = [grams(p) for p in passages]
    want = {(d, i) for d, t in enumerate(docs) for i, g in enumerate(held) if grams(t) & g}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(leaks.leaks(df, items)).collect()} == want and len(want) > 50


def test_reparameterised(spark):
    """Planted passages with other numbers, units and names, of other lengths too; unrelated and inconsistent ones aren't found."""
    rng = random.Random(6)
    names = ["Norvale", "Ashlake", "Wexmere Mills", "Harbour Trust Board", "Orchard", "Dunmore"]
    plain = "shall pay to the council before it opens any gate or bridge over that old canal and keeps its own books in good order".split()
    shape = lambda: rng.sample(plain, 9)
    fill = lambda a, n, b, u, c: f"when {n} {' '.join(a)} {u[0]} {u[1]} and {n} with {c} {' '.join(b)} at once"
    value = lambda: (rng.choice(names), (str(rng.randrange(10, 999)), rng.choice(["days", "acres", "rupees"])), rng.choice(names))
    items, docs, want = [], [], set()
    for i in range(60):
        a, b = shape(), shape()
        n, u, c = value()
        items.append((i, fill(a, n, b, u, c)))
        n2, u2, c2 = value()
        while n2 == n or c2 == c or (n2 == c2) != (n == c) or u2[0] == u[0]:
            n2, u2, c2 = value()
        docs.append((i, f"nothing else is written here. {fill(a, n2, b, u2, c2)} more words follow this one"))
        want.add((i, i))
    docs += [(100 + i, f"when Norvale {' '.join(shape())} 3 days and Ashlake with Dunmore {' '.join(shape())} at once") for i in range(60)]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.reworded(leaks.leaks(df, table)).collect()}
    assert got == want
    alone = {(r.doc_id, r.item_id) for i in (3, 41) for r in leaks.reworded(leaks.leaks(df, table.where(f"item_id = {i}"))).collect()}
    assert alone == {(3, 3), (41, 41)}
    passage = "a fee of 100 rupees is payable for each permit or for 100 permits within 30 days of the notice"
    texts = [(1, passage.replace("100", "250")), (2, passage), (3, passage.replace("100 r", "250 r"))]
    out = {r.doc_id: (r.equal, r.alike) for r in leaks.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, passage string")).collect()}
    assert out[1][0] == 0 < out[1][1] and out[2][0] == len(passage.split()) - 12
    assert 3 not in out or out[3][1] < out[1][1]


# 10. Truncation


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The Council shall hear the appeal.", False), ("The Council shall hear the app", True), ("The Council shall hear the app-", True), ("The Council shall…", True), ("The Council shall [...]", True),
        ("The Council shall &am", True), ("The Council sha�", True), ("The fee is Rs.", True), ("One.\n2.", True), ("One.\nNorvale, 1 July 1991", False), ("One.\nMinister of Canal Lands", False),
        ("One.\nL.D.-B. 61/92", False), ("One.\nPrice: Rs. 7,500", False), ("One.\nLot 1 | A | 0.2 ha\nLot 2 | B | 0.3 ha", False), ("One.\nLot 1 | A | 0.2 ha\nLot 2 | B", True), ("for “a”, of the words “b”.", False), ("for “a”, of the words “b”", True),
        ("නියෝග විසින් කරනු ලැබේ.", False), ("නියෝග විසින් කරනු ලැබ", True), ("1. එක.\n2. දෙක නියෝ", True), ("சட்டம் வரி காணி ஆகும்.", False), ("சட்டம் வரி காணி ஆகு", True), ("சட்டம் வரி காணி…", True),
    ],
)
def test_endings(spark, text, cut):
    assert (truncation.ending(text, None) in ("sign", "word", "open", "line")) == cut


def test_truncated(spark):
    whole = "The Council shall hear the appeal before the end of the year and publish it.\nRegistrar of the Mills"
    rows = [(1, "a", "s", None, whole, "x"), (2, "a", "s", None, whole[:60], "x"), (3, "b", "s", None, None, "x"), (4, "b", "t", None, "  ", "x"), (5, "b", "t", None, "", "x"), (6, "c", "t", None, whole, "x")]
    rows += [(100 + i, f"k{i}", "t", None, f"Text number {i} ends.\nApplication allowed with costs", "x") for i in range(12)]
    rows += [(200 + i, "same", "t", None, whole[: len(whole) - 6], "x") for i in range(3)]  # a closing line cut off, as its longer copy tells
    df = spark.createDataFrame(rows, "doc_id long, doc_key string, source string, title string, text string, core string")
    out = {r.doc_id: (r.cut, r.how) for r in truncation.truncated(df).collect()}
    assert {k for k, (c, _) in out.items() if c} == {2, 200, 201, 202} and out[200][1] == "prefix"
    assert len(out) == len(rows) and out[3][1] == "none"
    assert {r.source: r.cut for r in truncation.by_source(truncation.truncated(df)).collect()} == {"s": 1, "t": 3}
    assert truncation.truncated(df.limit(0)).count() == 0


def hot_texts(spark, copies):
    """Copies of one text that ends as if it were whole, a longer one, and others before and after them in order."""
    start = "The Council shall hear the appeal before the end of the year and publish it.\nMinister of Finance"
    texts = spark.createDataFrame([("hot", start), ("long", f"{start} shall pay the fee."), ("before", "A text ends."), ("after", "Words that end here.\nRegistrar of the Mills")], "doc_key string, own string")
    hot = spark.range(copies).selectExpr("id AS doc_id", "'hot' AS doc_key")
    rows = hot.unionByName(texts.where("doc_key <> 'hot'").selectExpr("1000000000 + length(own) AS doc_id", "doc_key"))
    return rows.join(texts, "doc_key").selectExpr("doc_id", "doc_key", "'s' AS source", "CAST(null AS string) AS title", "own AS text")


def in_partitions(spark, partitions, run):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("copies", "partitions"), [(400, 4), (40_000, 1), (60_000, 1), (60_000, 16), (230_000, 2)])
def test_truncated_copies_of_a_hot_text(spark, copies, partitions):
    out = in_partitions(spark, partitions, lambda: Counter((r.doc_key, r.how) for r in truncation.endings(hot_texts(spark, copies), hot_rows=50_000).collect()))
    assert out == {("hot", "prefix"): copies, ("long", "whole"): 1, ("before", "whole"): 1, ("after", "whole"): 1}


@pytest.mark.parametrize("partitions", [1, 7])
def test_prefixes_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    base = ["The Council shall hear the appeal. " * 9, "Lots and fees of the harbour, " * 12, "ab\ncd " * 60]
    texts = {b[: rng.randrange(1, len(b))].rstrip() + rng.choice(["", "", " and so on", "\nx.", "x"]) for b in base for _ in range(60)} | {"A", "The", "Lots and", "ab"}
    # A copy that goes on in a new line comes before the one that goes on inside the sentence.
    hidden = "Whoever keeps a lighthouse in repair shall be heard by the Council"
    texts |= {hidden, f"{hidden}\nAnother line.", f"{hidden} before the year ends."}
    # Ids repeat with another text, and some are null.
    ids = [i if i % 11 else None for i in range(2 * len(texts))]
    odd = [(1, None, "s", None, "Another text of the same id."), (None, None, "s", None, "Another of none.")]
    df = spark.createDataFrame(odd + [(ids[i], None, "s", None, t) for i, t in enumerate(sorted(texts) * 2)], "doc_id long, doc_key string, source string, title string, text string")
    own = {r.whole: r.core for r in truncation.trimmed(df).collect()}
    cores = set(own.values())
    want = {c for c in cores if any(o != c and o.startswith(c) and truncation.goes_on(c, o[len(c)]) for o in cores)}
    got = in_partitions(spark, partitions, lambda: Counter(r.doc_id for r in truncation.endings(df, hot_rows=20).where("how = 'prefix'").collect()))
    sure = {"sign", "word"}
    every = {i for i, t in enumerate(sorted(texts) * 2) if own[t] in want and truncation.ending(t, None) not in sure}
    counted = Counter(ids[i] for i in every)
    assert hidden in want and got == counted
