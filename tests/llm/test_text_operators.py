"""Encoders, counters, decontamination, personal data, languages: against libraries and brute force, and on odd tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lorekeep.llm import bpe, decontaminate, language, pii, token_counts

ALPHABET = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Z", "é", "ß", "1", "٣", "²", "½", "!", "\u3000", "\x85", "\xa0", "日本", "\u0301", "😀", "\x1c", "\x00", "s", "re", "'S", "<|endoftext|>", "Σ", "İ", "the", "World"]
ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "no id"), (5, "word " * 3000), (6, "x" * 5000)]


def random_texts(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 30))) for _ in range(n)] + ["", "a" * 3000, "ab'c" * 300, " " * 500]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ODD], "doc_id long, text string, row string, n_tokens int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_counts_equal_the_library_on_all_code_points():
    theirs, machine = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY)), token_counts.transducer()
    texts = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000] + [chr(c) + "a" for c in range(0xA700, 0xA800)]
    for at in range(0, len(texts), 1 << 14):
        own = texts[at : at + (1 << 14)]
        want = [len(x.ids) for x in theirs.encode_batch(own, add_special_tokens=False)]
        assert machine.count_texts(own) == want


def test_bpe_equals_the_library_and_decodes():
    own = bpe.codec()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = random_texts(3000)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_on_odd_tables(spark, odd, empty):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode(odd).collect()}
    assert len(bpe.encode(odd).collect()) == len(ODD)
    assert got[1, 0].ids_sha256 == got[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(empty).collect() == []
    ids = [r.ids for r in bpe.encode(odd, ids=True).where("doc_id = 4").collect()]
    assert ids[0] == ids[1]


def test_token_counts_equal_the_library():
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = random_texts(3000, 2)
    machine = token_counts.Transducer()
    assert machine.count_texts(texts) == [len(x.ids) for x in theirs.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_after_the_kept_maps_are_dropped(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(token_counts, "KEPT_MOVES", 5)
    texts = random_texts(200, 3)
    machine, again = token_counts.Transducer(), []
    for k in range(0, len(texts), 10):
        again += machine.count_texts(texts[k : k + 10])
    assert again == token_counts.transducer().count_texts(texts)


def test_token_counts_on_odd_tables(spark, odd, empty):
    got = token_counts.count(odd, limit=2048).collect()
    assert {(r.doc_id, r.n_bytes) for r in got if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
    assert [r.over_limit for r in got if r.doc_id == 5] == [True]
    assert token_counts.count(empty).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        if body is None:
            continue
        own = WORD.findall(body.translate(LOWER))
        n = min(13, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_decontamination_equals_brute_force(spark, block):
    rnd = random.Random(4)
    words = ["Alpha", "beta", "é", "日本", "7", "gamma", "x"]
    make = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(k, make(rnd.choice([1, 3, 12, 13, 14, 20]))) for k in range(12)] + [(50, None), (51, " ,."), (10, make(13))]
    docs = [(k, make(rnd.randint(0, 40)) + " " + rnd.choice(items[:12])[1] + "! " + make(rnd.randint(0, 5))) for k in range(60)] + [(100, None), (101, ""), (5, "beta"), (5, "beta")]
    got = decontaminate.search(spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string"), block)
    want = []
    for doc, text in docs:
        n, hit, found = brute_hits(text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((doc, n, hit, len(found), digest, hit > 0 and 20 * hit >= n))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == sorted(want)


def test_longest_match_and_place(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{k}" for k in range(5, 25)) + " c")], "doc_id long, text string")
    r = decontaminate.search(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (r.longest, r.longest_at, r.n_hit, r.items) == (20, 2, 20, [9])


def test_longest_matches_equal_brute_force():
    rnd = random.Random(8)
    make = lambda n: [b"%d" % rnd.randrange(3) for _ in range(n)]
    items = [(k, make(rnd.randint(13, 40))) for k in range(6)]
    docs = [make(rnd.randint(0, 10)) + rnd.choice(items)[1][rnd.randrange(5) :] + make(rnd.randint(0, 20)) for _ in range(40)]
    for own, (ranges, _, length, at) in zip(docs, decontaminate.Shard(decontaminate.Queries(items), docs).matches(), strict=True):
        stretches = {n: {tuple(x[k : k + n]) for _, x in items for k in range(len(x) - n + 1)} for n in range(13, 41)}
        best = max(((n, -k) for n in stretches for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in stretches[n]), default=(0, 1))
        assert (length, at) == (best[0], -best[1]) and bool(ranges) == (length > 0)


def test_equal_words_take_linear_room():
    import tracemalloc

    own = [b"x"] * 20_000
    shard = decontaminate.Shard(decontaminate.Queries([(1, own), (None, own)]), [own, [b"y"]])
    tracemalloc.start()
    assert shard.matches() == [([(0, 20_000)], [1], 20_000, 0), ([], [], 0, -1)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_items_without_an_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = decontaminate.search(docs, spark.createDataFrame([(None, "b c")], "item_id long, text string")).first()
    assert (r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (2, 0, True, hashlib.sha256(b"").hexdigest())


def test_decontamination_on_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(empty, none).collect() == []
    assert {r.contaminated for r in decontaminate.search(odd, none).collect()} == {False}
    assert decontaminate.remove(odd, none).count() == len(ODD)


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    parts = ["a", "Z", "9", "25", "255", "256", ".", "..", "@", "@@", "%", "+", "-", " ", "(", ")", "é", "4111111111111111", "+1 (555) 555-1234", "x.y@z.co", "10.0.0.1", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 16)))
        assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_take_linear_time_on_long_runs():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_terms(docs):
    """All spans of every text: bases, secrets, and all occurrences of telling terms in the documents of their entities."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, near, both, found = {}, {}, {}, []
    for text in docs:
        spans, low = pii.all_spans(text), text.translate(lower)
        words = [(m[0], *m.span()) for m in WORD.finditer(low)]
        for w in {w for w, _, _ in words}:
            seen[w] = seen.get(w, 0) + 1
        free = [all(b <= s or t <= a for _, s, t in spans) for _, a, b in words]
        places = {}
        for span in spans:
            left = [k for k, (_, _, b) in enumerate(words) if b <= span[1]][-4:]
            right = [k for k, (_, a, _) in enumerate(words) if a >= span[2]][:4]
            places.setdefault(pii.entity(text, span), set()).update(k for k in left + right if free[k])
        for e, own in places.items():
            near[e] = near.get(e, 0) + 1
            for w in {words[k][0] for k in own}:
                both[e, w] = both.get((e, w), 0) + 1
        found.append((spans, words, free, places))
    total, z = len(docs), 1.645

    def telling(e, w):
        k, n, p = both[e, w], seen[w], min(near[e] / total, 1 - 1e-9)
        share = (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return math.log2(share / p) / -math.log2(p) >= 0.75

    out = []
    for spans, words, free, places in found:
        terms = {words[k][0] for e, own in places.items() for k in own if telling(e, words[k][0])}
        out.append(pii.joined(spans + [("term", a, b) for (w, a, b), f in zip(words, free) if f and w in terms]))
    return out


def test_terms_equal_brute_force_on_real_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    want = sorted(zip([i for i, _ in docs], brute_terms([t for _, t in docs]), strict=True))
    got = sorted((r.doc_id, r.spans) for r in pii.find(frame).collect())
    assert got == want
    assert sum("term:" in x for _, x in got) >= 5


def test_terms_that_reveal_an_entity_are_spanned(spark):
    fill = "the cat sat on a mat and the dog ran off with it again today "
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = [(k, f"{fill * 3} captain zorg zorg@mail.org {fill * 3} then zorg left") for k in range(3)]
    docs += [(50 + k, f"{fill * 3} mail to user{k}@mail.org {fill}") for k in range(20)] + [(90, f"key {secret} {fill}")]
    docs += [(100 + k, fill * 6) for k in range(100)] + [(300, None), (301, ""), (None, "x@y.zz")]
    frame = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in docs], "doc_id long, text string, row string, __row int, spans string")
    rows = pii.find(frame).collect()
    assert len(rows) == len(docs)
    want = dict(zip([i for i, _ in docs], brute_terms([t or "" for _, t in docs]), strict=True))
    for r in rows:
        text = next(t for i, t in docs if i == r.doc_id) or ""
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k not in ("term", "secret")] == brute_spans(text)
        assert r.spans == want[r.doc_id] and r.n_spans == len(spans)
        terms = {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert ("zorg" in terms) == (r.doc_id in (0, 1, 2)) and not terms & {"the", "cat", "mat"}
        assert r.n_secret == (r.doc_id == 90)
    clean = {r.doc_id: r for r in pii.sanitised(frame).collect()}
    assert "[email]" in clean[1].text and "zorg" not in clean[1].text and clean[100].text == fill * 6 and "[secret]" in clean[90].text
    assert clean[300].text is None and all((r.row, r["__row"], r.spans) == ("x", 1, "y") for r in clean.values())
    assert len(clean) == len(docs)


def test_personal_data_in_an_empty_table(empty):
    assert pii.find(empty).collect() == []


LANGUAGES = {"aa": ["kala", "mala", "tala", "vala", "sala"], "bb": ["strength", "through", "thought", "wreath"], "cc": ["queño", "niño", "añejo", "piño"]}


def test_languages_and_mixtures(spark, empty):
    rnd = random.Random(6)
    rows = [(k, " ".join(rnd.choices(LANGUAGES[lang], k=30)), lang) for k in range(300) for lang in [rnd.choice(list(LANGUAGES))]]
    rows += [(1000, None, "aa"), (1001, "12 _ ² ½", "aa"), (1002, "kala " * 30 + "through " * 30, None), (1003, "mala", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:300])
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert sorted(got[1002].languages) == ["aa", "bb"] and abs(got[1002].score - 0.5) < 0.1
    assert got[1003].lang_pred == "aa" and 0 <= got[1003].score <= 1
    assert language.identify(empty).collect() == []


def test_language_without_training_texts(spark):
    got = language.identify(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_ranks_file_is_the_public_one():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        assert base64.b64decode(f.readline().split()[0])
