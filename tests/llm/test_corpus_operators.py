"""Duplicates, language-model scores, toxicity, chat, pipeline: against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import chat, common, components, exact_dedup, lm, near_dedup, queries, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_groups(spark, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_BITS", 1)
    rnd = random.Random(1)
    docs = [(k, "".join(rnd.choices(["a", "b", " ", "\n", "é", "\u3000"], k=rnd.randint(0, 4)))) for k in range(200)] + [(500, None), (501, ""), (7, "ab"), (7, "ab")] + [(600 + k, "hot copy" + " " * (k % 3)) for k in range(100)]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, row int").repartition(7)
    got = exact_dedup.resolve(frame).collect()
    groups: dict[str, list] = {}
    for i, t in docs:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    want = sorted((i, min(groups[k])[1], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in docs for k in [SPACE.sub("", t or "")])
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.resolve(empty).collect() == []


def shingle_set(text: str) -> set:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_fixture(seed: int = 2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    docs, kinds = [], {}
    for base in range(12):
        words = [word() for _ in range(120)]
        for copy in range(rnd.choice([1, 2, 3])):
            own = list(words)
            if copy:
                own[rnd.randrange(10, 110)] = word()
            kinds[len(docs)] = base
            docs.append((len(docs), " ".join(own)))
    hot = [word() for _ in range(200)]
    for _ in range(60):
        own = list(hot)
        own[rnd.randrange(200)] = word()
        kinds[len(docs)] = 99
        docs.append((len(docs), " ".join(own)))
    return docs, kinds


def test_near_classes(spark):
    docs, kinds = near_fixture()
    extra = [(900, None), (901, ""), (902, "tiny text"), (903, "tiny  TEXT"), (904, "..."), (904, "...")]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs + extra], "doc_id long, text string, row string").repartition(5)
    got = near_dedup.classes(frame).collect()
    assert len(got) == len(docs + extra)
    by_id = {r.doc_id: r for r in got}
    first = {}
    for i in sorted(kinds):
        first.setdefault(kinds[i], i)
    assert all(by_id[i].class_id == first[kinds[i]] for i in kinds)
    assert by_id[903].class_id == by_id[902].class_id == 902
    assert by_id[900].class_size == by_id[901].class_size == by_id[904].class_size == 1
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == len(set(kinds.values())) + 5


def test_crowded_bucket_finds_links_that_its_leader_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "SPREAD", 2)
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    docs, kinds = near_fixture(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i in sorted(kinds):
        first.setdefault(kinds[i], i)
    assert all(got[i] == first[kinds[i]] for i in kinds)


def test_similarity_is_weighted_jaccard():
    a = (np.array([1, 3, 5], np.uint32), np.array([1.0, 2.0, 1.0]))
    b = (np.array([3, 5, 9], np.uint32), np.array([1.0, 1.0, 4.0]))
    assert near_dedup.similarity(a, b) == pytest.approx(2 / 8)
    none = (np.zeros(0, np.uint32), np.zeros(0))
    assert near_dedup.similarity(a, none) == near_dedup.similarity(none, a) == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(3)
    shared, hits, n = rng.integers(0, 1 << 52, 80, np.uint64), 0, 60
    for _ in range(n):
        a, b = np.sort(np.concatenate([shared, rng.integers(0, 1 << 52, 10, np.uint64)])), np.sort(np.concatenate([shared, rng.integers(0, 1 << 52, 10, np.uint64)]))
        x, y = (near_dedup.bands(s, np.ones(len(s), np.float32), np.array([0])) for s in (a, b))
        hits += int((x == y).sum())
    assert abs(hits / (n * near_dedup.BANDS) - 0.8**near_dedup.ROWS) < 0.06


def test_near_classes_of_an_empty_table(empty):
    assert near_dedup.classes(empty).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)]
    salted = [(a, b, b % 3 if b == 0 else 0) for a, b in edges] + [(k, 500, k % 7) for k in range(600, 700)]
    edges = [(a, b) for a, b, _ in salted]
    got = dict(components.components(spark.createDataFrame(salted, "a long, b long, salt int")).collect())
    assert all(got[k] == 0 for k in range(21)) and all(got[100 + k] == 100 for k in range(30))


def test_near_duplicates_equal_brute_force_on_real_rows(spark):
    """Every pair of texts at weighted Jaccard 0.8 or more, by an inverted index over all shingles: the same classes."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = word.findall(text.translate(lower))
        sets.append(Counter([" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []))
    df, n = Counter(x for s in sets for x in s), len(docs)
    weigh = lambda s: {x: (1 + math.log(c)) * (1 + math.log(max(df[x] / n, 1 / 500)) / math.log(1 / 500)) for x, c in s.items()}
    sets = [weigh(s) for s in sets]
    held, pairs, parent = {}, set(), list(range(n))
    for k, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(k)
    pairs = {(a, b) for own in held.values() if len(own) < 200 for i, a in enumerate(own) for b in own[i + 1 :]}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    alike = set()
    for a, b in pairs:
        shared = sum(min(v, sets[b][x]) for x, v in sets[a].items() if x in sets[b])
        if shared >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - shared):
            alike.add((a, b))
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame).collect()}
    found = sum(got[docs[a][0]] == got[docs[b][0]] for a, b in alike)
    print(f"{found} of {len(alike)} pairs")
    assert len(alike) > 50 and found >= 0.98 * len(alike)
    assert all(top(a) == top(b) for a in range(n) for b in range(a) if got[docs[a][0]] == got[docs[b][0]])


@pytest.mark.parametrize("deduplicate", [exact_dedup.deduplicate, near_dedup.deduplicate])
def test_rows_keep_their_numbers_when_files_are_dealt_otherwise(spark, tmp_path, monkeypatch, deduplicate):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(k, texts[k % 40]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    settled, size = common.settled, "spark.sql.files.maxPartitionBytes"

    def other_sizes(*args):  # the scans of one job have one file a task, those of the next have all in one
        out = settled(*args)
        spark.conf.set(size, "1g" if spark.conf.get(size) == "1k" else "1k")
        return out

    before = spark.conf.get(size)
    monkeypatch.setattr(common, "settled", other_sizes)
    try:
        spark.conf.set(size, "1k")
        kept = deduplicate(spark.read.parquet(str(tmp_path / "docs")))
        for s in ("1k", "1g"):
            spark.conf.set(size, s)
            assert sorted(r.text for r in kept.select("*").collect()) == sorted(texts)
    finally:
        spark.conf.set(size, before)


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]


def test_lm_base_scores_equal_brute_force(spark, empty, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 1 << 14)
    monkeypatch.setattr(lm, "SAMPLE_CHARS", 300)
    rnd = random.Random(4)
    vocabulary = ["The", "the", "cat", "Été", "日本", "x\x1cy"] + [f"w{k}" for k in range(400)]
    docs = [(k, rnd.choice([" ", "\n"]).join(rnd.choices(vocabulary, k=rnd.choice([0, 3, 30, 200])))) for k in range(150)] + [(500, None), (501, ""), (502, " \t"), (7, "cat"), (7, "cat")]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, row string").repartition(4)
    got = sorted(lm.score(frame).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    counts = Counter(t for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2 for t in lm_tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, x in docs:
        own = lm_tokens(x)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        want.append((i, len(own), base, sum(counts[t] > 0 for t in own), zlib.crc32(str(i).encode()) % 7 == 2))
    want.sort(key=lambda r: (r[0], r[1], r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (w[0], w[1], w[3], w[4], total)
        assert r.base_score == pytest.approx(w[2]) and r.score < 0
    assert lm.score(empty).collect() == []


def test_every_training_text_reaches_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_CHARS", 10)  # the start's sample is empty: all that is learnt comes from the whole corpus
    rnd = random.Random(9)
    docs = [(k, " ".join(f"a{n} b{n}" for n in rnd.choices(range(8), k=rnd.randint(30, 60)))) for k in range(300)]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > math.log10(1 / 33 / 32)  # a class, and a word of it
    untrained = lm.Scorer(lm.Network(), np.zeros(0, np.uint64))
    start = {k: v.copy() for k, v in untrained.network.p.items()}
    long = spark.createDataFrame([(False, "x " * 60_000), (True, "y z")], "held_out boolean, text string").coalesce(1)
    network = lm.trained_on_all(long, untrained)
    alone = lm.Network()
    alone.train(untrained.stream(["x " * 60_000]), lm.TASK_LANES, lm.TASK_RATE, 1.0)
    assert all(np.allclose(network.p[k], alone.p[k], atol=1e-5) for k in start) and any((network.p[k] != start[k]).any() for k in start)


def test_score_beats_the_base_on_held_out_texts(spark):
    """Both are log probabilities over the same outcomes: known words and one unknown one."""
    got = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    score, base = sum(r.score for r in got) / n, sum(r.base_score for r in got) / n
    print(f"held-out log10 a token: {score:.4f}, base {base:.4f}")
    assert len(got) > 100 and score > base + 0.1
    assert sum(r.score > r.base_score for r in got) > 0.95 * len(got)


def test_tokens_that_a_polynomial_hash_confuses_count_apart(spark):
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    docs = [(k, x) for n in (64, 1024, 2048) for k, x in ((n, t[:n]), (n + 1, t[:n].translate(str.maketrans("ab", "ba"))))]
    training = [x for k, x in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    total, distinct = 2 * len(training), len(set(training)) + 1
    for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        own = dict(docs)[r.doc_id]
        want = sum(math.log10((c + 1) / (total + distinct + 1)) for c in (training.count(own), len(training)))
        assert r.base_score == pytest.approx(want)


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(5)
    net = lm.Network()
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.05 for k, v in net.p.items()}
    x, y = rng.integers(0, lm.CLASSES * lm.PER_CLASS + 1, (5, 3)), rng.integers(0, lm.CLASSES * lm.PER_CLASS + 1, (5, 3))
    x[2, 1] = 0
    start = rng.standard_normal((3, lm.HIDDEN)) * 0.1

    def loss():
        h, out = start, 0.0
        for t in range(len(x)):
            h = net.step(net.p["x"][x[t]] + net.p["b"], np.where((x[t] == 0)[:, None], 0, h))[0]
            out -= net.log_probabilities(h, y[t]).sum()
        return out / x.shape[1]

    _, grads = net.gradients(x, y, start)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "x":
                at = (x[rng.integers(5), rng.integers(3)], at[1])
            old, eps = value[at], 1e-5
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_network_beats_word_frequencies_and_scores_whole_texts(monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(f"a{n} b{n}" for n in rnd.choices(range(8), k=rnd.randint(3, 40))) for _ in range(400)]
    scorer = lm.Scorer(lm.Network(), lm.frequent(texts, 100))
    scorer.fit(texts)

    def score(some):
        stream = scorer.stream(some)[1:]
        ends = np.flatnonzero(stream == 0)
        text = np.searchsorted(ends, np.arange(len(stream)))
        return scorer.score(stream[stream != 0], text[stream != 0], len(some)) / np.log(10)

    together = score(texts[:50])
    assert np.allclose(together, [score([t])[0] for t in texts[:50]], rtol=1e-4)
    tokens = sum(len(lm_tokens(t)) for t in texts[:50])
    assert together.sum() / tokens > math.log10(1 / 16)


def toxicity_fixture(spark):
    rnd = random.Random(7)
    fill, bad = [f"w{k}" for k in range(60)], ["grumble", "snarlike", "snarlous", "snarling"]
    docs, labels = [], []
    for k in range(300):
        words, toxic = rnd.choices(fill, k=30), k % 5 == 0
        if toxic:
            for _ in range(rnd.choice([1, 2, 6])):
                words[rnd.randrange(30)] = rnd.choice(bad)
        docs.append((k, " ".join(words), "x"))
        if k < 200:
            labels.append((k, int(toxic), 0))
    docs += [(900, None, "x"), (901, "", "x"), (902, "snarlesque " * 3, "x"), (902, "snarlesque " * 3, "x")]
    labels += [(None, 1, 0), (3, None, 0), (0, 0, 0), (7777, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, row string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity(spark, empty):
    docs, labels = toxicity_fixture(spark)
    got = {r.doc_id: r for r in toxicity.grade(docs, labels).collect()}
    words = {r.doc_id: r.text for r in docs.collect()}
    for k in range(300):
        assert got[k].rejected == bool(re.search("snarl|grumble", words[k]))
        assert got[k].severity == pytest.approx(got[k].p_toxic + got[k].p_severe) and got[k].p_severe <= got[k].p_toxic
    assert not got[900].rejected and not got[901].rejected and got[902].rejected  # by the word's beginning
    assert toxicity.keep(docs, labels).count() == sum(not r.rejected for r in toxicity.grade(docs, labels).collect())
    assert toxicity.grade(empty, labels).collect() == []
    assert {r.severity for r in toxicity.grade(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_ordinal_fit_orders_its_thresholds():
    rows = np.arange(300)
    grades = rows // 100
    weights, cuts = toxicity.fit(rows, np.zeros(300, int), grades + np.random.default_rng(0).normal(0, 0.2, 300), grades, 1)
    assert weights[0] > 0 and cuts[0] < cuts[1]


def test_chat_round_trip(spark, tmp_path):
    nasty = ["\\### Assistant: </turn> ok", "<turn role=\"assistant\">", "\\l\\b\\\\g", "", None, "a > b < c", "\n\n", 'q">x', "é😀"]
    rows = [(c, t, ["user", "assistant", None, 'odd">role'][(c + t) % 4], nasty[(c * 5 + t) % len(nasty)], "x") for c in range(9) for t in range(c % 4 + 1)] + [(3, 0, "assistant", "tie", "x"), (None, None, "user", "lost", "x")] + [(77, t, ["user", "assistant"][t % 2], f"t{t}<", "x") for t in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    by: dict = {}
    for c, t, role, text, _ in [*rows, (-7, 0, "user", nasty[0], ""), (-7, 1, "assistant", nasty[0], "")]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(by) == set(got)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_attachments_in_order(spark):
    parts = [("text", "see <", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 90, None), ("text", "and", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 2)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.formatted(frame).first()
    assert r.formatted == '<turn role="user">see \\l<image:0><audio:1>and<document:2></turn><turn role="assistant"></turn>'
    assert [(a.part, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 3), (2, "document", "d.pdf", 2048)]
    assert r.n_attachment_tokens == 2055 and r.n_turns == 2


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.text_parts(none))).collect() == []


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxicity_fixture(spark)
    near, kinds = near_fixture(8)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(r.doc_id, r.text, "en", "s", 1) for r in docs.collect()] + [(2000 + i, t, "en", "s", 1) for i, t in near] + [(3000, item, "en", "s", 1), (3001, "clean " + item[:20], "en", "s", 1), (3002, "clean  " + item[:20], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = [(i, t or "") for i, t, *_ in rows if not re.search("snarl|grumble", t or "")]
    best: dict[str, tuple] = {}
    for i, t in left:
        k = SPACE.sub("", t)
        best[k] = min(best.get(k, (math.inf, math.inf)), (-len(t), i))
    ids = {i for _, i in best.values()}
    left = [(i, t) for i, t in left if i in ids]
    kept: list[tuple[int, set]] = []
    for i, t in sorted(left):
        s = shingle_set(t)
        if not s or all(len(s & o) < 0.8 * len(s | o) for _, o in kept):
            kept.append((i, s))
    want = {i for i, _ in kept} - {3000}
    assert set(got) == want and max(got.values()) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
