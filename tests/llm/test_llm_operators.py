"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeated rows, empty
tables, columns with clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chroma, kneser_ney, line_dedup, mixing, near_dedup, packing, quality, queries, rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "id long, key string, _score double, n int, _cut int, a string"


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, f"s{(i or 0) % 3}", len(t or "")) for i, t, g in zip(ids, texts, langs, strict=True)], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % size}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with copies, shared lines, junk; null, empty and long ones; a repeated row; a null id; clashing names."""
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += ["\n".join([words(rng, 20), " Common LINE \t", words(rng, 20)]) for _ in range(14)]
    base = words(rng, 150).split()
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[1], None, "", "  \n\t", "a", "a b", "ünïcödé …   wörd", words(rng, 20_000), "### $$$ %%% " * 30]
    ids = [*range(len(texts)), 5, None]
    df = frame(spark, [*texts, texts[5], "no id"], ids)
    return df.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ODD.split(", "))), dict(zip(ids, [*texts, texts[5], "no id"], strict=True))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rows_that_repeat_an_id(spark):
    """Near copies and common lines, where rows of one id hold other texts."""
    rng = random.Random(5)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(5, a), (5, b), (3, b), (9, a + " more"), (9, a + " more"), (None, a), (4, None)]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_dedup.report(df, 2).collect()), key=repr)
    n = [len(_shingles(t, 2)) for t in (a, b, a + " more")]
    assert got == sorted([(5, 5, n[0], True), (5, 3, n[1], False), (3, 3, n[1], True), (9, 5, n[2], False), (9, 5, n[2], False), (None, 5, n[0], False), (4, 4, 0, True)], key=repr)
    left = sorted(((r.doc_id, r.text) for r in near_dedup.one_of_each(df, 2).collect()), key=repr)
    assert left == sorted([(5, a), (3, b), (None, a), (4, None)], key=repr)
    lines = frame(spark, ["common\nown"] * 12, [i // 2 for i in range(12)])
    assert {r.n_dropped for r in line_dedup.line_report(lines, min_docs=10).collect()} == {2}
    assert {r.n_dropped for r in line_dedup.line_report(lines, min_docs=13).collect()} == {0}


def test_line_dedup(spark, corpus):
    df, texts = corpus
    count = Counter()
    for r in df.select("text").collect():
        count.update(set(line_dedup.line_keys((r.text or "").encode())))
    for least in (2, 10):
        got = line_dedup.line_report(df, min_docs=least).collect()
        assert len(got) == df.count()
        for r in got:
            lines = (texts[r.doc_id] or "").split("\n")
            kept = [x for x in lines if not (k := line_dedup.line_keys(x.encode())[0]) or count[k] < least]
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    cut = line_dedup.drop_common_lines(df)
    assert cut.columns == df.columns and cut.filter("doc_id IS NOT NULL AND text IS NULL").count() == 1
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_line_dedup_over_many_shards(spark, corpus, monkeypatch):
    df, _ = corpus
    want = {tuple(r) for r in line_dedup.line_report(df, min_docs=2).collect()}
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    many = line_dedup.drop_common_lines(df.select("doc_id", "text"), min_docs=2, stats=True)
    assert {tuple(r) for r in many.select("doc_id", "_n_lines", "_n_dropped", "_sha").collect()} == want


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        h = line_dedup.PerfectHash.build(keys)
        assert sorted(h.slots(keys)) == list(range(len(keys)))


def _shingles(text, width):
    w = [x.lower() if x.isascii() else x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, corpus, width):
    df, texts = corpus
    sets = {i: _shingles(t, width) for i, t in texts.items() if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.report(df, width).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.report(empty(spark)).count() == 0
    kept = near_dedup.one_of_each(df, width)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if find(i) == i} | {None}


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A base with many edited copies, many of which are near the base or a few others only."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 13):
            copy[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    sets = [_shingles(t, 2) for t in texts]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            for j in range(i):
                if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[r] == r for r in root):
            break
    got = {r.doc_id: r.component_id for r in near_dedup.report(frame(spark, texts), 2).collect()}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert got[i] == got[j]
    assert len(set(got.values())) == len({r for r in (root[root[i]] for i in range(len(root)))})


def test_pairs_under_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, (200, near_dedup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        wrong = rng.choice(near_dedup.POSITIONS, near_dedup.DISTANCE, replace=False)
        row[wrong] ^= 1
    ka, kb = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    df, texts = corpus
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.packed(df, capacity=64, keep_ids=True).collect()
    want = Counter()
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            own = ids[k : k + 64]
            want[r.doc_id, k // 64, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 64) + 2
    assert packing.packed(empty(spark)).count() == 0


def test_runs_fill_bins():
    rng = random.Random(1)
    for capacity in (7, 100, 4096):
        items = Counter(min(capacity, int(rng.expovariate(6 / capacity)) + 1) for _ in range(4000))
        bins, got = defaultdict(int), Counter()
        for n, low, high, seq, offset in packing.runs(items, capacity):
            got[n] += high - low
            for k in range(high - low):
                assert bins[seq + k] == offset
                bins[seq + k] += n
        assert got == items and max(bins.values()) <= capacity
        assert len(bins) <= 1.01 * sum(n * c for n, c in items.items()) / capacity + 2


def _kneser_ney(train):
    """The model by dictionaries."""
    toks = lambda t: [*t.encode().lower().split(), b"\n"]
    pairs, uni = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        pairs.update(zip([b"<s>", *w[:-1]], w, strict=True))
    types, total, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (v, _), c in pairs.items():
        total[v] += c
        kinds[v][min(c, 3)] += 1
    cc, tc = Counter(pairs.values()), Counter(types.values())
    d, e = kneser_ney.discounts(*(cc[k] for k in (1, 2, 3, 4))), kneser_ney.discounts(*(tc[k] for k in (1, 2, 3, 4)))
    all_types = sum(types.values())
    mass = sum(e[min(t, 3)] for t in types.values()) / all_types

    def p(v, w):
        low = max(types[w] - e[min(types[w], 3)], 0) / all_types + mass / (len(uni) + 1)
        if not total[v]:
            return low
        g = sum(d[k] * n for k, n in kinds[v].items()) / total[v]
        c = pairs[v, w]
        return max(c - d[min(c, 3)], 0) / total[v] + g * low

    n = sum(uni.values())

    def score(text):
        w = toks(text)
        return len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([b"<s>", *w[:-1]], w, strict=True))

    return score, p, uni


def test_kneser_ney(spark, corpus):
    df, texts = corpus
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [r.text or "" for r in df.collect() if not held(r.doc_id)]
    score_of, p, uni = _kneser_ney(train)
    for r in kneser_ney.report(df).collect():
        n, known, total, base, score = score_of(texts[r.doc_id] or "")
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    for context in (b"<s>", b"w1", b"never seen"):
        assert sum(p(context, w) for w in uni) + p(context, b"unknown word") == pytest.approx(1)
    assert kneser_ney.report(empty(spark)).count() == 0


def test_rules(spark, corpus):
    df, texts = corpus
    got = rules.verdicts(df, labels_of(spark, [(i, 1, 0) for i in range(20)])).collect()
    assert len(got) == df.count()
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        w = t.split()
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split(b"\n") if x.split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.decode().count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.verdicts(empty(spark), labels_of(spark, [])).count() == 0


def test_verdicts_by_brute_force(spark):
    """Cutoffs and verdicts from sums of binomial probabilities, document by document."""
    from fractions import Fraction

    rng = random.Random(31)
    texts, langs, known = [], [], []
    for i in range(2100):
        lang = "en" if i % 7 else "de"
        good = i % 3 > 0
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randint(55, 90))] + ["#"] * (rng.randrange(0, 4) if good else rng.randrange(0, 60))
        rng.shuffle(w)
        texts.append(" ".join(w[:40]) + "\n" + " ".join(w[40:]))
        langs.append(lang)
        known.append((i, int(good), 0))
    df = frame(spark, texts, langs=langs)
    got = rules.verdicts(df, labels_of(spark, known)).collect()
    features = {r.doc_id: r for r in got}
    n_lines = {i: sum(1 for x in t.split("\n") if x.split()) for i, t in enumerate(texts)}
    value = {
        "symbols_per_word": lambda r: r.n_symbols / max(1, r.n_words), "dup_line_share": lambda r: r.n_dup_lines / n_lines[r.doc_id],
        "repeat_word_share": lambda r: r.n_repeat_words / max(1, r.n_words), "mean_word_length": lambda r: r.word_chars / max(1, r.n_words),
    }

    def low_tail(k, n, p):
        return float(sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))

    cleans = {s: [r for r in got if langs[r.doc_id] == s and known[r.doc_id][1] and not r.base_failed] for s in set(langs)}
    # strata in which not even a cutoff that rejects no clean document could be certified don't count
    p, few = rules.ALPHA / len(rules.GRIDS), rules.DELTA / len(rules.GRIDS)
    strata = [s for s, clean in cleans.items() if low_tail(0, len(clean), p) <= few]
    assert strata == ["en"]
    fails: dict[int, set] = {i: set() for i in features}
    for stratum in strata:
        clean = cleans[stratum]
        for rule, grid in rules.GRIDS.items():
            cut = None
            for c in sorted(grid, reverse=True):
                k = sum(value[rule](r) > c for r in clean)
                if k > p * len(clean) or low_tail(k, len(clean), p) > few / len(strata):
                    break
                cut = c
            for r in got:
                if cut is not None and langs[r.doc_id] == stratum and value[rule](r) > cut:
                    fails[r.doc_id].add(rule)
    wrong = [(r.doc_id, r.failed_rules, fails[r.doc_id], r.base_failed, r.kept) for r in got if set(r.failed_rules) != fails[r.doc_id] or r.kept != (not r.base_failed and not fails[r.doc_id])]
    assert not wrong
    assert any(fails.values())


def test_rules_control_risk(spark):
    rng = random.Random(2)
    good = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) for _ in range(3000)]
    junk = [" ".join(f"w{rng.randrange(10**5)}###" for _ in range(60)) for _ in range(200)]
    df = frame(spark, good + junk)
    out = rules.verdicts(df, labels_of(spark, [(i, 1, 0) for i in range(3000)]), alpha=0.05).collect()
    assert sum(r.kept for r in out if r.doc_id < 3000) >= 2950 and not any(r.kept for r in out if r.doc_id >= 3000)
    few = rules.verdicts(df, labels_of(spark, [(i, 1, 0) for i in range(20)])).filter("kept").count()
    assert few == 3200
    assert rules.at_most(2, 50, 0.1) == pytest.approx(sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(3)))
    assert rules.certified(1000, [0, 1, 400, 0], 0.05, 0.01) == 2


def test_quality(spark, corpus):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "river", "stone", "grey"]) for _ in range(60)) for _ in range(150)] + [" ".join(rng.choice(["RIVER!!", "STONE!!", "GREY!!", "OF!!"]) for _ in range(60)) for _ in range(150)]
    df = frame(spark, texts)
    known = labels_of(spark, [(i, int(i < 150), 0) for i in range(300)])
    got = quality.report(df, known).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id < 150) for r in got if r.held_out) == sum(r.held_out for r in got)
    again = quality.report(df, known).collect()
    assert [r.score for r in got] == [r.score for r in again]
    odd, _ = corpus
    assert all(0 <= r.score <= 1 for r in quality.report(odd, known).collect())
    assert quality.report(empty(spark), known).count() == 0
    assert {r.score for r in quality.report(df, labels_of(spark, [])).collect()} == {0.5}


def test_toxicity(spark, corpus):
    rng = random.Random(6)
    plain = lambda: [f"w{rng.randrange(300)}" for _ in range(30)]
    texts, toxic = [], []
    for i in range(400):
        w = plain()
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["nastyone", "nastytwo", "Vilest"])
        texts.append(" ".join(w) + ".")
    df = frame(spark, texts)
    known = labels_of(spark, [(i, 1, y) for i, y in enumerate(toxic)])
    got = toxicity.report(df, known).collect()
    assert all(r.predicted == toxic[r.doc_id] for r in got)
    for r in got:
        for s in r.spans:
            assert all(w.lower().startswith(("nasty", "vilest")) for w in texts[r.doc_id][s.start : s.end].split())
    odd, _ = corpus
    assert all(0 <= r.score <= 1 for r in toxicity.report(odd, known).collect())
    assert toxicity.report(empty(spark), known).count() == 0
    assert all(0 <= r.score < 0.5 for r in toxicity.report(df, labels_of(spark, [])).collect())


@pytest.mark.parametrize("longest", [None, 256])
def test_sentences_and_spans(longest):
    rng = random.Random(4)
    lists = [[rng.choice([b"a", b"b", b".", b"\n", b"!"]) for _ in range(rng.randrange(60))] for _ in range(50)] + [[b"x"] * 700, []]
    laid = toxicity.laid_out(lists, longest)
    want = []
    for d, tokens in enumerate(lists):
        run = []
        for i, t in enumerate([*tokens, b"."]):
            if t[:1] in (b".", b"\n", b"!") or len(run) == longest:
                want += [(d, run)] if run else []
                run = []
            if t[:1] not in (b".", b"\n", b"!"):
                run.append(i)
    got = [(int(laid.doc[a]), laid.place[a:b].tolist()) for a, b in zip(laid.start, laid.end, strict=True)]
    assert got == want
    assert all(laid.words[laid.code[k]] == lists[laid.doc[k]][laid.place[k]] for k in range(len(laid.code)))
    text = "größe übel! schön böse".encode()
    found = toxicity._spans(text, np.array([1, 3, 4]), np.array([0.9, 0.8, 0.7]), 0.5)
    assert [text.decode()[s["start"] : s["end"]] for s in found] == ["übel", "schön böse"]


def test_forward_backward():
    """Against sums over all tag sequences."""
    from itertools import product

    rng = np.random.default_rng(0)
    emit, a, first = rng.normal(size=9), rng.normal(size=(2, 2)), 0.3
    a[0, 0] = 0
    start, end = np.array([0, 4, 5]), np.array([4, 5, 9])
    p = toxicity.forward_backward(emit, start, end, a, first)[0]
    for s, e in zip(start, end, strict=True):
        weight = {}
        for tags in product((0, 1), repeat=e - s):
            weight[tags] = math.exp(first * tags[0] + sum(emit[s + i] * t for i, t in enumerate(tags)) + sum(a[x, y] for x, y in zip(tags, tags[1:], strict=False)))
        for i in range(e - s):
            assert p[s + i] == pytest.approx(sum(w for t, w in weight.items() if t[i]) / sum(weight.values()))


def test_substring_dedup(spark, corpus):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    fresh = lambda n: " ".join(f"f{rng.randrange(10**7)}" for _ in range(n))
    texts = [f"{fresh(30 + i)} {passage} {fresh(20)}" for i in range(6)] + [fresh(200) for _ in range(6)] + ["ü" * 2000]
    df = frame(spark, texts)
    got = {r.id: r for r in substring_dedup.plan(df).collect()}
    # the last text repeats inside itself
    assert {i for i, r in got.items() if r.n_dropped} == {1, 2, 3, 4, 5, 12}
    cut = {r.doc_id: r.text for r in substring_dedup.cut_spans(df, substring_dedup.plan(df)).collect()}
    for i, t in enumerate(texts):
        kept, at = [], 0
        for s in got[i].spans:
            kept.append(t[at : s.start])
            at = s.end
        assert cut[i] == "".join(kept) + t[at:]
        if i in range(1, 6):
            assert sum(s.end - s.start for s in got[i].spans) > len(passage) // 2
            assert all(t[s.start : s.end] in passage for s in got[i].spans)
    odd, _ = corpus
    assert {r.id: set(r.first_ids) for r in got.values() if r.first_ids} == {i: {0} for i in range(1, 6)}
    assert substring_dedup.plan(odd).count() == odd.count() and substring_dedup.plan(empty(spark)).count() == 0


def test_substring_dedup_finds_short_passages(spark):
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("aeinorstl") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    passages = [prose(51) for _ in range(150)]
    texts = [f"{prose(40)} {p} {prose(40)}" for p in passages for _ in range(2)]
    for r in substring_dedup.plan(frame(spark, texts)).collect():
        a = texts[r.id].index(passages[r.id // 2])
        shared = [min(s.end, a + len(passages[r.id // 2])) - max(s.start, a) for s in r.spans]
        assert not shared if r.id % 2 == 0 else sum(shared) > 0.9 * len(passages[r.id // 2]) and r.first_ids == [r.id - 1]


def test_substring_dedup_of_repeated_ids(spark):
    """Rows of one id with other texts: each is cut by what it holds itself, and nothing is lost everywhere."""
    rng = random.Random(21)
    fresh = lambda n: " ".join(f"z{rng.randrange(10**7)}" for _ in range(n))
    shared = fresh(80)
    rows = [(7, fresh(30)), (7, fresh(300) + " " + shared + " " + fresh(50)), (9, fresh(50) + " " + shared), (9, "short"), (9, None), (None, shared), (11, shared), (11, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.plan(df).collect()
    assert len(got) == len(rows)
    texts = [(i, t or "") for i, t in rows]
    for r in got:
        own = [t for i, t in texts if i == r.id and len(t) == r.dropped_chars + r.kept_chars]
        assert own and all(any(t[s.start : s.end] in shared for t in own) for s in r.spans)
        assert r.id is not None or not r.spans
    assert sum(r.dropped_chars for r in got if r.id == 7) == 0
    assert sum(r.dropped_chars for r in got if r.id == 9) > 0.9 * len(shared)
    assert [r.dropped_chars for r in got if r.id == 11] == [len(shared)] * 2


def test_substring_dedup_query_has_every_document(spark, tmp_path):
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    own, shared = fresh(60), fresh(60)
    frame(spark, [f"{own} {fresh(40)} {own}", shared + " " + fresh(40), fresh(40) + " " + shared, fresh(30), None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and [i for i in got if got[i].spans] in ([0, 2], [2, 0])
    assert got[0].first_ids == [] and got[2].first_ids == [1]


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(3000)).encode()
    a, b = (substring_dedup.chunk_ends([x])[0] for x in (text, b"shifted " + text))
    assert a[-1] == len(text) and max(np.diff([0, *a])) <= substring_dedup.MOST
    assert len({text[i:j] for i, j in zip([0, *a], a, strict=False)} - {(b"shifted " + text)[i:j] for i, j in zip([0, *b], b, strict=False)}) <= 4
    h = substring_dedup.gear(np.frombuffer(text, np.uint8))
    slow = 0
    for i, byte in enumerate(text[:200]):
        slow = ((slow << 1) + int(substring_dedup._GEAR[byte])) % 2**32
        assert i < 1 or h[i] == slow


def test_mixing(spark, corpus):
    rng = random.Random(8)
    texts, langs = [], []
    for i in range(400):
        g = "de" if i % 4 == 0 else "en"
        langs.append(g)
        texts.append(" ".join(rng.choice(["und", "der", "die", "haus"] if g == "de" else ["and", "the", "of", "house"]) for _ in range(rng.randint(20, 60))))
    df = frame(spark, texts, langs=langs)
    targets = {"de": 0.5, "en": 0.5}
    covered = df.select(F.col("doc_id").alias("_id"), F.col("lang").alias("domain")).filter("doc_id < 200")
    got = mixing.rates(df, covered, targets).collect()
    total = sum(r.n_tokens for r in got)
    n, p, r = (np.array([row[c] for row in got], float) for c in ("n_tokens", "p0", "rate"))
    assert abs((n * p * r).sum() / total - 0.5) < 1e-3 and abs((n * (1 - p) * r).sum() / total - 0.5) < 1e-3 and r.min() >= 0
    assert all((row.p0 > 0.5) == (langs[row._id] == "de") for row in got)
    # plain numpy: a long projected gradient reaches no smaller error, with and without a lower bound
    s = np.array([(n * p).sum(), (n * (1 - p)).sum()])
    for least, share, weights in ((0.0, [0.5, 0.5], targets), (1.0, [0.9, 0.1], {"de": 0.9, "en": 0.1}), (1.0, [0.05, 0.95], {"de": 0.05, "en": 0.95})):
        table, fit = mixing.fitted(df, covered, weights, least=least)
        rows = table.collect()
        n, p, r = (np.array([row[c] for row in rows], float) for c in ("n_tokens", "p0", "rate"))
        sums = lambda x, n=n, p=p: np.array([(n * p * x).sum(), (n * (1 - p) * x).sum()])
        whole = s.sum() if least == 0 else (s / share).max()
        error = lambda x, sums=sums, whole=whole, share=share: (((sums(x) - whole * np.array(share)) / whole) ** 2 / s * s.sum()).sum()
        x = np.ones(len(n))
        for _ in range(3000):
            rho = (sums(x) - whole * np.array(share)) / s
            x = np.maximum(least, x - mixing.STEP * (p * rho[0] + (1 - p) * rho[1]))
        assert fit.converged and r.min() >= least and error(r) <= error(x) + 1e-6
        assert np.allclose(fit.reached, sums(r) / sums(r).sum())
    both = mixing.mixed(df, covered, targets, least=1.0, most=4.0)
    assert both.columns == df.columns and both.select("doc_id").distinct().count() == 400
    odd, _ = corpus
    out = mixing.mixed(odd, covered, targets, least=1.0, most=4.0)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mixed(empty(spark), covered, targets).count() == 0
    assert mixing.rates(df, covered.limit(0), targets).count() == 400


def _align(query, other):
    """Whether two prints align at the offset of most equal integers, by counting at every offset."""
    votes = {}
    for o in range(-len(query) + 1, len(other)):
        a, b = (query[: len(other) - o], other[o:]) if o >= 0 else (query[-o:], other)
        k = min(len(a), len(b))
        votes[o] = int((a[:k] == b[:k]).sum())
    best = min(votes, key=lambda o: (-votes[o], abs(o), o))
    shorter = min(len(query), len(other))
    error, k = chroma.aligned(query, other, best)
    return votes[best] >= max(1, min(chroma.VOTES, shorter)) and error <= chroma.BIT_ERROR and k >= min(chroma.OVERLAP, shorter)


def test_chroma_of_odd_media(spark):
    import io
    import wave

    tone = np.sin(np.arange(8000) / 3)

    def wav(width, channels=1, rate=chroma.RATE):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            x = np.repeat(np.rint(tone * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels)
            w.writeframes((x + 128).astype(np.uint8).tobytes() if width == 1 else x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return out.getvalue()

    for width in (1, 2, 3, 4):
        assert np.abs(chroma.wav_samples(wav(width, 2)) - tone).max() < 0.02
    assert len(chroma.wav_samples(wav(2, rate=16000))) == 4000
    good = wav(2)
    rows = [(0, b""), (1, b"no audio at all"), (2, good[:30]), (3, good[:60]), (4, good), (5, good), (6, None)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in rows], "id long, audio binary")
    got = {r.id: r for r in chroma.fingerprinted(df, ["id"], "audio").collect()}
    assert len(got) == 7 and got[0].reason == "no data" and got[6].reason == "null" and got[1].reason and got[2].reason
    assert all(bytes(got[i].print) == b"" for i in (0, 1, 2, 6)) and bytes(got[4].print) == bytes(got[5].print) != b""
    assert chroma.fingerprinted(df.limit(0), ["id"], "audio").count() == 0


def test_chroma_offsets_of_steady_recordings(monkeypatch):
    """Histograms of offsets by transforms equal those by counting; recordings together give what each gives alone."""
    rng = np.random.default_rng(0)
    queries_ = [rng.integers(0, 6, n).astype(np.uint32) for n in (50, 300, 20)] + [np.full(900, 3, np.uint32)]
    monkeypatch.setattr(chroma, "PAIRS", 1 << 10)
    block = chroma.Block([(i, x.astype("<u4").tobytes()) for i, x in enumerate(queries_)])
    for other in (rng.integers(0, 6, 400).astype(np.uint32), np.full(1200, 3, np.uint32), np.zeros(0, np.uint32)):
        got = Counter()
        for q, offset, votes in block._votes(other):
            for key, n in zip(zip(q.tolist(), offset.tolist(), strict=True), votes.tolist(), strict=True):
                got[key] += n
        want = Counter()
        for q, x in enumerate(queries_):
            for o in range(-len(x) + 1, len(other)):
                low, high = max(0, o), min(len(other), len(x) + o)
                if high > low and (n := int((other[low:high] == x[low - o : high - o]).sum())):
                    want[q, o] = n
        assert got == want
    sounds = [rng.normal(size=n).astype(np.float32) for n in (0, 1, 600, 4000, 30_000)]
    assert all(np.array_equal(a, chroma.fingerprint(x)) for a, x in zip(chroma.fingerprints(sounds), sounds, strict=True))


def test_chroma(spark):
    import io
    import wave

    rng = random.Random(3)
    song = " ".join(f"k{rng.randrange(10**4)}" for _ in range(80))
    samples = chroma.rendered_samples(song)

    def wav(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(chroma.RATE)
            w.writeframes((np.clip(x, -1, 1) * 30000).astype("<i2").tobytes())
        return bytearray(out.getvalue())

    noise = np.random.default_rng(0)
    others = [chroma.rendered_samples(" ".join(f"q{rng.randrange(10**4)}" for _ in range(80))) for _ in range(12)]
    parts = [samples, samples + noise.normal(0, 0.05, len(samples)), samples[chroma.HOP * 20 :], samples, *others]
    df = spark.createDataFrame([(i, wav(x)) for i, x in enumerate(parts)] + [(100, None), (200, wav(np.zeros(0)))], "conv_id long, audio binary")
    prints = chroma.fingerprinted(df, ["conv_id"], "audio")
    got = {r.conv_id: r for r in chroma.search(prints, ["conv_id"], F.col("conv_id") % 100 == 0).collect()}
    assert {r.conv_id: r.reason for r in prints.collect() if r.reason} == {100: "null", 200: "no samples"}
    assert set(got) == {0, 100, 200} and got[0].class_size == 2 and got[0].n_links == 2
    assert got[0].best_conv_id in (1, 2) and got[100].n_links == 0 and got[200].n_prints == 0
    # all of the search against all pairs at all offsets
    own = {r.conv_id: np.frombuffer(bytes(r.print), "<u4") for r in prints.collect()}
    links = {q: {tuple(own[c]) for c in own if len(own[c]) and tuple(own[c]) != tuple(own[q]) and _align(own[q], own[c])} for q in (0, 100, 200)}
    copies = Counter(tuple(x) for x in own.values())
    assert {q: got[q].n_links for q in got} == {q: sum(copies[x] for x in links[q]) if len(own[q]) else 0 for q in links}
    # recall of the index against all offsets, on noisy and shifted parts
    base = chroma.fingerprint(samples)
    found = 0
    for k in range(20):
        cut = samples[chroma.HOP * rng.randrange(30) :] + noise.normal(0, 0.05, 1)
        other = chroma.fingerprint(cut + noise.normal(0, 0.03, len(cut)))
        brute = min(chroma.aligned(base, other, o)[0] for o in range(-60, 60) if chroma.aligned(base, other, o)[1] >= 20)
        hit = list(chroma.Block([(1, base.tobytes())]).matches(other))
        found += bool(hit) and abs(hit[0][2] - brute) < 0.05
    assert found >= 18
    assert all(not list(chroma.Block([(1, base.tobytes())]).matches(chroma.fingerprint(x))) for x in others)
