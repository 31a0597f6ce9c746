"""Suffix dedup, vector codes and ranked lexical search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import bwt_dedup, lexical, vector_codes

DOCS = "doc_id long, text string, key long, digest string, at int, runs int, text_ string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0, 0, "y") for i, t in rows], DOCS).repartition(5)


# ---- suffix dedup


def removed(rows, depth=50):
    """Per row what the contract says, by dictionaries of windows."""
    first = {}
    own = lambda i: float("inf") if i is None else i
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            first[w] = min(first.get(w, float("inf")), own(i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < own(i):
                gone[p : p + depth] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(rng, n, alphabet="abcdeé ñ", size=220):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, size))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(base)[rng.randint(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3 % 101, "".join(parts)))
    return rows


def cut(spark, rows):
    return sorted((tuple(r) for r in bwt_dedup.report(frame(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    """With small batches, shards and groups too, so that groups are split into pieces and merged from many shards."""
    rng = random.Random(11)
    rows = passages(rng, 60)
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "y" * 50), (204, "y" * 51), (205, "z" * 400), (206, "z" * 120), (None, rows[3][1]), (None, rows[3][1]), (rows[5][0], rows[5][1]), (rows[5][0], rows[6][1] + "tail"), (207, rows[7][1] * 3)]
    rows += [(300 + i, "before %d " % rng.randrange(10**9) + "one very common passage that many of these documents hold, " + str(rng.randrange(10**9))) for i in range(40)]
    if small:
        for name, value in (("GROUP", 2), ("BATCH", 2000), ("SHARD", 64), ("PER_PART", 2000), ("BLOCK", 256)):
            monkeypatch.setattr(bwt_dedup, name, value)
    assert cut(spark, rows) == removed(rows)


def test_suffix_dedup_judges_where_occurrences_meet(spark, monkeypatch):
    """What can lose bytes comes out of the one shuffle; occurrences of anchors too common for their bucket are joined."""
    rng = random.Random(12)
    rows = passages(rng, 60) + [(500 + i, "a passage that comes again and again, in every document, without an end %d" % (i % 3)) for i in range(80)]
    docs = frame(spark, rows)
    plain = bwt_dedup.judged(docs).collect()
    assert plain and not [r for r in plain if r.fate == bwt_dedup.OPEN]
    monkeypatch.setattr(bwt_dedup, "WAITING", 3000)
    monkeypatch.setattr(bwt_dedup, "BATCH", 500)
    few = bwt_dedup.judged(docs)
    common = bwt_dedup._of_common(few.filter(few.fate == bwt_dedup.OPEN)).collect()
    told = lambda rs: sorted((r.doc, r.check, r.at, r.size, r.fate) for r in rs)
    assert len(common) > 80 and told([*common, *few.filter(few.fate != bwt_dedup.OPEN).collect()]) == told(plain)
    assert cut(spark, rows) == removed(rows)


def test_suffix_dedup_cuts_large_groups_as_far_as_needed(spark, monkeypatch):
    """Fragments at the edge of a common passage come apart as halves; not all of their windows are written as pairs."""
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(60)) + "a passage that very many of the documents hold, each behind its own words") for i in range(60)]
    rows += [(100 + i, rows[i][1][30:]) for i in range(20)]
    written, sizes = bwt_dedup.written, []

    def noted(df, name):
        out = written(df, name)
        if name == "pieces":
            sizes.append(out.selectExpr("sum(length(data))").first()[0] or 0)
        return out

    monkeypatch.setattr(bwt_dedup, "written", noted)
    monkeypatch.setattr(bwt_dedup, "GROUP", 10)
    assert cut(spark, rows) == removed(rows)
    assert 0 < sum(sizes) and max(sizes) < 60 * 6 * 300


def test_suffix_dedup_of_long_and_no_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    got = {r.doc_id: r for r in bwt_dedup.report(frame(spark, [(1, long[300_000:300_200]), (2, long), (3, "short")])).collect()}
    assert (got[2].n_bytes, got[2].n_removed, got[2].n_spans) == (600_000, 200, 1) and got[1].n_removed == 0
    assert got[2].kept_sha256 == hashlib.sha256((long[:300_000] + long[300_200:]).encode()).hexdigest()
    none = bwt_dedup.report(frame(spark, [(1, "a")]).limit(0))
    assert none.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and none.count() == 0


def test_merged_transforms():
    """Intervals and common prefixes of merged shards against all pairs of windows."""
    rng = random.Random(5)
    core = bytes(rng.choice(b"ab") for _ in range(70))
    frags = [core[a : a + n] for a, n in ((0, 60), (3, 67), (10, 55), (0, 50))] + [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 80))) for _ in range(12)]
    shards = [bwt_dedup.transform(frags[a : a + 3]) for a in range(0, len(frags), 3)]
    place, block, common = bwt_dedup.merged(shards)
    text, begin = b"".join(frags), np.cumsum([0, *map(len, frags)])
    starts = [(int(b) + p) for b, f in zip(begin[:-1], frags, strict=True) for p in range(len(f) - 49)]
    window = {s: text[s : s + 50] for s in starts}
    want = np.zeros(len(text), int)
    for depth in range(bwt_dedup.START, 51):
        heads = Counter(window[s][50 - depth :] for s in starts)
        for s in starts:
            if heads[window[s][50 - depth :]] > 1:
                want[s + 50 - depth] = depth
    assert np.array_equal(common, want) and common.max() == 50
    assert place.tolist() == sorted((s for s in starts if Counter(window.values())[window[s]] > 1), key=lambda s: (window[s], s))
    assert len({(int(b), window[int(s)]) for s, b in zip(place, block, strict=True)}) == len(set(block.tolist())) == len({window[int(s)] for s in place})


def test_fragments_hold_each_window_once():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc de") for _ in range(rng.randint(0, 400))) for _ in range(30)] + [b"", b"x" * 50, b"y" * 300]
    counts, anchor, at, size, digest = bwt_dedup.fragments(texts)
    assert counts.sum() == len(anchor) and size.min() > 0 and size.max() <= bwt_dedup.WIDTH
    by_window, seen, edge = defaultdict(set), 0, np.cumsum([0, *counts])
    for text, a, b in zip(texts, edge[:-1], edge[1:], strict=True):
        assert size[a:b].sum() == max(0, len(text) - 49)
        for k in range(a, b):
            for p in range(at[k], at[k] + size[k]):
                by_window[text[p : p + 50]].add(int(anchor[k]))
                seen += 1
    assert all(len(a) == 1 for a in by_window.values()) and seen == sum(max(0, len(t) - 49) for t in texts)


# ---- vector codes


def coded(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut_ = [[tuple(math.floor(4096 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut_[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut_:
                own[near(c[p], books[p])].append(c[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e], strict=True)) if e in own else b for e, b in enumerate(books[p])]
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], Counter()
    for (i, _, g), c in zip(kept, cut_, strict=True):
        codes = [near(x, b) for x, b in zip(c, books, strict=True)]
        error = sum(far(x, b[e]) for x, b, e in zip(c, books, codes, strict=True))
        by[g] += error
        out.append((i, "".join(f"{e:02x}" for e in codes), error, g))
    return sorted(((i, c, e, by[g], told) for i, c, e, g in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, place int, part string, n long, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, "p", 2, 3) for i, v, g in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("heavy", [1000, 20])
def test_vector_codes(spark, monkeypatch, heavy):
    monkeypatch.setattr(vector_codes, "HEAVY", heavy)
    rng = np.random.default_rng(heavy)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), int(i) % 3) for i in rng.permutation(90)]
    rows += [(100 + i, rows[0][1], None) for i in range(60)]  # a third of the rows is one vector
    rows += [(200, None, 1), (201, [None, *rows[0][1][1:]], 1), (202, [math.nan, *rows[0][1][1:]], 1), (203, [math.inf, *rows[0][1][1:]], 0), (None, rows[4][1], 2), (5, rows[6][1], 1), (5, rows[6][1], 1), (204, [0.0] * 16, None), (205, [20.0] * 16, 0), (206, [-20.0] * 16, 0), (207, [1.0] * 8, 0), (208, [], 0)]
    whole = [r for r in rows if r[1] is None or len(r[1]) == 16]  # other lengths are dropped
    got = sorted((tuple(r) for r in vector_codes.compressed(vectors(spark, rows)).collect()), key=repr)
    assert got == coded(whole)


def test_vector_codes_of_few_and_large(spark):
    few = [(3, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, [-0.25] * 8, None)]
    got = sorted((tuple(r) for r in vector_codes.compressed(vectors(spark, few)).collect()), key=repr)
    assert got == coded(few) and {r[1] for r in got} == {"00" * 8, "01" * 8}
    assert vector_codes.compressed(vectors(spark, few).limit(0)).count() == 0
    wide = [(1, [30000.0] * 8, 1), (2, [-30000.0] * 8, 1), (3, [0.1] * 8, 0)]
    assert sorted((tuple(r) for r in vector_codes.compressed(vectors(spark, wide)).collect()), key=repr) == coded(wide)
    with pytest.raises(Exception, match="64-bit"):
        vector_codes.compressed(vectors(spark, [(1, [1e30] * 8, 1)])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(vectors(spark, [(1, [1.0] * 9, 1)]))
    part = np.array([[1, -2], [40_000, 0], [2**40, 1], [-32768, 32767]])
    assert np.array_equal(vector_codes.unpacked(vector_codes.packed(part), 2), part)


# ---- ranked lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    known = [b for _, b in bags if b]
    n_docs, total = len(known), sum(sum(b.values()) for b in known)
    df = Counter(w for b in known for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 50 + (50 * n * n_docs) // max(1, total)
            score = sum(weight[w] * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in set(terms(text)) if w in bag)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def collection(seed=8):
    rng = random.Random(seed)
    words = ["The", "of", "Größe", "naïve", "x1", "42"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[min(len(words) - 1, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(i, "the same text, the same score w9 w11") for i in range(200, 280)] + [(300, None), (301, ""), (302, "-- ::"), (None, "w9 only"), (5, docs[5][1]), (303, "w9_w11\x00the" * 400)]
    items = [(0, "the Größe of w9"), (1, "w11 W11 w50; w51 w52 THE of"), (2, "unheard of-words x1"), (3, None), (4, "nothing-known!"), (1, "42 naïve"), (None, "w9"), (5, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("changed,k", [({}, 50), ({"RANGE": 300, "ITEMS": 3}, 5), ({"RANGE": 2000, "TERMS": 4}, 1)])
def test_lexical_search(spark, monkeypatch, changed, k):
    """Ties, repeated and null rows; many ranges, blocks of items, lists of all terms; thresholds that cut."""
    for name, value in changed.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = collection()
    own = spark.createDataFrame([(i, t, 1, "a", 0) for i, t in docs], "doc_id long, text string, row long, term string, n int").repartition(4)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item long")
    got = sorted((tuple(r) for r in lexical.report(own, asked, k).collect()), key=repr)
    assert got == ranked(docs, items, k)


def test_lexical_search_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.report(none, asked).count() == 0
    assert lexical.report(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), asked.limit(0)).count() == 0
    one = lexical.report(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), asked).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in one] == [(1, 1, 1)]


def test_thresholds_leave_postings_unread(spark):
    """A few documents hold a rare term: of the common list only what reaches the threshold is fetched, and an index of all
    terms answers as one of the asked terms does."""
    rng = random.Random(1)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))])) for i in range(400)]
    docs += [(1000 + i, "needle common " + f"w{i}") for i in range(20)]
    index = lexical.postings(spark.createDataFrame(docs, "doc_id long, text string"))
    got = [(r["rank"], r.id, r.score) for r in lexical.search(index, [{"needle", "common", "none"}], 10).orderBy("rank").collect()]
    assert got == [(r, i, s) for _, r, i, s in sorted(ranked(docs, [(1, "needle common")], 10), key=lambda x: x[1])]
    terms_, sizes, rows, impacts = lexical._range([t.encode() for _, t in docs], None, 420, 5000)
    lists = lexical.Lists({"ids": list(range(420)), "terms": [t.decode() for t in terms_], "sizes": sizes.tolist(), "rows": rows.tobytes(), "impacts": impacts.tobytes()})
    item = lexical.Item({"common": 1, "needle": 3000})
    (w, a, b), needle = lists.of(item)
    least = lexical.threshold(int(np.sort(lists.sums([needle]))[-10]), item)
    assert lists.above((w, a, b), least) == a and lists.above(needle, least) == needle[2] and b - a == 420
