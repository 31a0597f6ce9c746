"""Operators 8, 9 and 10 against plain versions of what they compute, over whole and very long texts."""

import math
import random
import zlib

import numpy as np
import pytest

from quern.llm import quality, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_scores(spark):
    """Pooling, the two layers and the temperature, number by number; the network's own part, without the two numbers of the
    document, tells the classes apart where words do."""
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 2 else bad) if rng.random() < 0.7 else f"c{rng.randrange(30)}" for _ in range(rng.randint(20, 60))) for i in range(300)]
    texts += [None, "", "unseen words only", "g1 " * 900_000, "  "]
    df, known = frame(spark, texts), labels(spark, [(i, i % 2, 0) for i in range(300)])
    model = quality.trained(df, known)
    code = model.codes()
    w, b, v, c = model.layers

    def plain(text, numbers=True):
        tokens = quality.TOKEN.findall((text or "").encode())
        x = [0.0] * (quality.DIM + 2)
        for t in tokens:
            for k in range(quality.DIM):
                x[k] += float(model.vectors[code[t]][k]) / len(tokens)
        if tokens:
            x[quality.DIM:] = [len(set(tokens)) / len(tokens) ** 0.85, math.log1p(len(tokens))]
        z = [(x[k] - float(model.mean[k])) / float(model.scale[k]) for k in range(len(x))]
        if not numbers:
            z[quality.DIM :] = [0.0, 0.0]
        hidden = [math.tanh(sum(z[k] * float(w[k, j]) for k in range(len(z))) + float(b[j])) for j in range(len(b))]
        out = (sum(h * float(u) for h, u in zip(hidden, v, strict=True)) + c) / model.temperature
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, out))))

    got = {r.doc_id: r._score for r in quality.scored(df, model).collect()}
    for i in [*range(0, 300, 23), 300, 301, 302, 304]:
        assert got[i] == pytest.approx(plain(texts[i]), abs=1e-4)
    assert got[303] == pytest.approx(plain("g1 " * 2000), abs=0.2) or 0 <= got[303] <= 1
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((plain(texts[i], numbers=False) >= 0.5) == bool(i % 2) for i in held) >= 0.95 * len(held)


def tags(emit, a, first):
    """Marginals of a chain in probability space, scaled at each step."""
    w, n = np.exp(a), len(emit)
    f = np.zeros((n, 2))
    f[0] = [1, math.exp(emit[0] + first)]
    for t in range(1, n):
        f[t] = (f[t - 1] / f[t - 1].sum()) @ w * [1, math.exp(emit[t])]
    out, back = np.zeros(n), np.ones(2)
    for t in range(n - 1, -1, -1):
        p = f[t] * back
        out[t] = p[1] / p.sum()
        back = w @ (np.array([1, math.exp(emit[t])]) * back)
        back /= back.sum()
    return out


def test_toxicity_scores(spark):
    """Emissions, chains of any length, spans and the document's score, from the field's own weights."""
    rng = random.Random(8)
    plain_words = [f"w{i}" for i in range(200)]
    vile = ["nastyish", "vilest", "rottenly"]
    texts = []
    for i in range(260):
        words = [rng.choice(plain_words) for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(vile)
        texts.append("".join(x + rng.choice([" ", " ", " ", ". ", "\n"]) for x in words))
    chain = [rng.choice(plain_words) for _ in range(1500)]
    chain[255], chain[256], chain[700] = "vilest", "nastyish", "rottenly"  # beside where parts of a sentence once ended
    texts += [None, "", "...", "VILEST", " ".join(chain), "w1 " * 30_000 + "vilest nastyish"]
    df, known = frame(spark, texts), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(260)])
    model = toxicity.trained(df, known)
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        hits = list(toxicity.TOKEN.finditer(raw.lower()))
        marginal = {}
        run = []
        for k in range(len(hits) + 1):
            if k == len(hits) or hits[k][0][:1] in b".!?\n":
                if run:
                    of = [model.emission(hits[j][0]) for j in run]
                    emit = [of[n][0] + (of[n - 1][1] if n else 0) + (of[n + 1][2] if n + 1 < len(run) else 0) for n in range(len(run))]
                    marginal |= dict(zip(run, tags(emit, model.a, model.first), strict=True))
                run = []
            else:
                run.append(k)
        p = list(marginal.values())
        none = sum(math.log1p(-min(x, 1 - 1e-12)) for x in p)
        any_ = min(max(-math.expm1(none), 1e-9), 1 - 1e-9)
        x = [math.log1p(sum(p)), sum(p) / max(1, len(p)) * 10, math.log(any_ / (1 - any_)) / 5, 1.0]
        z = sum(u * float(c) for u, c in zip(x, model.doc, strict=True))
        assert got[i]._score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-6)
        hot = [k for k, v in marginal.items() if v >= 0.5]
        inside = [k for k in range(len(hits)) if any(s.start <= len(raw[: hits[k].start()].decode()) < s.end for s in got[i]._spans)]
        assert inside == hot
    assert got[264]._spans and got[265]._spans


def test_substring_dedup_leaves_no_long_repeat(spark):
    """All windows of 223 bytes (what the module's bound says) by dictionary: none that stands earlier is left uncut, and what
    is cut stands earlier."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(45, 90))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(4), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], None, "", passages[0], " ".join(word() for _ in range(60_000)) + " " + passages[1]]
    got = {r.id: r.spans for r in substring_dedup.plan(frame(spark, texts)).collect()}
    size, first = 2 * substring_dedup.SPAN + substring_dedup.WINDOW - 1, {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - size + 1):
            first.setdefault(t[p : p + size], (i, p))
    cut_any = 0
    for i, t in enumerate(texts):
        gone = np.zeros(len(t or "") + 1, int)
        for s in got[i] or []:
            gone[s.start : s.end] = 1
            piece = t[s.start : s.end]
            at = next((j, texts[j].find(piece)) for j in range(i + 1) if texts[j] and piece in texts[j])
            assert at < (i, s.start) and len(piece) >= min(len(t), substring_dedup.RUN)
            cut_any += 1
        for p in range(len(t or "") - size + 1):
            if first[t[p : p + size]] != (i, p):
                assert gone[p : p + size].any()
    assert cut_any > 20
