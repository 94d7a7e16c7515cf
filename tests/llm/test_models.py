import hashlib
import random
import re
from collections import Counter

import numpy as np
from conftest import table

from quernlake.llm import langid, secret_scan, toxicity

STEMS = {"en": ["the", "and", "thing", "with", "other", "house"], "de": ["der", "und", "ich", "nicht", "schön", "straße"], "fr": ["le", "et", "être", "pour", "avec", "garçon"]}


def corpus(spark, edge_texts, n=60):
    rnd = random.Random(9)
    rows = [(k * n + i, " ".join(rnd.choice(stems) for _ in range(rnd.randint(5, 60))), lang, "s", 0) for k, (lang, stems) in enumerate(STEMS.items()) for i in range(n)]
    rows += [(10_000 + i, t, None, None, None) for i, t in enumerate(edge_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_language_id(spark, edge_texts):
    docs = corpus(spark, edge_texts)
    model = langid.train_on(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.lang:
            assert r.lang_pred == r.lang and 0.5 <= r.score <= 1
        elif not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in STEMS
    assert langid.identify(docs.where("false"), model).collect() == []
    nothing = langid.RankOrder(langid.learn_profiles(docs.where("false")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_ngrams_match_a_plain_count():
    texts = ["Ab c!", None, "éa\u0000a", "1"]
    grams = langid.Ngrams(texts)
    keys, counts = langid.runs(grams.keys)
    got = {}
    for key, gram, n in zip(keys, grams.decoded(keys), counts):
        chars = [int(gram >> np.uint64(21 * i)) & ((1 << 21) - 1) for i in (2, 1, 0)]
        got.setdefault(int(key >> grams.width), {})["".join(map(chr, chars))] = int(n)
    # a space before a letter counts with the shorter n-gram: " c" with "c", " c " with "c "
    assert got[0] == {"  a": 1, "  b": 1, "  c": 2, " ab": 1, " b ": 1, " c ": 2, "ab ": 1}
    assert set(got) == {0, 2}


def plain_ngrams(text):
    """Counts of n-grams as Ngrams defines them, by plain counting; a space before a letter counts with the shorter n-gram."""
    squeezed = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(squeezed) - n + 1):
            g = squeezed[i : i + n]
            if g[n // 2] != " " or n == 2 and g[0] != " ":
                counts[g.rjust(3)] += 1
    return counts


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def as_text(profile):
    return ["".join(chr(int(g) >> (21 * i) & ((1 << 21) - 1)) for i in (2, 1, 0)) for g in profile]


def plain_distances(text, profiles, size):
    """Out-of-place distances, ties by n-gram."""
    places = [{g: r for r, g in enumerate(p)} for p in profiles]
    return [sum(abs(p[g] - r) if g in p else size for r, g in enumerate(ranked(plain_ngrams(text), size))) for p in places]


def test_language_is_the_nearest_profile_by_brute_force(spark, edge_texts):
    docs = corpus(spark, edge_texts, n=20)
    for size in (15, 40):
        learned = langid.learn_profiles(docs, size)
        profiles = [as_text(p) for p in learned.values()]
        texts = [*STEMS["en"], "aa bb", "être ou ne pas", "Straße ist schön", "zz", "aaaa aaaa", "and the and the der", "é", "the the the"] * 2
        langs, scores = langid.RankOrder(learned, size).predict(texts)
        for text, lang, score in zip(texts, langs, scores):
            away = plain_distances(text, profiles, size)
            nearest, second = sorted(away)[:2]
            assert lang == list(learned)[away.index(nearest)], text
            assert abs(score - (1 - 0.5 * nearest / second if second else 0.5)) < 1e-9


def test_profiles_rank_all_counts(spark):
    """Counts over all texts, by falling count and then n-gram, rows that are repeated counting each."""
    rows = [(i, t, "x") for i, t in enumerate(["ab ab", "b", "b", None, "abc"])] + [(9, "q", None)]
    profile = langid.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 6)["x"]
    assert as_text(profile) == ranked(sum((plain_ngrams(t) for t in ["ab ab", "b", "b", "abc"]), Counter()), 6)


def test_very_common_ngrams_keep_their_order(monkeypatch):
    """Counts beyond what fits beside the text's number in one key are ranked as they are."""
    model = langid.RankOrder({"x": np.array(langid.Ngrams(["a"]).decoded(np.unique(langid.Ngrams(["a"]).keys)))}, 8)
    expected = model.predict(["abca", "b"])
    runs = langid.runs
    monkeypatch.setattr(langid, "runs", lambda keys: (runs(keys)[0], runs(keys)[1] + (1 << 23)))
    got = model.predict(["abca", "b"])
    assert got[0] == expected[0] and np.allclose(got[1], expected[1])


def test_toxicity_separates_held_out_rows(spark, edge_texts):
    rnd = random.Random(2)
    plain, bad = [f"w{i}" for i in range(300)], ["scumbag", "blockhead", "numskull"]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        if i % 3 == 0:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 3 == 0)))
    rows += [(5000 + i, t, "x") for i, t in enumerate(edge_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    known = spark.createDataFrame([*labels, (1, 0), (None, 1), (7000, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(y, got[i].predicted) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and sum(y == p for y, p in held) > 0.97 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    none = toxicity.train(docs, known.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("false"), none).collect() == []


def test_isotonic_is_the_least_squares_fit():
    rnd = random.Random(3)
    score = np.array([rnd.randrange(12) for _ in range(60)], float)  # with ties
    y = np.array([float(rnd.random() < s / 12) for s in score])
    at, rates = toxicity.isotonic(score, y)
    means = lambda a, b: y[(score >= a) & (score <= b)].mean()
    for s, r in zip(at, rates):
        assert abs(r - max(min(means(a, b) for b in at if b >= s) for a in at if a <= s)) < 1e-9


def test_first_split_has_the_largest_gain():
    rnd = np.random.Generator(np.random.PCG64(5))
    x = np.round(rnd.normal(size=(200, 3)), 1)
    y = ((x[:, 1] > 0.3) ^ (rnd.random(200) < 0.1)).astype(float)
    t = toxicity.Trees(rounds=1, depth=1, bins=8).fit(x, y)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(j, k): value(x[:, j] < c) + value(x[:, j] >= c) for j in range(3) for k, c in enumerate(t.cuts[j]) if 0 < (x[:, j] < c).sum() < 200}
    feature, cut, leaves = t.trees[0]
    best = max(gains.values())
    assert abs(gains[int(feature[0]), int(cut[0])] - best) < 1e-9
    right = x[:, feature[0]] >= t.cuts[int(feature[0])][int(cut[0])]
    for side, leaf in ((~right, leaves[0]), (right, leaves[1])):
        assert abs(leaf + 0.15 * g[side].sum() / (h[side].sum() + 1)) < 1e-9


def test_features_by_plain_counting():
    text = "YOU sc0mbag! you are a scumbag, Scumbag!! 12 tttt"
    lexicon = {b"scumbag": 2.0, b"are": 0.5}
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
    words = re.findall(r"[a-z0-9]+", text.lower())
    hits = [lexicon[w.encode()] for w in words if w.encode() in lexicon]
    at = [i for i, w in enumerate(words) if w.encode() in lexicon]
    you = [i for i, w in enumerate(words) if w == "you"]
    n, size, letters = len(words), len(text), sum(c.isalpha() for c in text)
    assert f["words"] == np.log1p(n) and f["lexicon_count"] == len(hits) and f["lexicon_share"] == len(hits) / n and f["lexicon_distinct"] == 2
    assert f["weight_sum"] == sum(hits) and f["weight_max"] == 2.0 and f["second_person_share"] == 2 / n
    assert abs(f["near_second_person"] - max(w / (1 + min(abs(i - k) for k in you)) for i, w in zip(at, hits))) < 1e-12
    assert f["capitals"] == sum(c.isupper() for c in text) / letters and f["exclamations"] == text.count("!") / size and f["digits"] == 3 / size
    assert f["obfuscated"] == 2 / n and f["repeats"] == 1 / size  # sc0mbag! and Scumbag!!; tttt is one run of three
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_repeated_ids_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "fine words"), (1, "fine words"), (None, "x")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, model).count() == 4


def test_isotonic_is_monotone():
    rnd = np.random.Generator(np.random.PCG64(0))
    s = rnd.normal(size=500)
    at, rates = toxicity.isotonic(s, (s + rnd.normal(size=500) > 0).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(rates) >= 0).all() and 0 <= rates[0] < rates[-1] <= 1


BASE = ((r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, least, g) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= least)


def test_secret_scan(spark, edge_texts):
    rnd = random.Random(4)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    texts = edge_texts + ['é token = "' + hexa(40) + '"', "PASSWORD:abc", "apI_Key='" + "Z9_" * 8, "AKIAAKIA" + "B" * 12 + " AKIA" + "C" * 13, hexa(15) + "z" + hexa(16), "toKen=" + "a" * 20, "ſecret=" + "q" * 20, "secret=" + "=" * 14]
    texts += [f"some words {hexa(40)} here" for _ in range(60)] + ["verylongwordindeedwithoutanydigit " * 3] * 3
    docs = table(spark, texts)
    model = secret_scan.train(secret_scan.labelled_findings(docs))
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs, model).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in got[i] if s.kind != "network"] == brute_spans(t)
    assert secret_scan.scan_secrets(docs.where("false"), model).collect() == []
    blank = secret_scan.train(secret_scan.labelled_findings(docs.where("false")))
    assert all(s.kind != "network" for r in secret_scan.scan_secrets(docs, blank).collect() for s in r.spans)


def test_network_learns_and_keeps_recall():
    rnd = random.Random(1)
    good = ["key " + "".join(rnd.choice("0123456789ABCDEFabcdefXYZ+/") for _ in range(32)) for _ in range(300)]
    other = ["the " + "".join(rnd.choice("aeinrst") for _ in range(32)) for _ in range(300)]
    x = np.stack([secret_scan.window(t, 4, 36) for t in good + other])
    y = np.r_[np.ones(300), np.zeros(300)]
    model = secret_scan.CharCnn().start().fit(x[::2], y[::2], epochs=6).calibrate(x[1::2], y[1::2])
    p = model.probability(x[1::2])
    assert (p[y[1::2] == 1] >= model.threshold).mean() >= secret_scan.RECALL - 0.01
    assert (p[y[1::2] == 0] >= model.threshold).mean() <= 0.05


def test_network_recall_is_kept_even_where_scores_are_low():
    rnd = np.random.Generator(np.random.PCG64(8))
    x, y = rnd.integers(1, secret_scan.N_CLASSES, (600, secret_scan.SEEN)).astype(np.uint8), (np.arange(600) % 2).astype(float)
    model = secret_scan.CharCnn().start().fit(x[:300], y[:300], epochs=1).calibrate(x[300:], y[300:])  # noise: nothing to learn
    assert (model.probability(x[300:][y[300:] == 1]) >= model.threshold).mean() >= secret_scan.RECALL


def test_logits_are_the_network():
    rnd = np.random.Generator(np.random.PCG64(8))
    x = rnd.integers(0, secret_scan.N_CLASSES, (40, secret_scan.SEEN)).astype(np.uint8)
    model = secret_scan.CharCnn().start()
    assert np.allclose(model.logits(x, batch=7), model._forward(x)[-1], atol=1e-4)


def test_windows_cover_whole_candidates():
    assert secret_scan.cuts(3, 60) == [(3, 60)]
    for n in (64, 65, 96, 97, 500):
        seen = {i for s, e in secret_scan.cuts(10, 10 + n) for i in range(s, e)}
        assert seen == set(range(10, 10 + n)) and all(e - s == 64 for s, e in secret_scan.cuts(10, 10 + n))
    x = secret_scan.windows(["é a", "key " + "b" * 20 + " z"], [(1, 4, 24), (0, 2, 3)])
    key = secret_scan.classes("key " + "b" * 20 + " z")
    assert x[0].tolist() == [0] * 20 + key[:4].tolist() + key[4:24].tolist() + [0] * 44 + key[24:].tolist() + [0] * 6
    assert x[1].tolist() == [0] * 22 + secret_scan.classes("é ").tolist() + secret_scan.classes("a").tolist() + [0] * 71


def test_network_finds_kinds_that_it_has_not_seen(spark):
    """Late in a long run, next to a base finding, and of a kind that training left out."""
    rnd = random.Random(6)
    key = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: key(rnd.randint(3, 16), "aeioulnrst")
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{prose(20)} password={key(24, rnd.choice([mixed, hexa]))} {prose(20)}" for _ in range(200)] + [f"{prose(20)} AKIA{key(16, mixed[:26] + hexa[:10])} {prose(20)}" for _ in range(150)] + [f"{prose(20)} {key(32, hexa)} {prose(20)}" for _ in range(150)]
    docs = table(spark, texts)
    told = {kind: rest for kind, *rest in secret_scan.unseen_kinds(secret_scan.labelled_findings(docs))}
    n, recall, precision = told["assign"]  # found by the looks of the values, which training saw as no assignments
    assert n >= 150 and recall >= 0.8 and precision >= 0.8 and told["hex"][0] >= 150 and told["access"][0] == 150, told
    model = secret_scan.train(secret_scan.labelled_findings(docs))
    path, late = "/".join(word() for _ in range(14)), key(40, mixed)
    new = [f"see {path}/{late} now", f"{key(16, mixed)}Z{key(16, hexa)}Z{key(20, mixed)}", prose(30), None, ""]
    got = [[(s.kind, s.start, s.end) for s in r.spans if s.kind == "network"] for r in sorted(secret_scan.scan_secrets(table(spark, new), model).collect(), key=lambda r: r.doc_id)]
    assert got[0] == [("network", 4, 5 + len(path) + 40)] and got[1] == [("network", 0, len(new[1]))] and got[3:] == [[], []]


def test_network_is_trained_on_all_findings(spark, monkeypatch):
    """More of each label than the former sample took; in several shards and slices too, which part the rows and lose none."""
    rnd = random.Random(2)
    key = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    docs = table(spark, [f"{key(16, 'aeinrst')} {key(5, 'aeinrst')} and {key(32, '0123456789abcdef')} is" for _ in range(2_300)])
    findings = secret_scan.labelled_findings(docs)
    assert {r["y"]: r["count"] for r in findings.groupBy("y").count().collect()} == {0: 2_300, 1: 2_300}
    monkeypatch.setattr(secret_scan, "SHARD_ROWS", 1_200)
    monkeypatch.setattr(secret_scan, "SLICE_ROWS", 500)
    rows, whole = [], np.average
    monkeypatch.setattr(secret_scan.np, "average", lambda a, axis, weights: (rows.append(list(weights)), whole(a, axis, weights))[1])
    model = secret_scan.train(findings)
    held = findings.where(secret_scan._hash(1, 5) == 0).count()
    assert len(rows) > 1 and all(len(r) > 1 for r in rows) and sum(map(sum, rows)) == 4_600 - held
    x, y = secret_scan._rows(findings.toArrow())
    found = model.probability(x) >= model.threshold
    assert found[y == 1].mean() >= 0.97 and found[y == 0].mean() <= 0.05
    again = secret_scan.train(findings)
    assert again.threshold == model.threshold and all((again.w[k] == model.w[k]).all() for k in model.w)


def test_calibration_by_counts_is_that_by_rows():
    rnd = np.random.Generator(np.random.PCG64(3))
    z, y = np.round(rnd.normal(0, 2, 500)), (np.arange(500) % 3 == 0).astype(float)
    one, other = secret_scan.CharCnn().calibrate_counts(z, y, np.ones(500)), secret_scan.CharCnn()
    pairs, n = np.unique(np.stack([z, y]), axis=1, return_counts=True)
    other.calibrate_counts(pairs[0], pairs[1], n)
    assert np.allclose([one.slope, one.shift, one.threshold], [other.slope, other.shift, other.threshold])


def test_base_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
