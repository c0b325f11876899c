import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, mixing, quality, toxicity

# ---- fingerprints -------------------------------------------------------------------------------


def brute_syncmers(data):
    """(position, hash) of each chosen k-mer, one at a time, in whole numbers."""
    full = (1 << 64) - 1
    mix, odd = int(fingerprint._MIX), [int(x) for x in fingerprint._ODD]
    letter = lambda b: ((b + 1) * mix & full) ^ ((b + 1) * odd[1] & full) >> 29
    if 0 < len(data) < fingerprint.K:
        return [(0, int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))]

    def inner(piece):
        h = 0
        for b in piece:
            h = (h * mix + letter(b)) & full
        h = (h ^ h >> 31) * odd[0] & full
        return h ^ h >> 27

    out = []
    for i in range(len(data) - fingerprint.K + 1):
        span = fingerprint.K - fingerprint.S + 1
        own = [inner(data[i + j : i + j + fingerprint.S]) for j in range(span)]
        if min(own) in (own[0], own[-1]):
            middle = (own[0] * odd[1] + own[fingerprint.S - 1] * odd[2] + own[-1] * mix) & full
            out.append((i, (middle ^ middle >> 32) * odd[0] & full))
    return out


def brute_likeness(a, b):
    """Matches one by one: the n-th anchor of a hash with the n-th of that hash."""
    if not a or not b:
        return float(a == b)
    places = {}
    for p, h in b:
        places.setdefault(h, []).append(p)
    seen, shifts = {}, []
    for p, h in a:
        k = seen[h] = seen.get(h, -1) + 1
        shifts.append(places[h][k] - p if k < len(places.get(h, [])) else None)
    both = sum(s is not None and (min(len(a), len(b)) == 1 or s in shifts[max(0, i - 1) : i] or s in shifts[i + 1 : i + 2]) for i, s in enumerate(shifts))
    return both / (len(a) + len(b) - both)


def brute_sketch(found):
    if not found:
        return ""
    bins = ["-" * 6] * 64
    for _, h in sorted(found, key=lambda x: -x[1]):
        bins[h >> 58] = f"{h >> 34 & 0xFFFFFF:06x}"
    return "".join(bins)


def test_syncmers_by_definition():
    rng = random.Random(5)
    for data in (b"", b"short", "the quick brown fox jumps over the lazy dog, once more and once more".encode(), bytes(rng.randrange(256) for _ in range(500)), b"again and " * 30):
        at, hashes = fingerprint.syncmers(data)
        assert list(zip(at.tolist(), hashes.tolist())) == brute_syncmers(data)
    at, hashes = fingerprint.syncmers(data)
    shifted, again = fingerprint.syncmers(b"xx" + data)
    known = dict(zip(at.tolist(), hashes.tolist()))
    assert all(h == known[i - 2] for i, h in zip(shifted.tolist(), again.tolist()) if i >= 2)  # the choice depends on the k-mer alone


@pytest.mark.parametrize("cuts", [[], [5], [1, 4], list(range(0, 300, 7)), list(range(50))])
def test_parts_by_bisection(spark, cuts):
    part, is_cut = fingerprint._part(F.col("id"), cuts)
    for r in spark.range(-3, 310).select("id", part.alias("p"), is_cut.alias("c")).collect():
        assert (r["p"], r["c"]) == (sum(c <= r["id"] for c in cuts), r["id"] in cuts)


@pytest.mark.parametrize("stretch", [4000, 7])
def test_next_document(spark, monkeypatch, stretch):
    monkeypatch.setattr(fingerprint, "ROWS_A_PART", stretch)
    rng = random.Random(4)
    rows = [(i * 3, None if i == 5 else "" if i % 11 == 0 else "é" * (i % 4) + "".join(rng.choice("abcdef ") for _ in range(rng.randrange(400)))) for i in range(99)]
    rows.append((400, "a line that comes again. " * 3000))
    rows[40] = (120, rows[39][1])
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(df, "doc_id", "text").collect()}
    assert len(got) == 100
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % 100][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = (brute_syncmers(x.encode()) for x in (t, edited, following))
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(own, changed)) and got[i]["near_next"] == pytest.approx(brute_likeness(own, after))
        assert got[i]["fingerprint"] == brute_sketch(own) and got[i]["edited_fingerprint"] == brute_sketch(changed)
    assert got[117]["near_next"] == 1.0


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(1, "same text here, long enough"), (2, "same text here, long enough"), (2, None), (None, "short")], "doc_id long, text string")
    rows = fingerprint.edited_pairs(df, "doc_id", "text").collect()
    assert len(rows) == 4 and len({r["fingerprint"] for r in rows if r["n_chars"] == 27}) == 1
    assert fingerprint.edited_pairs(df.limit(0), "doc_id", "text").count() == 0
    one = fingerprint.edited_pairs(df.limit(1), "doc_id", "text").first()
    assert one["near_next"] == 1.0
    assert fingerprint.anchors(df, "doc_id", "text").where("doc_id = 1").count() > 1


# ---- mixing -------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1], [3, 1], [5, 7, 11, 2], [1, 1, 1, 97], [333, 333, 334]])
def test_cycle_deviates_by_less_than_one_block(weights):
    slots, total = mixing.schedule(weights, weights), sum(weights)
    order = sorted((int(s), i) for i, own in enumerate(slots) for s in own)
    assert [s for s, _ in order] == list(range(total))
    done = [0] * len(weights)
    for slot, i in order:
        done[i] += 1
        assert all(abs(d * total - w * (slot + 1)) < total for d, w in zip(done, weights))
    assert done == weights


def fluid_share(weights, blocks, slots):
    """Blocks that each source has had at each slot (an array) of the fluid schedule, from its definition."""
    ends = sorted((Fraction(n) / w, n, w, i) for i, (w, n) in enumerate(zip(weights, blocks)) if n)
    at, v, rate = Fraction(0), Fraction(0), sum(w for _, _, w, _ in ends)
    knots, times = [0.0], [0.0]
    for end, _, w, _ in ends:
        at, v, rate = at + (end - v) * rate, end, rate - w
        knots.append(float(at))
        times.append(float(v))
    virtual = np.interp(slots, knots, times)
    return [np.minimum(float(w) * virtual, n) for w, n in zip(weights, blocks)]


@pytest.mark.parametrize("weights,total", [([Fraction(10), Fraction(7123, 1000), Fraction(30005, 10000), Fraction(100049, 100000)], 1_000_000), ([Fraction(k**0.5) for k in range(1, 120)], 60_000)])
def test_exact_weights_deviate_by_less_than_one_block(weights, total):
    rng = random.Random(len(weights))
    blocks = [rng.randrange(total // len(weights) // 2, total // len(weights) * 3 // 2) for _ in weights]
    slots = mixing.schedule(mixing.whole_numbers(weights), blocks)
    assert np.array_equal(np.sort(np.concatenate(slots)), np.arange(sum(blocks)))
    for i in range(len(weights)):
        before = fluid_share(weights, blocks, slots[i])[i]
        after = fluid_share(weights, blocks, slots[i] + 1)[i]
        j = np.arange(blocks[i])
        assert (before < j + 1 + 1e-6).all() and (after > j - 1e-6).all()


def brute_schedule(weights, blocks):
    """Slots of each source, slot by slot, with all blocks compared."""
    windows = {}
    for i, (w, n) in enumerate(zip(weights, blocks)):
        at = [sum(min(Fraction(m), x * Fraction(j) / w) for x, m in zip(weights, blocks)) for j in range(n + 1)]
        windows |= {(i, j): (at[j].__floor__(), at[j + 1].__ceil__()) for j in range(n)}
    out = [[] for _ in weights]
    for slot in range(sum(blocks)):
        due, i, j = min((windows[i, len(own)][1], i, len(own)) for i, own in enumerate(out) if len(own) < blocks[i] and windows[i, len(own)][0] <= slot)
        assert due > slot
        out[i].append(slot)
    return out


def test_schedule_equals_brute_force():
    rng = random.Random(14)
    for _ in range(30):
        weights = [Fraction(rng.randrange(1, 50), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))]
        blocks = [rng.randrange(0, 25) for _ in weights]
        assert [own.tolist() for own in mixing.schedule(mixing.whole_numbers(weights), blocks)] == brute_schedule(weights, blocks)


def test_many_sources_are_planned_quickly():
    import time

    began = time.perf_counter()
    got = mixing.plan({f"s{i}": 1 + i % 97 for i in range(10_000)}, {f"s{i}": (i % 97 + 1) ** 0.5 for i in range(10_000)})
    assert sum(map(len, got.slots)) >= 10_000 and time.perf_counter() - began < 60


def test_mix_is_a_permutation_by_the_schedule(spark):
    rows = [(i, s) for s, n in (("a", 3000), ("b", 700), (None, 130), ("c", 5)) for i in range(n)]
    rows = [(k, s) for k, (_, s) in enumerate(rows)] + [(0, "a")]
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, block int")
    weights = {"a": 3.0, "b": 2.0, None: 1.0, "c": 1.0}
    got = mixing.mix(df, weights=weights, block=16).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    by = sorted(got, key=lambda r: r["position"])
    ends = [i for i, r in enumerate(by[:900]) if i % 16 == 0]
    for end in ends[1:20]:  # before the first source runs out
        share = sum(r["source"] == "a" for r in by[:end])
        if any(r["source"] == "c" for r in by[:end]):
            break
        assert abs(share - end * 3 / 7) <= 2 * 16
    last = {s: max(r["position"] for r in by if r["source"] == s) for s in ("a", "b", None, "c")}
    assert last["c"] < last[None] < last["b"] < last["a"]
    assert mixing.mix(df.limit(0)).count() == 0
    ordered = mixing.in_order(mixing.mix(df, block=16)).collect()
    assert [r["position"] for r in ordered] == list(range(len(rows)))


# ---- toxicity -----------------------------------------------------------------------------------


def distance(a, b):
    """Edits between two words; neighbouring letters that change places are one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = random.Random(8)
    terms = ["idiot", "moron", "stupid", "scum", "worthless"]
    lexicon = toxicity.Lexicon({(t, True): 3.0 for t in terms} | {("lowei", False): 3.0}, frozenset(t for t in terms if len(t) >= 5))
    a = toxicity.Automaton(lexicon)
    for _ in range(4000):
        word = list(rng.choice([*terms, "loweis"]))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word) + 1)
            if rng.random() < 0.3:
                word[k : k + 2] = word[k : k + 2][::-1]
            else:
                word[k : k + rng.randrange(2)] = rng.choice(["", "x", "o", "i"])
        word = "".join(word)
        got = a.find(word)
        exact = word in terms
        near = [t for t in terms if len(t) >= 5 and distance(word, t) <= 1]
        stem = word.startswith("lowei")
        assert (got is not None) == bool(exact or near or stem), word
        if exact:
            assert got == ((word, True), 0)


def test_short_words_by_changed_places_only():
    a = toxicity.Automaton(toxicity.Lexicon({("scum", True): 3.0, ("idiot", True): 3.0}, frozenset({"scum", "idiot"})))
    assert [a.find(w) for w in ("scum", "scmu", "csum", "scam", "sum", "idoit")] == [(("scum", True), 0), (("scum", True), 1), (("scum", True), 1), None, None, (("idiot", True), 1)]


def brute_score(model, text):
    """Score of a text with every word compared with every term."""
    terms, far = list(model.lexicon.weights), {}

    def near_of(w):
        if w not in far:
            far[w] = [t for t in terms if t[1] and t[0] in model.lexicon.fuzzy and abs(len(w) - len(t[0])) < 2 and distance(w, t[0]) == 1 and (len(t[0]) >= 5 or len(t[0]) == len(w) and sorted(t[0]) == sorted(w))]
        return far[w]

    words = re.findall(rf"[\w]+|[{toxicity.QUOTES}]", (text or "").lower())
    best, total = {}, 0.0
    for i, w in enumerate(words):
        if w in toxicity.QUOTES:
            continue
        stems = [t for t in terms if not t[1] and w.startswith(t[0])]
        term = (w, True) if (w, True) in model.lexicon.weights else max(stems, key=lambda t: len(t[0]), default=None) or min(near_of(w), default=None)
        if term is None:
            continue
        weight = model.lexicon.weights[term]
        if term[1] and term[0] != w:
            weight = model.lexicon.forms.get(w, 0.5 * weight)
        around = words[max(0, i - 6) : i], words[i + 1 : i + 7]
        weight *= 0.35 if all(any(x in toxicity.QUOTES for x in side) for side in around) else 1.0
        weight *= 0.6 if set(around[0]) & toxicity.REPORTING else 1.0
        weight *= 1.25 if set(around[0] + around[1]) & toxicity.ADDRESS else 1.0
        best[term] = max(best.get(term, 0.0), weight)
        total += weight
    x = [12 * math.tanh(sum(best.values()) / 12), math.log1p(total), min(3.0, math.sqrt(100 * total / max(20, len(words)))), max(best.values(), default=0.0)]
    return 1 / (1 + math.exp(-(model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], x)))))


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    lexicon = toxicity.Lexicon({("idiot", True): 4.0, ("moron", True): 3.0, ("scum", True): 2.5, ("zorb", False): 3.5, ("zorbels", False): 1.0}, frozenset({"idiot", "moron", "scum"}), {"idiat": 0.1})
    model = toxicity.Model(lexicon, [-3.0, 0.4, 0.5, 0.3, 0.2])
    bag = 'you said "word" the idiot idoit idiat idiots moron mroon scum scmu scam zorbling zorbelsy stone tree house he it and '.split() + ['"', "„"]
    texts = [None, "", *(" ".join(rng.choice(bag) for _ in range(rng.randrange(60))) for _ in range(150)), "tree and " * 100_000 + "idiot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == pytest.approx(brute_score(model, t), rel=1e-9)
    assert got[len(texts) - 1] == pytest.approx(model.score(toxicity.features(lexicon, [("idiot", ("idiot", True), 0, 1.0)], 200_001)))


def test_terms_of_any_length(spark):
    """Words of one or of forty letters may be terms; lengths of stems are a parameter."""
    long = "zq" * 20
    docs = [(i, f"number{i} {'ß' if i % 4 else long} plain words here {'ohneendingsxy' if i % 2 else 'ohneendingsab'}" if i % 3 == 0 else f"plain words here and there {i}") for i in range(300)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    found = toxicity.fit(df, labels).lexicon.weights
    assert ("ß", True) in found and (long, True) in found and not any(len(t) > 8 and not whole for t, whole in found)
    assert ("ohneendings", False) in toxicity.fit(df, labels, stems=range(11, 12)).lexicon.weights


def test_terms_have_no_cap(spark):
    """More learned terms than any round number: each marks its own toxic texts."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("bcdfghklmnprstvz") for _ in range(n))
    terms = [letters(7) for _ in range(600)]
    docs = [(i, " ".join(rng.sample(terms, 40)) if i % 6 == 0 else " ".join(letters(7) for _ in range(40))) for i in range(900)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    assert sum((t, True) in model.lexicon.weights or any((t[:k], False) in model.lexicon.weights for k in toxicity.STEMS) for t in terms) > 500


def test_context_weighs_hits():
    lexicon = toxicity.Lexicon({("idiot", True): 4.0})
    a = toxicity.Automaton(lexicon)
    score = toxicity.Model(lexicon, toxicity.UNFITTED).score
    abuse, plain, quoted = (score(toxicity.features(lexicon, *a.hits(t))) for t in ("you are an idiot", "some idiot there", 'he said "the word idiot here" again'))
    assert abuse > plain > quoted and abuse > 0.7 > quoted


def test_learns_from_labels_only(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [word() for _ in range(40)] + ([f"zorb{word()}" for _ in range(3)] + ["blarg"] if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "blagr blarg zorbxy"), (1002, "blagr blarg zorbxy")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[1000] == got[1001] < 0.5 < got[1002]
    kept = toxicity.reject(d.withColumn("score", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id = 1002").count() == 0 and kept.where("doc_id >= 1000").count() == 2
    bare = toxicity.fit(d, y.limit(0))
    assert bare.coefficients == toxicity.UNFITTED and toxicity.score(d.limit(0), bare).count() == 0


def test_toxicity_does_not_depend_on_the_cap(spark, monkeypatch):
    kinds = [("idiot", 1)] * 60 + [("stone", 1)] * 40 + [("idiot", 0)] * 90 + [("stone", 0)] * 810
    docs = spark.createDataFrame([(i, f"n{i} some {w} there") for i, (w, _) in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(kinds)], "doc_id long, toxic int")

    def likely():
        model = toxicity.fit(docs, labels)
        return model.score(toxicity.features(model.lexicon, *toxicity.Automaton(model.lexicon).hits("n some idiot there")))

    whole = likely()
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    assert whole == pytest.approx(60 / 150, abs=0.05) and likely() == pytest.approx(whole, abs=0.15)


# ---- quality ------------------------------------------------------------------------------------


def test_small_sites_shrink(spark):
    good, bad = "Plain words in a sentence, one after another, that say this and that. " * 3, "$$$ *** ### %%% BUY!!! NOW!!! $$$ " * 9
    rows = [(i, good, "good", "a") for i in range(60)] + [(100 + i, bad, "bad", "a") for i in range(60)] + [(200, good, "tiny", "a"), (201, None, None, None), (202, "", "tiny", "b"), (200, good, "tiny", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, posterior string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model, F.col("source"), F.lit("p")).collect()}
    assert got[50]["posterior"] > 0.9 > 0.1 > got[150]["posterior"]
    assert got[150]["site_rate"] < 0.2 < got[200]["site_rate"] < got[50]["site_rate"] + 1e-9
    kept = quality.keep_good(docs, model, F.col("source"), F.lit("p"))
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 60 and kept.where("doc_id between 100 and 160").count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels), F.col("source"), F.lit("p")).count() == 0


def brute_quality(rows, model):
    """Posteriors from the definition, group by group; rows: (text, host, path)."""
    z = [model.logit(quality.shape(t)) for t, _, _ in rows]
    soft = [1 / (1 + math.exp(-x)) for x in z]

    def strength(keys):
        groups = {}
        for k, s in zip(keys, soft):
            n, good = groups.get(k, (0, 0.0))
            groups[k] = n + 1, good + s
        total, good = sum(n for n, _ in groups.values()), sum(g for _, g in groups.values())
        mean = min(0.999, max(0.001, good / total))
        between = sum(n * (g / n - mean) ** 2 for n, g in groups.values()) - total * (good / total - mean) ** 2 * (good / total != mean)
        scale = total - sum(n * n for n, _ in groups.values()) / total
        variance = max(0.0, (between - mean * (1 - mean) * (len(groups) - 1)) / scale) if scale else 0.0
        return mean, min(1e4, max(2.0, mean * (1 - mean) / variance - 1)) if variance > 1e-9 else 1e4

    rate, outer = strength([h for _, h, _ in rows])
    _, inner = strength([(h, p) for _, h, p in rows])
    out = []
    for i, (_, h, p) in enumerate(rows):
        at_host = [s for k, s in enumerate(soft) if k != i and rows[k][1] == h]
        at_path = [s for k, s in enumerate(soft) if k != i and rows[k][1:] == (h, p)]
        host = (sum(at_host) + outer * rate) / (len(at_host) + outer)
        site = (sum(at_path) + inner * host) / (len(at_path) + inner)
        out.append((z[i], site, 1 / (1 + math.exp(-(z[i] + math.log(site / (1 - site)) - math.log(rate / (1 - rate)))))))
    return out


@pytest.mark.parametrize("groups", [200_000, 0])
def test_quality_equals_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(quality, "GROUPS_BROADCAST", groups)
    rng = random.Random(6)
    good, bad = "Plain words in a sentence, one after another, that say this. ", "$$$ *** BUY!!! NOW!!! $$$ "
    texts = [None, "", *((good * rng.randrange(1, 6) + bad * rng.randrange(0, 4) * (rng.random() < 0.4)) for _ in range(150)), good * 20_000]
    rows = [(t, rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"])) for t in texts]
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, source string, part string, posterior int")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else int("$" not in (r[0] or ""))) for i, r in enumerate(rows[:100])], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model, F.col("source"), F.col("part")).collect()}
    for i, want in enumerate(brute_quality(rows, model)):
        assert [got[i]["evidence"], got[i]["site_rate"], got[i]["posterior"]] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_quality_does_not_depend_on_the_cap(spark, monkeypatch):
    plain, marked = "Plain words in a sentence, one after another, that say this and that. " * 3, "$$$ *** ### %%% BUY!!! NOW!!! $$$ " * 9
    kinds = [(plain, 1)] * 800 + [(marked, 1)] * 100 + [(plain, 0)] * 50 + [(marked, 0)] * 50
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(kinds)], "doc_id long, quality int")
    likely = lambda model: [1 / (1 + math.exp(-model.logit(quality.shape(t)))) for t in (plain, marked)]
    whole = likely(quality.fit(docs, labels))
    monkeypatch.setattr(quality, "SAMPLE", 100)
    capped = likely(quality.fit(docs, labels))
    assert whole == pytest.approx([800 / 850, 100 / 150], abs=0.02) and capped == pytest.approx(whole, abs=0.08)


# ---- chat ---------------------------------------------------------------------------------------


def test_levels():
    text = "Hi.\nOn Monday, Ann wrote:\n> I think so, maybe.\n>> Earlier words here.\n> > And these.\n\nBye"
    assert chat.levels(text) == [(0, "Hi."), (1, "I think so, maybe."), (2, "Earlier words here.\nAnd these."), (0, "Bye")]
    assert chat.levels("") == [] and chat.levels(">") == []


def test_conversations(spark):
    rows = [
        (1, 0, "user", "What is the capital of France?"), (1, 1, "assistant", "The capital of France is Paris."), (1, 2, "user", "And how large is it, then?"),
        (1, 3, "assistant", "> What is the capital of France?\nAs said before: Paris."), (1, 4, "user", "Thanks for that answer."), (1, 5, "user", "> And how large is it, then?\n>> The capital of France is Paris.\nStill open."),
        (2, 0, "user", "> the CAPITAL of France is, Paris\nIs that so?"), (3, 0, "user", "> no such passage anywhere at all\nOdd."), (4, None, None, None), (1, 4, "user", "Thanks for that answer."), (None, 0, "user", "> What is the capital of France?"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, branch int")
    got = chat.conversations(df).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert one[3]["reply_to"] == 0 and one[3]["text"] == "As said before: Paris." and one[3]["branch"] == 3
    assert one[5]["reply_to"] == 2 and one[5]["text"] == "Still open." and one[5]["linked_level"] == 1
    assert one[1]["reply_to"] == 0 and one[0]["reply_to"] is None and one[4]["reply_to"] == 3
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["place"])]
    assert order == [0, 3, 4, 4, 1, 2, 5]
    two = next(r for r in got if r["conv_id"] == 2)
    assert (two["reply_to_conv"], two["reply_to"]) == (1, 1) and two["text"] == "Is that so?"
    assert next(r for r in got if r["conv_id"] == 3)["reply_to"] is None
    assert not any(">" in (r["text"] or "") for r in got)
    assert chat.conversations(df.limit(0)).count() == 0


def test_recurring_passage_answers_the_latest_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)
    line = "the very same passage again"
    rows = [(1, i, "user", line if i % 3 == 0 else f"> {line}\n{line}" if i % 3 == 1 else f"> {line}\nreply {i}") for i in range(15)]
    got = {r["turn"]: r["reply_to"] for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    holders = [i for i in range(15) if i % 3 != 2]
    for i in range(1, 15):
        assert got[i] == (i - 1 if i % 3 == 0 else max(h for h in holders if h < i))


def test_long_conversation_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 3)
    rows = [(1, i, "user", f"message number {i} with words" if i != 8 else "> message number 2 with words\nback to that") for i in range(12)]
    got = {r["turn"]: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i]["reply_to"] for i in range(12)] == [None, 0, 1, 2, 3, 4, 5, 6, 2, 8, 9, 10]
    assert got[11]["branch"] == 8 and got[7]["branch"] is None
    assert [got[i]["place"] for i in range(12)] == [0, 1, 2, 7, 8, 9, 10, 11, 3, 4, 5, 6]


def brute_conversations(rows):
    """(conv, turn) -> (reply_to_conv, reply_to, place), one message at a time."""
    texts = {}
    for conv, turn, text in rows:
        found = chat.levels(text or "")
        held, quotes = texts.setdefault((conv, turn), (set(), []))
        held.update(n for level, x in found if level == 0 for part in (x, *re.split(r"\n\s*\n", x), *x.split("\n")) if (n := chat.normal(part)))
        quotes += [(level, n) for level, x in found if level for part in (x, *re.split(r"\n\s*\n", x), *x.split("\n")) if (n := chat.normal(part))]
    out, after = {}, {}
    turns = {}
    for conv, turn in texts:
        turns.setdefault(conv, []).append(turn)
    for conv, own in turns.items():
        own.sort()
        line = None  # the message before, and the branch it is in
        for k, turn in enumerate(own):
            options = []
            for level, n in texts[conv, turn][1]:
                near = [t for t in own if t < turn and n in texts[conv, t][0]]
                if near:
                    options.append((False, level, -max(near), conv))
                elif len(n) >= chat.LEAST_CHARS:
                    others = sorted((c, t) for (c, t), (held, _) in texts.items() if c != conv and n in held)
                    # Conversations are compared as text.
                    options += [(True, level, -t, c) for c, t in sorted(others, key=lambda x: (str(x[0]), x[1]))[:1]]
            best = min(options) if options else None
            line = own[k - 1] if k else None
            to = (best[3], -best[2]) if best else (conv, line) if k else (None, None)
            opens = best is not None and not best[0] and -best[2] < (line if k else -(10**30))
            out[conv, turn] = to
            after.setdefault((conv, -best[2]) if opens else None, []).append((conv, turn)) if opens else None
        opened = {t for key, found in after.items() if key and key[0] == conv for _, t in found}
        order = []

        def walk(at):  # a segment from its first message to the next opener
            while True:
                order.append(own[at])
                for _, b in sorted(after.get((conv, own[at]), [])):
                    walk(own.index(b))
                at += 1
                if at == len(own) or own[at] in opened:
                    return

        walk(0)
        for place, t in enumerate(order):
            out[conv, t] = (*out[conv, t], place)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_conversations_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(chat, "TURNS", 5)
    rng = random.Random(seed)
    rows = []
    for conv in range(1, 9):
        scale = rng.choice([1, 1, 10**12 + 7])
        said = []
        for k in range(rng.choice([1, 5, 30])):
            own = rng.choice(["yes", "agreed then", f"a passage of its own, number {rng.randrange(40)}", f"message {conv} {k} with words"])
            quote = "\n".join("> " + x for x in (rng.choice(said) if said and rng.random() < 0.6 else f"a passage of its own, number {rng.randrange(40)}").split("\n")) if rng.random() < 0.6 else None
            rows.append((conv, (k - 3) * scale, f"{quote}\n{own}" if quote else own))
            said.append(own)
    want = brute_conversations(rows)
    got = chat.conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_to_conv"], r["reply_to"], r["place"]) for r in got} == want


def test_short_quotes_and_long_numbers(spark):
    base = 1_700_000_000_000
    rows = [(1, base, "Shall we go?"), (1, base + 1, "Yes, agreed"), (1, base + 2, "Where to?"), (1, base + 3, "> Yes, agreed\nGood."), (2, 5, "> Yes, agreed\nWhat?"), (2, 6, "a passage that only others hold, too"), (3, 7, "> a passage that only others hold, too\nno"), (2, -4, "> a passage that only others hold, too\nhm"), (3, 9, "a passage that only others hold, too")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, base + k]["place"] for k in range(4)] == [0, 1, 3, 2] and got[1, base + 3]["reply_to"] == base + 1
    assert got[2, 5]["reply_to"] == -4 and got[2, 5]["reply_to_conv"] == 2  # short: not looked up elsewhere
    assert (got[2, -4]["reply_to_conv"], got[2, -4]["reply_to"]) == (3, 9)  # the only holder before is itself, later


def test_deep_answers_in_few_rounds(spark):
    """Each message answers the second last: 80 branches, each within the one before it."""
    n = 80
    rows = [(1, i, "user", f"message number {i}" if i < 2 else f"> message number {i - 2}\nmessage number {i}") for i in range(n)]
    got = {r["turn"]: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {(1, i): (1 if i else None, i - 2 if i > 1 else 0 if i else None, got[i]["place"]) for i in range(n)} == brute_conversations([(c, t, x) for c, t, _, x in rows])
