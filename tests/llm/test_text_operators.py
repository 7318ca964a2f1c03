"""Near-duplicates, decontamination, language id and toxicity against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from radiolake.llm import decontaminate, langid, simhash, toxicity

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    """Null, empty, long and repeated texts, null ids; extra columns with the operators' names."""
    rng = random.Random(7)
    base = prose(rng, 60)
    texts = [None, "", "   ", base, base, base + " end", "\x1c \x0b x", "one", "One  TWO",
             prose(rng, 40_000), "É ß 漢字 é", prose(rng, 30)]
    rows = [(k, t, "x", "y", 1) for k, t in enumerate(texts)]
    return [*rows, (3, base, "x", "y", 1), (None, base, "x", "y", 1)]


COLUMNS = "doc_id long, text string, fp string, word string, id int"


# --- SimHash -------------------------------------------------------------------------------

def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = ([" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
             if len(words) >= 3 else [" ".join(words)])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_fingerprints_match_brute_force():
    for _, text, *_ in odd_rows():
        if len(text or "") < 5000:
            assert simhash.fingerprint(text or "") % (1 << 64) == brute_fingerprint(text)


def test_near_duplicates_on_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()
    fps = [simhash.fingerprint(t or "") % (1 << 64) for _, t, *_ in rows]
    want = brute_components(fps, [r[0] for r in rows])
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got) == Counter(
        zip([r[0] for r in rows], fps, want, strict=True))


def test_links_find_all_within_radius_and_chains(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds[:10]:
        x = s
        for _ in range(12):  # chains of steps of two bits
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table)).collect()}
    want = brute_components(fps, signed)
    assert [roots.get(f, f) for f in signed] == want
    with pytest.raises(ValueError):
        simhash.links(table, 3)


def test_near_duplicates_of_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0


# --- decontamination -----------------------------------------------------------------------

def brute_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(text, items, window=10):
    words, hit, who = brute_words(text), set(), set()
    for item, body in items:
        w = brute_words(body)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[k:k + n]:
                    hit |= set(range(at, at + n))
                    who.add(item)
    return len(words), sorted(hit), sorted(str(x) for x in who if x is not None)


def bench_rows(rng):
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 9, 10, 11, 25]))))
             for k in range(12)]
    return [*items, (12, None), (13, ""), (14, "!!"), (5, "b b b"), (None, "a a"), (20, "Z9 é")]


@pytest.mark.parametrize("block_words", [1 << 20, 8])
def test_spans_match_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(5)
    items = bench_rows(rng)
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(90, None), (91, ""), (92, items[3][1]), (92, items[3][1]), (93, "x z9, É z9-é"),
             (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*d, 1) for d in docs],
                                  "doc_id long, text string, n_words int")
    got = decontaminate.spans_of(table, bench).collect()
    want = Counter()
    for doc, text in docs:
        n, hit, who = brute_hits(text, items)
        want[doc, n, tuple(hit), tuple(who)] += 1
    assert want == Counter(
        (r["id"], r["n_words"], tuple(k for a, b in zip(r["starts"], r["ends"], strict=True)
                                      for k in range(a, b)), tuple(r["items"])) for r in got)
    digest = decontaminate.spans_of(table, bench).select(
        "items", decontaminate.items_digest().alias("d")).first()
    assert digest["d"] == hashlib.sha256(",".join(digest["items"]).encode()).hexdigest()


def test_decontaminate_cuts_spans_and_keeps_clean_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it, {passage}! After it.", "id"), (2, "clean text", "id"), (3, None, "id"),
            (4, passage, "id")]
    table = spark.createDataFrame(docs, "doc_id long, text string, id string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(table, bench,
                                                               max_coverage=0.8).collect()}
    assert set(got) == {1, 2, 3} and got[1]["id"] == "id"
    assert got[1]["text"] == "Before it, ! After it."
    assert got[2]["text"] == "clean text" and got[3]["text"] is None
    assert decontaminate.decontaminate(table.limit(0), bench).count() == 0
    assert decontaminate.spans_of(table, bench.limit(0)).where(F.size("starts") > 0).count() == 0


# --- language ------------------------------------------------------------------------------

def brute_length(texts, text, order=3):
    """Code length of a text under one language's tree, byte by byte."""
    counts = Counter()
    for t in texts:
        data = langid.START * order + t.encode()
        for k in range(order, len(data)):
            for n in range(order + 1):
                counts[data[k - n:k + 1]] += 1
    kinds, size = Counter(), Counter()
    for g, c in counts.items():
        kinds[g[:-1], len(g)] += 1
        size[g[:-1], len(g)] += c
    data, bits = langid.START * order + text.encode(), 0.0
    for k in range(order, len(data)):
        for n in range(order, -1, -1):
            g = data[k - n:k + 1]
            total, many = size[g[:-1], n + 1], kinds[g[:-1], n + 1]
            if counts[g]:
                bits -= math.log2(counts[g] / (total + many))
                break
            if total:
                bits -= math.log2(many / (total + many))
        else:
            bits += 8
    return bits


LANGS = {"aa": ["the cat sat on the mat", "a hat for the cat"],
         "bb": ["der hund und die katze", "und der hut für die maus"]}


def learned(spark, extra=()):
    rows = [(k, t, lang) for lang, ts in LANGS.items() for k, t in enumerate(ts)]
    rows += [(9, None, "aa"), (9, "", "bb"), (9, "words", None), *extra]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_code_lengths_match_brute_force(spark):
    trees = learned(spark)
    texts = ["the hat", "die maus\n\n", "zß 漢 \x00", "x", "the " * 50]
    got = trees.lengths([t.encode() for t in texts])
    for k, t in enumerate(texts):
        for x, lang in enumerate(trees.languages):
            assert got[k, x] == pytest.approx(brute_length(LANGS[lang], t), abs=1e-3 * len(t) + .01)


def test_long_texts_are_coded_whole(spark, monkeypatch):
    trees = learned(spark)
    text = ("the cat und der hund " * 400).encode()
    whole = trees.lengths([text])
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert np.array_equal(trees.lengths([text, b"", text]), np.stack([whole[0], [0, 0], whole[0]]))


def test_predict_on_odd_rows(spark):
    trees = learned(spark)
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (4, "12 34 !"), (None, "der hund"),
            (5, "漢字")]
    table = spark.createDataFrame([(*r, "bb") for r in rows],
                                  "doc_id long, text string, score string")
    got = Counter((r["id"], r["lang_pred"]) for r in langid.predict(table, trees).collect())
    last = [lang for (i, lang) in got if i == 5]
    assert got - Counter({(5, last[0]): 1}) == Counter({(1, "aa"): 2, (2, "und"): 1, (3, "und"): 1,
                                                        (4, "und"): 1, (None, "bb"): 1})
    assert langid.predict(table.limit(0), trees).count() == 0


# --- toxicity ------------------------------------------------------------------------------

def brute_segments(scores):
    """Maximal scoring segments by their definition: the best one, then left and right of it."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-9):
                    top = (i, j + 1, total)
        return top

    def split(a, b):
        top = best(a, b)
        return [] if top is None else [*split(a, top[0]), top, *split(top[1], b)]
    return split(0, len(scores))


def test_segments_match_definition():
    rng = random.Random(11)
    for _ in range(300):
        scores = [rng.choice([-2.5, -1.25, -0.3, 0.7, 1.6, 3.1]) + rng.random() / 50
                  for _ in range(rng.randrange(14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def test_toxicity_learns_held_out_rows(spark):
    rng = random.Random(1)
    rows = []
    for k in range(900):
        words = prose(rng, 80).split()
        toxic = k % 6 == 0
        if toxic:
            words[20:24] = rng.sample(["badword", "nastyword", "foulword", "vileword"], 4)
        rows.append((k, " ".join(words), int(toxic)))
    learn = spark.createDataFrame(rows[:600], "doc_id long, text string, toxic int")
    odd = [(2000, None, 0), (2001, "", 0), (2002, prose(rng, 30_000), 0), (600, rows[600][1], 1)]
    test = spark.createDataFrame(rows[600:] + odd, "doc_id long, text string, score int")
    model = toxicity.train(learn.unionAll(spark.createDataFrame(
        [(1, None, 1), (2, "x", None), (3, "x", 7)], learn.schema)))
    got = toxicity.score(test, model).collect()
    truth = {k: t for k, _, t in rows[600:] + odd}
    assert len(got) == 304
    wrong = [r["id"] for r in got if (r["score"] >= 0.5) != bool(truth[r["id"]])]
    assert len(wrong) <= 3
    assert all(0 <= r["score"] <= 1 for r in got)
    hit = next(r for r in got if r["id"] == 600)
    top = max(hit["passages"], key=lambda p: p["score"])
    assert top["first"] == 20 and top["end"] >= 24


def test_copies_neither_fill_nor_leave_the_samples(spark):
    """A text that holds most rows counts once, so the models are those of the distinct rows."""
    rng = random.Random(4)
    rows = [(prose(rng, 30) + (" badword vileword" if k % 4 == 0 else ""), int(k % 4 == 0), "xx")
            for k in range(300)]
    columns = "text string, toxic int, lang string"
    once = spark.createDataFrame(rows, columns)
    often = spark.createDataFrame(rows + [rows[0]] * 400 + [rows[1]] * 400, columns)
    for bound in (1000, 200):
        assert toxicity.train(often, max_rows=bound) == toxicity.train(once, max_rows=bound)
        one, two = (langid.train(x, rows_per_language=bound) for x in (once, often))
        assert all((a == b).all() for a, b in zip(one.cost, two.cost, strict=True))


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.train(none)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.score(docs, model).first()["score"] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_smallest_hashes_are_exact(spark):
    from radiolake.llm.common import smallest_hashes
    rows = spark.range(30_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 2).alias("toxic"))
    want = [r["h"] for r in rows.orderBy("h").limit(500).collect()]
    assert sorted(r["h"] for r in smallest_hashes(rows, 500, "few").collect()) == want
    assert smallest_hashes(rows, 40_000, "all").count() == 30_000
    assert smallest_hashes(rows.limit(0), 5, "none").count() == 0
