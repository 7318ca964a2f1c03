"""Token store, packing, WARC, wrappers, licences and neighbours against brute force."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import (html_wrappers, licences, neighbours, packing, queries, tokens,
                           tokenstore, warc)
from radiolake.llm.common import new_dir

WORD, BYTE = (queries.tokenizer_file(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "a  b", "The cat sat.\nOn the mat, it's fine", "x\n\ny", "É ß 漢字 é́",
       "a　b c", " a　b", "<|endoftext|> a", "a\x1cb c", "tab\tx", "word " * 3000, "the",
       "the"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_ids_equal_those_of_whole_texts(path):
    rng = random.Random(2)
    signs = list(" \n  ab'stTé,.<|>1٣́日😀 　_\x1c") + [" the", " of", "\n"]
    rows = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randrange(30)))
                                     for _ in range(3000)]
    codec = tokens.WordIds(path)
    whole = [np.array(codec.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
             for t in rows]
    assert codec.encode(rows) == whole


def brute_ids(path, text):
    codec = tokens.encoder(path)
    return [*codec.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- token store ---------------------------------------------------------------------------

def test_store_round_trip(spark):
    rows = [(10 * k % 70 - 5, t, 0) for k, t in enumerate(ODD)] + [(3, "twice", 0)] * 3
    rows += [(None, "no id", 0), (None, "none", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = tokenstore.round_trip(table, WORD).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (d, len(brute_ids(WORD, t)), crc(brute_ids(WORD, t))) for d, t, _ in rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[
        :-1].tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_lookup_and_empty_store(spark):
    rows = [(k, f"text number {k}") for k in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokenstore.write(table, new_dir(spark, "t"), WORD)
    keys = spark.createDataFrame([(k,) for k in (0, 7, 7, 499, 777, -3, None)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in tokenstore.lookup(spark, manifest, keys).collect()}
    assert got == {k: brute_ids(WORD, rows[k][1]) for k in (0, 7, 499)}
    assert tokenstore.round_trip(table.limit(0), WORD).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers(monkeypatch):
    for levels in (40, 2):  # with few levels most keys stand in the table of the rest
        monkeypatch.setattr(tokenstore, "LEVELS", levels)
        index = tokenstore.Index([str(k) for k in range(20_000)], np.ones(20_000, np.int64))
        index = tokenstore.Index.load(index.dump())
        slots = index.hash.slot(tokenstore.key_hashes(index.keys)[0])
        assert sorted(slots.tolist()) == list(range(20_000))
        ok, offset, _ = index.find(["5", "19999", "no", "-1"])
        assert ok.tolist() == [True, True, False, False] and offset[:2].tolist() == [5, 19999]


# --- packing -------------------------------------------------------------------------------

def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([7, 6, 3, 4, 1, 10]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2, 3] and offsets.tolist() == [0, 0, 7, 6, 0, 0]
    assert fill == [10, 10, 1, 10]


@pytest.mark.parametrize("group", [40_000, 50])
def test_packing_in_rounds(spark, group):
    rng = random.Random(4)
    items = [(k, rng.choice([3, 40, 333, 512, 700, 1023]) + rng.randrange(2)) for k in range(1500)]
    out = packing.pack(spark.createDataFrame(items, "key long, length long"), 1024,
                       group=group).toPandas()
    size = dict(items)
    assert sorted(out.key) == sorted(size)
    fills = {}
    for seq, rows in out.groupby("sequence_id"):
        rows = sorted(zip(rows.offset, rows.key, strict=True))
        at = 0
        for offset, key in rows:
            assert offset == at
            at += size[key]
        assert at <= 1024
        fills[seq] = at
    best = packing.best_fit(np.array(sorted(size.values(), reverse=True)), 1024)[2]
    assert len(fills) <= 1.02 * len(best) + 1


def test_pack_documents(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(3, "twice", 1)] * 2 + [(None, "none", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    packed = packing.pack_documents(table, BYTE, with_ids=True)
    got = packed.toPandas()
    want = Counter()
    for doc, text, _ in rows:
        ids = brute_ids(BYTE, text)
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, first, *range(first + 1024, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, p, a, b - a, crc(ids[a:b])] += 1
    assert want == Counter(
        (None if d != d else int(d), p, s, n, c) for d, p, s, n, c in
        zip(got.id, got.piece, got.start, got.length, got.ids_crc32, strict=True))
    filled = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for seq, part in got.groupby("sequence_id"):
        assert len(filled[seq]) == part.length.sum() <= 1024
    assert packing.pack_documents(table.limit(0), BYTE).count() == 0


# --- WARC ----------------------------------------------------------------------------------

@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, least):
    pages = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"),
             (2, "http://a/2", None), (4, "http://a/4", ""), (6, "http://a/\n6", "é" * 70_000),
             (7, "http://a/7", "other"), (7, "http://a/7", "other"), (None, "http://n", "same"),
             (8, "http://b\r\n\r\nx", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]
    table = spark.createDataFrame([(*p, "x") for p in pages],
                                  "page_id long, url string, html string, path string")
    got = warc.round_trip(table.repartition(3), least).collect()
    want = Counter()
    left = Counter()
    for page, _, text in pages:
        payload = (text or "").encode()
        same = [p for p, _, t in pages if (t or "") == (text or "") and p is not None]
        code = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = page == max(same) and not left[page, payload]
        left[page, payload] += 1
        kind = "response" if len(payload) < least or first else "revisit"
        want[page, len(payload), code, kind, max(same) if kind == "revisit" else None] += 1
    assert want == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"],
                            r["record_type"], r["refers_to"]) for r in got)
    assert len({r["record_id"] for r in got}) == len(pages)
    kept = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert {r["refers_to_id"] for r in got if r["record_type"] == "revisit"} <= kept
    assert warc.round_trip(table.limit(0)).count() == 0


# --- main text -----------------------------------------------------------------------------

def page(body, title="T", tail="</body></html>"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style>"
            f"<script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li>"
            f"<li><a href='/b'>B</a></li></ul></nav><!-- x --><div class=\"ad top\">Buy</div>"
            f"<article><h1>{title}</h1>{body}</article><footer>&copy; us</footer>{tail}")


def test_main_text(spark):
    rows = [(1, "http://h.com/1", page("<p>One &amp; two&nbsp;three</p><p>B\n c</p>")),
            (2, "http://h.com/2", page("<p><b>Lone<br>line<p>next", tail="")),
            (3, "http://h.com/3", page("<p>A</p>" * 500)),
            (4, "http://H.com/4", page("")), (5, "http://h.com/5", None), (6, None, ""),
            (7, "no url", "plain text < 3 &lt;b&gt;"), (8, "http://other/", "<p>x<p>y<aside>z"),
            (1, "http://h.com/1", page("<p>One &amp; two&nbsp;three</p><p>B\n c</p>"))]
    table = spark.createDataFrame([(*r, "z") for r in rows],
                                  "page_id long, url string, html string, host string")
    got = html_wrappers.main_text(table).collect()
    want = {1: "T\nOne & two three\nB c", 2: "T\nLone line\nnext", 3: "T" + "\nA" * 500, 4: "T",
            5: "", 6: "", 7: "plain text < 3 <b>", 8: "x\ny"}
    assert Counter((r["id"], r["text"], r["n_chars"]) for r in got) == Counter(
        (k, want[k], len(want[k])) for k, *_ in rows)
    assert html_wrappers.main_text(table.limit(0)).count() == 0


def test_wrapper_is_union_free_and_independent_of_order():
    shapes = [html_wrappers.shape_of(s.split()) for s in
              ("a p # /p /a", "a p # /p p # /p /a", "a h # /h p # /p p # /p /a b # /b")]
    one, two = html_wrappers.infer(shapes), html_wrappers.infer(shapes[::-1])
    assert one == two
    assert '["+", ["p", "#", "/p"]], false' in one and '["h", true]' in one


def test_long_wrappers_align_like_short_ones():
    """No node is left out for being frequent, however long the lists are."""
    page = [x for k in range(90) for x in (f"h{k}", "p", "#", "/p")]
    wrapper = [x for k in range(9000) for x in ("p", "#", "/p", f"h{k % 90}")]
    pairs = html_wrappers.align(wrapper, page)
    both = [(i, j) for i, j in pairs if i is not None and j is not None]
    assert [j for _, j in both] == list(range(len(page)))
    assert both == sorted(both) and all(wrapper[i] == page[j] for i, j in both)
    assert len(pairs) == len(wrapper)


def test_texts_that_agree_are_no_content(spark):
    """Repeated boilerplate goes, names of the body mark nothing apart, layouts can mix."""
    rows = [(k, "http://c.com/", f'<body class="has-sidebar"><div>Welcome to C</div><p>Story {k}</p>'
                                 "<div>All of C</div></body>") for k in range(3)]
    rows += [(10, "http://m.com/a", "<h2>A</h2><p>B</p><div>own text</div>"),
             (11, "http://m.com/b", "<article><h2>X</h2><p>Y</p></article><footer>foot</footer>")]
    got = html_wrappers.main_text(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()
    assert {r["id"]: r["text"] for r in got} == {
        0: "Story 0", 1: "Story 1", 2: "Story 2", 10: "A\nB\nown text", 11: "X\nY"}


def test_long_groups_fold_and_inline_tags_make_no_shape(spark, monkeypatch):
    group = "<div>" + "".join(f"<h{k % 6 + 1}>x</h{k % 6 + 1}><p>y</p>" for k in range(9)) + "</div>"
    pages = [group * n + "<p>a <b>b</b> c</p>" * (n % 2) + "<p>a b c</p>" for n in (2, 3, 4, 5)]
    names = [html_wrappers.skeleton(html_wrappers.tokens(p))[0] for p in pages]
    assert len({html_wrappers.shape_of(n) for n in names}) == 2
    monkeypatch.setattr(html_wrappers, "GROUP", 4)
    many = [(k, "http://h/", "".join(f"<h{k >> b & 1}>t{k}</h{k >> b & 1}><ul></ul>"
                                     for b in range(6))) for k in range(64)]
    table = spark.createDataFrame(many, "page_id long, url string, html string")
    assert [r["n_shapes"] for r in html_wrappers.wrappers(table).collect()] == [
        len({html_wrappers.shape_of(html_wrappers.skeleton(html_wrappers.tokens(h))[0])
             for *_, h in many})]
    got = {r["id"]: r["text"] for r in html_wrappers.main_text(table).collect()}
    assert got == {k: "\n".join([f"t{k}"] * 6) for k in range(64)}


# --- licences ------------------------------------------------------------------------------

def test_licences(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"Some prose\n{notice}\nmore"), (2, "RELEASED UNDER the MIT License!"),
            (3, "He works at the mit in a general way"), (4, None), (5, ""), (6, "\n \n"),
            (7, "All rights reserved."), (8, "Licensed under CC BY-NC 4.0."), (8, notice),
            (9, f"x {notice} y " + "filler words " * 4000),
            (10, "Licensed under the Apache License, Version 2.0.\n" + notice)]
    table = spark.createDataFrame([(*r, "k") for r in rows],
                                  "doc_id long, text string, family string")
    got = licences.scan(table).collect()
    named = Counter((r["id"], tuple((x["paragraph"], x["family"]) for x in r["licences"]
                                    if x["confirmed"])) for r in got)
    gpl = (0, "gpl-3.0")
    assert named == Counter({(1, ((1, "gpl-3.0"),)): 1, (2, ((0, "mit"),)): 1, (3, ()): 1,
                             (4, ()): 1, (5, ()): 1, (6, ()): 1, (7, ((0, "proprietary"),)): 1,
                             (8, ((0, "cc-by-nc-4.0"),)): 1, (8, (gpl,)): 1, (9, (gpl,)): 1,
                             (10, ((0, "apache-2.0"), (1, "gpl-3.0"))): 1})
    assert {r["id"]: r["n_paragraphs"] for r in got}[6] == 0
    assert licences.scan(table.limit(0)).count() == 0


def test_notices_without_usual_words(spark):
    """Every word of a feature counts: these hold none of license, licensed, copyright, ..."""
    rows = [(1, "Available under CC BY-SA 4.0."), (2, "x\nDistributed under the GPLv3."),
            (3, "Dedicated to the public domain under CC0 1.0."), (4, "der hund mit der katze")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: [(x["paragraph"], x["family"]) for x in r["licences"] if x["confirmed"]]
            for r in got} == {1: [(0, "cc-by-sa-4.0")], 2: [(1, "gpl-3.0")], 3: [(0, "cc0-1.0")],
                              4: []}


def test_wrapped_notices(spark):
    """Notices wrapped at 72 columns or in comments are found, once, at their first line."""
    rows, want = [], {}
    for k, (family, text) in enumerate(licences.TEMPLATES):
        lines = textwrap.wrap(text, 72)
        rows.append((2 * k, "Some prose.\n\n" + "\n".join(lines) + "\n\nmore prose"))
        rows.append((2 * k + 1, "/*\n *\n" + "\n".join(f" * {x}" for x in lines) + "\n *\n */"))
        want[2 * k] = want[2 * k + 1] = {family}
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = {r["id"]: [x for x in r["licences"] if x["confirmed"]] for r in got}
    assert {k: {x["family"] for x in v} for k, v in named.items()} == want
    whole = next(k for k, (_, t) in enumerate(licences.TEMPLATES) if "sublicense" in t)
    assert [x["paragraph"] for x in named[2 * whole]] == [2]


def test_every_unknown_paragraph_teaches(spark, monkeypatch):
    kept, keep = {}, licences.keep
    monkeypatch.setattr(licences, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    # 2,300 distinct paragraphs of one core, each twice, and one that is a notice
    rows = [(k, f"software of house w{k // 2}") for k in range(4600)]
    rows += [(-1, "All rights reserved."), (-2, None)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["id"], [x["family"] for x in r["licences"]]) for r in got if r["licences"]] == [
        (-1, ["proprietary"])]
    unknown = kept["licence-examples"].where("family = 'unknown'")
    weight = F.sum("n") if "n" in unknown.columns else F.count("*")
    assert unknown.agg(weight).first()[0] == 2300 + len(licences.DECOYS)


def test_least_probability_is_exact(spark):
    rng = random.Random(3)
    for share, many in ((0.99, 400), (0.5, 7), (0.99, 1)):
        rows = [(rng.choice([rng.random(), 0.7, 0.7 + rng.random() / 1e12]), rng.randrange(1, 40))
                for _ in range(many)]
        every = sorted(p for p, n in rows for _ in range(n))
        want = every[math.ceil(share * len(every)) - 1]
        got = licences._quantile(spark.createDataFrame(rows, "p double, n long"), share, 0.1, 0.95)
        assert got == min(max(want, 0.1), 0.95)
    none = spark.createDataFrame([], "p double, n long")
    assert licences._quantile(none, 0.99, 0.5, 0.95) == 0.5


def runs_by_hand(text):
    """Runs of template words with a word that is no function word, or of five words."""
    runs = [[]]
    for w in re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", text):
        if w in licences.TEMPLATE_WORDS:
            runs[-1].append(w)
        else:
            runs.append([])
    told = set(licences.TEMPLATE_WORDS) - set(licences.FUNCTION_WORDS)
    if not any(told & set(r) for r in runs):
        return ""
    return "|".join(" ".join(r) for r in runs if told & set(r) or len(r) >= 5)


def test_cores_by_hand(spark):
    rng = random.Random(7)
    some = [*licences.TEMPLATE_WORDS, *licences.FUNCTION_WORDS * 3, *"foo x1 é 漢字 ß * | - 2.0. a-b".split()]
    signs = [" ", " ", " ", ".", "-", "..", ", ", "", "é", "\t", "\r", " * ", "|"]
    rows = [(k, "".join(rng.choice(some) + rng.choice(signs) for _ in range(rng.randrange(40))))
            for k in range(2000)]
    table = spark.createDataFrame(rows, "k int, text string")
    got = table.select("k", licences.core(licences.marks(F.col("text"))).alias("core")).collect()
    assert {r["k"]: r["core"] for r in got} == {k: runs_by_hand(t) for k, t in rows}


def test_very_long_words(spark):
    rows = [(1, "a." * 60000 + "b\nReleased under the MIT License."), (2, "a-" * 60000)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: [(x["paragraph"], x["family"]) for x in r["licences"]] for r in got} == {
        1: [(1, "mit")], 2: []}


def test_licence_plan_is_native(spark):
    table = spark.createDataFrame([(1, "Released under the MIT License.")],
                                  "doc_id long, text string")
    table.write.mode("overwrite").parquet(path := new_dir(spark, "docs"))
    plan = licences.scan(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- neighbours ----------------------------------------------------------------------------

def test_neighbours_recall_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(3000 + k, [2.0] * 24) for k in range(60)]  # a group of copies
    odd = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, []),
           (5080, [None] * 24), (5100, [1.0, 2.0]), (None, [1.0] * 24)]
    table = spark.createDataFrame([(*r, 0) for r in rows + odd],
                                  "vec_id long, embedding array<float>, rank int")
    monkeypatch.setattr(neighbours, "BLOCK", 1000)
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).toPandas()
    data = np.array([np.float32(v) for _, v in rows], float)
    hit = total = 0
    for q in range(0, 3060, 20):
        scores = (data * data[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(len(data)), -scores)) if k != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, scores[own.vec_id])
        assert own.score.is_monotonic_decreasing and q not in set(own.vec_id)
        hit, total = hit + len(set(order) & set(own.vec_id)), total + 20
    assert hit / total >= 0.95
    assert not set(got.query_id) & {5020, 5040, 5060, 5080}
    copies = got[got.query_id == 3000].sort_values("rank").vec_id.tolist()
    assert copies == sorted(copies)
    assert neighbours.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_candidates_are_all_returned(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])],
                                  "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [
        (0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]


def test_repeated_ids_crowd_nothing_out(spark, monkeypatch):
    """Many rows of one id beside the query, equal vectors of other ids, an id with two vectors."""
    near, far = [1.0, 0.0, 0.0], [0.5, 0.5, 0.1]
    rng = np.random.default_rng(4)
    rows = [(20, near)] * 3 + [(1, near)] * 30 + [(1, far)] + [(k, near) for k in range(2, 7)]
    rows += [(9, far), (9, [0.9, 0.1, 0.0])] * 12
    rows += [(100 + k, rng.uniform(-1, 1, 3).tolist()) for k in range(1, 39)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(neighbours, "BLOCK", 1000)
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).where("query_id = 20")
    best = {}
    for k, v in rows:
        if k != 20:
            best[k] = max(best.get(k, -9.0), float(np.dot(near, v)))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == want


def test_a_full_memory_starts_anew():
    rng = random.Random(6)
    codec, whole = tokens.WordIds(WORD, memo=50), tokens.WordIds(WORD)
    for _ in range(40):
        rows = [" ".join(rng.choice(["the", "cat", "sat."]) if rng.random() < .5
                         else f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(3)]
        assert codec.encode(rows) == [whole.whole(t) for t in rows]
    assert len(codec.memo) < 200
