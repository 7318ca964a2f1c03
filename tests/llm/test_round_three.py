"""Line dedup, Merkle manifest and periodic runs against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import linededup, merkle, periodic

BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- line dedup ----------------------------------------------------------------------------

def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_lines(rows, min_chars, min_docs):
    held = defaultdict(list)
    for doc, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                held[key].append(doc)
    last = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in held.items()
            if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    pool = [f"line number {k} of the pool, a little longer than it has to be" for k in range(30)]
    pool += ["ÄÖ" * 20, "ÄÖ" * 19 + "Ä", "a\x0bb" * 14, "İ" * 40, "x" * 40, "x" * 39]
    rows = [(k, "\n".join(rng.choice([p, p.upper(), f" \t{p}\x0c", p[:30], ""])
                          for p in rng.choices(pool, k=rng.randrange(9)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\r" + pool[0] + "\r"),
             (204, "\n".join(pool * 400)), (None, pool[1]), (None, pool[2]), (3, pool[3]),
             (3, pool[3]), (900, "\n".join(pool))]
    rows += [(900, "\n".join(pool[:3]))] * 2
    return rows


@pytest.mark.parametrize("n_parts", [1, 7])
def test_repeated_lines(spark, n_parts):
    rows = line_rows()
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in rows],
                                  "doc_id long, text string, id int, keys string")
    got = linededup.drop_repeated(table.repartition(n_parts)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows, 40, 5), key=str)


def test_partial_filters_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FAN_IN", 2)
    rows = line_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = linededup.drop_repeated(table, min_chars=20, min_docs=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows, 20, 2), key=str)


def test_full_filter_loses_no_line(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LOG_MOST", 13)
    monkeypatch.setattr(linededup, "HOT", 3)  # some keys go by broadcast, others by the join
    rows = line_rows() + [(1000 + k, "\n".join(f"{k} {j} " + "alone " * 9 for j in range(90)))
                          for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linededup.drop_repeated(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows, 40, 5), key=str)


def test_filter_misses_no_hash_and_few_others_pass():
    rng = np.random.default_rng(1)
    seen, other = rng.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    bits = linededup.Bits(linededup.log_bits(len(seen)))
    bits.add(seen)
    assert bits.has(seen).all() and bits.has(other).mean() < 0.05


def test_no_lines(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.drop_repeated(table).count() == 0


# --- Merkle manifest -----------------------------------------------------------------------

COLUMNS = ["doc_id", "source", "n", "text"]


def brute_tree(digests):
    """All levels of nodes."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows, change):
    def leaf(row):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        return sha("".join(parts))
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row, leaf(row), leaf(change(row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1], x[2]))
        trees[g] = brute_tree([x[1] for x in groups[g]])
    top = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, (row, digest, cur) in enumerate(groups[g]):
            siblings = ""
            for tree, place in ((trees[g], k), (top, at)):
                for level in tree[:-1]:
                    first = place // 3 * 3
                    run = level[first:first + 3]
                    siblings += "".join(run[:place - first] + run[place - first + 1:])
                    run[place - first] = cur
                    cur, place = sha("".join(run)), place // 3
            out.append((row[0], digest, trees[g][-1][0], top[-1][0], sha(siblings), cur,
                        cur == top[-1][0]))
    return out


def merkle_rows():
    rng = random.Random(3)
    rows = [(k, f"s{rng.randrange(3)}", k % 7, f"text {k}\nof é") for k in range(140)]
    rows += [(500 + k, f"lone{k:02}", None, None) for k in range(31)]
    rows += [(1, None, 4, ""), (None, None, 5, "no id"), (None, "s1", 5, "x\n"), (2, "é", 1, "a"),
             (3, "Z", 1, "a\n" * 3000), (3, "Z", 1, "b"), (3, "Z", 1, "b"), (4, "", 1, "e\n")]
    return rows


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    rows = merkle_rows()
    rng = random.Random(height)
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "doc_id long, source string, n long, text string, g string, "
                                  "idx int")
    got = merkle.manifest(table, COLUMNS, height=height,
                          instead={"text": F.replace("text", F.lit("\n"), F.lit(""))}).collect()
    want = brute_manifest(rows, lambda r: (*r[:3], r[3] and r[3].replace("\n", "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["verified"] for r in got} == {True, False}


def test_states_fold_like_a_new_hash():
    tree = merkle.levels([sha(str(k)) for k in range(11)], None)
    for leaf in range(11):
        cur = sha("other")
        changed = [sha(str(k)) if k != leaf else cur for k in range(11)]
        for parent, slot in merkle.path(tree, leaf):
            assert len(parent.states) == len(parent.children)
            cur = parent.fold(slot, cur)
        assert cur == brute_tree(changed)[-1][0]


@pytest.mark.parametrize("rows", [[], [(7, None, None, None)]])
def test_small_manifests(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, source string, n long, text string")
    got = [tuple(r) for r in merkle.manifest(table, COLUMNS).collect()]
    assert got == brute_manifest(rows, lambda r: r) if rows else got == []


# --- periodic runs -------------------------------------------------------------------------

def brute_runs(w, least, min_words):
    """The smallest period comes first, so a stretch found again has a larger one."""
    out, n = {}, len(w)
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, least * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_lyndon(a):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))
    return [max(e - i for e in range(i + 1, len(a) + 1) if is_lyndon(a[i:e]))
            for i in range(len(a))]


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 2, 3, 5])
        rows = [[rng.randrange(k) for _ in range(rng.randrange(1, 16))] for _ in range(3)]
        got = periodic.lyndon(np.array([x for r in rows for x in [-1, *r]]))
        assert got.tolist() == [x for r in rows for x in [0, *brute_lyndon(r)]]


def periodic_words(rng):
    k, out, n = rng.choice([1, 2, 2, 3, 5]), [], rng.randrange(90)
    while len(out) < n:
        out += [rng.randrange(k) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
    return [b"%d" % x for x in out]


@pytest.mark.parametrize(("least", "min_words"), [(4, 6), (2, 2), (3, 5)])
def test_runs_by_brute_force(least, min_words):
    rng = random.Random(least)
    for _ in range(500):
        rows = [periodic_words(rng) for _ in range(rng.randrange(1, 5))]
        for words, found in zip(rows, periodic.of_texts(rows, least, min_words), strict=True):
            assert [tuple(x) for x in found.tolist()] == brute_runs(words, least, min_words)


def test_runs_of_a_table(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "a a a a a a", "x\x1cy z\x0bz", "É " * 9 + "漢字 " * 4,
             "ab " * 30_000, " ".join(f"w{k % 400}" for k in range(2000))]
    texts += [" ".join(w.decode() for w in periodic_words(rng)) for _ in range(40)]
    rows = [(k, t, 1, "y") for k, t in enumerate(texts)] + [(4, texts[4], 1, "y"),
                                                           (None, texts[4], 1, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int, id string")
    got = periodic.find_runs(table.repartition(3)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        found = [(0, 30_000, 1)] if len(words) == 30_000 else brute_runs(words, 4, 6)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want[doc].append((len(words), found, kept.decode()))
    for row in got:
        own = (row["n_words"], [tuple(r) for r in row["runs"]], row["text"])
        assert own in want[row["id"]]


def test_no_runs(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(table).count() == 0
