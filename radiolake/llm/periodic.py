"""Runs of words: maximal stretches that repeat a root, by the Lyndon roots of a grouped text.

A text's words become numbers; stretches of several texts lie one behind the other, a barrier before
each. The first phase of Baier's suffix sorter groups the suffixes by their longest Lyndon prefix:
groups are taken from the highest down, and the nearest earlier suffix of a lower group (its group
goes on with the taken one's prefix as often as it is met) moves to a group just above its own. The
length of a group's prefix is the Lyndon array. It is made for the order of the words and for the
reverse one: by the theorem of runs every run has a Lyndon root that one of them shows. Roots are
extended to both sides by the longest common extension, looked up in names of all substrings whose
length is a power of two, so it is exact.

A run of `least` repeats holds each of its words that often. So a word that is rarer in its stretch
parts it, until no such word is left: what remains is little of ordinary text, and no run is lost.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import map_batches, with_id

BARRIER = -1


def lyndon(codes: np.ndarray) -> np.ndarray:
    """Lengths of the longest Lyndon words that start at each place; 0 at barriers.

    codes: integers of 0 or more, BARRIER before each text (and at the front). A text's end counts
    as lower than every code.
    """
    n = len(codes)
    length = [0] * n
    # left[k]: the place itself while its group is not taken, else some place before it
    left = list(range(n))
    # groups are a list from low to high; `below` leads from a group to the next lower one
    values, group_of = np.unique(codes, return_inverse=True)
    members: list[list[int]] = np.split(np.argsort(group_of, kind="stable"),
                                        np.cumsum(np.bincount(group_of))[:-1]) if n else []
    members = [m.tolist() for m in members]
    size = [1] * len(members)           # length of a group's common prefix
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    group_of = group_of.tolist()
    lowest = 0 if n and values[0] == BARRIER else -1
    g = len(members) - 1
    while g > lowest:
        own = [k for k in members[g] if group_of[k] == g]
        members[g], width = None, size[g]
        for k in own:
            length[k] = width
            left[k] = k - 1
        # how often the nearest place of a lower group is met from this group
        times: dict[int, int] = {}
        for k in own:
            at = k - 1
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            left[k] = at
            times[at] = times.get(at, 0) + 1
        moved: dict[tuple[int, int], list[int]] = defaultdict(list)
        for at, often in times.items():
            if group_of[at] != lowest:
                moved[group_of[at], often].append(at)
        # just above the old group, those met more often higher
        last = old = -1
        for was, often in sorted(moved):
            last, old = (last if was == old else was), was
            new, up = len(members), above[last]
            above[last], below[up] = new, new
            above.append(up)
            below.append(last)
            members.append(moved[was, often])
            size.append(size[was] + often * width)
            for at in members[new]:
                group_of[at] = new
            last = new
        g = below[g]
    return np.array(length, np.int64)


def names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] stands for the 2**k codes from i on: equal names, equal codes."""
    own = codes.astype(np.int64)
    walls = np.flatnonzero(own == BARRIER)
    own[walls] = own.max() + 1 + np.arange(len(walls))  # no two barriers are equal
    out = [own]
    while 2 << len(out) - 1 <= longest:
        half = 1 << len(out) - 1
        pairs = out[-1][:-half].astype(np.int64) * (int(out[-1].max()) + 1) + out[-1][half:]
        out.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return out


def common(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes from a on equal those from b on (b > a)."""
    total = np.zeros(len(a), np.int64)
    for k in reversed(range(len(table))):
        at = b + total
        fits = np.flatnonzero(at < len(table[k]))
        same = table[k][a[fits] + total[fits]] == table[k][at[fits]]
        total[fits[same]] += 1 << k
    return total


def common_before(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes before a equal those before b (b > a)."""
    total = np.zeros(len(a), np.int64)
    for k in reversed(range(len(table))):
        at = a - total - (1 << k)
        fits = np.flatnonzero(at >= 0)
        same = table[k][at[fits]] == table[k][b[fits] - total[fits] - (1 << k)]
        total[fits[same]] += 1 << k
    return total


def _repeated(table: list[np.ndarray], i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the p codes from i on come again right behind: two names that overlap tell."""
    out = np.zeros(len(i), bool)
    level = np.frexp(p.astype(float))[1] - 1
    for k in range(len(table)):
        own = np.flatnonzero((level == k) & (i + 2 * p <= len(table[0])))
        a, b = i[own], i[own] + p[own]
        shift = p[own] - (1 << k)
        out[own] = (table[k][a] == table[k][b]) & (table[k][a + shift] == table[k][b + shift])
    return out


def runs(codes: np.ndarray, longest: int, least: int, min_words: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of codes, by start, then period.

    Runs have `least` periods and min_words words or more; `longest` bounds the stretches between
    barriers.
    """
    table = names(codes, longest)
    found = []
    upside_down = np.where(codes == BARRIER, BARRIER, codes.max(initial=0) - codes)
    for order in (codes, upside_down):
        p = lyndon(order)
        i = np.flatnonzero(p)
        if least > 2:  # the first root of such a run comes again whole
            i = i[_repeated(table, i, p[i])]
        p = p[i]
        before = common_before(table, i, i + p)
        length = before + p + common(table, i, i + p)
        long = length >= np.maximum(min_words, least * p)
        found.append(np.stack([i - before, length, p], axis=1)[long])
    both = np.unique(np.concatenate(found), axis=0)
    return both[np.lexsort((both[:, 2], both[:, 0]))]


def stretches(text_of: np.ndarray, codes: np.ndarray, least: int,
              min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, stretch) of the words that may lie in a run: each is in its stretch `least` times.

    Ends when a round takes away little: what is left over costs time, not results.
    """
    place, part = np.arange(len(codes)), text_of.astype(np.int64)
    width = int(codes.max(initial=0)) + 1
    while len(place):
        _, which, times = np.unique(part * width + codes[place], return_inverse=True,
                                    return_counts=True)
        stay = times[which] >= least
        left, old = place[stay], part[stay]
        start = np.diff(left, prepend=-2) != 1
        start |= np.diff(old, prepend=-1) != 0
        part = np.cumsum(start) - 1
        long = np.bincount(part, minlength=1)[part] >= max(least, min_words) if len(
            part) else np.zeros(0, bool)
        before, place, part = len(place), left[long], part[long]
        if len(place) > 0.95 * before:
            break
    return place, part


def of_texts(rows: list[list[bytes]], least: int, min_words: int) -> list[np.ndarray]:
    """The runs of every list of words."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(words) for words in rows], np.int64)
    codes = np.fromiter((number[w] for words in rows for w in words), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(rows)), sizes)
    out = [np.zeros((0, 3), np.int64)] * len(rows)
    place, part = stretches(text_of, codes, least, min_words)
    if not len(place):
        return out
    # a barrier before each stretch
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    lengths = np.diff(np.append(starts, len(part)))
    joined = np.insert(codes[place], starts, BARRIER)
    origin = np.insert(place, starts, BARRIER)
    found = runs(joined, int(lengths.max()), least, min_words)
    first = origin[found[:, 0]]
    texts = text_of[first]
    found[:, 0] = first - (np.cumsum(sizes) - sizes)[texts]
    cuts = np.searchsorted(texts, np.arange(len(rows) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run repeats: each run keeps its first period."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4,
              min_words: int = 6) -> DataFrame:
    """Per row: id, n_words, runs (start, length and period, in words), text (collapsed).

    Words are what ASCII white space parts; a run is a maximal stretch with `least` times its
    smallest period and min_words words or more. Runs stand by start, then period. The collapsed
    text has the words, joined by single spaces, that no run repeats after its first period. Null
    and empty texts have no words, no run and an empty text. Rows that repeat an id stay as they
    are; other columns are not read.
    """
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(x or b"").split() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        found = of_texts(rows, least, min_words)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        cols = np.concatenate([np.zeros((0, 3), np.int64), *found]).T
        flat = pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(RUN))
        texts = [collapse(w, f).decode("utf-8") for w, f in zip(rows, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in rows], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(texts, pa.string())],
            ["id", "n_words", "runs", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, with_id(
        df, id_col, "n_words long, runs array<struct<start:long,length:long,period:long>>, "
                    "text string"))
