"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton holds every item of a block of the benchmark; a document's words stream through it
and the state keeps the longest suffix that occurs in an item. A match of `window` words or more
ends a hit; an item with fewer words is one window of its own length.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import map_batches, with_id

# words: runs of digits, letters and everything beyond ASCII, with A-Z lowered
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else
                 c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Words of a block of items: an automaton of this many words takes some hundred MB at most.
BLOCK_WORDS = 250_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window at its state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = 10):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        owners: dict[int, set] = defaultdict(set)
        short: dict[int, set] = defaultdict(set)
        for item, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    owners[self._at(state, window)].add(item)
            if words and len(words) < window:
                short[self._at(state, len(words))].add((len(words), item))
        # what each state owes to itself and to the suffixes below it
        self.items: list[tuple] = [()] * len(self.link)
        self.short: list[tuple] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.items[s] = tuple(owners[s]) if s in owners else self.items[up]
            self.short[s] = self.short[up] + tuple(short.get(s, ()))

    def _new(self, length: int, link: int, onward: dict) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of w after p's longest word, cut off from q where q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        half = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        made = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][w], w)
        return made

    def _at(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint spans [first, end) of hit words in order, and the items that hit them."""
        onward, link, length = self.next, self.link, self.length
        short, window, items = self.short, self.window, self.items
        found: list[list[int]] = []
        who: set = set()
        state = matched = 0
        root = onward[0].get
        for i, w in enumerate(words):
            if not state:
                state = root(w, 0)
                if not state:
                    continue
                matched = 1
            else:
                to = onward[state].get(w)
                while to is None:
                    state = link[state]
                    if state < 0:
                        break
                    matched = length[state]
                    to = onward[state].get(w)
                if to is None:
                    state = matched = 0
                    continue
                state = to
                matched += 1
            reach = 0
            if matched >= window:
                who.update(items[state])
                reach = window
            for n, item in short[state]:
                if n <= matched:
                    who.add(item)
                    reach = max(reach, n)
            if reach:
                first = i + 1 - reach
                while found and found[-1][1] >= first:
                    first = min(first, found.pop()[0])
                found.append([first, i + 1])
        return [(a, b) for a, b in found], who


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(a + b):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def blocks(bench: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks whose words fit one automaton; most benchmarks are one block."""
    items = bench.select(F.col(item_col).cast("string").alias("item"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // (4 * BLOCK_WORDS)
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def spans_of(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", bench_text: str = "text", window: int = 10,
             cut_text: bool = False) -> DataFrame:
    """Per row: id, text, n_words, starts and ends of hit word spans, items (sorted strings).

    With `cut_text` the text comes without its hit spans.
    Null texts have no words. An item without words is no window; one without an id hits but is
    not listed. Repeated items count once by id. Blocks of the benchmark follow one another as
    passes over the same rows, each with a broadcast automaton of bounded size.
    """
    schema = with_id(df, id_col, "text string, n_words long, starts array<int>, "
                                 "ends array<int>, items array<string>")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                    F.lit(0).cast("long").alias("n_words"),
                    F.array().cast("array<int>").alias("starts"),
                    F.array().cast("array<int>").alias("ends"),
                    F.array().cast("array<string>").alias("items"))
    parts = blocks(bench, item_col, bench_text)
    for block in parts:
        rows = [(r["item"], words_of(r["text"])) for r in block.toLocalIterator()]
        shared = df.sparkSession.sparkContext.broadcast(Automaton(rows, window))

        def one(batch: pa.RecordBatch, shared=shared,
                finish=cut_text and block is parts[-1]) -> pa.RecordBatch:
            automaton = shared.value
            body = batch.column(1).to_pylist()
            counts, starts, ends, items = [], [], [], []
            old = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(),
                      batch.column(5).to_pylist(), strict=True)
            for k, (s, e, names) in enumerate(old):
                words = words_of(body[k] or "")
                found, who = automaton.spans(words)
                if s:
                    found = merged(found, list(zip(s, e, strict=True)))
                counts.append(len(words))
                starts.append([a for a, _ in found])
                ends.append([b for _, b in found])
                items.append(sorted({*names, *(x for x in who if x is not None)}))
                if finish and found:
                    body[k] = cut(body[k], starts[-1], ends[-1])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(body, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], batch.schema.names)

        out = map_batches(out, one, schema)
    return out


def n_hit(starts="starts", ends="ends"):
    pairs = F.zip_with(starts, ends, lambda a, b: (b - a).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x)


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the word spans and what stands between their words."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """The rows of df with every hit span taken out of the text; rows hit beyond the coverage go.

    Spans of `window` words or more (or whole shorter items) are removed; a row of whose words
    more than `max_coverage` is hit is dropped. Rows without a hit keep their text unchanged,
    null included. Other columns are kept as they are.
    """
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(text_col).alias("text"))
    clean = spans_of(packed, bench, "row", "text", window=window, cut_text=True).where(
        n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    return clean.select(*[F.col("text").alias(c) if c == text_col else
                          F.col(f"id.`{c}`").alias(c) for c in names])


def items_digest(items="items"):
    """Lowercase hex SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)

