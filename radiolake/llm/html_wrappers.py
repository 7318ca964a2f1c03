"""Main text of web pages by wrappers inferred from each host's pages.

A page is a stream of tags and text slots, without inline tags. Adjacent equal groups of any length
fold into repeated groups, so pages of one template have few shapes. The distinct shapes of a host
are aligned: what both sides have stays, what one side lacks becomes optional. The result is a
union-free regular expression of tags, text slots, repeated and optional nodes: the wrapper. Its
text slots are marked as content by where they stand: inside an article or main element if the
page has one, and never inside menus, headers, footers, asides, forms or what is named as advert,
notice, sidebar or comments. A page is read by aligning its shape with the wrapper of its host;
nodes align only in like containers. On pages without an article or main element, texts that stand on
every such page of the host are constants, no content.

Only distinct shapes are shuffled by host. They are merged in a tree of rounds, some GROUP of them in
a task, so a host with many layouts has many tasks; its wrapper is as long as its layouts differ.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import bounded, keep, texts, with_id

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|select|textarea|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?[a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?|<[a-zA-Z][^<>]*>|[^<]+|<", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label "
             "mark q s samp small span strike strong sub sup time tt u var wbr".split())
APART = set("nav header footer aside form button dialog menu".split())
APART_NAMES = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice "
    "notices comment comments disqus share sharing social related newsletter subscribe popup modal "
    "widget toolbar search contentinfo complementary".split())
MAIN = set("article main".split())
WHOLE = set("html head body".split())  # their names say something of the whole page
GROUP = 64         # wrappers that a task merges in one round, about
MEMO = 20_000      # shapes whose reading a task keeps

TEXT = "#"


def tokens(page: str) -> list[tuple[str, str]]:
    """(name, text): name is `#` for text, the tag's name otherwise, `name!` if it stands apart."""
    out = []
    for m in TOKEN.finditer(page):
        name = m.group(2)
        if name:
            name = name.lower()
            if name[0] != "/":
                said = " ".join(NAMED.findall(m.group(3))).lower() if m.group(3) else ""
                if name in APART or name not in WHOLE and APART_NAMES & set(re.split(r"[^a-z0-9]+", said)):
                    name += "!"
            out.append((name, ""))
        elif m.group()[0] != "<" or m.group() == "<":
            # text, and a lone < is text, too
            if out and out[-1][0] == TEXT:
                out[-1] = (TEXT, out[-1][1] + m.group())
            elif m.group().strip():
                out.append((TEXT, m.group()))
    return out


def skeleton(stream: list[tuple[str, str]]) -> tuple[list[str], list[str], list[int]]:
    """Names without inline tags, texts of their slots, and the slot of each text of the stream.

    Text that only inline tags part is one slot; an inline tag that stands apart stays.
    """
    names: list[str] = []
    slot_texts: list[str] = []
    places: list[int] = []
    open_tags: list[str] = []
    for name, text in stream:
        if name == TEXT:
            if names and names[-1] == TEXT:
                slot_texts[-1] += text
            else:
                names.append(name)
                slot_texts.append(text)
            places.append(len(slot_texts) - 1)
            continue
        plain = name.strip("/!")
        if plain in INLINE:
            if name[0] != "/":
                if plain not in VOID:
                    open_tags.append(name)
                if name[-1] != "!" or plain in VOID:
                    continue
            else:
                at = next((k for k in range(len(open_tags) - 1, -1, -1)
                           if open_tags[k].rstrip("!") == plain), None)
                if at is None or open_tags.pop(at)[-1] != "!":
                    continue
        names.append(name)
    return names, slot_texts, places


def fold(names: list, bodies: list = ()) -> tuple[list, list[int]]:
    """(nodes, tokens of each): a node is a name, or ["+", nodes] for equal groups in a row.

    A group of `bodies` (those that repeat on other pages) is one even if it stands alone.
    """
    nodes, sizes = list(names), [1] * len(names)
    while True:
        before, size, ids = len(nodes), 0, _ids(nodes)
        while size < len(nodes) // 2:
            size += 1
            if not _repeats(ids, size):
                continue
            out, counts, k = [], [], 0
            while k < len(nodes):
                group, end = nodes[k:k + size], k + size
                while nodes[end:end + size] == group and len(group) == size:
                    end += size
                if end > k + size and _unit(group):
                    out.append(["+", group])
                    counts.append(sum(sizes[k:end]))
                    k = end
                else:
                    out.append(nodes[k])
                    counts.append(sizes[k])
                    k += 1
            nodes, sizes, ids = out, counts, _ids(out)
        nodes, sizes = _alone(nodes, sizes, bodies, sum)
        if len(nodes) == before:
            return nodes, sizes


def _ids(nodes: list) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(k, len(seen)) for k in _keys(nodes)], np.int64)


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Is there a group of that size that stands twice in a row?"""
    same = np.concatenate([[0], np.cumsum(ids[size:] == ids[:-size])])
    return bool((same[size:] - same[:-size] == size).any())


def _alone(nodes: list, marks: list, bodies: list, join) -> tuple[list, list]:
    """Groups of `bodies` that stand alone become repeated groups; their marks are joined."""
    for body in bodies:
        out, kept, k, n = [], [], 0, len(body)
        while k < len(nodes):
            if nodes[k:k + n] == body:
                new, mark = ["+", body], join(marks[k:k + n])
                k += n
            else:
                new, mark = nodes[k], marks[k]
                k += 1
            if out and new == ["+", body] and out[-1] == new:
                kept[-1] = join([kept[-1], mark])
            else:
                out.append(new)
                kept.append(mark)
        nodes, marks = out, kept
    return nodes, marks


def _unit(group: list) -> bool:
    """A group that can repeat: it starts with a tag that opens, or is one repeated group."""
    first = group[0]
    return isinstance(first, str) and first != TEXT and first[0] != "/"


def groups(nodes: list) -> list:
    """Bodies of the repeated groups, outer ones first."""
    out = []
    for n in nodes:
        if not isinstance(n, str):
            out += [n[1], *groups(n[1])]
    return out


def by_length(bodies: list) -> list:
    """Distinct bodies, the longest first."""
    texts_of = {json.dumps(g): g for g in bodies}
    return [texts_of[k] for k in sorted(texts_of, key=lambda k: (-len(k), k))]


def _keys(nodes: list) -> list[str]:
    return [n if isinstance(n, str) else json.dumps(n) for n in nodes]


def placed(nodes: list) -> list:
    """Each node with where it stands: its container and the kinds of containers around it."""
    stack: list[str] = []
    out = []
    for n in nodes:
        if not (isinstance(n, str) and n[0] == "/"):
            out.append(_context(n, stack))
        for name in _flat([n]):
            _walk(stack, name)
        if isinstance(n, str) and n[0] == "/":
            out.append(_context(n, stack))
    return out


def _context(node, stack: list[str]) -> list:
    return [node, stack[-1] if stack else "", any(x[-1] == "!" for x in stack),
            any(x in MAIN for x in stack)]


def _walk(stack: list[str], name: str) -> None:
    """The open tags after a tag or text."""
    if name[0] == "/":
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].rstrip("!") == name[1:]:
                del stack[k:]
                return
    elif name != TEXT and name.rstrip("!") not in VOID:
        stack.append(name)


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places of two node lists, in order; None where one side has nothing.

    A longest common subsequence at every size, by bit vectors (Hyyrö): a bit of row j is 0 where
    one more node of a raises the length that is common with the first j nodes of b.
    """
    keys, places = _keys(a), {}
    for i, k in enumerate(keys):
        places[k] = places.get(k, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    rows = []
    for k in _keys(b):
        hit = row & places.get(k, 0)
        row = (row + hit | row - hit) & every
        rows.append(row)
    out: list[tuple[int | None, int | None]] = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append((i, None))
            continue
        j -= 1
        if j and not rows[j - 1] >> (i - 1) & 1:
            out.append((None, j))
        else:
            i -= 1
            out.append((i, j))
    out += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def merge(one: list, two: list) -> list:
    """Wrapper of two wrappers: lists of [node, optional]."""
    bodies = by_length(groups([n for n, _ in one + two]))
    one, two = ([list(x) for x in zip(*_stable(w, bodies), strict=True)] for w in (one, two))
    out = []
    for i, j in align(placed([n for n, _ in one]), placed([n for n, _ in two])):
        if i is not None and j is not None:
            out.append([one[i][0], one[i][1] or two[j][1]])
        else:
            out.append([one[i][0] if j is None else two[j][0], True])
    return out


def _stable(wrapper: list, bodies: list) -> tuple[list, list[bool]]:
    """Nodes and options after all single groups have become repeated ones."""
    nodes, options = [n for n, _ in wrapper], [o for _, o in wrapper]
    while True:
        before = len(nodes)
        nodes, options = _alone(nodes, options, bodies, any)
        if len(nodes) == before:
            return nodes, options


def infer(shapes: list[str]) -> str:
    """Wrapper (JSON) of wrappers (JSON); the order is that of their texts, so it is the same
    whatever the order of arrival."""
    wrapper = None
    for s in sorted(shapes, key=lambda s: (len(s), s)):
        own = json.loads(s)
        wrapper = own if wrapper is None else merge(wrapper, own)
    return json.dumps(wrapper or [])


def shape_of(names: list[str]) -> str:
    """The wrapper of one page."""
    return json.dumps([[n, False] for n in fold(names)[0]])


def has_main(names) -> bool:
    return any(n.rstrip("!") in MAIN for n in names)


def slots(nodes: list, main: bool) -> list[bool]:
    """For every text slot in order, in a group once: is it content?

    `main`: the page has an article or main element, so what stands outside is none.
    """
    stack: list[str] = []
    out = []
    for name in _flat(nodes):
        if name == TEXT:
            apart = any(s[-1] == "!" for s in stack)
            inside = any(s in MAIN for s in stack)
            out.append(not apart and (inside or not main))
        _walk(stack, name)
    return out


def _flat(nodes: list):
    for n in nodes:
        if isinstance(n, str):
            yield n
        else:
            yield from _flat(n[1])


def reading(wrapper: str, names: list[str]) -> list[bool]:
    """For every text of a page: is it content, by the slot of the wrapper that it falls into?

    A text outside the wrapper is judged by the page's own structure.
    """
    whole = [n for n, _ in json.loads(wrapper)]
    nodes, sizes = fold(names, by_length(groups(whole)))
    main = has_main(names)
    it = iter(slots(whole, main))
    marks = [[next(it) for x in _flat([n]) if x == TEXT] for n in whole]
    wrapped = {j: i for i, j in align(placed(whole), placed(nodes)) if i is not None and j is not None}
    own, verdict, place = slots(names, main), [], 0
    for j, size in enumerate(sizes):
        n = sum(x == TEXT for x in names[place:place + size])
        mark = marks[wrapped[j]] if j in wrapped else []
        # the slots of a group stand in one container as a rule; if not, the page itself decides
        verdict += ([mark[0]] * n if len(set(mark)) == 1 else own[len(verdict):len(verdict) + n])
        place += size
    return verdict


def text_hash(text: str) -> int:
    """Signed 64 bits of a text, white space aside."""
    return xxhash.xxh64_intdigest(" ".join(html.unescape(text).split())) - (1 << 63)


def loose_texts(stream: list[tuple[str, str]]) -> set[int]:
    """Hashes of the texts of a page without a main element that no tag or name marks apart."""
    names, slot_texts, _ = skeleton(stream)
    if has_main(names):
        return set()
    return {text_hash(t) for t, content in zip(slot_texts, slots(names, False), strict=True)
            if content}


def constants(pages: DataFrame) -> DataFrame:
    """(host, constants): texts that stand on every page of a host that has no main element.

    Equal pages count once; a page without such texts, and a host with one such page, say nothing.
    """
    def own(batches):
        for batch in batches:
            found = [loose_texts(tokens(page)) for page in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))],
                ["host", "found"])

    found = bounded(pages).mapInArrow(own, "host string, found array<long>").where(
        "size(found) > 0").distinct()
    found = keep(found, "loose-texts")
    sizes = found.groupBy("host").count().where("count > 1")
    each = found.select("host", F.explode("found").alias("h")).groupBy("host", "h").agg(
        F.count("*").alias("n"))
    # no more than the texts of one page
    return each.join(sizes, "host").where("n = count").groupBy("host").agg(
        F.collect_list("h").alias("constants"))


def extract(wrapper: str, page: str, memo: dict, constant: frozenset = frozenset()) -> str:
    """Blocks of content in page order, one line each."""
    stream = tokens(page)
    names, slot_texts, places = skeleton(stream)
    key = (wrapper, " ".join(names))
    marks = memo.get(key)
    if marks is None:
        if len(memo) >= MEMO:
            memo.clear()
        marks = memo[key] = reading(wrapper, names)
    blocks, current, k = [], [], 0
    if constant and not has_main(names):
        marks = [m and text_hash(t) not in constant
                 for m, t in zip(marks, slot_texts, strict=True)]
    for name, text in stream:
        if name == TEXT:
            if marks[places[k]]:
                current.append(html.unescape(text))
            k += 1
        elif name == "br":
            current.append(" ")
        elif name.strip("/!") not in INLINE:
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: str) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
                      F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, n_shapes) from all pages of each host."""
    def shapes(batches):
        memo: dict[str, str] = {}
        for batch in batches:
            out = []
            for page in texts(batch.column(1)):
                names = " ".join(skeleton(tokens(page))[0])
                if names not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[names] = shape_of(names.split(" ") if names else [])
                out.append(memo[names])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())],
                                             ["host", "shape"])

    def whole(table: pa.Table) -> pa.Table:
        return pa.table({"host": table["host"][:1], "wrapper": [infer(table[1].to_pylist())],
                         "n_shapes": [sum(table["n_shapes"].to_pylist())]})

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string"))
    found = bounded(rows).mapInArrow(shapes, "host string, shape string").distinct()
    ddl = "host string, wrapper string, n_shapes long"
    level = keep(found.select("host", F.col("shape").alias("wrapper"),
                              F.lit(1).cast("long").alias("n_shapes")), "wrappers")
    # rounds: a task merges GROUP wrappers or so, however many a host has
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= 1:
            return level
        salt = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("size") / GROUP))
        dealt = level.join(sizes, "host").withColumn("salt", salt)
        level = keep(dealt.groupBy("host", "salt").applyInArrow(
            lambda t: whole(t.select(["host", "wrapper", "n_shapes"])), ddl), "wrappers")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars, by the wrapper of its host.

    A null html is an empty page with empty text; a null or malformed url belongs to the host ``,
    whose pages share a wrapper. Character references are decoded, white space inside a block is
    one space, blocks are joined by line ends; repeated rows stay rows of their own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html"),
                        host_of(url_col).alias("host"))
    known = wrappers(pages, url_col, html_col).select("host", "wrapper")
    same = constants(rows.select("host", "html"))
    joined = rows.join(known.join(same, "host", "left"), "host", "left").select(
        "id", "url", "html", "wrapper", "constants")

    def read(batches):
        memo: dict = {}
        for batch in batches:
            wrapper = [w or "[]" for w in batch.column(3).to_pylist()]
            out = [extract(w, t, memo, frozenset(c or ()))
                   for w, t, c in zip(wrapper, texts(batch.column(2)),
                                      batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    return bounded(joined).mapInArrow(read, with_id(
        pages, id_col, "url string, text string, n_chars long"))
