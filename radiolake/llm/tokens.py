"""Whole texts to token ids with the tokenizers library, word by word where that is exact.

Both kinds of tokenizer used here cut a text before every run of white space, so the ids of a text
whose words stand apart by single spaces or line ends are those of its words. A task encodes a new
word once, together with others, and keeps the ids of words; every other text is encoded whole.
"""

from __future__ import annotations

import os
import string

import numpy as np

MEMO = 1_600_000  # words whose ids a worker keeps (some 380 MB); when full it starts anew
TOGETHER = 2_000  # new words of one call to the library
ODD = "\x1c\x1d\x1e\x1f"  # white space to str.split, but not to the tokenizer


class WordIds:
    """Token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = MEMO):
        self.most = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.token_to_id(self.special[0])
        code = self.tokenizer.encode
        self.caseless = code("A", add_special_tokens=False).ids == code(
            "a", add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. A word stands for itself behind a space, or behind its line end.

        Tokenizers part letters from the punctuation behind them, so of such a word only the
        letters are encoded, once for all endings.
        """
        endings, plain = [], []
        for w in words:
            base = w.rstrip(string.punctuation)
            if len(base) < len(w) and base.isalpha():
                endings.append((w, base))
            else:
                plain.append(w)
        bases = {b for _, b in endings}.difference(self.memo, plain)
        self._encode(plain + list(bases))
        for w, base in endings:
            end = w[len(base):]
            if end not in self.ends:
                self.ends[end] = self.whole(end)
            self.memo[w] = self.memo[base] + self.ends[end]

    def _encode(self, words: list[str]) -> None:
        """Words are told apart in one call by a special token between them, which none holds."""
        groups = [words[at:at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        mark = self.special[0]
        rows = [mark + mark.join([w if w[0] == "\n" else " " + w for w in g]) for g in groups]
        codes = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
        for group, code in zip(groups, codes, strict=True):
            ids = np.array(code.ids, dtype="<u4")
            data = ids.tobytes()
            at = (4 * np.flatnonzero(ids == self.mark)).tolist()
            ends = [*at[1:], len(data)]
            self.memo.update((w, data[a + 4:b])
                             for w, a, b in zip(group, at, ends, strict=True))

    def _words(self, text: str) -> list[str] | None:
        """The words, with the line end before them; None if they stand otherwise apart."""
        if self.caseless and text.isascii():
            text = text.lower()
        line = text.replace("\n", " ")
        words = line.split(" ")
        # printable text has no white space but blanks
        if "" in words or not line.isprintable() and (
                words != line.split() or any(c in text for c in ODD)):
            return None
        if any(s in text for s in self.special):
            return None
        return text.replace("\n", " \n").split(" ") if "\n" in text else words

    def encode(self, rows: list[str]) -> list[bytes]:
        parts = [self._words(t) for t in rows]
        if len(self.memo) > self.most:
            self.memo.clear()
            self.ends.clear()
        # the first word has no space before it, so it is encoded as it is
        first = self.tokenizer.encode_batch([w[0] for w in parts if w], add_special_tokens=False)
        first = iter(first)
        rest = [w[1:] if w else [] for w in parts]
        self._learn(list(set().union(*rest).difference(self.memo)))
        get = self.memo.__getitem__
        out = []
        for text, words, own in zip(rows, parts, rest, strict=True):
            if words is None:
                out.append(self.whole(text) if text else b"")
            else:
                head = np.array(next(first).ids, dtype="<u4").tobytes()
                out.append(head + b"".join(map(get, own)))
        return out


_MADE: dict[tuple[str, int], WordIds] = {}


def encoder(path: str, memo: int = MEMO) -> WordIds:
    """The encoder of this Python worker, made at its first use and kept for later tasks."""
    if (path, memo) not in _MADE:
        _MADE[path, memo] = WordIds(path, memo)
    return _MADE[path, memo]
