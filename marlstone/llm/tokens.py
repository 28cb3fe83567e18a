"""Whole texts to token ids with the tokenizers library, a batch at a time.

Both vocabularies first cut a text into pieces (words, numbers, punctuation) and then merge inside
a piece, so a text can be cut wherever such a boundary is certain, and the parts' ids joined. Texts
are cut at the boundaries that plain bytes show: between ASCII letters (and Latin-1 ones), digits,
punctuation and white space. Where other characters or an apostrophe make a boundary uncertain
there is no cut. Each distinct part is encoded by the library once and remembered, up to
`MOST_PARTS` parts in a Python worker, by a 64-bit hash (two of so many parts are equal by chance
once in 10**8 workers). A part that is one piece for certain goes to the library as a piece, many in a
call; it cuts all others itself. A text that holds the string of a special token is encoded whole, by the
library itself: such a string is that token, or ordinary text where `special_as_text` is set.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from marlstone.llm import textbatch as tb

MOST_PARTS = 400_000
#: Pieces that the library encodes in a call.
IN_A_CALL = 256
_OTHER, _LETTER, _DIGIT, _PUNCTUATION, _SPACE, _APOSTROPHE = range(6)
_CLASS = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = _DIGIT if 48 <= _b <= 57 else _LETTER if chr(_b).isalpha() else _PUNCTUATION
_CLASS[list(tb.SPACES)] = _SPACE
_CLASS[ord("'")] = _APOSTROPHE
#: _CUT[before, after]: a piece is sure to end between them
_CUT = np.zeros((6, 6), bool)
for _a, _after in ((_LETTER, (_DIGIT, _PUNCTUATION, _APOSTROPHE, _SPACE)), (_DIGIT, (_LETTER, _PUNCTUATION, _APOSTROPHE, _SPACE)), (_PUNCTUATION, (_LETTER, _DIGIT, _SPACE)), (_APOSTROPHE, (_SPACE,))):
    _CUT[_a, list(_after)] = True
#: The characters that stand for bytes in both vocabularies: printable ones for themselves, the others from U+0100 on
_CHARACTER = np.arange(256, dtype="<u4")
_UNPRINTED = np.array([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)])
_CHARACTER[_UNPRINTED] = 256 + np.arange(len(_UNPRINTED))


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of U+00C0..U+00FF but the two signs are letters."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, int)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Known:
    """Places 0, 1, ... of 64-bit keys other than 0: open addressing, looked up and filled a whole array at a time."""

    def __init__(self, bits: int = 12) -> None:
        self.n, self.bits = 0, bits
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places, -1 where a key isn't there."""
        place, left, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            place[left[hit]] = self.at[slot[hit]]
            on = np.flatnonzero(~hit & (held != 0))
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return place

    def _fill(self, keys: np.ndarray, places: np.ndarray) -> None:
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[left[free]]  # of keys for one slot one stays
            mine = self.keys[slot] == keys[left]
            self.at[slot[mine]] = places[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that aren't there get the next places."""
        total = self.n + len(keys)
        if 2 * total > len(self.keys):
            used = self.keys != 0
            old, places = self.keys[used], self.at[used]
            self.bits = (2 * total - 1).bit_length()
            self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._fill(old, places)
        self._fill(keys, np.arange(self.n, total, dtype=np.int32))
        self.n = total


class Encoder:
    """Ids of whole texts. lower: the vocabulary lower-cases and drops white space."""

    def __init__(self, file: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.file, self.library = file, Tokenizer.from_file(file)
        self.library.encode_special_tokens = special_as_text
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.lower = self.library.normalizer is not None
        self.pieces = Tokenizer(self.library.model)  # the same model, for pieces that are cut already
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>") if self.lower else token)
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.start, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, total = self.known.n, len(flat)
        while len(self.start) < n + len(keys):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while len(self.flat) < self.used + total:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[n : n + len(keys)] = sizes
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.known.add(keys)

    def _whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any parts, one part after another, and their number for each part."""
        text = data.tobytes()
        found = [e.ids for e in self.library.encode_batch_fast([text[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _single(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which parts are one piece for certain, with bytes that the vocabulary leaves as they are."""
        first = start if self.lower else start + (data[start] == 32)
        full = np.flatnonzero(first < end)
        sure = np.zeros(len(start), bool)
        if not len(full):
            return sure
        first, sizes = first[full], (end - first)[full]
        at, heads = tb.ranges(first, sizes), np.cumsum(sizes) - sizes
        kinds = kind[at]
        one = kinds[heads]
        same = (np.minimum.reduceat(kinds, heads) == one) & (np.maximum.reduceat(kinds, heads) == one)
        if self.lower:  # each digit is a piece, and capitals of U+00C0..U+00DE become small
            capital = (data[at] >= 0x80) & (data[at] <= 0x9E)
            sure[full] = same & ((one == _LETTER) | (one == _PUNCTUATION)) & ~np.maximum.reduceat(capital, heads)
        else:
            sure[full] = same & ((one == _LETTER) | (one == _PUNCTUATION) | (one == _DIGIT))
        return sure

    def _one_each(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """As `_whole`, of parts that are one piece each, many in a call; None if the tokens' bytes don't say where a part ends."""
        sizes = end - start
        text = _CHARACTER[data[tb.ranges(start, sizes)]].tobytes().decode("utf-32-le")
        ends = np.cumsum(sizes)
        words = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        calls = self.pieces.encode_batch_fast([words[i : i + IN_A_CALL] for i in range(0, len(words), IN_A_CALL)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in calls])
        reached = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(reached, ends)
        if not len(ids) or last[-1] != len(ids) - 1 or (reached[last] != ends).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def _encoded(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts in the order of the third result."""
        sure = self._single(data, kind, start, end)
        ones, others = np.flatnonzero(sure), np.flatnonzero(~sure)
        found = self._one_each(data, start[ones], end[ones]) if len(ones) else None
        if found is None:
            return *self._whole(data, start, end), np.arange(len(start))
        if len(others):
            more = self._whole(data, start[others], end[others])
            found = np.concatenate([found[0], more[0]]), np.concatenate([found[1], more[1]])
        return *found, np.concatenate([ones, others])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one row after another, and the number of each row's ids; null is empty."""
        data, bounds = tb.raw(column)
        plain = data.tobytes()
        if not any(x in plain for x in self.special):
            return self._cut(data, bounds)
        ids, sizes = self._cut(data, bounds)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for row in range(len(column)):
            text = plain[bounds[row] : bounds[row + 1]]
            if any(x in text for x in self.special):
                parts[row] = np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, part by part."""
        rows = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if self.lower:
            data = tb.LOWER[data]
        kind = classes(data)
        begins = np.zeros(len(data), bool)
        begins[1:] = _CUT[kind[:-1], kind[1:]]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        if self.lower:  # white space before a part doesn't count
            word = np.flatnonzero(kind != _SPACE)
            first = np.append(word, len(data))[np.searchsorted(word, start)]
            full = first < end
            start, end = first[full], end[full]
        keys = np.maximum(tb.hash_spans(data, start, end), np.uint64(1))
        place = self.known.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, sample, which = np.unique(keys[new], return_index=True, return_inverse=True)
            if self.known.n and self.known.n + len(distinct) > MOST_PARTS:
                self.forget()
                new = np.arange(len(keys))
                distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
            at = new[sample]
            flat, sizes, order = self._encoded(data, kind, start[at], end[at])
            turn = np.empty(len(order), np.int32)
            turn[order] = np.arange(self.known.n, self.known.n + len(order))
            self._learn(distinct[order], flat, sizes)
            place[new] = turn[which]
        sizes = self.length[place]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        return self.flat[tb.ranges(self.start[place], sizes)], np.diff(before[np.searchsorted(start, bounds)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary file, by path or by its name among the public ones; one for each worker."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _ENCODERS[name]


def drop() -> None:
    """Let go of a worker's encoders and what they remember: for tasks that need the room and no ids."""
    _ENCODERS.clear()
    tb.give_back()


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more after each row's."""
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out, lengths + 1
