"""Token ids of whole texts with public tokenizers, inside Spark tasks."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

from canvass.llm.common import SHORT, short_keys

_SPACE, _BREAK = 32, 10
_LONG = 1024  # bytes of a chunk that is worth remembering
_GROUP = 1 << 19  # bytes of texts that are looked up at once
_WHOLE = (1 << 64) - 1
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_CODE = np.arange(256)
_LATIN = ((_CODE | 32) >= ord("a")) & ((_CODE | 32) <= ord("z")) & (_CODE < 128)
_MARK = (_CODE > 32) & (_CODE < 127) & ~_LATIN & ~((_CODE >= ord("0")) & (_CODE <= ord("9")))


def _mix(keys: np.ndarray) -> np.ndarray:
    x = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0xD6E8FEB86659FD93)) ^ (keys[:, 2] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _other(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] != b[:, 0]) | (a[:, 1] != b[:, 1]) | (a[:, 2] != b[:, 2])


def _inside(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of each run."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class _Memory:
    """Ids of chunks: a row of a table per short chunk (its bytes, its length, where its ids lie), a dictionary for long ones.

    Keys are the bytes themselves, so equal rows are equal chunks. A place is the first id's position
    in ``ids`` and, in the low half, how many there are; or ``_WHOLE``, if texts with this chunk go to the library whole.
    """

    def __init__(self) -> None:
        self.table = np.zeros((1 << 12, 4), np.uint64)
        self.rows = self.used = 0
        self.ids = np.zeros(1 << 14, "<u4")
        self.long: dict[bytes, int] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys) >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which keys are not known."""
        slot = self._slots(keys)
        row = self.table[slot]
        place, gone = row[:, 3].copy(), row[:, 2] == 0
        todo = np.flatnonzero(_other(row, keys) & ~gone)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            row = self.table[slot[todo]]
            place[todo], gone[todo] = row[:, 3], row[:, 2] == 0
            todo = todo[_other(row, keys[todo]) & (row[:, 2] != 0)]
        return place, gone

    def add(self, keys: np.ndarray, place: np.ndarray) -> None:
        rows = np.column_stack([keys, place])
        self.rows += len(rows)
        if 2 * self.rows > len(self.table):
            rows = np.concatenate([self.table[self.table[:, 2] != 0], rows])
            self.table = np.zeros((1 << (2 * self.rows).bit_length(), 4), np.uint64)
        slot = self._slots(rows)
        while len(rows):
            self.table[slot] = np.where((self.table[slot, 2] == 0)[:, None], rows, self.table[slot])
            left = _other(self.table[slot], rows)
            rows, slot = rows[left], (slot[left] + 1) & (len(self.table) - 1)

    def keep(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Places of ids that are put into the memory."""
        first = self.used + np.cumsum(count) - count
        if self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(self.used + len(ids), "<u4")]
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return first.astype(np.uint64) << _HALF | count.astype(np.uint64)


def _letters(byte: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of letters up to U+017E that lower case leaves as long as they are."""
    before = np.r_[np.uint8(0), byte[:-1]]
    lead = (byte >= 0xC3) & (byte <= 0xC5)
    after = (before >= 0xC3) & (before <= 0xC5)
    sign = (before == 0xC3) & ((byte == 0x97) | (byte == 0xB7)) | (before == 0xC4) & (byte == 0xB0) | (before == 0xC5) & (byte == 0xBF)
    return _LATIN[byte] | lead | after & ~sign


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of chunks.

    Byte-level and word-end patterns never join a character to the white space after it, nor
    a letter to the mark after it, so most texts may be cut before white space. Plain texts hold
    only printable characters, spaces and line breaks, no three of those in a row and no two at the end;
    others go to the library whole. Chunks recur, whole texts do not: each chunk is encoded once by the
    library and remembered; chunks are found and their ids put together for many texts at once, in arrays.
    The memory starts anew when it holds more than ``limit`` chunks.
    A word with marks after it is put together from the word and the marks.
    Special tokens written out in a text become their ids, as in a plain call of the library; such texts go to it whole.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaced = tuple(s for s in self.special if any(c.isspace() for c in s))
        self.lowered = "Lowercase" in str(self.tokenizer.normalizer)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            # One character of a byte-level token stands for one byte.
            self.bytes_of[i] = len(token.removesuffix("</w>") if self.lowered else token)
        # Words of letters are one piece to the patterns: they go to the same model without them, as byte-level characters.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = _CODE.astype("<u4")
        for c in map(chr, (_SPACE, *range(0x41, 0x180))):
            self.shown[list(c.encode())] = [ord(x) for x in shown.pre_tokenize_str(c)[0][0]]
        # No word with marks after it holds a special token that has a letter after a mark.
        self.simple = all(_MARK[ord(s[0]) % 256] and s[0].isascii() and any(c.isalpha() for c in s) for s in self.special)
        self.limit = limit
        self.memory = _Memory()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _apart(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many ids there are up to the end of each chunk, told by the bytes that each token stands for."""
        at = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(at, ends, side="right")
        if len(at) == 0 or at[-1] != ends[-1] or np.any(np.where(cut > 0, at[np.maximum(cut, 1) - 1], 0) != ends):
            return None
        return cut

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks encoded as one text, then told apart."""
        apart = [c if c[:1] in (" ", "\n") else "\n" + c for c in chunks]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(apart)], add_special_tokens=False)[0].ids, "<u4")
        if self.lowered:
            shown = [unicodedata.normalize("NFC", c.strip()).lower() for c in chunks]
        else:
            shown = apart
        cut = self._apart(ids, np.cumsum([len(c.encode()) for c in shown]))
        if cut is None:
            return self._encode(chunks)
        first = np.r_[0, cut[:-1]]
        if not self.lowered:  # the line break put before a chunk is a token of its own
            first = first + np.array([a is not c for a, c in zip(apart, chunks)], np.int64)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), cut.tolist())]

    def _learn_any(self, chunks: list[str], lot: int = 200) -> np.ndarray:
        """Places of chunks of any kind, encoded with the tokenizer's own patterns."""
        found: list[bytes | None] = [None] * len(chunks)
        bare = [c.lstrip(" \n") for c in chunks]
        seen = [c.isprintable() and not any(s in c for s in self.special) for c in bare]
        blank = [i for i, c in enumerate(bare) if not c]
        rest = [i for i, c in enumerate(bare) if c and seen[i]]
        for some, call in ((blank, self._encode), (rest, self._encode_chunks)):
            for at in range(0, len(some), lot):
                for i, ids in zip(some[at : at + lot], call([chunks[i] for i in some[at : at + lot]])):
                    found[i] = ids
        ids = np.frombuffer(b"".join(x for x in found if x), "<u4")
        place = self.memory.keep(ids, np.array([len(x or b"") // 4 for x in found], np.int64))
        place[~np.array(seen, bool)] = _WHOLE
        return place

    def _learn_words(self, joined: np.ndarray, size: np.ndarray, lot: int = 200) -> np.ndarray:
        """Places of words of letters, given with a line break after each, encoded by the model."""
        if self.lowered:
            joined = np.frombuffer(joined.tobytes().decode().lower().encode(), np.uint8)
        text = self.shown[joined].tobytes().decode("utf-32-le")
        edge = np.r_[0, np.cumsum(size + 1)]
        ids: list[int] = []
        for at in range(0, len(size), lot):
            some = text[edge[at] : edge[min(at + lot, len(size))] - 1]
            ids += self.model.encode_batch_fast([some], add_special_tokens=False)[0].ids
        known = np.array(ids, "<u4")
        cut = self._apart(known, np.cumsum(size))
        if cut is None:
            return self._learn_any(joined.tobytes().decode().split("\n")[:-1])
        return self.memory.keep(known, np.diff(np.r_[0, cut]))

    def _learn(self, raw: bytes, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of short chunks that are not known, each once."""
        step = size + 1
        joined = np.frombuffer(raw, np.uint8)[_inside(at, step)]
        first = np.cumsum(step) - step
        joined[first + size] = _BREAK
        letter, mark = _letters(joined), _MARK[joined]
        n_letter, n_mark = np.add.reduceat(letter, first, dtype=np.int64), np.add.reduceat(mark, first, dtype=np.int64)
        back = np.add.reduceat(np.r_[mark[:-1] & letter[1:], False], first, dtype=np.int64)
        simple = (n_letter > 0) & (n_letter + n_mark + (joined[first] == _SPACE) == size) & (back == 0) & self.simple
        word, marked, rest = (np.flatnonzero(x) for x in (simple & (n_mark == 0), simple & (n_mark > 0), ~simple))
        out = np.zeros(len(at), np.uint64)
        if len(word):
            out[word] = self._learn_words(joined[np.repeat(simple & (n_mark == 0), step)], size[word])
            self.memory.add(keys[word], out[word])
        if len(rest):
            out[rest] = self._learn_any([raw[a : a + n].decode() for a, n in zip(at[rest].tolist(), size[rest].tolist())])
            self.memory.add(keys[rest], out[rest])
        if len(marked):
            at, size, n_mark = at[marked], size[marked], n_mark[marked]
            both = np.column_stack([self._look(raw, at, size - n_mark), self._look(raw, at + size - n_mark, n_mark)]).ravel()
            count = (both & _LOW).astype(np.int64)
            ids = self.memory.ids[_inside((both >> _HALF).astype(np.int64), count)]
            out[marked] = self.memory.keep(ids, count[::2] + count[1::2])
            self.memory.add(keys[marked], out[marked])
        return out

    def _look(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the chunks of ``raw``; those not known are learnt."""
        out = np.zeros(len(at), np.uint64)
        fits = size <= SHORT
        short = np.flatnonzero(fits)
        keys = short_keys(raw, at[short], size[short])
        out[short], gone = self.memory.find(keys)
        new = short[gone]
        if len(new):
            keys = keys[gone]
            order = np.argsort(_mix(keys))
            sorted_keys = keys[order]
            begins = np.r_[True, _other(sorted_keys[1:], sorted_keys[:-1])]
            once = order[begins]
            out[new[order]] = self._learn(raw, at[new[once]], size[new[once]], keys[once])[np.cumsum(begins) - 1]
        if len(short) < len(at):
            where = np.flatnonzero(~fits)
            long = [raw[a : a + n] for a, n in zip(at[where].tolist(), size[where].tolist())]
            fresh = [c for c in dict.fromkeys(long) if c not in self.memory.long]
            found = dict(zip(fresh, self._learn_any([c.decode() for c in fresh]).tolist())) if fresh else {}
            out[where] = np.array([found[c] if c in found else self.memory.long[c] for c in long], np.uint64)
            self.memory.long.update((c, p) for c, p in found.items() if len(c) <= _LONG)
        return out

    def _some(self, texts: Sequence[str | None], bodies: list[bytes], tail: bytes) -> Iterator[bytes]:
        if self.memory.rows + len(self.memory.long) > self.limit or self.memory.used > 8 * self.limit:
            self.memory = _Memory()
        raw = b"".join(bodies) + bytes(24)
        if self.lowered and b"\xcc" not in raw and b"\xcd" not in raw:  # accents that follow some small letters only
            raw = raw.lower()
        ends = np.cumsum([len(b) for b in bodies])
        starts, n = np.r_[0, ends[:-1]], int(ends[-1])
        byte = np.frombuffer(raw, np.uint8)[:n]
        white = (byte == _SPACE) | (byte == _BREAK)
        whole = np.array([bool(t) and any(s in t for s in self.spaced) for t in texts])
        filled = np.flatnonzero(ends > starts)
        last = ends[filled] - 1
        whole[filled[white[last] & ((last == starts[filled]) | white[last - 1])]] = True
        three = np.flatnonzero(white[:-2] & white[1:-1] & white[2:])
        of = np.searchsorted(ends, three, side="right")
        whole[of[three + 2 < ends[of]]] = True
        begin = white.copy()
        begin[starts[filled]] = True
        if not self.lowered:  # a line break is a piece of its own
            begin[1:] |= byte[:-1] == _BREAK
        at = np.flatnonzero(begin)
        size = np.diff(np.r_[at, n])
        if self.lowered:  # white space has no ids
            skip = white[at]
            at, size = at + skip, size - skip
            at, size = at[size > 0], size[size > 0]
        edge = np.r_[np.searchsorted(at, starts), len(at)]
        place = self._look(raw, at, size)
        for i in np.flatnonzero(place == np.uint64(_WHOLE)).tolist():
            whole[np.searchsorted(edge, i, side="right") - 1] = True
            place[i] = 0
        count = (place & _LOW).astype(np.int64)
        ids = self.memory.ids[_inside((place >> _HALF).astype(np.int64), count)].tobytes()
        cut = (4 * np.r_[0, np.cumsum(count)][edge]).tolist()
        for t, a, b, lone in zip(texts, cut, cut[1:], whole.tolist()):
            yield (self._encode([t])[0] if lone else ids[a:b]) + tail

    def __call__(self, texts: Sequence[str | None], end: int) -> list[bytes]:
        """Each text's ids followed by ``end``; a null text counts as empty."""
        tail = end.to_bytes(4, "little")
        out, held, bodies, size = [], [], [], 0
        for t in texts:
            held.append(t), bodies.append((t or "").encode())
            size += len(bodies[-1])
            if size >= _GROUP:
                out += self._some(held, bodies, tail)
                held, bodies, size = [], [], 0
        if held:
            out += self._some(held, bodies, tail)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of a public tokenizer file, or of a path; a worker process keeps it between tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name if "/" in name else public_path(name))
    return _ENCODERS[name]


def public_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; call it inside the task."""
    import public_tokenizers

    return public_tokenizers.path(name)
