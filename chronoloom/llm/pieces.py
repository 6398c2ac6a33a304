"""Ids of many texts at once: texts are cut into pieces as whole vectors, and each distinct piece is encoded once.

The vocabulary's pattern cuts a text into pieces: ``'s`` and its like; a run of letters, of digits or of other signs, each with the space
before it; blanks. No id reaches over a piece's end, so a piece has the same ids wherever it stands. ``Pieces`` finds where pieces begin by comparing
the kinds of neighbouring bytes, and looks pieces of up to 15 bytes up by their bytes in a table of SLOTS places. What is not there is
encoded by ``packing.encoder`` and takes the place of what was, which moves to the place beside it. Kinds of signs beyond ASCII are asked of the tokenizer's own pattern engine.

Texts that hold an added token, or more than MOST bytes, go to ``packing.encoder`` whole. Memory: one slice of texts, and at most POOL ids of known pieces
beside those of the slice.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import text_buffer
from .packing import encoder

#: Places of the table (a power of two); bytes of text from which a text goes its own way; ids that are kept before the table starts anew.
SLOTS, MOST, POOL = 1 << 20, 4 << 20, 1 << 22
LETTER, DIGIT, SIGN, BLANK, UNKNOWN = range(5)
#: The low bytes of a number, for 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a piece that is looked up.
KEYED = 15


@functools.cache
def _engines() -> list:
    import tiktoken

    single = {bytes([k]): k for k in range(256)}
    return [(kind, tiktoken.Encoding(f"kind{kind}", pat_str=pat, mergeable_ranks=single, special_tokens={})) for kind, pat in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (BLANK, r"\s"))]


def kinds_of(points: list[int]) -> list[int]:
    """Kinds of code points, as the pattern's engine sees them."""
    found, text = dict.fromkeys(points, SIGN), "".join(map(chr, points))
    for kind, engine in _engines():
        found.update(dict.fromkeys(map(ord, bytes(engine.encode_ordinary(text)).decode()), kind))
    return [found[p] for p in points]


class Pieces:
    def __init__(self, tokenizer: str = "byte_bpe_50k.tiktoken"):
        import json

        import public_tokenizers

        self.encode = encoder(tokenizer)
        with open(public_tokenizers.path(tokenizer.removesuffix(".tiktoken").removesuffix(".json") + ".json"), encoding="utf-8") as f:
            self.added = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[:128] = kinds_of(list(range(128)))
        self.ascii = np.append(self.kinds[:128], np.full(128, UNKNOWN, np.uint8))
        (self.line,) = self.encode("\n").tolist()
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros((SLOTS, 3), np.uint64)  # a piece's first 8 bytes; the other 7 and its size; where its ids are
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of pieces, one after the other

    def begins(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and the kinds of bytes. data: UTF-8 and 16 bytes more; bounds: where texts begin, and the end."""
        n = int(bounds[-1])
        kind = self.ascii.take(data)
        lead = np.flatnonzero(data[:n] >= 0xC0)
        if len(lead):
            top = data[lead].astype(np.int32)
            more = 1 + (top >= 0xE0) + (top >= 0xF0)
            point = top & (0x3F >> more)
            tails = [np.flatnonzero(more >= k) for k in (1, 2, 3)]
            for k, own in enumerate(tails, 1):
                point[own] = point[own] << 6 | data[lead[own] + k] & 0x3F
            what = self.kinds.take(point)
            if (new := what == UNKNOWN).any():
                points = np.unique(point[new])
                self.kinds[points] = kinds_of(points.tolist())
                what = self.kinds.take(point)
            kind[lead] = what
            for k, own in enumerate(tails, 1):
                kind[lead[own] + k] = what[own]
        at = np.zeros(len(data), bool)
        np.not_equal(kind[1:n], kind[: n - 1], out=at[1:n])
        at[bounds] = False
        after = np.flatnonzero(at[1:n] & (kind[: n - 1] == BLANK)) + 1  # the first sign behind blanks of its text
        at[bounds] = True
        space = data[after - 1] == 0x20
        at[after[space]] = False
        last = after - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        at[last] = True  # the last of the blanks stands alone, or with what follows if it is a space
        quote = np.flatnonzero(data[:n] == 0x27)
        quote = quote[at[quote]]
        if len(quote):
            a, b = data[quote + 1], data[quote + 2]
            long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # 're 've 'll
            size = np.where(long, 2, (a == 115) | (a == 116) | (a == 109) | (a == 100))  # 's 't 'm 'd
            own = (size > 0) & (quote + 1 + size <= bounds[np.searchsorted(bounds, quote, "right")])
            at[quote[own] + 1] = False
            at[quote[own] + 1 + size[own]] = True
        return np.flatnonzero(at[:n]), kind

    def learn(self, pieces: list[bytes], blank: np.ndarray) -> np.ndarray:
        """Puts the ids of these pieces into the pool; for each, its first place there << 32 | its ids. Pieces that are not blanks are
        encoded as lines of one text: a line's end cuts as a text's does."""
        plain = np.flatnonzero(~blank)
        ids = self.encode("".join([pieces[k].decode() + "\n" for k in plain.tolist()]))
        ends = np.flatnonzero(ids == self.line)
        count = np.zeros(len(pieces), np.int64)
        count[plain] = np.diff(ends, prepend=-1) - 1
        parts = [ids[ids != self.line]]
        first = np.zeros(len(pieces), np.int64)
        first[plain] = np.cumsum(count[plain]) - count[plain]
        at = len(parts[0])
        for k in np.flatnonzero(blank).tolist():
            parts.append(self.encode(pieces[k].decode()))
            first[k], count[k] = at, len(parts[-1])
            at += len(parts[-1])
        while self.used + at > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + at] = np.concatenate(parts)
        first += self.used
        self.used += at
        return (first << 32 | count).astype(np.uint64)

    def many(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = int(bounds[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        if self.used > POOL:
            self.clear()
        at, kind = self.begins(data, bounds)
        ends = np.append(at[1:], n)
        size = ends - at
        every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the 8 bytes from each byte on
        low = every[at] & _LOW.take(np.minimum(size, 8))
        high = every[np.minimum(at + 8, len(every) - 1)] & _LOW.take(np.clip(size - 8, 0, 7)) | size.astype(np.uint64) << np.uint64(56)
        mixed = (low ^ high * _M1) * _M2
        mixed ^= mixed >> np.uint64(32)
        slot = ((mixed * _M1) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        found = self.table.take(slot, axis=0)
        known = (found[:, 0] == low) & (found[:, 1] == high)
        held = found[:, 2].copy()
        known[size > KEYED] = False
        raw, blank = data.tobytes(), kind[ends - 1] == BLANK

        def texts(own):
            return [raw[a:b] for a, b in zip(at[own].tolist(), ends[own].tolist(), strict=True)]

        todo = np.flatnonzero(~known & (size <= KEYED))
        found = self.table[slot[todo] ^ 1]
        done = (found[:, 0] == low[todo]) & (found[:, 1] == high[todo])
        held[todo[done]] = found[done, 2]
        todo = todo[~done]
        while len(todo):
            where = slot[todo]
            places, k = np.unique(where, return_index=True)
            new = todo[k]
            full = places[self.table[places, 1] > 0]
            self.table[full ^ 1] = self.table[full]
            self.table[places] = np.column_stack([low[new], high[new], self.learn(texts(new), blank[new])])
            found = self.table[where]
            done = (found[:, 0] == low[todo]) & (found[:, 1] == high[todo])
            held[todo[done]] = found[done, 2]
            todo = todo[~done]
        long = np.flatnonzero(size > KEYED)
        if len(long):
            ranks: dict[bytes, int] = {}
            own = np.array([ranks.setdefault(p, len(ranks)) for p in texts(long)])
            k = np.unique(own, return_index=True)[1]
            held[long] = self.learn(list(ranks), blank[long[k]])[own]
        held = held.astype(np.int64)
        count = held & 0xFFFFFFFF
        ahead = np.append(0, np.cumsum(count))
        ids = self.pool.take(np.repeat((held >> 32) - ahead[:-1], count) + np.arange(ahead[-1]))
        return ids, np.diff(ahead[np.searchsorted(at, bounds)])

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array of strings), one after the other, and how many each has. A null has none."""
        import pyarrow as pa

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.fill_null("") if texts.null_count else texts
        own, bounds = text_buffer(texts)
        apart = np.diff(bounds) > MOST
        raw = own.tobytes()
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                apart[np.searchsorted(bounds, k, "right") - 1] = True
                k = raw.find(token, k + 1)
        if not apart.any():
            return self.many(np.append(own, np.zeros(16, np.uint8)), bounds)
        rest, counts = self(texts.filter(pa.array(~apart)))
        count = np.zeros(len(texts), np.int64)
        count[~apart] = counts
        parts, ahead = [], np.cumsum(count) - count
        for a, b in zip(np.append(0, np.flatnonzero(apart) + 1), np.append(np.flatnonzero(apart), len(texts)), strict=True):
            parts.append(rest[ahead[a] if a < len(texts) else len(rest) : ahead[b] if b < len(texts) else len(rest)])
            if b < len(texts):
                parts.append(self.encode(texts[int(b)].as_py()))
                count[b] = len(parts[-1])
        return np.concatenate(parts), count


@functools.cache
def pieces(tokenizer: str = "byte_bpe_50k.tiktoken") -> Pieces:
    """One for each worker, so that what a task has met is known to the next."""
    return Pieces(tokenizer)
