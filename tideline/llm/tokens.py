"""Token ids of whole texts by the tokenizers library, each word once.

Texts of Latin letters, digits and ASCII marks are lower-cased and cut into pieces here, as the
vocabulary's own rules say, for whole blocks of bytes at a time. Pieces are told apart by 64-bit
hashes; only those that a process hasn't met go through the library's merges, thousands in one call. The ids
of a block are then gathered from the hash table of known pieces. Texts with any other character are cut
at white space, across which the vocabulary never joins, and those parts go through the whole library.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np

from .common import LOWER, SPACE, WordHasher, groups_of, text_bytes

#: Pieces and parts a process remembers; beyond that it forgets parts, and pieces that didn't come back.
MEMORY, PARTS = 300_000, 50_000
HALF = (1 << 32) - 1
BLOCK = 2 << 20
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_OWN = np.zeros(256, bool)
_OWN[[*range(0x21, 0x7F), 0x20, *range(0x09, 0x0E)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = True
_GAP, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[SPACE], _CLASS[48:58] = _GAP, _DIGIT
_CLASS[97:123] = _CLASS[128:] = _LETTER


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _foreign(data: np.ndarray) -> np.ndarray:
    """Positions of bytes of anything but printable ASCII, ASCII white space and Latin-1 letters."""
    good = _OWN[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    lead = lead[_LATIN[data[lead + 1]]]
    good[lead] = good[lead + 1] = True
    return np.flatnonzero(~good)


def _pieces(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece: runs of letters, single digits, runs of marks; 's 't 'm 'd 're 've 'll stand alone
    where no other mark is before them."""
    n = len(low)
    kind = _CLASS[low]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    start = kind != _GAP
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | head[1:n]
    stop = head[1:].copy()  # the text ends after this byte
    at = np.flatnonzero(start & (low == 39))
    at = at[at + 1 < n]
    at = at[~stop[at]]
    one = low[at + 1]
    two = np.where((at + 2 < n) & ~stop[at + 1], low[np.minimum(at + 2, n - 1)], 0)
    size = np.where(np.isin(one, list(b"stmd")), 2, 0)
    size[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 3
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    after = at + size
    inside = (after < n) & ~stop[after - 1]
    after = after[inside]
    start[after[kind[after] == _LETTER]] = True
    end = stop | (kind != _GAP)
    end[:-1] &= stop[:-1] | start[1:] | (kind[1:] == _GAP)
    end &= kind != _GAP
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def encoder(path: str) -> "Encoder":
    """The encoder of this Python process, which remembers pieces from one task to the next."""
    held = sys.modules.setdefault("_tideline_encoders", types.ModuleType("_tideline_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Encoder:
    """Texts to ids, for a vocabulary of words whose file is at `path`."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = rules["pre_tokenizer"]["pretokenizers"]
        if pre[0]["pattern"]["Regex"] != _SPLIT or pre[1]["type"] != "ByteLevel" or rules["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} doesn't split words as expected")
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        if any(re.search(rb"\s", t) for t in self.special):
            raise ValueError("a special token has white space in it")
        vocab = rules["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.merges = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.hasher = WordHasher()
        self.parts: dict[bytes, np.ndarray] = {}
        self.ids = np.zeros(0, "<u4")
        self.clear(MEMORY)

    def clear(self, room: int) -> None:
        """An empty table of known pieces, for `room` of them: a slot has a piece's hash, where its ids begin in `ids` (upper half) and
        how many there are (lower half; -1: free), and whether a later block had it again."""
        power = (2 * room).bit_length()
        self.shift, self.key, self.value = np.uint64(64 - power), np.zeros(1 << power, np.uint64), np.full(1 << power, -1, np.int64)
        self.again, self.known = np.zeros(1 << power, bool), 0

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Enter pieces that aren't in the table, each once."""
        if 2 * (self.known + len(hashes)) > len(self.key):
            old, again = self.value >= 0, self.key[self.again]
            known, found = self.key[old], self.value[old]
            self.clear(len(known) + len(hashes))
            self.put(known, found)
            self.again[self.find(again)[1]] = True
        self.known += len(hashes)
        at = (hashes >> self.shift).view(np.int64)
        while len(at):
            free = self.value[at] < 0
            self.key[at[free]], self.value[at[free]] = hashes[free], values[free]  # of several for one slot the last stays
            left = self.value[at] != values
            hashes, values, at = hashes[left], values[left], (at[left] + 1) & (len(self.key) - 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each piece, -1 where it isn't known, and its slot."""
        at = (hashes >> self.shift).view(np.int64)
        value = self.value.take(at)
        open_ = np.flatnonzero((self.key.take(at) != hashes) & (value >= 0))
        while len(open_):
            here = at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            value[open_] = self.value[here]
            open_ = open_[(self.key[here] != hashes[open_]) & (value[open_] >= 0)]
        return value, at

    def forget(self) -> None:
        """Forget all pieces but those that a later block had again since the last time (half of MEMORY at most), as most new ones never come back."""
        keep = np.flatnonzero(self.again)[: MEMORY // 2]
        hashes, begin, size = self.key[keep], self.value[keep] >> 32, self.value[keep] & HALF
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(begin - ends + size, size) + np.arange(size.sum())]
        self.clear(MEMORY)
        self.put(hashes, ends - size << 32 | size)

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Learn new pieces by the library's merges alone. A piece ends at an id that ends a word."""
        all_ids, sizes = [self.ids], []
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            text = b" ".join(some)
            if text.isascii():
                text = text.decode()
            else:  # 0x20 stays itself, so that pieces stay apart
                text = " ".join(text.decode("latin-1").translate(self.letters | {32: " "}).split(" "))
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word has no last token")
            all_ids.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        size = np.concatenate(sizes)
        self.put(hashes, len(self.ids) + np.cumsum(size) - size << 32 | size)
        self.ids = np.concatenate(all_ids)

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, and n + 1 offsets."""
        low = LOWER[data]
        lead = np.flatnonzero(low == 0xC3) + 1
        lead = lead[lead < len(low)]
        low[lead] += (low[lead] < 0x9F).astype(np.uint8) * 32
        starts, ends = _pieces(low, offs)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        h = self.hasher(low, starts, ends)
        if self.known > MEMORY:
            self.forget()
        value, at = self.find(h)
        new = np.flatnonzero(value < 0)
        self.again[at] = value >= 0
        if len(new):
            own, first = np.unique(h[new], return_index=True)
            first = new[first]
            raw = low.tobytes()
            self.learn(own, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            value[new] = self.find(h[new])[0]
        size = value & HALF
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat((value >> 32) - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offs)]

    def whole(self, text: bytes) -> np.ndarray:
        """Ids of any text, by its parts between white space."""
        parts = text.split()
        new = list(set(parts).difference(self.parts))
        if new:
            if len(self.parts) > PARTS:
                self.parts.clear()
                new = list(set(parts))
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)
            self.parts.update((p, np.array(e.ids, "<u4")) for p, e in zip(new, found))
        return np.concatenate([np.zeros(0, "<u4"), *[self.parts[p] for p in parts]])

    def encode(self, column) -> list[np.ndarray]:
        """Ids (little-endian 32-bit) of every text of a string column; a null counts as empty."""
        data, offs = text_bytes(column)
        out: list[np.ndarray] = []
        for i, j in groups_of(np.diff(offs), BLOCK):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            foreign = _foreign(part)
            odd = np.searchsorted(foreign, o[1:]) > np.searchsorted(foreign, o[:-1])
            raw = None
            if (part == 60).any() and any(t in (raw := part.tobytes()) for t in self.special):
                odd |= np.array([any(raw.find(t, a, b) >= 0 for t in self.special) for a, b in zip(o[:-1].tolist(), o[1:].tolist())])
            if not odd.any():
                ids, cuts = self.block(part, o)
            else:
                keep = ~np.repeat(odd, np.diff(o))
                ids, cuts = self.block(part[keep], np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(o)))]))
            raw = part.tobytes() if odd.any() else None
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                out.append(self.whole(raw[o[k] : o[k + 1]]) if odd[k] else ids[a:b])
        return out
