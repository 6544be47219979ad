"""Subword ids of many words at once from a public tokenizer file.

White space never joins tokens in the two word-wise vocabularies used here, so
a text's ids are the ids of its words one after the other, and each different
word needs encoding once. Words of plain letters, digits and punctuation are
merged together in numpy, one merge a word and round, by the file's merge
ranks; all other words (apostrophes, combining marks, rare scripts, special
tokens) go through the tokenizers library. Both give the library's ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from tokenizers import Tokenizer

SIMPLE_BELOW = 0x250  # code points that the numpy path may handle
NONE = np.int32(1 << 30)


class WordEncoder:
    """``path``: a tokenizers file of byte-level BPE. ``word_ends``: its symbols have
    an end-of-word mark and it lower-cases (pieces: letter runs, single digits,
    other runs). Otherwise a word is read with a space before it and digits run."""

    def __init__(self, path: str, word_ends: bool = True, most: int = 1 << 20):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not word_ends
        self.word_ends = word_ends
        self.most = most
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        names = _byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in names], np.int32) if word_ends else self.inner
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self._index(a << 20 | b)
        self._classes()
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing: slot -> (pair, rank), as few probes as the longest run."""
        bits = 19
        self.shift = np.uint64(64 - bits)
        self.slots, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left, at, self.probes = np.arange(len(keys))[::-1], self._slot(keys)[::-1], 0
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            mine = self.slots[at] == keys[left]
            self.ranks[at[mine]] = left[mine]
            left, at, self.probes = left[~mine], (at[~mine] + 1) & ((1 << bits) - 1), self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.ranks[at], NONE)
        miss = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        for _ in range(1, self.probes):
            if not len(miss):
                break
            at_m = at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            hit = self.slots[at_m] == keys[miss]
            out[miss[hit]] = self.ranks[at_m[hit]]
            miss = miss[~hit & (self.slots[at_m] >= 0)]
        return out

    def _classes(self) -> None:
        """Per code point (the last entry stands for all others): class (0 end of word,
        1 letter, 2 digit, 3 other, 9 not simple) and the code point as encoded."""
        self.cls, self.low = np.full(SIMPLE_BELOW + 1, 9, np.uint8), np.arange(SIMPLE_BELOW + 1, dtype=np.uint32)
        for c in range(0x21, SIMPLE_BELOW):
            ch = chr(c)
            low = ch.lower() if self.word_ends else ch
            kind = unicodedata.category(ch)
            if len(low) != 1 or ord(low) >= SIMPLE_BELOW or unicodedata.normalize("NFC", ch) != ch or kind[0] in "CZM" or c == 0x27:
                continue
            self.cls[c], self.low[c] = (1 if kind[0] == "L" else 2 if kind[0] == "N" else 3), ord(low)
        self.cls[10] = 0

    def encode(self, words: list[bytes], block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of ``words`` and where each word's ids begin (one more at the end).
        Blocks are small enough to stay in the processor's cache."""
        parts = [self._encode(words[k:k + block]) for k in range(0, len(words), block)] or [self._encode([])]
        sizes = np.cumsum([0] + [len(p[0]) for p in parts])
        return (np.concatenate([p[0] for p in parts]),
                np.concatenate([[0]] + [p[1][1:] + k for p, k in zip(parts, sizes)]))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer(b"\n".join(words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        cp = np.minimum(cp, SIMPLE_BELOW)
        cls = self.cls[cp]
        word = np.cumsum(cp == 10)
        hard = np.zeros(len(words), bool)
        hard[word[cls == 9]] = True
        if self.word_ends:  # special tokens are spelt in plain characters
            bar = np.flatnonzero((cp[1:] == 0x7C) & (cp[:-1] == 0x3C))
            hard[word[bar]] = True
        keep = (cls > 0) & ~hard[word] if len(words) else np.zeros(0, bool)
        cp, cls, word = self.low[cp[keep]], cls[keep], word[keep]
        ids, owner = self._merge(cp, cls, word)
        slow = np.flatnonzero(hard)
        if len(slow):
            prefix = "" if self.word_ends else " "
            got = [e.ids for e in self.library.encode_batch(
                [prefix + words[i].decode("utf-8", "replace") for i in slow], add_special_tokens=False)]
            ids = np.concatenate([ids, np.array([x for g in got for x in g], np.int32)])
            owner = np.concatenate([owner, np.repeat(slow, [len(g) for g in got])])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.searchsorted(owner, np.arange(len(words) + 1))

    def _merge(self, cp: np.ndarray, cls: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        new_word = np.concatenate([[True], word[1:] != word[:-1]])
        new = new_word | np.concatenate([[True], cls[1:] != cls[:-1]])
        if self.word_ends:
            new |= cls == 2
        space = 0 if self.word_ends else 1
        wide = (cp >= 0x80).astype(np.int64)
        n_bytes = 1 + wide + (new_word * space)
        end = np.cumsum(n_bytes)
        byte = np.zeros(int(end[-1]), np.uint8)
        byte[end - 1] = np.where(wide, 0x80 | cp & 0x3F, cp)
        byte[(end - 2)[wide > 0]] = 0xC0 | cp[wide > 0] >> 6
        if space:
            byte[(end - n_bytes)[new_word]] = 0x20
        piece = np.repeat(np.cumsum(new) - 1, n_bytes)
        piece_word = word[new]
        sym = self.inner[byte]
        last = np.concatenate([piece[1:] != piece[:-1], [True]])
        sym[last] = self.final[byte[last]]
        rank = np.full(len(sym), NONE, np.int32)
        pair = np.flatnonzero(~last)
        rank[pair] = self._rank(sym[pair], sym[pair + 1])
        done_sym, done_piece = [], []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            rep = np.repeat(best, size)
            over = rep == NONE
            done_sym.append(sym[over])
            done_piece.append(piece[over])
            if over.any():
                sym, rank, piece, rep = sym[~over], rank[~over], piece[~over], rep[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == rep)
            hit = hit[np.concatenate([[True], piece[hit[1:]] != piece[hit[:-1]]])]  # the leftmost of each piece
            sym[hit] = self.merged[rank[hit]]
            rank[hit] = rank[hit + 1]  # NONE where the pair was the piece's last
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, rank, piece = sym[stay], rank[stay], piece[stay]
            right = moved[np.append(piece[1:] == piece[:-1], False)[moved]]
            rank[right] = self._rank(sym[right], sym[right + 1])
            left = moved[(moved > 0)]
            left = left[piece[left - 1] == piece[left]] - 1
            rank[left] = self._rank(sym[left], sym[left + 1])
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return sym[order], piece_word[piece[order]].astype(np.int64)

    def of(self, words: list[bytes], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of a chunk of texts, each different word encoded once:
        flat ids, and the number of ids of each word. Keeps at most ``most`` words.
        With ``codes``, ``words`` are the different ones and the chunk is ``words[codes]``."""
        if len(self.known) > self.most:
            self.known, self.ids, self.begin = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        known = self.known
        fresh = [w for w in (set(words) if codes is None else words) if w not in known]
        if fresh:
            ids, begin = self.encode(fresh)
            known.update(zip(fresh, range(len(self.begin) - 1, len(self.begin) - 1 + len(fresh))))
            self.begin = np.concatenate([self.begin, begin[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        w = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if codes is not None:
            w = w[codes]
        n = self.begin[w + 1] - self.begin[w]
        end = np.cumsum(n)
        at = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n) + np.repeat(self.begin[w], n)
        return self.ids[at], n


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]
