"""Token ids of whole texts with a tokenizer file, memoised by word.

For a byte-level BPE file whose texts are cut by its own standard pattern,
a new unit always starts where a space or newline follows another character. So
a text of words parted by spaces and newlines has the ids of its words (each
with the white space before it), one after the other, and the ids of a
word are found once and remembered. Words of letters that are new are
merged together, a pair of each in a round (``_merge``); others are asked of the tokenizer.
Texts with other white space, a NUL or a special token in them, and all texts for other
tokenizer files, are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker at most (about 250 bytes each): as many new ones as old ones.
CACHE_WORDS = 250_000
#: Bytes of the longest words that are merged together; longer ones go to the tokenizer's model.
MERGED_BYTES = 32

_ATOM = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
# White space other than these, and NUL, which marks keys.
_OTHER = ["\0", *(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
# Marks after a letter and before white space or the end are a unit of their own.
_MARKS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+)( |\z)"
_NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept with what it remembers for as long as the worker lives."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plan = json.loads(self.tokenizer.to_str())
        pre = plan.get("pre_tokenizer") or {}
        self.by_word = (not plan.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                        and not pre.get("add_prefix_space") and not plan.get("truncation") and not plan.get("padding"))
        self.special = [t["content"] for t in plan.get("added_tokens", [])]
        if self.by_word:
            self._read_merges(plan["model"])
        # Ids by word: its key is the word itself if it stands after one space, the word with the line ends before it,
        # or else "\0" and all of it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _read_merges(self, model: dict) -> None:
        """Pairs of ids in order, with their rank and the id made; none unless bytes are merged by rank alone."""
        vocab, pairs = model["vocab"], [p.split(" ") if isinstance(p, str) else p for p in model.get("merges", [])]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        shown = [chr(_VISIBLE.get(b, b)) for b in range(256)]
        self.pairs = None
        if plain and pairs and all(c in vocab for c in shown) and len(set(map(tuple, pairs))) == len(pairs):
            self.bytes = np.array([vocab[c] for c in shown], np.int32)
            self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
            self.span = max(vocab.values()) + 1
            pairs = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
            # A hash table of four places a pair and more: a pair whose place is taken is in the next free one.
            self.bits = 64 - int(4 * len(pairs)).bit_length()
            self.pairs, self.ranks = np.full(2 << (63 - self.bits), -1, np.int64), np.full(2 << (63 - self.bits), _NONE)
            left, at = np.arange(len(pairs), dtype=np.int32), self._place(pairs)
            while len(left):
                free = np.flatnonzero(self.pairs[at] < 0)
                free = free[np.unique(at[free], return_index=True)[1]]
                self.pairs[at[free]], self.ranks[at[free]] = pairs[left[free]], left[free]
                left, at = np.delete(left, free), np.delete(at, free) + 1 & len(self.pairs) - 1
            every = self.bytes.astype(np.int64)
            self.of_bytes = self._rank(np.repeat(every, 256), np.tile(every, 256))

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * self.span + right
        at = self._place(pair)
        held = self.pairs[at]
        more = np.flatnonzero((held != pair) & (held >= 0))
        while len(more):
            at[more] = at[more] + 1 & len(self.pairs) - 1
            held[more] = self.pairs[at[more]]
            more = more[(held[more] != pair[more]) & (held[more] >= 0)]
        return np.where(held == pair, self.ranks[at], _NONE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        plain, spaced = [], []
        for k, t in enumerate(texts):
            if not self.by_word or any(c in t for c in (_OTHER_ASCII if t.isascii() else _OTHER)) or any(s in t for s in self.special):
                out[k] = self._whole(t)
            elif "  " in t or "\n " in t or " \n" in t or t[:1] == " " or t[-1:] == " ":
                spaced.append((k, [_key(a) for a in _ATOM.findall(t)]))
            else:
                plain.append(k)
        parted = pa.array([_parted(texts[k]) for k in plain], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring_regex(parted, _MARKS, "\\1 \0\\2\\3"), " ")
        words = cut.values.dictionary_encode()
        ids = self._learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        every, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        kind = words.indices.to_numpy()
        ends = np.cumsum(sizes[kind])
        start = np.repeat(begin[kind] - (ends - sizes[kind]), sizes[kind])
        got = every[start + np.arange(len(start))].tobytes()
        ends = np.concatenate([[0], ends])[cut.offsets.to_numpy()] * 4
        for k, a, b in zip(plain, ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = got[a:b]
        for k, keys in spaced:
            out[k] = b"".join(self._learn(keys))
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, keys: list[str]) -> list[bytes]:
        """The ids of all ``keys``, which are in ``known`` then."""
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, keys))
        todo, letters, units, joined = [w for w, ids in zip(keys, found) if ids is None], [], [], []
        for key in todo:  # which grows
            ids = older.get(key)
            if ids is not None:
                known[key] = ids
            elif key.isalpha():
                letters.append(key)
                units.append((" " + key).encode())
            elif key not in known:
                atom = _atom(key)
                if len(parts := [_key(a) for a in _atoms(atom)]) > 1:
                    joined.append((key, parts))
                    todo += [p for p in parts if p not in known]
                elif atom.isalpha():
                    letters.append(key)
                    units.append(atom.encode())
                else:
                    known[key] = self._whole(atom)
        known.update(zip(letters, self._letters(units)))
        for key, parts in reversed(joined):
            known[key] = b"".join([known[p] for p in parts])
        return [known[w] if ids is None else ids for w, ids in zip(keys, found)]

    def _letters(self, units: list[bytes]) -> list[bytes]:
        """A word of letters alone (UTF-8), perhaps after a space, is one unit, which needs no cutting."""
        if self.pairs is not None:
            short = [k for k, u in enumerate(units) if 0 < len(u) <= MERGED_BYTES]
        else:
            short = []
        out: list = [None] * len(units)
        for k, ids in zip(short, self._merge([units[k] for k in short])):
            out[k] = ids
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = array("I", [t.id for t in self.model.tokenize(_visible(units[k]))]).tobytes()
        return out

    def _merge(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit. In a round every unit merges the first of its pairs of least rank, as long as it has one;
        units of n bytes join in when those of more have n symbols left, so that a round's units make a matrix."""
        out: list = [None] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join([units[k] for k in order.tolist()]), np.uint8)
        ends = np.cumsum(sizes[order])
        sizes = sizes[order]
        at = 0
        unit, ids, rank = order[:0], np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for n in range(int(sizes[0]) if len(units) else 0, 0, -1):
            to = int(np.searchsorted(-sizes, -n, "right"))
            if to > at:
                new = flat[ends[at] - n:ends[to - 1]].reshape(-1, n)
                ids_new, rank_new = self.bytes[new], self.of_bytes[new[:, :-1].astype(np.int64) * 256 + new[:, 1:]]
                unit, ids, rank = ((np.concatenate(p) for p in ((unit, order[at:to]), (ids, ids_new), (rank, rank_new)))
                                   if len(unit) else (order[at:to], ids_new, rank_new))
                at = to
            if not len(unit):
                continue
            rows = np.arange(len(unit))
            first = rank.argmin(1) if n > 1 else np.zeros(len(unit), np.int64)
            best = rank[rows, first] if n > 1 else np.full(len(unit), _NONE)
            done = best == _NONE
            whole = ids[done].astype("<u4").tobytes()
            for k, u in enumerate(unit[done].tolist()):
                out[u] = whole[4 * n * k:4 * n * (k + 1)]
            go = ~done
            unit, first, best, ids, rank = unit[go], first[go], best[go], ids[go], rank[go]
            if not len(unit):
                continue
            rows, places = rows[:len(unit)], np.arange(n - 1)
            ids = np.where(places <= first[:, None], ids[:, :-1], ids[:, 1:])
            ids[rows, first] = made = self.made[best]
            rank = np.where(places[:-1] < first[:, None], rank[:, :-1], rank[:, 1:])
            r = np.flatnonzero(first > 0)
            rank[r, first[r] - 1] = self._rank(ids[r, first[r] - 1], made[r])
            r = np.flatnonzero(first < n - 2)
            rank[r, first[r]] = self._rank(made[r], ids[r, first[r] + 1])
        return out


# A byte-level vocabulary writes each byte as a visible character: itself, or the next one from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_VISIBLE = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _visible(unit: bytes) -> str:
    return unit.decode("latin-1").translate(_VISIBLE)


def _parted(text: str) -> str:
    """A text of words with single spaces or line ends between, with a space before line ends and a NUL at its start."""
    if "\n" in text:
        text = text.replace("\n", " \n")
        while "\n \n" in text:
            text = text.replace("\n \n", "\n\n")
    return "\0" + text


def _key(atom: str) -> str:
    if atom[:1] == "\n":
        return atom
    return atom[1:] if atom[:1] == " " and atom[1:2] != "\n" else "\0" + atom


def _atom(key: str) -> str:
    if key[:1] == "\0":
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def _atoms(atom: str) -> list[str]:
    """The parts of a word that are encoded each on its own: the line ends before it (the last one by itself), and
    the marks at its end if these follow a letter."""
    bare = atom.lstrip("\n")
    lines = len(atom) - len(bare)
    if not bare or lines and bare[0] == " ":
        return [atom]
    out = ["\n" * (lines - 1)] * (lines > 1) + ["\n"] * (lines > 0)
    word = bare.rstrip(string.punctuation)
    return out + ([word, bare[len(word):]] if word and word != bare and word[-1].isalpha() else [bare])
