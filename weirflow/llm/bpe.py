"""Rank-synchronous byte-pair merging in numpy, and the word caches of two public tokenizers built on it.

Many sequences of symbols lie in one flat array. In each step every sequence applies its pair of lowest rank, at all
places at once, and neighbours' ranks are looked up anew; finished sequences leave. Applying all places of a pair at
once equals the sequential order as long as the new symbol can't take part in a pair of lower or equal rank; symbols
that can (RISKY) are merged at their leftmost place alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex

from . import ragged as rg

_NONE = np.int32(0x7FFFFFFF)
#: Words held by a worker; a fuller cache starts anew.
CACHE_WORDS = 400_000


class PairTable:
    """(left, right) -> rank and merged symbol, by open addressing; looked up as whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = left.astype(np.uint64) << np.uint64(24) | right.astype(np.uint64)
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64((1 << 64) - 1), np.uint64)
        self.rank, self.merged = np.full(1 << self.bits, _NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        todo, self.probes = np.arange(len(key)), 0
        while len(todo):
            at = self._slot(key[todo], self.probes)
            free = self.keys[at] == np.uint64((1 << 64) - 1)
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            win = one[free[one]]
            self.keys[at[win]], self.rank[at[win]], self.merged[at[win]] = key[todo[win]], rank[todo[win]], merged[todo[win]]
            left_over = np.ones(len(todo), bool)
            left_over[win] = False
            todo, self.probes = todo[left_over], self.probes + 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.uint64) << np.uint64(24) | right.astype(np.uint64)
        rank, merged = np.full(len(key), _NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for probe in range(self.probes):
            at = self._slot(key[todo], probe)
            held = self.keys[at]
            hit = held == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            todo = todo[~hit & (held != np.uint64((1 << 64) - 1))]
            if not len(todo):
                break
        return rank, merged


def merge_all(symbols: np.ndarray, offs: np.ndarray, table: PairTable, risky: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of every sequence once no pair is left to merge."""
    n = len(offs) - 1
    sym, seq = symbols.astype(np.int32), np.repeat(np.arange(n), np.diff(offs))
    rank, new = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner], new[inner] = table.find(sym[inner], sym[inner + 1])
    done_sym, done_seq = [], []
    while len(sym):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        sizes = np.diff(np.r_[first, len(sym)])
        best = np.minimum.reduceat(rank, first)
        going = np.repeat(best != _NONE, sizes)
        if not going.all():
            done_sym.append(sym[~going])
            done_seq.append(seq[~going])
            best = np.repeat(best, sizes)[going]
            sym, seq, rank, new = sym[going], seq[going], rank[going], new[going]
            if not len(sym):
                break
        else:
            best = np.repeat(best, sizes)
        at = np.flatnonzero(rank == best)
        start = np.r_[True, np.diff(at) != 1]
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
        if risky is not None:
            again = np.r_[False, seq[at[1:]] == seq[at[:-1]]]
            at = at[~(again & risky[new[at]])]
        sym[at] = new[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        # The merged symbol has a new pair to its right, and its left neighbour has one with it.
        moved = np.cumsum(keep) - 1
        sym, seq, rank, new = sym[keep], seq[keep], rank[keep], new[keep]
        mark = np.zeros(len(sym) + 1, bool)
        mark[moved[at]] = mark[moved[at] - 1] = True
        touched = np.flatnonzero(mark[:-1])
        rank[touched] = _NONE
        touched = touched[touched < len(sym) - 1]
        touched = touched[seq[touched] == seq[touched + 1]]
        rank[touched], new[touched] = table.find(sym[touched], sym[touched + 1])
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
    order = np.argsort(seq, kind="stable")
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(seq, minlength=n), out=out[1:])
    return sym[order], out


class PieceCounter:
    """Token counts as sentencepiece gives them for a BPE model with byte fallback, a dummy prefix and no normalisation."""

    SPACE = "▁"

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("a model with another kind of normalisation or without byte fallback")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(self.SPACE in p.lstrip(self.SPACE) for p in score):
            raise ValueError("pieces reach over the beginning of a word")
        names = {p: i for i, p in enumerate(score)}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, rank, merged, risky = [], [], [], [], np.zeros(len(names) + 5, bool)
        for p, i in names.items():
            for c in range(1, len(p)):
                a, b = names.get(p[:c]), names.get(p[c:])
                for part, text in ((a, p[:c]), (b, p[c:])):
                    if part is not None and c and len(text) > 1 and score[text] <= score[p]:
                        risky[part] = True
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(levels[score[p]]), merged.append(i)
        self.table = PairTable(*(np.array(x, np.int64) for x in (left, right, rank, merged)))
        self.risky = risky
        # A character without a piece stands for as many byte tokens as it has bytes.
        self.of_char = len(names) + np.repeat(np.array([1, 2, 3, 4], np.int32), [0x80, 0x780, 0xF800, 0x100000])
        for p, i in names.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.cost = np.ones(len(names) + 5, np.int64)
        self.cost[len(names) + 1 :] = [1, 2, 3, 4]
        self.known: dict[str, int] = {}

    def _learn(self, missing: list[str]) -> None:
        text = [self.SPACE + w.replace(" ", self.SPACE) for w in missing]
        offs = np.zeros(len(text) + 1, np.int64)
        np.cumsum([len(t) for t in text], out=offs[1:])
        sym, at = merge_all(self.of_char[np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)], offs, self.table, self.risky)
        total = np.r_[0, np.cumsum(self.cost[sym])]
        self.known.update(zip(missing, (total[at[1:]] - total[at[:-1]]).tolist(), strict=True))

    def counts(self, texts: Iterable[str]) -> list[int]:
        words = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        missing = {w for ws in words for w in ws} - self.known.keys()
        if missing:
            self._learn(list(missing))
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in words]

    def words(self, text: str) -> list[str]:
        """Pre-tokens, without the space each begins with: a word with all but one of the spaces before it."""
        if not text:
            return []
        text = text.replace(self.SPACE, " ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [w[1:] for w in regex.findall(r" +[^ ]*", " " + text)]


#: Bytes of words whose form, case and class are plain: ASCII but for the apostrophe, and the letters of Latin-1.
_LATIN_LEAD = 0xC3
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x20, 0x7F), _LATIN_LEAD, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_PLAIN[ord("'")] = False
#: How they make pre-tokens: runs of letters, single digits, runs of others.
_LETTER, _DIGIT, _OTHER = range(3)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = _LETTER
_KINDS[range(ord("0"), ord("9") + 1)] = _DIGIT


class Ragged:
    """Runs of numbers by number, in one array that grows."""

    def __init__(self, kind: type):
        self.data, self.at, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 12, np.int64), 0

    def append(self, values: np.ndarray, offs: np.ndarray) -> int:
        """Adds values[offs[i] : offs[i + 1]] of each i; the number of the first."""
        first, new, end = self.n, len(offs) - 1, int(self.at[self.n]) + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(2 * end - len(self.data), self.data.dtype)])
        if first + new >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(2 * (first + new) + 2 - len(self.at), np.int64)])
        self.data[self.at[first] : end] = values
        self.at[first + 1 : first + new + 1] = self.at[first] + offs[1:]
        self.n += new
        return first

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of numbers one after another, and their sizes."""
        first, sizes = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        return self.data[np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())], sizes


class WordTable:
    """Word -> number by open addressing, looked up as whole arrays.

    A word of WIDE bytes at most is told from all others by its first and last eight bytes and its length.
    """

    WIDE = 16

    def __init__(self, bits: int = 14):
        self.bits, self.n = bits, 0
        self.first, self.last = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size, self.number = np.zeros(1 << bits, np.uint8), np.full(1 << bits, -1, np.int32)

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        eight, size = rg.eights(data), ends - starts
        last = eight[np.maximum(ends - 8, 0)]
        last[size < 8] = 0
        return eight[starts] & rg.KEPT[np.minimum(size, 8)], last, size.astype(np.uint8)

    @staticmethod
    def mixed(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        return rg.LANE_A.join(first ^ (last >> np.uint64(7)), last + size)

    def _slots(self, mixed: np.ndarray, probe: int) -> np.ndarray:
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it isn't there."""
        out, todo, probe = np.full(len(first), -1, np.int32), np.arange(len(first)), 0
        while len(todo):
            at = self._slots(mixed[todo], probe)
            found = self.number[at]
            hit = (self.first[at] == first[todo]) & (self.last[at] == last[todo]) & (self.size[at] == size[todo]) & (found >= 0)
            out[todo[hit]] = found[hit]
            todo, probe = todo[~hit & (found >= 0)], probe + 1
        return out

    def add(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Words that are distinct and new."""
        if 3 * (self.n + len(first)) > 1 << self.bits:
            held, old = self.number >= 0, (self.first, self.last, self.size, self.number)
            self.__init__((3 * (self.n + len(first))).bit_length())
            self.add(*(x[held] for x in old))
        todo, probe, mixed = np.arange(len(first)), 0, self.mixed(first, last, size)
        self.n += len(first)
        while len(todo):
            at = self._slots(mixed[todo], probe)
            free = np.flatnonzero(self.number[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            win, at = todo[free[one]], at[free[one]]
            self.first[at], self.last[at], self.size[at], self.number[at] = first[win], last[win], size[win], number[win]
            left = np.ones(len(todo), bool)
            left[free[one]] = False
            todo, probe = todo[left], probe + 1


def distinct(first: np.ndarray, last: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, which of them each word is)."""
    _, place, which = np.unique(mixed, return_index=True, return_inverse=True)
    if all((x[place][which] == x).all() for x in (first, last, size)):
        return place, which
    _, place, which = np.unique(np.stack([first, last, size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    return place, which


class WordEncoder:
    """Token ids as the tokenizers library gives them for a lower-casing BPE with word ends.

    Pre-tokens never cross a space or a line feed, so ids are held by word, and by pre-token. Words of ASCII and Latin-1
    letters are merged here; words with any other character, with an apostrophe, or with what may begin a special token,
    are the library's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.table = PairTable(left, right, np.arange(len(pairs)), merged)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.table_of_words, self.long_words, self.of_word = WordTable(), {}, Ragged(np.uint16)
        self.tokens, self.of_token = {}, Ragged(np.uint16)

    def _learn(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of new words, which are the bytes flat[at[i] : at[i + 1]]."""
        after = np.r_[flat[1:], np.uint8(0)]
        odd = ~_PLAIN[flat]
        odd[1:] |= (flat[:-1] == _LATIN_LEAD) != ((flat[1:] & 0xC0) == 0x80)
        strange = np.add.reduceat(odd | (flat == ord("<")) & (after == ord("|")), at[:-1]) > 0 if len(flat) else np.zeros(len(at) - 1, bool)
        strange &= at[1:] > at[:-1]
        number = np.zeros(len(at) - 1, np.int64)
        some = np.flatnonzero(strange)
        if len(some):
            found = [np.array(self.library.encode(flat[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint16) for i in some]
            number[some] = self.of_word.append(np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])]) + np.arange(len(some))
        plain = np.flatnonzero(~strange)
        if len(plain):
            number[plain] = self.of_word.append(*self._merged(*spans(flat, at[plain], at[plain + 1]))) + np.arange(len(plain))
        return number

    def _merged(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after another and their offsets by word; every byte is in a pre-token."""
        low = rg.ascii_lower(flat)
        latin = np.flatnonzero(flat[:-1] == _LATIN_LEAD) + 1
        low[latin] += ((low[latin] < 0x9F)).astype(np.uint8) * np.uint8(0x20)
        kind = _KINDS[low]
        begins = np.ones(len(low) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[at] = True
        offs = np.flatnonzero(begins).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(low)]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        number = np.fromiter((self.tokens.get(t, -1) for t in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [distinct[i] for i in new]
            cuts = np.r_[0, np.cumsum([len(t) for t in fresh])]
            raw = np.frombuffer(b"".join(fresh), np.uint8)
            symbols = self.inner[raw]
            symbols[cuts[1:] - 1] = self.last[raw[cuts[1:] - 1]]
            ids, cuts = merge_all(symbols, cuts, self.table)
            number[new] = self.of_token.append(ids.astype(np.uint16), cuts) + np.arange(len(new))
            self.tokens.update(zip(fresh, number[new].tolist(), strict=True))
        ids, sizes = self.of_token.take(number[found.indices.to_numpy()])
        return ids, np.r_[0, np.cumsum(sizes)][np.searchsorted(offs, at)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 data and its offsets by text) one after another, and the number of each text's."""
        if self.of_word.n > CACHE_WORDS:
            self._forget()
        starts, ends, at = rg.words(data, offs, _BETWEEN)
        number = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(ends - starts <= WordTable.WIDE)
        keys = WordTable.keys(data, starts[short], ends[short])
        mixed = WordTable.mixed(*keys)
        found = self.table_of_words.find(*keys, mixed)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys = [x[new] for x in keys]
            place, which = distinct(*keys, mixed[new])
            numbers = self._learn(*spans(data, starts[short[new[place]]], ends[short[new[place]]]))
            self.table_of_words.add(*(x[place] for x in keys), numbers)
            found[new] = numbers[which]
        number[short] = found
        rest = np.flatnonzero(ends - starts > WordTable.WIDE)
        if len(rest):
            raw = data.tobytes()
            words = [raw[i:j] for i, j in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            missing = list(dict.fromkeys(w for w in words if w not in self.long_words))
            if missing:
                cuts = np.r_[0, np.cumsum([len(w) for w in missing])]
                self.long_words.update(zip(missing, self._learn(np.frombuffer(b"".join(missing), np.uint8), cuts).tolist(), strict=True))
            number[rest] = [self.long_words[w] for w in words]
        ids, sizes = self.of_word.take(number)
        total = np.r_[0, np.cumsum(sizes)]
        return ids, total[at[1:]] - total[at[:-1]]


_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x0A]] = True


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[starts[i] : ends[i]] one after another, and offsets."""
    sizes = ends - starts
    at = np.r_[0, np.cumsum(sizes)]
    return data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at
