"""Token ids of whole texts with a public tokenizer, with a bounded cache of words.

No pre-token and no normalisation of these tokenizers crosses a space or line end, so a
text's ids are those of its words on end. The first `CACHE_WORDS` words that a process
meets stay in its cache, which thereby holds the frequent ones; others are encoded once
a batch. A text with an angle-bracket bar, the mark of special tokens, is encoded whole.
Columns of texts are taken apart by arrays: words are told apart by their hashes, and ids
are gathered from tables of arrays (`Runs`), which hold the first `KEPT_WORDS` words that a
process meets. Of other words, the letters and the stops behind them are parts with a table
of their own; only words of another kind become Python strings.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from quillon.llm.words import _BYTE, run_hashes, utf8
from quillon.llm.words import words as split_words

#: Words, and pre-tokens of other words, that a process keeps for lists of texts, about 120 MB in all.
CACHE_WORDS, CACHE_PARTS = 400_000, 200_000
#: The same for columns of texts, about 60 MB in all (16-bit ids, 8 of them a word at most on average).
KEPT_WORDS, KEPT_PARTS, KEPT_IDS = 1_000_000, 500_000, 8
#: Places of a table that are looked at for one hash, besides the first.
PROBES = 8
#: Bytes of new words that are taken apart at once; longer words become Python strings.
FRESH_BYTES, LONG = 1 << 18, 256
#: Pre-tokens encoded in one call: the library holds about 100 bytes for each of their tokens.
ENCODE_AT_ONCE = 10_000
END_ID = 1
#: Fixed value: the pattern of tokenizers for which plain words may skip the normaliser.
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True
#: The first byte of À to ÿ, and the second bytes of × and ÷ among them.
_LATIN, _TIMES, _OVER = 0xC3, 0x97, 0xB7


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs at .. at + size of values, on end."""
    upto = np.cumsum(size)
    return values[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


class Runs:
    """Ids by hash: an open table of at most `most` hashes, and their ids on end.

    What does not find room is not kept; its ids then lie behind the kept ones until others
    are put there.
    """

    def __init__(self, most: int, kind):
        self.most, self.bits = most, (2 * most).bit_length()
        places = (1 << self.bits) + PROBES + 1
        self.hash, self.at, self.size = np.zeros(places, np.uint64), np.zeros(places, np.uint32), np.zeros(places, np.uint8)
        self.ids, self.count, self.used = np.zeros(KEPT_IDS * most, kind), 0, 0

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes (not 0) in the table, -1 where it lacks them."""
        place = self._first(h)
        left = np.flatnonzero(self.hash[place] != h)
        for _ in range(PROBES):
            empty = self.hash[place[left]] == 0
            place[left[empty]] = -1
            left = left[~empty]
            place[left] += 1
            left = left[self.hash[place[left]] != h[left]]
        place[left] = -1
        return place

    def put(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Takes the ids of different hashes that the table lacks, on end; returns where they lie
        until the next call."""
        room = KEPT_IDS * self.most - self.used
        left = np.flatnonzero((size < 256) & (np.cumsum(size) <= room))[: self.most - self.count]
        place, kept = self._first(h), np.zeros(len(h), bool)
        for _ in range(PROBES + 1):
            free = left[self.hash[place[left]] == 0]
            self.hash[place[free]] = h[free]
            kept[free[self.hash[place[free]] == h[free]]] = True
            left = left[~kept[left]]
            place[left] += 1
        # Those with a place in the table lie first.
        order = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept)])
        at = np.empty(len(h), np.int64)
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(ids), self.ids.dtype)])
        self.ids[self.used : end] = gather(ids, (np.cumsum(size) - size)[order], size[order])
        self.at[place[kept]], self.size[place[kept]] = at[kept], size[kept]
        self.used, self.count = self.used + int(size[kept].sum()), self.count + int(kept.sum())
        return at

    def where(self, h: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Where in `ids` those of hashes lie, and how many they are. make: a function from
        indices of different hashes to their ids, on end, and how many each has."""
        h = np.maximum(h, np.uint64(1))
        place = self.find(h)
        at, size = self.at[place].astype(np.int64), self.size[place].astype(np.int64)
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            kinds, first, which = np.unique(h[lacking], return_index=True, return_inverse=True)
            ids, sizes = make(lacking[first])
            at[lacking], size[lacking] = self.put(kinds, ids, sizes)[which], sizes[which]
        return at, size


class Words:
    """A tokenizer that encodes words, and this process's cache of them."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # Such a tokenizer makes a plain word lower case and one pre-token, its stops another.
        self.plain = None
        mark = parts["model"].get("end_of_word_suffix")
        if kinds == ["NFC", "Replace", "Lowercase"] and splits == [PLAIN_SPLIT, None] and mark:
            self.closes = np.zeros(self.full.get_vocab_size(), bool)
            self.closes[[k for w, k in parts["model"]["vocab"].items() if w.endswith(mark)]] = True
            self.plain = Tokenizer(self.full.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        kind = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.pieces = Runs(KEPT_WORDS, kind), Runs(KEPT_PARTS, kind)

    def whole(self, some: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in self.full.encode_batch_fast(some, add_special_tokens=False)]

    def joined(self, parts: list[str]) -> list[bytes]:
        """Ids of plain pre-tokens, encoded as one text with spaces between: the last token
        of each, and no other, has the mark of a word's end."""
        out: list[bytes] = []
        for k in range(0, len(parts), ENCODE_AT_ONCE):
            some = " ".join(parts[k : k + ENCODE_AT_ONCE])
            ids = np.array(self.plain.encode_batch_fast([some], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        if self.plain is None:
            return dict(zip(words, self.whole(words), strict=True))
        bare, marked, rest = [], [], []
        for w in words:
            if w.isascii() and w.isalpha():
                bare.append(w)
            elif m := _PLAIN.fullmatch(w):
                marked.append((w, m[1].lower(), m[2]))
            else:
                rest.append(w)
        low = [w.lower() for w in bare]
        known = self.parts
        parts = set(low)
        parts.update(a for _, a, _ in marked)
        parts.update(b for _, _, b in marked)
        parts = list(parts.difference(known))
        more = dict(zip(parts, self.joined(parts), strict=True))
        if len(known) + len(more) <= CACHE_PARTS:
            known.update(more)
        have = known.get
        out = dict(zip(bare, [b if (b := have(w)) is not None else more[w] for w in low], strict=True))
        for w, a, stop in marked:
            x, y = have(a), have(stop)
            out[w] = (more[a] if x is None else x) + (more[stop] if y is None else y)
        out.update(zip(rest, self.whole(rest), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # the collector would walk the cache again and again
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        get = cache.get
        split = [None if "<|" in t else t.replace("\n", " ").split(" ") for t in texts]
        # One look-up a word; only words that the cache lacks are gone through again.
        found = [None if ws is None else list(map(get, ws)) for ws in split]
        lacking: set[str] = set()
        for ws, fs in zip(split, found, strict=True):
            if fs is not None and None in fs:
                lacking.update([w for w, f in zip(ws, fs, strict=True) if f is None])
        more = self.fresh(list(lacking)) if lacking else {}
        out = []
        for t, ws, fs in zip(texts, split, found, strict=True):
            if fs is None:
                out.append(self.whole([t])[0])
            elif None in fs:
                out.append(b"".join([more[w] if f is None else f for w, f in zip(ws, fs, strict=True)]))
            else:
                out.append(b"".join(fs))
        if len(cache) + len(more) <= CACHE_WORDS:
            cache.update(more)
        return out

    def _joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `joined`, of runs of bytes, none of which ends the data: ids on end, and how many
        each run has."""
        ids, sizes = [], []
        for k in range(0, len(start), ENCODE_AT_ONCE):
            a, size = start[k : k + ENCODE_AT_ONCE], (end - start)[k : k + ENCODE_AT_ONCE] + 1
            text = gather(data, a, size)
            text[np.cumsum(size) - 1] = 32
            ids.append(np.array(self.plain.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.closes[ids[-1]]), prepend=-1))
            if len(sizes[-1]) != len(a):
                raise ValueError("parts and word ends differ")
        return np.concatenate(ids), np.concatenate(sizes)

    def _fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (runs of bytes) on end, and how many each has."""
        n = end - start
        if self.plain is None or not len(n):
            plain = np.zeros(len(n), bool)
        else:
            upto = np.cumsum(n)
            begin = upto - n
            raw = gather(data, start, n)
            tail = np.append(False, raw[:-1] == _LATIN) & (raw != _TIMES) & (raw != _OVER)
            letter = _LETTER[raw] | tail
            letter[:-1] |= tail[1:]
            stop = _STOP[raw]
            back = letter & np.append(False, stop[:-1])
            back[begin] = False
            letters = np.add.reduceat(letter, begin, dtype=np.int64)
            plain = (letters > 0) & (letters + np.add.reduceat(stop, begin, dtype=np.int64) == n) & (np.add.reduceat(back, begin, dtype=np.int64) == 0)
        flat, sizes = [], np.zeros(len(n), np.int64)
        if plain.any():
            # Small letters, and after them the stops of words that have some.
            low = np.append(raw + np.where(((raw >= 65) & (raw <= 90)) | (tail & (raw < 0x9F)), 32, 0).astype(np.uint8), np.uint8(32))
            mid, to = (begin + letters)[plain], upto[plain]
            marked = mid < to
            a, b = np.concatenate([begin[plain], mid[marked]]), np.concatenate([mid, to[marked]])
            at, size = self.pieces.where(run_hashes(_BYTE[low], a, b), lambda k: self._joined(low, a[k], b[k]))
            both = np.zeros((2, 2, len(mid)), np.int64)
            both[:, 0], both[:, 1, marked] = (at[: len(mid)], size[: len(mid)]), (at[len(mid) :], size[len(mid) :])
            at, size = both[0].T.ravel(), both[1].T.ravel()
            flat.append(gather(self.pieces.ids, at, size))
            sizes[plain] = both[1].sum(0)
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = self.whole([data[i:j].tobytes().decode() for i, j in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
            sizes[rest] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat.append(np.frombuffer(b"".join(ids), "<u4"))
        # Plain words lie before the others; each goes to its place.
        order = np.concatenate([np.flatnonzero(plain), rest])
        at = np.empty(len(n), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate(flat).astype(self.words.ids.dtype), at, sizes), sizes

    def fresh_runs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_fresh`, some `FRESH_BYTES` of words at a time; long words one by one."""
        n = end - start
        parts, at = [], 0
        group = np.cumsum(n) // FRESH_BYTES
        cuts = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (n > LONG) | np.append(False, n[:-1] > LONG)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(n)], strict=True):
            if n[i] > LONG:
                ids = np.frombuffer(self.whole([data[start[i] : end[i]].tobytes().decode()])[0], "<u4")
                parts.append((ids, np.array([len(ids)])))
            else:
                parts.append(self._fresh(data, start[i:j], end[i:j]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(2))

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (32 bits) of each text of a column; null is empty."""
        data, offsets = utf8(column)
        found = list(split_words(data, offsets, fold=False))
        n = len(column)
        if found:
            h, doc, start, end = (np.concatenate([f[k] for f in found]) for k in range(4))
            at, size = self.words.where(h, lambda k: self.fresh_runs(data, start[k], end[k]))
            ids = gather(self.words.ids, at, size).astype("<u4")
            cuts = np.append(0, np.cumsum(size))[np.searchsorted(doc, np.arange(n + 1))]
        else:
            ids, cuts = np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for k in np.unique(np.searchsorted(offsets, mark, side="right") - 1).tolist() if len(mark) else ():
            out[k] = np.frombuffer(self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode()])[0], "<u4")
        return out


def _kept(path: str | None) -> Words:
    kept = sys.__dict__.setdefault("_quillon_tokens", {})
    if path not in kept:
        kept.clear()
        kept[path] = Words(path)
    return kept[path]


def forget() -> None:
    """Free this process's cache, for operators that need its memory."""
    sys.__dict__.pop("_quillon_tokens", None)
    trim()


def trim() -> None:
    """Give memory that earlier tasks freed in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):  # glibc has it, musl does not
            libc.malloc_trim(0)


def vocabulary(path: str | None = None) -> int:
    """One more than the largest id."""
    return _kept(path).full.get_vocab_size()


def encoder(path: str | None = None):
    """A function from a list of texts to a list of bytes: little-endian unsigned 32-bit ids.

    path: a tokenizer file of the `tokenizers` library that drops white space and lets no
    token cross it; None takes the public ``word_bpe_49k.json`` of the executor. The cache
    outlives a task where Spark keeps its Python workers.
    """
    trim()
    return _kept(path).encode


def column_encoder(path: str | None = None):
    """A function from a column of texts to a list of arrays of ids; see `encoder`."""
    trim()
    return _kept(path).encode_column
