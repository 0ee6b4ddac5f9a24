"""Byte-pair merges of a sentencepiece model over flat numpy arrays of symbols.

A text, its white space written as U+2581 after a leading one, falls apart where
two characters stand together in no piece of the vocabulary: no merge crosses
such a place.  The parts ("words") repeat; Arrow numbers the distinct ones, a
bounded memo in each worker keeps their ids, and the merges run over new words
alone, all at once: in each round every word's least pair rank is found by a
segmented minimum, its occurrences are merged from the left, and the arrays are
compacted; words without a pair left drop out.

Ranks follow scores, so a merge may give rise to a pair of a rank no worse than
its own, which has to come before the word's other occurrences.  The pieces
after which that can happen are known from the vocabulary (``risky``); their
leftmost occurrence is merged alone.  Words of over ``LONG`` symbols (long runs of
blanks, or of letters without one) would need as many rounds as they have
different pairs; they are merged one pair at a time from a heap.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import utf8

#: Bytes of text that are cut into words at once.
AT_ONCE = 2 << 20
#: Words a worker remembers before it starts anew.
MEMO = 500_000
LONG = 512
#: Symbols that are merged side by side.
SIDE = 1 << 20
_NONE = np.iinfo(np.int32).max
_models: dict[str, "Pieces"] = {}


class Pieces:
    """A model of kind BPE whose normalizer changes nothing but white space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        m = schema.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = schema.ModelProto.SentencePiece
        spec, kept = m.normalizer_spec, (kinds.NORMAL, kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)
        if m.trainer_spec.model_type != schema.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.denormalizer_spec.precompiled_charsmap or any(p.type not in kept for p in m.pieces):
            raise ValueError("only BPE models with a leading blank, all blanks kept, no character rules and no user-defined or unused pieces")
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.begin, self.end = (next(i for i, p in enumerate(m.pieces) if p.piece == x) for x in (m.trainer_spec.bos_piece, m.trainer_spec.eos_piece))
        own = {p.piece.replace("▁", " "): i for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        at_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        spelled = lambda c: [at_byte[b] for b in c.encode()] if len(at_byte) == 256 else [self.unknown]

        # symbols: pieces by id, then characters that pieces hold and that are none
        chars = sorted({c for p in own for c in p})
        lone = [c for c in chars if c not in own]
        symbols = own | {c: len(m.pieces) + k for k, c in enumerate(lone)}
        self.names = {i: p for p, i in symbols.items()}
        order = np.unique([-m.pieces[i].score for i in own.values()])
        rank = {p: int(np.searchsorted(order, -m.pieces[i].score)) for p, i in own.items()}
        keys, risky = [], set()
        for p, i in own.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    keys.append((a << 32 | b, rank[p], i))
                    risky.update(x for x in (p[:k], p[k:]) if x in rank and rank[x] >= rank[p])
        keys.sort()
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*keys) if keys else ((), (), ()), (np.int64, np.int32, np.int32)))
        self.risky = np.zeros(len(m.pieces) + len(lone), bool)
        self.risky[[own[p] for p in risky]] = True
        #: ids written for a symbol
        self.written = [[i] for i in range(len(m.pieces))] + [spelled(c) for c in lone]
        self.spelled = spelled

        # characters by number, and the pairs of them that stand together in some piece
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbol = np.array([-1] + [symbols[c] for c in chars], np.int32)
        n = self.n_chars = len(chars) + 1
        self.char = self.char if n * n < 1 << 31 else self.char.astype(np.int64)
        together = np.zeros(n * n, bool)
        for p in own:
            c = self.char[[ord(x) for x in p]].astype(np.int64)
            together[c[:-1] * n + c[1:]] = True
        self.together = np.packbits(together, bitorder="little")

        # for decoding: bytes of each id
        text = [b"" if p.type == kinds.CONTROL else m.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in m.pieces]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) for x in text])])
        self.control = np.array([p.type == kinds.CONTROL for p in m.pieces])
        self.is_byte = np.array([p.type == kinds.BYTE for p in m.pieces])
        self.blank = np.array([p.type == kinds.NORMAL and p.piece.startswith("▁") for p in m.pieces])
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)  # ids of word i: ids[at[i]:at[i + 1]]

    # merging

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging symbols a and b; rank _NONE where they do not merge."""
        if not len(self.keys):
            return np.full(len(a), _NONE, np.int32), np.zeros(len(a), np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def rounds(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all words in a row, and of each, from the words' symbols in a row; no word is empty."""
        name, count = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        done_names, done_syms = [], []
        starts = np.cumsum(sizes) - sizes
        rank, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.ones(len(sym), bool)
        inner[starts + sizes - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], into[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(name):
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                stay = np.repeat(~done, sizes)
                done_names.append(name[done]), done_syms.append(sym[~stay])
                count[name[done]] = sizes[done]
                sym, rank, into = sym[stay], rank[stay], into[stay]
                name, sizes, least = name[~done], sizes[~done], least[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(name):
                    break
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.flatnonzero(rank == least[of])
            word = of[at]
            # overlapping occurrences (a a a): every second one from the left of their run
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            place = np.arange(len(at))
            keep = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
            first = np.ones(len(at), bool)
            first[1:] = word[1:] != word[:-1]
            wary = np.maximum.reduceat(self.risky[into[at]], np.flatnonzero(first))[np.cumsum(first) - 1]
            keep &= first | ~wary
            at, word = at[keep], word[keep]
            sym[at] = into[at]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            sym, rank, into, changed = sym[left], rank[left], into[left], changed[left]
            starts = np.cumsum(sizes) - sizes
            rank[changed] = _NONE
            rank[starts + sizes - 1] = _NONE
            changed[starts + sizes - 1] = False
            at = np.flatnonzero(changed)
            rank[at], into[at] = self._pairs(sym[at], sym[at + 1])
        # words in their own order again
        names = np.concatenate(done_names) if done_names else np.zeros(0, np.int64)
        flat = np.concatenate(done_syms) if done_syms else np.zeros(0, np.int32)
        begin = np.zeros(len(count), np.int64)
        begin[names] = np.cumsum(count[names]) - count[names]
        total = np.cumsum(count)
        return flat[np.arange(len(flat)) + np.repeat(begin - (total - count), count)], count

    def one_by_one(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word: the best pair, the leftmost of equal ones, from a heap."""
        n = len(sym)
        s, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        table = getattr(self, "_table", None)
        if table is None:
            table = self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        heap = [(*table[k], i, k) for i, k in enumerate((sym[:-1].astype(np.int64) << 32 | sym[1:]).tolist()) if k in table]
        heap = [(r, i, k, m) for r, m, i, k in heap]
        heapq.heapify(heap)
        while heap:
            r, i, k, m = heapq.heappop(heap)
            j = after[i] if s[i] >= 0 else n
            if j >= n or s[i] << 32 | s[j] != k:
                continue
            s[i], s[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (got := table.get(key := s[a] << 32 | s[after[a]])):
                    heapq.heappush(heap, (got[0], a, key, got[1]))
        return np.array([x for x in s if x >= 0], np.int32)

    def _learn(self, words: list[bytes]) -> None:
        whole = b"".join(words)
        data = np.frombuffer(whole, np.uint8)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        n_bytes = np.fromiter(map(len, words), np.int64, len(words))
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        sizes = np.diff(lead[np.concatenate([[0], np.cumsum(n_bytes)])])
        sym = self.symbol[self.char[points]]
        begin = np.cumsum(sizes) - sizes
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, ids in each, ids
        odd = np.flatnonzero(sym[begin] < 0)  # a character of no piece is a word of its own
        if len(odd):
            ids = [self.spelled(words[k].decode()) for k in odd.tolist()]
            parts.append((odd, np.array([len(x) for x in ids]), np.array(list(chain.from_iterable(ids)), np.int32)))
        long_ = np.flatnonzero(sizes > LONG)
        for k in long_.tolist():
            parts.append((np.array([k]), *self._written(self.one_by_one(sym[begin[k] : begin[k] + sizes[k]]), None)))
        rest = np.flatnonzero((sym[begin] >= 0) & (sizes <= LONG))
        total = np.cumsum(sizes[rest])
        cuts = [0, *np.searchsorted(total, np.arange(SIDE, int(total[-1]) if len(total) else 0, SIDE)).tolist(), len(rest)]
        for lo, hi in zip(cuts, cuts[1:]):
            own = rest[lo:hi]
            which = np.arange(int(sizes[own].sum())) + np.repeat(begin[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own])
            parts.append((own, *self._written(*self.rounds(sym[which], sizes[own]))))
        name, count, flat = (np.concatenate(x) for x in zip(*parts))
        ordered, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ordered[name], at[name] = count, np.cumsum(count) - count
        ends = np.cumsum(ordered)
        n = len(self.memo)
        self.memo.update(zip(words, range(n, n + len(words))))
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        self.ids = np.concatenate([self.ids, flat[np.arange(len(flat)) + np.repeat(at - (ends - ordered), ordered)]])

    def _written(self, sym: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids in each word, and all ids, from symbols; a character that is no piece itself is spelled out."""
        count = np.array([len(sym)]) if count is None else count
        if not len(sym) or int(sym.max()) < len(self.control):
            return count, sym
        ids = [self.written[x] for x in sym.tolist()]
        n = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return np.diff(n[np.concatenate([[0], np.cumsum(count)])]), np.array(list(chain.from_iterable(ids)), np.int32)

    # whole texts

    def encode(self, texts: pa.Array, begin: int | None = None, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and ids in each text; null counts as empty, ``begin`` and ``end`` surround each text's."""
        if len(self.memo) > MEMO:
            self._reset()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "▁", " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, offsets = utf8(texts)
        if not len(data):
            return self._closed(np.zeros(0, np.int32), np.zeros(len(texts), np.int64), begin, end)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character, its first byte
        kind = self.char[points]
        pair = kind[:-1] * self.n_chars + kind[1:]
        cut = np.ones(len(kind), bool)
        cut[1:] = (self.together[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
        cut[np.searchsorted(first, offsets[:-1][np.diff(offsets) > 0])] = True
        starts = first[cut]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names = words.dictionary.to_pylist()
        new = [x for x in names if x not in self.memo]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        size = self.at[number + 1] - self.at[number]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.at[number] - total[:-1], size)]
        return self._closed(flat, np.diff(total[np.searchsorted(starts, offsets)]), begin, end)

    @staticmethod
    def _closed(flat: np.ndarray, lengths: np.ndarray, begin: int | None, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        all_ = lengths + (begin is not None) + (end is not None)
        out, own = np.empty(int(all_.sum()), np.int32), np.ones(int(all_.sum()), bool)
        ends = np.cumsum(all_)
        if begin is not None:
            own[ends - all_], out[ends - all_] = False, begin
        if end is not None:
            own[ends - 1], out[ends - 1] = False, end
        out[own] = flat
        return out, all_

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of some lists of ids in a row: control ids give nothing, the leading blank goes, byte pieces join to characters, each byte that belongs to none becomes U+FFFD."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.control):
            raise ValueError("an id outside the vocabulary")
        begin, size = self.text_at[ids], self.text_at[ids + 1] - self.text_at[ids]
        # the first id that is not control gives up its blank
        of = np.repeat(np.arange(len(lengths)), lengths)
        real = np.flatnonzero(~self.control[ids])
        lead = real[np.unique(of[real], return_index=True)[1]]
        lead = lead[self.blank[ids[lead]]]
        begin[lead] += 1
        size[lead] -= 1
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.text[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)].tobytes()
        cuts = total[np.concatenate([[0], np.cumsum(lengths)])]
        # nothing may join over the end of a text, or over a control id inside it
        breaks = np.union1d(cuts, total[:-1][self.control[ids]])
        inside = breaks[breaks < len(data)]
        try:
            data.decode()
            whole = not np.any((np.frombuffer(data, np.uint8)[inside] & 0xC0) == 0x80)
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        where = np.searchsorted(breaks, cuts)
        breaks = breaks.tolist()
        return pa.array(["".join(_readable(data[breaks[k] : breaks[k + 1]]) for k in range(a, b)) for a, b in zip(where, where[1:])], pa.large_string())


def _readable(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def pieces(path: str) -> Pieces:
    """This worker's tables for a model file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]
