"""Token ids of whole texts by the tokenizers library, with a memo of words where the vocabulary allows it.

A vocabulary that drops white space, lower-cases, and never joins characters
across white space, from a letter to a mark or next to a digit (``WORD_LEVEL``,
compared on load) gives a text the ids of its pieces in order.  Pieces repeat:
Arrow numbers the distinct ones of many texts at once, and each worker keeps the
ids of those it has met (a bounded memo, cleared when full) and asks the library
for new ones alone.  Texts that may hold a special token, and all texts under
any other vocabulary, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import utf8

#: Twice the pieces a worker remembers before it starts anew; about 200 MB.
MEMO = 1_600_000
#: Bytes of text that are cut into pieces at once.
AT_ONCE = 12 << 20

#: Normalizer and pre-tokenizer under which pieces are independent of each other.
WORD_LEVEL = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK, _DIGIT, _MARK, _LETTER, _WIDE = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _WIDE
#: Second bytes, after 0xC3, of the Latin-1 letters (all but the signs of multiplication and division).
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
#: Words that are one piece for the model itself: small letters of ASCII and Latin-1.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The characters that byte-level vocabularies write for bytes: printable ones themselves, the k-th other one as 256 + k.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SAME)))}
_KINDS, _FOLDED = _KIND.tobytes(), _FOLD.tobytes()
_encoders: dict[str, "Encoder"] = {}


def _bytes(a: pa.BinaryArray) -> list[bytes]:
    """As ``to_pylist`` of an array without nulls, by slices of one string."""
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)
    data = a.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes()
    return [data[i:j] for i, j in pairwise((off - off[0]).tolist())]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.size = size
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        self.by_words = all(stated.get(k) == v for k, v in WORD_LEVEL.items()) and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        self.special = [t["content"] for t in stated.get("added_tokens", [])]
        self.by_words = self.by_words and all(self.special)
        common = os.path.commonprefix(self.special)
        self.special = [common] if common else self.special
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros(MEMO + 1, np.int64)  # ids of piece i: ids[at[i]:at[i + 1]]

    def _learn(self, pieces: list[bytes]) -> None:
        got, rest, tokenize = [], [], self.tokenizer.model.tokenize
        for x in pieces:
            if x.isalpha() or _PLAIN.fullmatch(x):  # of ASCII, or with Latin-1
                got.append([t.id for t in tokenize(x.decode() if x.isascii() else x.decode("latin1").translate(_BYTES))])
            else:
                rest.append(len(got))
                got.append(())
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)):
                got[i] = e.ids
        k, lengths = len(self.memo), np.fromiter(map(len, got), np.int64, len(got))
        if k + len(pieces) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(k + len(pieces) + 1 - len(self.at), np.int64)])
        self.at[k + 1 : k + 1 + len(pieces)] = self.at[k] + np.cumsum(lengths)
        end = int(self.at[k + len(pieces)])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), self.dtype)])
        self.ids[int(self.at[k]) : end] = np.fromiter(chain.from_iterable(got), self.dtype, int(lengths.sum()))
        self.memo.update(zip(pieces, range(k, k + len(pieces))))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memo numbers of all pieces, and pieces in each text."""
        if len(self.memo) > MEMO // 2:
            self._reset()
        data, offsets = utf8(texts)
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        solid = kind != _BLANK
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[begins] = solid[begins]
        # a mark after a letter, and either side of a digit
        at = np.flatnonzero(kind == _MARK)
        at = at[at > 0]
        before = kind[at - 1]
        letter = before == _LETTER
        wide = np.flatnonzero((before == _WIDE) & (at > 1))
        letter[wide] = (data[at[wide] - 2] == 0xC3) & _LATIN[data[at[wide] - 1]]
        first[at[letter]] = True
        digit = np.flatnonzero(kind == _DIGIT)
        first[digit] = True
        after = digit[digit + 1 < len(data)] + 1
        first[after[(kind[after] != _BLANK) & (kind[after] != _WIDE)]] = True
        starts = np.flatnonzero(first[solid])
        counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
        if not len(starts):
            return np.zeros(0, np.int64), counts
        packed = data[solid].tobytes().translate(_FOLDED)
        # equal pieces meet before any becomes a Python object
        off = np.append(starts, len(packed)).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(packed)]).dictionary_encode()
        keys = _bytes(own.dictionary)
        numbers = np.fromiter(map(self.memo.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = np.arange(len(self.memo), len(self.memo) + len(new))
            self._learn([keys[i] for i in new.tolist()])
        return numbers[own.indices.to_numpy()], counts

    def _by_words(self, texts: pa.Array, wanted: bool) -> tuple[np.ndarray | None, np.ndarray]:
        which, counts = self._pieces(texts)
        begin, size = self.at[which], self.at[which + 1] - self.at[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        lengths = total[ends] - total[ends - counts]
        return (self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)] if wanted else None), lengths

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(lengths.sum())), lengths

    def _all(self, texts: pa.Array, wanted: bool) -> tuple[np.ndarray | None, np.ndarray]:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if not self.by_words:
            return self._whole(texts)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._by_words(texts, wanted)
        flat, lengths = self._by_words(pc.if_else(pa.array(special), "", texts.cast(pa.string())), wanted)
        own, n = self._whole(texts.filter(pa.array(special)))
        lengths = lengths.copy()
        lengths[special] = n
        if not wanted:
            return None, lengths
        out = np.empty(int(lengths.sum()), self.dtype)
        there = np.repeat(special, lengths)
        out[there], out[~there] = own, flat
        return out, lengths

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Ids in each text; null counts as empty."""
        return self._all(texts, False)[1]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and ids in each text; ``end`` follows each text if given."""
        flat, lengths = self._all(texts, True)
        if end is None:
            return flat, lengths
        out = np.empty(len(flat) + len(lengths), self.dtype)
        closing = np.cumsum(lengths + 1) - 1
        keep = np.ones(len(out), bool)
        keep[closing] = False
        out[keep], out[closing] = flat, end
        return out, lengths + 1


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
