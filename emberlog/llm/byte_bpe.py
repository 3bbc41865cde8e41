"""Byte-level BPE encoding with the tokenizers library, a distinct word at a time.

Merges never cross the words into which the pre-tokenizer splits a text. The
split is done for whole batches of texts in numpy, over classes of characters
(letter, number, white space, other) that the library itself is asked for once
a character; the library then encodes each distinct word once for a worker.
Ids are those of the library for the whole text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

#: Words in the table of a worker at most, and their bytes.
TABLE_WORDS, TABLE_BYTES = 1_500_000, 1 << 25
#: Words given to the library at once.
AT_ONCE = 20_000
#: Odd factor of the hash by which equal words of a batch are found, and its inverse modulo 2**64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
QUOTE, BLANK = 39, 32


class Encoder:
    """Encodes with the tokenizer file at path, which must split as byte-level BPE does."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        #: Whether texts may be split here: byte-level split, nothing that changes or moves text before it.
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec["normalizer"] is None
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        #: The library without its own split, for words that have been split.
        self.merges = Tokenizer.from_file(path)
        if self.by_words:
            self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: An added token (and its id) that the library cuts out wherever it stands.
        self.mark = next(((t["content"], t["id"]) for t in spec["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"])), None)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.powers = self.inverses = np.zeros(0, np.uint64)
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker and path."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _reset(self) -> None:
        #: The table: hashes of words in order, their codes; by code, the word's bytes and ids.
        self.hashes, self.code_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.letters, self.word_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Add words and their ids to the table. Put between special tokens, each word is a text of its own to the library."""
        found, sizes = [self.flat], []
        for a in range(0, len(words), AT_ONCE):
            texts = [w.decode() for w in words[a : a + AT_ONCE]]
            if self.mark:
                texts = [self.mark[0].join(["", *texts, ""])]
            own = [np.array(e.ids, np.int32) for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)]
            if self.mark:
                at = np.flatnonzero(own[0] == self.mark[1])
                sizes.append(np.diff(at) - 1)
                own = [np.delete(own[0], at)]
            else:
                sizes.append(np.array([len(x) for x in own]))
            found += own
        self.flat = np.concatenate(found)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), np.uint8)])
        self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum([len(w) for w in words])])

    def _codes(self, offsets: np.ndarray, raw: bytes) -> np.ndarray:
        """Codes of the words between the offsets; new ones are learned.

        Words are found by a hash, and then compared byte by byte: with the
        others of their hash here, and with the word in the table.
        """
        data = np.frombuffer(raw, np.uint8)
        if len(data) >= len(self.powers):
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(2 * len(data), f, np.uint64)]) for f in (FACTOR, INVERSE))
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])]
        begin, size = offsets[:-1], np.diff(offsets)
        hashed = (sums[offsets[1:]] - sums[begin]) * self.inverses[begin]
        hashes, first, same = np.unique(hashed, return_index=True, return_inverse=True)
        twin = np.repeat(begin[first][same] - begin, size) + np.arange(len(data))
        if (size[first][same] != size).any() or (data[np.minimum(twin, len(data) - 1)] != data).any():
            hashes, first, same = hashed, np.arange(len(size)), np.arange(len(size))  # a collision: every word by itself
        begin, size = begin[first], size[first]

        place = np.searchsorted(self.hashes, hashes)
        near = np.minimum(place, len(self.hashes) - 1)
        known = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        code = np.full(len(hashes), -1, np.int32)
        code[known] = self.code_of[near[known]]
        at, own = self.word_at[code[known]], size[known]
        alike = self.word_at[code[known] + 1] - at == own
        at, own, where = at[alike], own[alike], np.flatnonzero(known)[alike]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        differ = self.letters[np.repeat(at, own) + inside] != data[np.repeat(begin[where], own) + inside]
        code[np.flatnonzero(known)[~alike]] = -1
        code[np.repeat(where, own)[differ]] = -1

        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = len(self.start) - 1 + np.arange(len(new))
            self._learn([raw[a : a + n] for a, n in zip(begin[new].tolist(), size[new].tolist(), strict=True)])
            fresh = new[~known[new]]  # of words of one hash only the first is in the table
            fresh = fresh[np.r_[True, hashes[fresh][1:] != hashes[fresh][:-1]]] if len(fresh) and hashes is not hashed else fresh[:0]
            self.hashes = np.insert(self.hashes, place[fresh], hashes[fresh])
            self.code_of = np.insert(self.code_of, place[fresh], code[fresh])
        return code[same]

    def _classify(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points. Those that are new are put between letters, digits and marks, to see where the library joins them."""
        kinds = self.kind[points]
        if (kinds != UNKNOWN).all():
            return kinds
        for p in np.unique(points[kinds == UNKNOWN]).tolist():
            c = chr(p)
            joined = [len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c + x)) == 1 for x in "a1!"]
            self.kind[p] = LETTER if joined[0] else NUMBER if joined[1] else OTHER if joined[2] else SPACE
        return self.kind[points]

    def split(self, texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Byte offsets of the words of all texts, the texts' bytes, and the number of words before each text's end."""
        data = "".join(texts)
        raw = data.encode()
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        n = len(points)
        ends = np.cumsum([len(t) for t in texts])
        if not n:
            return np.zeros(1, np.int64), raw, np.zeros(len(texts), np.int64)
        kind = self._classify(points)
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        edge[ends] = True
        run = edge.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begins = run.copy()
        # white space of several characters ends before its last one, which a blank that follows leaves to the next word
        space = kind == SPACE
        last = np.flatnonzero(space & run[1:] & ~edge[1:])
        begins[last] = True
        begins[last[points[last] == BLANK] + 1] = False
        # contractions: a quote that begins a word, with s, t, m, d, re, ve or ll behind it
        quote = np.flatnonzero((points == QUOTE) & begins[:n] & run[1:] & ~edge[1:])
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~short & ~edge[np.minimum(quote + 2, n)]
        taken = quote[short | pair]
        size = np.where(short, 1, 2)[short | pair]
        begins[taken + 1] = False
        begins[taken + 2] |= size == 1
        begins[(taken + 3)[size == 2]] = True
        places = np.flatnonzero(begins)
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        offset = np.append(lead, len(raw))
        return offset[places], raw, np.searchsorted(places, ends)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each one's begin; each closed by end_id, if given. Null is empty."""
        texts = [t or "" for t in texts]
        plain = [self.by_words and not any(a in t for a in self.added) for t in texts]
        if len(self.start) > TABLE_WORDS or len(self.letters) > TABLE_BYTES:
            self._reset()
        offsets, raw, n_words = self.split([t if p else "" for t, p in zip(texts, plain, strict=True)])
        code = self._codes(offsets, raw)
        begin, n = self.start[code], self.start[code + 1] - self.start[code]
        first = np.cumsum(n) - n
        ids = self.flat[np.repeat(begin - first, n) + np.arange(n.sum())]
        starts = np.r_[0, np.r_[first, n.sum()][n_words]]
        for i in [i for i, p in enumerate(plain) if not p]:
            own = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
            ids = np.insert(ids, starts[i], own)
            starts[i + 1 :] += len(own)
        if end_id is not None:
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
        return ids, starts

    @staticmethod
    def chunks(texts: pa.Array, chars: int) -> list[tuple[int, int]]:
        """Cuts of an Arrow column into pieces of about so many bytes, whole texts each."""
        cuts, at, total = [], 0, 0
        for i, size in enumerate(t.as_buffer().size if t.is_valid else 0 for t in texts):
            if total and total + size > chars:
                cuts.append((at, i))
                at, total = i, 0
            total += size
        return [*cuts, (at, len(texts))] if len(texts) > at else cuts
