"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of words lies in flat numpy arrays of symbols. Each round looks up the
rank of every adjacent pair, takes the least rank of each word, merges its
leftmost occurrences in all words at once and compacts the arrays, until no
word has a pair left. Words (a run of U+2581 and what follows up to the next)
can be merged apart because no piece has U+2581 after another character; this
is checked when the model is loaded. Each worker keeps the ids of the words
that it has seen in a table of bounded size.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NEVER = np.int64(1) << 62
#: Words and characters in the table of a worker at most, and characters handled at once.
TABLE_WORDS, TABLE_CHARS, CHUNK_CHARS = 400_000, 1 << 23, 1 << 20
#: Odd multiplier of the pair table's hash.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The error handler of decoding: U+FFFD for each byte that is no part of a character.
EACH_BYTE = "emberlog-each-byte"
codecs.register_error(EACH_BYTE, lambda e: ("\ufffd" * (e.end - e.start), e.end))


class WordTable(dict):
    """Codes of words in order of arrival; new ones wait in fresh to be merged."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self.chars += len(word)
        self[word] = code = len(self)
        return code


class PieceModel:
    """The tables of a BPE model file; see the module's text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece crosses a word boundary")
        if sp.encode("a  b ") != sp.encode(sp.decode(sp.encode("a  b "))) or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("only models that keep their text as it is are supported")
        self.unk = sp.unk_id()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        _, order = np.unique(-scores, return_inverse=True)  # equal scores, equal rank
        self.of_char = np.full(0x110000, n, np.int32)  # n: a character without a piece
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.base = np.int64(n + 1)
        self.reach = 2 * max(map(len, normal))
        pairs = [
            (normal[p[:k]] * (n + 1) + normal[p[k:]], order[i], i)
            for p, i in normal.items()
            for k in range(1, len(p))
            if p[:k] in normal and p[k:] in normal
        ]
        pairs.sort()
        self.keys = np.array([*(k for k, _, _ in pairs), -1], np.int64)
        self.ranks = np.array([*(r for _, r, _ in pairs), NEVER], np.int64)
        self.merged = np.array([*(m for _, _, m in pairs), 0], np.int32)
        inside = {(normal[a], normal[b]) for p in normal for a, b in zip(p, p[1:], strict=False) if a in normal and b in normal}
        self.inside = np.array(sorted(a * (n + 1) + b for a, b in inside), np.int64)
        self._hash_pairs()
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.byte) if i != self.unk}
        decoded = [of_byte.get(i, b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        decoded[self.unk] = " ⁇ ".encode()
        self.decoded = decoded
        self.is_byte = np.zeros(n + 1, bool)
        self.is_byte[self.byte] = True
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        self.spelling = np.frombuffer(b"".join(decoded), np.uint8)
        self.spelling_len = np.array([len(d) for d in decoded], np.int64)
        self.spelling_at = np.cumsum(self.spelling_len) - self.spelling_len
        self._reset()

    def _hash_pairs(self) -> None:
        """slots[(key * MIX) >> shift] and the slots after it hold the places of pairs in keys."""
        bits = int(len(self.keys)).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        none, places = len(self.keys) - 1, np.arange(len(self.keys) - 1)
        self.slots = np.full((1 << bits) + 64, none, np.int32)
        home = ((self.keys[:-1].astype(np.uint64) * MIX) >> self.shift).astype(np.int64)
        self.probes = 0
        while len(places):
            slot = home[places] + self.probes
            free = self.slots[slot] == none
            self.slots[slot[free]] = places[free]  # of several, the last stays
            places = places[self.slots[slot] != places]
            self.probes += 1

    def _reset(self) -> None:
        self.table = WordTable()
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if none) and merged piece of each pair."""
        key = left.astype(np.int64) * self.base + right
        home = ((key.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)
        found = self.slots[home]
        for k in range(1, self.probes):
            miss = np.nonzero((self.keys[found] != key) & (found < len(self.keys) - 1))[0]
            if not len(miss):
                break
            found[miss] = self.slots[home[miss] + k]
        found[self.keys[found] != key] = len(self.keys) - 1
        return self.ranks[found], self.merged[found]

    def beside(self, sym: np.ndarray) -> np.ndarray:
        """Whether a piece holds a character and the next one side by side: no merge crosses other places."""
        key = sym[:-1].astype(np.int64) * self.base + sym[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return self.inside[at] == key

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after merging, and the word of each symbol.

        Words are cut where no merge can cross, so that the parts of a long
        word have minima of their own.
        """
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[cp]
        raw = cp.astype(np.int64)  # the character of a symbol without a piece
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        cut = np.r_[np.ones(min(len(sym), 1), bool), (owner[1:] != owner[:-1]) | ~self.beside(sym)]
        owner, word = owner[cut], np.cumsum(cut) - 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.r_[True, word[1:] != word[:-1]]
            starts = np.nonzero(first)[0]
            of_word = np.cumsum(first) - 1
            rank, merged = self.lookup(sym, np.r_[sym[1:], 0])
            rank[np.r_[starts[1:] - 1, len(sym) - 1]] = NEVER
            least = np.minimum.reduceat(rank, starts)[of_word]
            over = least == NEVER
            if over.any():
                done.append((word[over], sym[over], raw[over]))
                live = ~over
                sym, raw, word, rank, merged, least, of_word = (x[live] for x in (sym, raw, word, rank, merged, least, of_word))
                if not len(sym):
                    break
            at = np.nonzero(rank == least)[0]
            # of overlapping occurrences (aaa) the leftmost counts, then every second one
            run = np.r_[True, (np.diff(at) != 1)]
            run_start = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - run_start) % 2 == 0]
            new = merged[at]
            # What a merge opens may be merged next, and grow, but no further than a piece is long. So one that
            # opens a pair of no larger rank holds back those behind it, as long as each is in reach of the one before.
            w, size = word[at], len(sym)
            joined = np.r_[False, at[1:] - at[:-1] == 2]
            before = np.where(joined, np.r_[0, new[:-1]], sym[np.maximum(at - 1, 0)])
            has_before = (at > 0) & (word[np.maximum(at - 1, 0)] == w)
            after = np.minimum(at + 2, size - 1)
            has_after = (at + 2 < size) & (word[after] == w)
            opens = (has_before & (self.lookup(before, new)[0] <= rank[at])) | (has_after & (self.lookup(new, sym[after])[0] <= rank[at]))
            if opens.any():
                seen = np.cumsum(opens) - opens
                at_first = np.r_[True, (w[1:] != w[:-1]) | (np.diff(at) >= self.reach)]
                at_start = np.maximum.accumulate(np.where(at_first, np.arange(len(at)), 0))
                keep = seen == seen[at_start]
                at, new = at[keep], new[keep]
            sym = sym.copy()
            sym[at] = new
            gone = np.zeros(size, bool)
            gone[at + 1] = True
            sym, raw, word = sym[~gone], raw[~gone], word[~gone]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, sym, raw = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(word, kind="stable")
        return self._bytes(sym[order], raw[order], owner[word[order]])

    def _bytes(self, sym: np.ndarray, raw: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        lost = np.nonzero(sym == self.base - 1)[0]
        if not len(lost):
            return sym, word
        spelled = [chr(c).encode("utf-8", "replace") for c in raw[lost]]
        n = np.ones(len(sym), np.int64)
        n[lost] = [len(b) for b in spelled]
        at = np.cumsum(n) - n
        out = np.repeat(sym, n)
        for i, b in zip(at[lost], spelled, strict=True):
            out[i : i + len(b)] = self.byte[list(b)]
        return out, np.repeat(word, n)

    def learn(self) -> None:
        """Merge the table's fresh words and append their ids in order of code."""
        fresh = [w if w.startswith(SPACE) else SPACE + w for w in self.table.fresh]
        self.table.fresh = []
        ids, word = self.merge_words(fresh)
        n = np.bincount(word, minlength=len(fresh))
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and where each text's begin (one more than texts)."""
        words: list[str] = []
        n_words = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t and t[0] != " " and t[-1] != " " and "  " not in t and SPACE not in t:
                words += t.split(" ")  # kept without the U+2581 that each begins with
            elif t:
                words += WORDS.findall((SPACE + t).replace(" ", SPACE))
            n_words[i + 1] = len(words)
        if len(self.table) > TABLE_WORDS or self.table.chars > TABLE_CHARS:
            self._reset()
        code = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if self.table.fresh:
            self.learn()
        begin, n = self.start[code], self.start[code + 1] - self.start[code]
        first = np.cumsum(n) - n
        ids = self.flat[np.repeat(begin - first, n) + np.arange(n.sum())]
        return ids, np.r_[first, n.sum()][n_words]

    def decode(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all sequences, and where each one's begin.

        As in the library, the U+2581 that leads a sequence is dropped, and
        bytes that are no UTF-8 become U+FFFD each.
        """
        n, at = self.spelling_len[ids], self.spelling_at[ids]
        lead = start[:-1][start[1:] > start[:-1]]
        lead = lead[self.spaced[ids[lead]]]
        n[lead] -= 1
        at[lead] += 1
        first = np.cumsum(n) - n
        out = self.spelling[np.repeat(at - first, n) + np.arange(n.sum())]
        ends = np.r_[first, n.sum()][start]
        if not self.is_byte[ids].any():
            return out, ends
        whole = [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        whole = [b.decode("utf-8", EACH_BYTE).encode() for b in whole]
        return np.frombuffer(b"".join(whole), np.uint8), np.r_[0, np.cumsum([len(b) for b in whole])].astype(np.int64)


_loaded: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _chunks(sizes: list[int]) -> list[tuple[int, int]]:
    """Cuts of a batch into pieces of about CHUNK_CHARS."""
    cuts, at, total = [], 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > CHUNK_CHARS:
            cuts.append((at, i))
            at, total = i, 0
        total += s
    return [*cuts, (at, len(sizes))] if len(sizes) > at else cuts


def encode_batch(texts: pa.Array, model: PieceModel) -> pa.ListArray:
    """Ids of all texts of an Arrow batch, a piece of the batch at a time."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    ids, ends, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    for a, b in _chunks(sizes):
        part, start = model.encode([t or "" for t in texts[a:b].to_pylist()])
        ids.append(part)
        ends.append(start[1:] + total)
        total += len(part)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))


def decode_batch(rows: pa.ListArray, model: PieceModel) -> pa.StringArray:
    """Texts of all id sequences of an Arrow batch; null sequences give empty texts."""
    n = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, ids = np.r_[0, np.cumsum(n)], rows.flatten().to_numpy()
    texts, ends, total = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
    for a, b in _chunks((4 * n).tolist()):
        part, end = model.decode(ids[start[a] : start[b]], start[a : b + 1] - start[a])
        texts.append(part)
        ends.append(end[1:] + total)
        total += len(part)
    return pa.StringArray.from_buffers(
        len(rows), pa.py_buffer(np.concatenate(ends).astype(np.int32)), pa.py_buffer(np.concatenate(texts))
    )


def encode_column(text: Column, model_path: str) -> Column:
    """Ids of each whole text (array of int), without begin or end ids.

    A null or empty text has no ids. Every text is encoded by itself:
    repeated rows give equal ids, and nothing is shuffled.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_batch(texts, loaded(model_path))

    return encode(text)


def decode_column(ids: Column, model_path: str) -> Column:
    """Text of each id sequence. Null or empty: the empty text."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return decode_batch(rows, loaded(model_path))

    return decode(ids)


def round_trip_column(text: Column, model_path: str) -> Column:
    """(ids, decoded) of each whole text: as decode_column after encode_column, in one pass of the worker."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def code(texts: pa.Array) -> pa.Array:
        model = loaded(model_path)
        ids = encode_batch(texts, model)
        return pa.StructArray.from_arrays([ids, decode_batch(ids, model)], ["ids", "decoded"])

    return code(text)


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """op1: every whole text encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), model_path)


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded text, a row for each row of docs.

    Null and empty texts have no ids and an empty decoded text. Rows that are
    repeated, or have no id, are rows like any other; further columns of docs
    are passed over, whatever their names. Empty table: no rows.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    coded = docs.select("doc_id", round_trip_column(F.col("text"), model_path).alias("c"))
    return coded.select(
        "doc_id",
        F.size("c.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("c.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"),
    )
