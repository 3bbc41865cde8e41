"""Token-ID files: byte-level BPE ids in rANS-coded binary blocks.

Static range asymmetric numeral system (Duda, 2013): ids are counted over all
documents, the counts are scaled to a shared table of 2**precision slots, and
blocks of up to BLOCK ids are coded by themselves with LANES interleaved states.
Every SEGMENT rows of lanes a checkpoint keeps the states and the place in the
word stream, so that the segments of a block are decoded side by side. Frames
carry checksums of their bytes and of their ids.

Files are written by Spark's committed text writer, whose records may hold any
bytes: a frame, then SEPARATOR. Layout of a folder (all numbers little-endian):

    table/part-*       one frame: magic EMBT, precision u32, used ids u64, ids in all u64, id u32 * used,
                       slots u32 * used, crc32 u32 of what is before
    ids/range=N/part-* frames of ascending documents: HEADER, doc table, checkpoints, words, crc32 u32

A doc table holds, a column after the other, doc_id i64, flags u8 (1: has an id),
total u64 (ids of the document), skip u64 (those in earlier blocks), take u64.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm.byte_bpe import Encoder
from emberlog.llm.common import discard, materialize, shared_dir, table

#: The frequency table has at least this many slots (a power of two), and SPARE for each id that occurs.
LEAST_PRECISION, SPARE = 16, 4
#: Ids of a block, states of a block, and rows of LANES ids between checkpoints.
BLOCK, LANES, SEGMENT = 1 << 18, 256, 256
#: Frames of a file at most: a file is read whole by one task.
FRAMES_PER_FILE = 64
#: Blocks coded side by side, and characters tokenised at once.
SIDE_BY_SIDE, CHUNK_CHARS = 8, 1 << 19
#: States lie in LOW..2**63.
LOW = np.uint64(1 << 31)
SEPARATOR = "\nEMB\n"
#: magic, ids, lanes, segment, docs, words, checkpoints, crc of the ids, crc of the table, range, block, first id's place
HEADER = struct.Struct("<4s9IQQ")
BLOCKS = "range bigint, block bigint, n bigint, ids binary, doc_id array<bigint>, total array<bigint>, skip array<bigint>, take array<bigint>"
PIECES = "doc_id bigint, start bigint, total bigint, skip bigint, take bigint, crc bigint, ids array<int>"
#: zlib's polynomial, bits reversed.
CRC_POLYNOMIAL = 0xEDB88320


class Corrupt(ValueError):
    """A file that is no token file, or was changed."""


def scaled(counts: np.ndarray, precision: int) -> np.ndarray:
    """Slots of each id, in proportion to its count and one at least; their sum is 2**precision.

    What rounding leaves over goes to the most frequent id.
    """
    size = 1 << precision
    share = counts.astype(np.float64) / counts.sum()
    slots = 1 + np.floor(share * (size - len(counts))).astype(np.int64)
    slots[np.argmax(counts)] += size - slots.sum()
    return slots


class Table:
    """The shared frequency table: coding by id, decoding by slot."""

    def __init__(self, ids: np.ndarray, slots: np.ndarray, precision: int, n_ids: int) -> None:
        self.ids, self.slots, self.precision, self.n_ids = ids.astype(np.uint32), slots.astype(np.uint32), precision, n_ids
        self.begin = np.cumsum(slots).astype(np.uint64) - slots.astype(np.uint64)
        self.size = slots.astype(np.uint64)
        #: Of each slot: the id, its slots, and the place among them.
        self.slot_id = np.repeat(self.ids, slots).astype(np.int32)
        self.slot_size = np.repeat(self.size, slots)
        self.slot_rest = np.arange(len(self.slot_id), dtype=np.uint64) - np.repeat(self.begin, slots)
        #: Of each id up to the largest: its place in the arrays above.
        self.index = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        self.index[self.ids] = np.arange(len(ids))
        #: A state from which coding an id would overflow gives its low word away first.
        self.limit = self.size << np.uint64(63 - precision)
        self.frequent = int(np.argmax(slots)) if len(slots) else 0

    @classmethod
    def fitted(cls, counts: dict[int, int]) -> Table:
        ids = np.array(sorted(counts), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], np.int64)
        precision = max(LEAST_PRECISION, (SPARE * len(n)).bit_length())
        return cls(ids, scaled(n, precision) if len(n) else n, precision, int(n.sum()))

    def to_bytes(self) -> bytes:
        body = struct.pack("<4sIQQ", b"EMBT", self.precision, len(self.ids), self.n_ids) + self.ids.tobytes() + self.slots.tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, precision, used, n_ids = struct.unpack_from("<4sIQQ", data)
        end = 24 + 8 * used
        if magic != b"EMBT" or len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise Corrupt("no frequency table, or a changed one")
        return cls(np.frombuffer(data, "<u4", used, 24), np.frombuffer(data, "<u4", used, 24 + 4 * used), precision, n_ids)


def encode_blocks(blocks: list[np.ndarray], table: Table, lanes: int = LANES, segment: int = SEGMENT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of ids: the words, the states and the word offsets at its checkpoints.

    All blocks go backwards row by row, side by side. A last row that is not
    full is filled up with the most frequent id.
    """
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    rows = [-(-len(blocks[i]) // lanes) for i in order]
    most = max(rows, default=0)
    symbol = np.full((len(blocks), most * lanes), table.frequent, np.int32)
    for k, i in enumerate(order):
        symbol[k, : len(blocks[i])] = table.index[blocks[i]]
    symbol = symbol.reshape(len(blocks), most, lanes)
    state = np.full((len(blocks), lanes), LOW, np.uint64)
    low = np.zeros(symbol.shape, np.uint32)
    gave = np.zeros(symbol.shape, bool)
    kept: list[list[np.ndarray]] = [[] for _ in blocks]
    precision, word = np.uint64(table.precision), np.uint64(32)
    for t in range(most - 1, -1, -1):
        live = sum(r > t for r in rows)
        s, x = symbol[:live, t], state[:live]
        size = table.size[s]
        over = x >= table.limit[s]
        low[:live, t] = x.astype(np.uint32)
        gave[:live, t] = over
        x = np.where(over, x >> word, x)
        whole = x // size
        state[:live] = (whole << precision) + (x - whole * size) + table.begin[s]
        if t % segment == 0:
            for k in range(live):
                kept[k].append(state[k].copy())
    out: list = [None] * len(blocks)
    for k, i in enumerate(order):
        per_row = gave[k].sum(1)
        offsets = (np.cumsum(per_row) - per_row)[: rows[k] : segment]
        out[i] = low[k][gave[k]], np.array(kept[k][::-1], np.uint64).reshape(-1, lanes), offsets.astype(np.uint32)
    return out


def decode_segments(words: np.ndarray, states: np.ndarray, offsets: np.ndarray, rows: np.ndarray, table: Table) -> list[np.ndarray]:
    """Ids of segments, each from its checkpoint (states, offset in words), so many rows; all side by side."""
    order = np.argsort(-rows, kind="stable")
    x, at, left = states[order].copy(), offsets[order].astype(np.int64), rows[order]
    most, lanes = int(left.max(initial=0)), states.shape[1]
    found = np.zeros((len(order), most, lanes), np.int32)
    mask, precision, word = np.uint64((1 << table.precision) - 1), np.uint64(table.precision), np.uint64(32)
    for t in range(most):
        live = int((left > t).sum())
        now = x[:live]
        slot = (now & mask).astype(np.int64)
        found[:live, t] = table.slot_id[slot]
        now = table.slot_size[slot] * (now >> precision) + table.slot_rest[slot]
        short = now < LOW
        taken = short.sum(1)
        place = np.repeat(at[:live] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
        now[short] = (now[short] << word) | words[place]
        at[:live] += taken
        x[:live] = now
    out: list = [None] * len(order)
    for k, i in enumerate(order.tolist()):
        out[i] = found[k, : left[k]].reshape(-1)
    return out


def frame(ids: np.ndarray, coded: tuple, docs: tuple, place: tuple[int, int, int], table_crc: int) -> bytes:
    """A block's bytes. docs: (doc_id or None, total, skip, take) columns; place: (range, block, first id's place)."""
    words, states, offsets = coded
    doc_id, total, skip, take = docs
    has = np.array([d is not None for d in doc_id], np.uint8)
    columns = [np.array([d or 0 for d in doc_id], "<i8"), has, *[np.array(c, "<u8") for c in (total, skip, take)]]
    head = HEADER.pack(b"EMBI", len(ids), states.shape[1], SEGMENT, len(doc_id), len(words), len(offsets), zlib.crc32(ids.astype("<u4").tobytes()), table_crc, place[0], place[1], place[2])
    body = b"".join([head, *[c.tobytes() for c in columns], states.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def frames(content: bytes) -> Iterator[dict]:
    """The frames of a file, checked against their checksums."""
    at, gap = 0, len(SEPARATOR.encode())
    while at < len(content):
        if len(content) < at + HEADER.size or content[at : at + 4] != b"EMBI":
            raise Corrupt("no frame where one must begin")
        _, n, lanes, segment, n_docs, n_words, n_points, ids_crc, table_crc, part, block, first = HEADER.unpack_from(content, at)
        kinds = [("doc_id", "<i8", n_docs), ("has", "u1", n_docs), ("total", "<u8", n_docs), ("skip", "<u8", n_docs), ("take", "<u8", n_docs)]
        kinds += [("states", "<u8", n_points * lanes), ("offsets", "<u4", n_points), ("words", "<u4", n_words)]
        out, place = {}, at + HEADER.size
        end = place + sum(np.dtype(kind).itemsize * size for _, kind, size in kinds)
        if len(content) < end + 4 or zlib.crc32(content[at:end]) != struct.unpack_from("<I", content, end)[0]:
            raise Corrupt("a frame that is cut off or changed")
        for name, kind, size in kinds:
            out[name] = np.frombuffer(content, kind, size, place)
            place += out[name].nbytes
        out["states"] = out["states"].reshape(n_points, lanes)
        yield out | {"n": n, "lanes": lanes, "segment": segment, "ids_crc": ids_crc, "table_crc": table_crc, "range": part, "block": block, "first": first}
        at = end + 4 + gap


def decode_frames(many: list[dict], table: Table) -> list[np.ndarray]:
    """The ids of frames, whose segments are decoded side by side, checked against their checksums."""
    if not many:
        return []
    before = np.cumsum([0, *[len(f["words"]) for f in many]])
    rows = [-(-f["n"] // f["lanes"]) for f in many]
    each = [np.minimum(f["segment"], r - f["segment"] * np.arange(len(f["offsets"]))) for f, r in zip(many, rows, strict=True)]
    words = np.concatenate([f["words"] for f in many])
    offsets = np.concatenate([f["offsets"] + b for f, b in zip(many, before[:-1], strict=True)])
    parts = decode_segments(words, np.concatenate([f["states"] for f in many]), offsets, np.concatenate(each), table)
    out, at = [], 0
    for f in many:
        ids = np.concatenate([np.zeros(0, np.int32), *parts[at : at + len(f["offsets"])]])[: f["n"]]
        at += len(f["offsets"])
        if zlib.crc32(ids.astype("<u4").tobytes()) != f["ids_crc"]:
            raise Corrupt("ids that differ from what was written")
        out.append(ids)
    return out


def _product(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC's, highest power in the lowest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What bytes of this crc32 add (by exclusive or) to the crc32 of a whole in which n_bytes follow them."""
    power, square = 1 << 31, 1 << 23  # the polynomials 1 and x**8
    while n_bytes:
        if n_bytes & 1:
            power = _product(power, square)
        square = _product(square, square)
        n_bytes >>= 1
    return _product(crc, power)


def id_kind(n: int) -> str:
    """The narrowest numpy type of ids below n, in blocks that wait for the table."""
    return "<u2" if n <= 1 << 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) rows of a task as blocks of ids; a text longer than what is left of a block goes on in the next."""
    encoder = Encoder.of(tokenizer_path)
    kind = id_kind(max(end_id + 1, encoder.tokenizer.get_vocab_size()))
    part, block = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    docs: list[tuple] = []
    free = BLOCK

    def whole() -> pa.RecordBatch:
        flat = np.concatenate(ids)
        lists = [pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*docs, strict=True)]
        longs = [pa.array([x], pa.int64()) for x in (part, block, len(flat))]
        packed = pa.array([flat.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([*longs, packed, *lists], ["range", "block", "n", "ids", "doc_id", "total", "skip", "take"])

    for batch in batches:
        for a, b in encoder.chunks(batch.column(1), CHUNK_CHARS):
            flat, start = encoder.encode(batch.column(1)[a:b].to_pylist(), end_id)
            for doc_id, x, y in zip(batch.column(0)[a:b].to_pylist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                at = x
                while at < y:
                    take = min(free, y - at)
                    ids.append(flat[at : at + take])
                    docs.append((doc_id, y - x, at - x, take))
                    at, free = at + take, free - take
                    if not free:
                        yield whole()
                        ids, docs, free, block = [], [], BLOCK, block + 1
    if ids:
        yield whole()


def _counts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in the blocks of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            n = np.bincount(np.frombuffer(ids.as_buffer(), kind))
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def _frames(batches: Iterator[pa.RecordBatch], packed: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks with the place of their first id as frames."""
    shared, crc = Table.from_bytes(packed), zlib.crc32(packed)
    for batch in batches:
        for a in range(0, batch.num_rows, SIDE_BY_SIDE):
            rows = batch.slice(a, SIDE_BY_SIDE)
            ids = [np.frombuffer(x.as_buffer(), kind) for x in rows.column("ids")]
            coded = encode_blocks(ids, shared)
            for k, c in enumerate(coded):
                docs = tuple(rows.column(name)[k].as_py() for name in ("doc_id", "total", "skip", "take"))
                place = tuple(rows.column(name)[k].as_py() for name in ("range", "block", "first"))
                made = frame(ids[k], c, docs, place, crc)
                yield pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int64()), pa.array([made], pa.binary())], ["range", "frame"])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every text of docs (doc_id, text) and write the ids, each document's closed by end_id, below path.

    Documents come in ascending doc_id, those without one first; rows of one
    doc_id in order of their texts' hashes, each a document of its own. A null
    text is an empty one, which has only the end id. Texts are tokenised whole
    and may go over any number of blocks. An empty table gives a table of no
    ids and no frames. Further columns, whatever their names, are not read.

    One shuffle, by ranges of doc_id: a range's blocks are made in one pass and
    written to the shared folder, where the two passes behind it (counts, then
    frames) find them as they were. The driver gets the counts of ids, as many
    as the vocabulary has at most, and a total for each range.
    """
    spark = docs.sparkSession
    # equal rows are told apart by place, so that many of them need not lie in one range
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    texts = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = materialize(texts.mapInArrow(lambda rows: _blocks(rows, tokenizer_path, end_id), BLOCKS), "blocks", compression="zstd")
    kind = id_kind(max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size()))

    counted = blocks.select("ids").mapInArrow(lambda rows: _counts(rows, kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    packed = Table.fitted({r.id: r.n for r in counted}).to_bytes()
    before, first = 0, []
    for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        first.append((r.range, before))
        before += r.n
    places = spark.createDataFrame(first, "range bigint, base bigint")

    placed = blocks.join(places, "range").withColumn("first", F.col("base") + F.col("block") * BLOCK).drop("base")
    made = placed.sortWithinPartitions("range", "block").mapInArrow(lambda rows: _frames(rows, packed, kind), "range bigint, frame binary")
    as_text = F.col("frame").cast("string").alias("value")
    written = {"lineSep": SEPARATOR}
    made.select("range", as_text).write.options(**written, maxRecordsPerFile=FRAMES_PER_FILE).partitionBy("range").text(f"{path}/ids")
    spark.createDataFrame([(packed,)], "frame binary").coalesce(1).select(as_text).write.options(**written).text(f"{path}/table")
    discard(blocks)


def read_table(spark: SparkSession, path: str) -> bytes:
    """The bytes of the frequency table, with its checksum tested."""
    found = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/table").select("content").collect()]
    content = b"".join(found).removesuffix(SEPARATOR.encode())
    Table.from_bytes(content)
    return content


def _pieces(batches: Iterator[pa.RecordBatch], packed: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of documents in the frames of whole files."""
    shared, crc = Table.from_bytes(packed), zlib.crc32(packed)
    for batch in batches:
        for content in batch.column(0):
            many = list(frames(content.as_py()))
            for a in range(0, len(many), SIDE_BY_SIDE):
                for f, ids in zip(many[a : a + SIDE_BY_SIDE], decode_frames(many[a : a + SIDE_BY_SIDE], shared), strict=True):
                    if f["table_crc"] != crc:
                        raise Corrupt("a frame of another table")
                    yield _piece_rows(f, ids, with_ids)


def _piece_rows(f: dict, ids: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    """A row for each piece of a document in a frame."""
    ends = np.cumsum(f["take"].astype(np.int64))
    begins = ends - f["take"].astype(np.int64)
    raw = ids.astype("<u4").tobytes()
    after = (f["total"] - f["skip"] - f["take"]).astype(np.int64).tolist()
    crcs = [crc_before(c, 4 * n) if n else c for c, n in ((zlib.crc32(raw[4 * a : 4 * b]), n) for a, b, n in zip(begins.tolist(), ends.tolist(), after, strict=True))]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
    longs = [pa.array(x.astype(np.int64)) for x in (f["first"] + begins - f["skip"].astype(np.int64), f["total"], f["skip"], f["take"])]
    doc_id = pa.array(f["doc_id"], mask=f["has"] == 0)
    fields = [doc_id, *longs, pa.array(crcs, pa.int64()), lists if with_ids else pa.nulls(len(doc_id), lists.type)]
    return pa.RecordBatch.from_arrays(fields, ["doc_id", "start", "total", "skip", "take", "crc", "ids"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents, a task a file: doc_id, start (ids of all documents before it), total, skip, take, crc, ids.

    A document of one block has one piece; others have one for each block, with
    skip ids before it. The crc32 of all of a document's ids as little-endian
    32-bit numbers is the exclusive or of its pieces' crc. Raises Corrupt where a
    frame is cut off, changed, or of another table. Without frames: no rows.
    """
    packed = read_table(spark, path)
    if not Table.from_bytes(packed).n_ids:
        return spark.createDataFrame([], PIECES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("content")
    return files.mapInArrow(lambda rows: _pieces(rows, packed, with_ids), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from its pieces; start tells documents apart."""
    grouped = pieces.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("take").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return grouped.select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents written as token files and read back.

    Null texts are empty (one id, the end id); see write_token_files for rows
    without or with equal doc_id. Empty table: no rows.
    """
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return digests(read_token_files(spark, path, with_ids=False))
