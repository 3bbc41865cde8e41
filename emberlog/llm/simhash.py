"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are sorted into tiles of one population count, and tiles into
blocks. A tile travels once for each pair of blocks, which a task compares. Only
tiles whose counts differ by no more than the radius are compared; within them,
sub-tiles whose four quarter counts are farther apart than the radius are skipped
too. What remains is compared exactly by numpy exclusive-or and bit counts. A
tile pair returns one link per fingerprint at most, which connect what all its
pairs connect.

For a bound on the similarity itself (similar_groups) such groups are only
candidates: within each, the shingle sets of the pairs with close fingerprints
are compared, and only pairs that reach the bound are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, hot_join, materialize, table
from emberlog.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLES_AT_ONCE = 100_000
#: Fingerprints of a tile (aimed at; dealt by hash) and of a sub-tile.
TILE, SUB_TILE = 8192, 128
#: Rows that are compared with a tile at once: few, so that what they give stays in the cache.
STRIP = 16
#: Blocks that the fingerprints are cut into, for tasks enough, and fingerprints of a block at most (and a tile more).
BLOCKS, BLOCK = 16, 262_144
#: Tasks of the comparison at most.
TASKS = 4096
#: Texts and shingles of a chunk of a candidate group (aimed at), and shingles for a task of small groups.
CHUNK, CHUNK_SHINGLES, TASK_SHINGLES = 1024, 500_000, 250_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    begin, end = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digests = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)])
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[a : a + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes for word k of a longer fingerprint (k = 0: as they are), by a 64-bit finaliser."""
    if k == 0:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: Column, width: int, words: int = 1) -> Column:
    """Fingerprint of each whole text as signed longs, 64 bits each; null and wordless texts: 0."""

    @F.arrow_udf("array<bigint>")
    def prints(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), words), np.uint64)
        for i, t in enumerate(texts):
            hashes = shingle_hashes(t.as_py(), width)
            for k in range(words if len(hashes) else 0):
                out[i, k] = majority(mixed(hashes, k))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words), pa.array(out.view(np.int64).ravel()))

    return prints(text)


def quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters: (n, 4)."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def linked_pairs(a: np.ndarray, b: np.ndarray, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of a and b (n, words) within radius bits in the first word and total in all, by sub-tile of a."""
    if not len(a) or not len(b):
        return
    qa, qb = quarters(a[:, 0]), quarters(b[:, 0])
    oa, ob = np.lexsort(qa.T), np.lexsort(qb.T)
    a, qa, b, qb = a[oa], qa[oa], b[ob], qb[ob]
    cuts = np.arange(0, len(b), SUB_TILE)
    low_b, high_b = np.minimum.reduceat(qb, cuts), np.maximum.reduceat(qb, cuts)
    sub = np.arange(len(b)) // SUB_TILE
    lead = np.ascontiguousarray(b[:, 0])
    held = [np.empty(STRIP * len(b), kind) for kind in (np.uint64, np.uint8, np.bool_)]
    for s in range(0, len(a), SUB_TILE):
        part = a[s : s + SUB_TILE]
        low, high = qa[s : s + SUB_TILE].min(axis=0), qa[s : s + SUB_TILE].max(axis=0)
        apart = np.maximum(0, np.maximum(low - high_b, low_b - high)).sum(axis=1)
        near = apart <= radius
        if not near.any():
            continue
        rows = slice(None) if near.all() else np.nonzero(near[sub])[0]
        beside = lead[rows]
        hits = []
        for r in range(0, len(part), STRIP):
            xor, count, close = (v[: len(part[r : r + STRIP]) * len(beside)].reshape(-1, len(beside)) for v in held)
            np.bitwise_xor(part[r : r + STRIP, :1], beside, out=xor)
            np.less_equal(np.bitwise_count(xor, out=count), radius, out=close)
            hits.append(np.flatnonzero(close) + r * len(beside))
        x, y = np.divmod(np.concatenate(hits), len(beside))
        y = y if near.all() else rows[y]
        if part.shape[1] > 1 and len(x):
            close = np.bitwise_count(part[x] ^ b[y]).sum(axis=1) <= total
            x, y = x[close], y[close]
        if len(x):
            yield oa[s + x], ob[y]


def absorb(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """up (the root of each node) after the pairs x, y are linked."""
    while True:
        rx, ry = up[x], up[y]
        apart = rx != ry
        if not apart.any():
            return up
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        up[np.maximum(rx, ry)] = np.minimum(rx, ry)
        while (up[up] != up).any():
            up = up[up]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (of a place to its root's) that connect two tiles, or one with itself, as all their pairs do."""
    n = len(a) if same else len(a) + len(b)
    up = np.arange(n)
    for x, y in linked_pairs(a, b, radius, total):
        up = absorb(up, x, y if same else y + len(a))
    hung = np.nonzero(up != np.arange(n))[0]
    return hung, up[hung]


def links(classes: DataFrame, words: int, radius: int, total: int, written: list[DataFrame] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (node, fp) that keep all connections.

    Tiles hold the fingerprints of one population count (of the first word),
    dealt by hash into as many as keep each near TILE rows; blocks are runs of
    tiles. A tile travels as one row to each pair of blocks that it is in and
    that have counts within the radius, not to each tile that it must meet. The
    table of tiles goes to written, if there is one.
    """
    n = classes.select(F.bit_count(F.get("fp", F.lit(0))).alias("pop"), "node", "fp")
    counts = sorted(map(tuple, n.groupBy("pop").count().collect()))  # 65 rows at most
    total_rows = sum(c for _, c in counts)
    block = max(TILE, min(BLOCK, -(-total_rows // BLOCKS)))
    runs, before = [], 0
    for pop, count in counts:
        runs.append((pop, -(-count // TILE), count, before))
        before += count
    sizes = classes.sparkSession.createDataFrame(runs, "pop int, tiles int, count bigint, before bigint")
    dealt = n.join(F.broadcast(sizes), "pop").withColumn("part", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    at = F.expr(f"CAST((before + part * count DIV tiles) DIV {block} AS INT)")
    rows = dealt.groupBy(at.alias("block"), "pop", "part").agg(F.collect_list(F.struct("node", "fp")).alias("rows"))
    tiles = materialize(rows.select("block", "pop", "part", F.col("rows.node").alias("nodes"), F.flatten("rows.fp").alias("fps")), "tiles")
    if written is not None:
        written.append(tiles)
    ranges: dict[int, list[int]] = {}  # the counts in each block
    for pop, n_tiles, count, start in runs:
        for of in range(start // block, (start + (n_tiles - 1) * count // n_tiles) // block + 1):
            ranges.setdefault(of, []).append(pop)
    beside = {i: [j for j in ranges if max(ranges[i][0] - ranges[j][-1], ranges[j][0] - ranges[i][-1]) <= radius] for i in ranges}
    met = classes.sparkSession.createDataFrame([(i, min(js), max(js)) for i, js in beside.items()], "block int, first int, last int")
    n_pairs = sum(j >= i for i, js in beside.items() for j in js)

    def compare(rows: pa.Table) -> pa.Table:
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        sides: tuple[list, list] = [], []
        for of, pop, nodes, fps in zip(*[rows.column(c) for c in ("block", "pop", "nodes", "fps")], strict=True):
            tile = pop.as_py(), nodes.values.to_numpy(), fps.values.to_numpy().view(np.uint64).reshape(-1, words)
            sides[of.as_py() != low].append(tile)
        found = [np.zeros((2, 0), np.int64)]
        for i, (pop, nodes, fps) in enumerate(sides[0]):
            for k, (pop2, nodes2, fps2) in enumerate(sides[0][i:] if low == high else sides[1]):
                if abs(pop - pop2) > radius:
                    continue
                same = low == high and k == 0
                hung, root = tile_links(fps, fps2, same, radius, total)
                names = nodes if same else np.concatenate([nodes, nodes2])
                found.append(np.stack([names[hung], names[root]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b})

    each = tiles.join(F.broadcast(met), "block").withColumn("other", F.explode(F.expr("sequence(first, last)")))
    each = each.select("block", "pop", "nodes", "fps", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    # few bytes but much work: small shuffles must not be merged into few
    spread = each.repartition(max(1, min(TASKS, 2 * n_pairs)), "low", "high")
    return spread.groupBy("low", "high").applyInArrow(compare, "a bigint, b bigint").where("a <> b")


def simhash_groups(
    docs: DataFrame, id_col: str, width: int, radius: int, words: int = 1, total: int | None = None, text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) of every row of docs; fp is an array of words longs.

    Fingerprints of 64 * words bits link if the first 64 differ in radius bits
    at most, and all in total at most (by default radius, for one word);
    component_id is the least id reachable by links, its own included. A null
    id becomes a component's id only if all ids of the component are null.
    Null, empty and wordless texts have fingerprint 0 and link like any other.
    Exact copies are reduced to one fingerprint before anything is compared,
    so a large group of copies costs no more than one. Empty table: no rows.
    Longer fingerprints are known by a 64-bit hash between the steps.
    """
    prints = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, words).alias("fp"))
    node = F.get("fp", F.lit(0)) if words == 1 else F.xxhash64("fp")
    prints = materialize(prints.withColumn("node", node), "prints")
    classes = prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    written: list[DataFrame] = []
    roots = components(links(classes, words, radius, radius if total is None else total, written))
    discard(*written)
    return grouped(prints, classes, roots)


def grouped(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, fp, component_id) of every row of prints; roots has the classes (node) that hang on another. classes is deleted."""
    rooted = classes.select("node", "least", F.col("n").alias("copies")).join(roots, "node", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    discard(classes)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = materialize(named, "named")
    of_print = hot_join(rooted, named, ["root"], rooted.count()).select("node", "component_id", F.col("copies").alias("n"))
    of_print = materialize(of_print, "components")
    discard(rooted, named)
    return hot_join(prints, of_print, ["node"], prints.count()).select("id", "fp", "component_id")


def shingle_sets(text: Column, width: int) -> Column:
    """Sorted distinct hashes of each text's shingles."""

    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return sets(text)


def set_prints(text: Column, width: int, words: int) -> Column:
    """Fingerprint (as fingerprint(), but each shingle counts once), 64-bit name and size of each text's shingle set."""

    @F.arrow_udf("struct<fp: array<bigint>, node: bigint, size: bigint>")
    def prints(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        out = np.zeros((len(texts), words), np.uint64)
        names, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            hashes = np.unique(shingle_hashes(t.as_py(), width))
            names[i], sizes[i] = xxh64_intdigest(hashes.tobytes()), len(hashes)
            for k in range(words if len(hashes) else 0):
                out[i, k] = majority(mixed(hashes, k))
        fps = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words), pa.array(out.view(np.int64).ravel()))
        return pa.StructArray.from_arrays([fps, pa.array(names.view(np.int64)), pa.array(sizes)], ["fp", "node", "size"])

    return prints(text)


def similar_links(
    fps: np.ndarray, fps2: np.ndarray | None, sizes: np.ndarray, shingles: np.ndarray, radius: int, total: int, similarity: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Links (of a place to its root's) that connect what the pairs of close fingerprints and sufficient similarity do.

    sizes and shingles hold the sets, those of fps2 behind those of fps.
    Pairs that are connected already, or whose sizes rule the similarity out,
    are not compared.
    """
    num, den = similarity
    n, up = len(sizes), np.arange(len(sizes))
    names, ids = np.unique(shingles, return_inverse=True)
    ends = np.cumsum(sizes)
    of = [ids[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mine = np.zeros(len(names), np.int64)
    for x, y in linked_pairs(fps, fps if fps2 is None else fps2, radius, total):
        y = y if fps2 is None else y + len(fps)
        fit = (up[x] != up[y]) & (den * np.minimum(sizes[x], sizes[y]) >= num * np.maximum(sizes[x], sizes[y]))
        x, y = x[fit], y[fit]
        if not len(x):
            continue
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        starts = np.nonzero(np.diff(x, prepend=-1))[0]
        for one, others in zip(x[starts].tolist(), np.split(y, starts[1:]), strict=True):
            others = others[(up[others] != up[one]) & (sizes[others] > 0)]
            if not len(others):
                continue
            mine[of[one]] = 1
            begin = np.cumsum(sizes[others]) - sizes[others]
            both = np.add.reduceat(mine[np.concatenate([of[j] for j in others.tolist()])], begin)
            mine[of[one]] = 0
            others = others[den * both >= num * (sizes[one] + sizes[others] - both)]
            up = absorb(up, np.full(len(others), one), others)
    hung = np.nonzero(up != np.arange(n))[0]
    return hung, up[hung]


def verified_links(chunks: DataFrame, words: int, radius: int, total: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links between the texts of each candidate group that keep all connections of similar pairs.

    A chunk (root, n_chunks, part, nodes, fps, sizes, shingles) meets itself
    and the other chunks of its group, each pair as one row.
    """
    held = ["nodes", "fps", "sizes", "shingles"]
    right = chunks.select("root", F.col("part").alias("part2"), *[F.col(c).alias(f"{c}2") for c in held])
    none = [F.lit(None).cast("array<bigint>").alias(f"{c}2") for c in held]
    # the narrow ids are paired first, so each pair can go to a task of its own
    ids = chunks.where("part + 1 < n_chunks").select("root", "part", F.explode(F.expr("sequence(part + 1, n_chunks - 1)")).alias("part2"))
    total_shingles, n_pairs = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0, ids.count()
    tasks = max(1, min(TASKS, n_pairs + total_shingles // TASK_SHINGLES))
    pairs = chunks.select("root", "part", F.col("part").alias("part2"), *held, *none)
    if n_pairs:
        pairs = pairs.unionByName(ids.join(chunks.drop("n_chunks"), ["root", "part"]).join(right, ["root", "part2"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                array = lambda c: at[c].values.to_numpy(zero_copy_only=False)
                alone = not at["nodes2"].is_valid
                nodes, sizes, shingles = (
                    array(c) if alone else np.concatenate([array(c), array(f"{c}2")]) for c in ("nodes", "sizes", "shingles")
                )
                fps, fps2 = (None if c == "fps2" and alone else array(c).view(np.uint64).reshape(-1, words) for c in ("fps", "fps2"))
                hung, root = similar_links(fps, fps2, sizes, shingles, radius, total, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root])], ["a", "b"])

    return pairs.repartition(tasks, "root", "part", "part2").mapInArrow(compare, "a bigint, b bigint").where("a <> b")


def similar_groups(
    docs: DataFrame, id_col: str, width: int, radius: int, words: int, total: int, similarity: tuple[int, int], text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) as simhash_groups, but two texts link only if their shingle sets are similar.

    Close fingerprints (of the distinct shingles) make candidates; where both
    texts have few shingles, of which each tells on many bits, wider bounds hold. Of these,
    pairs link whose Jaccard similarity, counted exactly on 64-bit hashes of
    the shingles, is similarity (numerator, denominator) at least. Texts with
    the same set, such as those without words, are one class and not compared.
    """
    print_of = set_prints(F.col(text_col), width, words).alias("p")
    key = F.xxhash64(text_col).alias("key")
    prints = docs.select(F.col(id_col).alias("id"), key, print_of).select("id", "key", "p.fp", "p.node", "p.size")
    prints = materialize(prints, "prints")
    classes = prints.groupBy("node").agg(
        F.min("id").alias("least"),
        F.coalesce(F.min_by("key", "id"), F.min("key")).alias("key"),
        F.first("fp").alias("fp"),
        F.first("size").alias("size"),
        F.count("*").alias("n"),
    )
    classes = materialize(classes, "classes")
    written: list[DataFrame] = []
    close = links(classes.where("size > 0"), words, radius, total, written)
    few = classes.where(F.col("size").between(1, FEW))
    near = components(close.union(links(few, words, FEW_RADIUS, FEW_TOTAL, written)))
    near = near.union(near.select("root", "root")).distinct()
    narrow = members = materialize(near.join(classes.drop("n"), "node"), "members")
    by_root = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    n_chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("s") / CHUNK_SHINGLES)).cast("int").alias("n_chunks")
    members = hot_join(members, by_root.select("root", "n", n_chunks), ["root"], members.count()).drop("n")
    # one text of each class: that of its least id
    texts = docs.select(F.col(id_col).alias("_id"), key, F.col(text_col).alias("text"))
    texts = texts.join(members, (texts["key"] == members["key"]) & texts["_id"].eqNullSafe(members["least"]))
    texts = texts.select("node", "root", "n_chunks", "fp", "text").dropDuplicates(["node"])
    dealt = texts.select("node", "root", "n_chunks", "fp", shingle_sets(F.col("text"), width).alias("shingles"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "n_chunks").cast("int"))
    chunks = dealt.groupBy("root", "n_chunks", "part").agg(F.collect_list(F.struct("node", "fp", "shingles")).alias("rows"))
    chunks = chunks.select(
        "root",
        "n_chunks",
        "part",
        F.col("rows.node").alias("nodes"),
        F.flatten("rows.fp").alias("fps"),
        F.transform("rows.shingles", lambda s: F.size(s).cast("bigint")).alias("sizes"),
        F.flatten("rows.shingles").alias("shingles"),
    )
    chunks = materialize(chunks, "chunks")
    discard(*written, narrow)
    roots = components(verified_links(chunks, words, max(radius, FEW_RADIUS), max(total, FEW_TOTAL), similarity))
    discard(chunks)
    return grouped(prints, classes, roots)


#: For a similarity of 0.8 of 5-word shingles: fingerprints of 256 bits. At that similarity they differ in
#: 39 bits on average (standard deviation 5.7), in their first 64 in 9.7 (2.9); unrelated ones in 128 (8).
NEAR_WIDTH, NEAR_WORDS, NEAR_RADIUS, NEAR_TOTAL = 5, 4, 20, 54
#: Texts of FEW shingles at most are candidates at more bits: 4 of 5 shingles differ in 48 bits on average (6.2),
#: in their first 64 in 12 (3.1).
FEW, FEW_RADIUS, FEW_TOTAL = 24, 30, 80
#: The least Jaccard similarity of near-duplicates, as a fraction.
NEAR_SIMILARITY = (4, 5)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id.

    Pairs of similarity 0.8 or more link, and groups are what links connect.
    Rows of that id whose text is in the group all stay if the id is repeated.
    Rows with a null id stay. Texts without words are one group. Empty table: no rows.
    """
    groups = similar_groups(docs, id_col, NEAR_WIDTH, NEAR_RADIUS, NEAR_WORDS, NEAR_TOTAL, NEAR_SIMILARITY, text_col)
    gone = groups.where("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    kept = groups.where("id = component_id").select(F.col("id").alias("_gone")).distinct()
    gone = gone.join(kept, "_gone", "left_anti")  # a repeated id that leads another group is no copy
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: components of near-duplicate documents: 4-word shingles, 4 bits."""
    found = simhash_groups(table(spark, sf_dir, "documents"), "doc_id", 4, 4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"),
        "component_id",
    )
