"""Near-duplicates: SimHash with tiled exact comparison, candidates confirmed by shared shingles, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plaudit.llm.common import row_print, split_words, texts
from plaudit.llm.components import components, forest
from plaudit.scratch import new_path, release, store

# Words per shingle, differing bits that still link, and the seed of the shingle hash.
SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42

# Fingerprints are cut into this many blocks. With a radius of 3 at least BLOCKS - 3 blocks agree,
# so pairs are looked for under every choice of that many blocks.
BLOCKS = 6

# Near copies in a corpus: words per shingle, and shared over all distinct shingles from which two
# texts are near copies.
COPY_WORDS, SIMILARITY = 5, 0.8

# Bands of MinHash values, and values of one band. Two texts with a similarity of 0.8 agree in a
# band with chance 0.8 ** 6 = 0.26, so they share none of 40 with chance 5 in a million.
BANDS, BAND_ROWS = 40, 6

# Rows of one tile. A bucket that holds more is cut into tiles and compared tile by tile.
TILE_ROWS = 2048


def shingles(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased word shingles of a text in order, repeats included, in stretches.

    A text with fewer words is one shingle, a text without words has none.
    """
    tokens = split_words(text.lower())
    if not tokens:
        return
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])
    whole = b" ".join(tokens)
    last = max(1, len(tokens) - words + 1)
    stops = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, 65_536):
        part = zip(starts[at:at + 65_536].tolist(), stops[at:at + 65_536].tolist())
        yield np.array([digest(whole[i:j], seed) for i, j in part], np.uint64)


def shingle_set(text: bytes, words: int = COPY_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = list(shingles(text, words))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def band_keys(members: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """One hash for each band of MinHash values of a set; none for the empty set."""
    if not len(members):
        return []
    masks, factors = np.random.default_rng(SEED).integers(0, 1 << 32, (2, bands * rows, 1), np.uint32)
    factors |= np.uint32(1)
    least = np.full(bands * rows, (1 << 32) - 1, np.uint32)
    high = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, ((high[at:at + 1024] ^ masks) * factors).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in least.reshape(bands, rows)]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the lower-cased word shingles of a text; 0 if it has no word.

    A bit is set if it is set in more than half of the shingle hashes, repeats included.
    """
    counts, last = np.zeros(64, np.int64), 0
    for hashes in shingles(text, words, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        last += len(hashes)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the fingerprint of every text as a signed long. A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints)], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _block_keys(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(choice, block, fp): every fingerprint under every choice of blocks that may agree."""
    width = -(-64 // blocks)
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = 0
        for block in chosen:
            low, high = block * width, min(64, (block + 1) * width)
            mask |= ((1 << high) - 1) ^ ((1 << low) - 1)
        masks.append(int(np.uint64(mask).astype(np.int64)))
    listed = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                       for i, m in enumerate(masks)])
    return prints.select("fp", F.inline(listed))


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles whose fingerprints differ in at most ``radius`` bits."""
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def _tile_links(rows: np.ndarray, weights: np.ndarray, radius: int, size: int = 256):
    """Links inside one unit, whose rows are sorted by population count, in square tiles.

    A pair of tiles is skipped when the population counts of its rows are further apart than the
    radius: two fingerprints differ in at least as many bits as their counts do.
    """
    for i in range(0, len(rows), size):
        for j in range(i, len(rows), size):
            if weights[j] - weights[min(i + size, len(rows)) - 1] > radius:
                break
            a, b = _near(rows[i:i + size], rows[j:j + size], radius)
            keep = a + i < b + j
            yield rows[i + a[keep]], rows[j + b[keep]]


def _unit_links(columns: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the units of a sorted stretch of rows."""
    fp = columns["fp"].view(np.uint64)
    same = np.ones(len(fp) - 1, bool)
    for name in ("choice", "block", "tile", "other"):
        same &= columns[name][1:] == columns[name][:-1]
    starts = np.concatenate([[0], np.nonzero(~same)[0] + 1, [len(fp)]])
    unit = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size = np.diff(starts)[unit]
    left, right = [], []
    # Small units, all at once: each row against the next, the one after that, and so on.
    small = np.nonzero(size <= 32)[0]
    for lag in range(1, int(size[small].max()) if len(small) else 0):
        a = small[small + lag < len(fp)]
        a = a[unit[a + lag] == unit[a]]
        near = np.bitwise_count(fp[a] ^ fp[a + lag]) <= radius
        left.append(fp[a[near]])
        right.append(fp[a[near] + lag])
    for s, e in zip(starts[:-1], starts[1:]):
        if e - s > 32:
            for a, b in _tile_links(fp[s:e], columns["ones"][s:e], radius):
                if len(a):
                    a, b = forest(a.view(np.int64), b.view(np.int64))
                    left.append(a.view(np.uint64))
                    right.append(b.view(np.uint64))
    if not left or not sum(map(len, left)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))


def near_links(prints: DataFrame, path: str, radius: int = RADIUS, blocks: int = BLOCKS,
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most ``radius`` bits.

    The links of a group are cut down to a spanning forest inside each task, which keeps every
    component. Buckets of rows that agree in some blocks come from an exact count; those with
    more than ``tile_rows`` rows are dealt into tiles by population count and a hash, and only
    pairs of tiles whose population counts are within the radius become units of work, so no task
    holds more than two tiles of a bucket.
    """
    keys = _block_keys(prints, radius, blocks)
    sizes = keys.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    rows = keys.join(sizes, ["choice", "block"]).withColumn("ones", F.bit_count("fp"))
    small = rows.where(F.col("n") <= tile_rows).select(
        "choice", "block", F.lit(0).alias("tile"), F.lit(0).alias("other"), "ones", "fp")
    # tile = population count * salts + salt; a unit is an ordered pair of tiles within the radius.
    large = rows.where(F.col("n") > tile_rows).withColumn(
        "salts", F.ceil(F.col("n") / tile_rows).cast("int")).withColumn(
        "own", (F.col("ones") * F.col("salts") + F.pmod(F.xxhash64("fp"), "salts")).cast("int"))
    reach = F.sequence((F.col("ones") - radius) * F.col("salts"), (F.col("ones") + radius + 1) * F.col("salts") - 1)
    large = large.withColumn("mate", F.explode(reach)).select(
        "choice", "block", F.least("own", "mate").cast("int").alias("tile"),
        F.greatest("own", "mate").cast("int").alias("other"), "ones", "fp")
    units = small.union(large)
    order = ["choice", "block", "tile", "other", "ones", "fp"]
    units = units.repartition(*order[:4]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in order}
            held = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            n = len(held["fp"])
            # The last unit may go on in the next batch.
            first = n - 1
            same = np.ones(n, bool)
            for name in order[:4]:
                same &= held[name] == held[name][-1]
            first = int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
            if first:
                yield from emit({k: v[:first] for k, v in held.items()})
                held = {k: v[first:] for k, v in held.items()}
        if held and len(held["fp"]):
            yield from emit(held)

    def emit(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = _unit_links(columns, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return store(units.mapInArrow(run, "a long, b long"), f"{path}/links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links between fingerprints that differ in
    at most ``radius`` bits; texts without words have fingerprint 0 and link like any other. A
    null key stays in its row; a component of null keys only has a null id. Repeated rows stay.
    """
    path = new_path(docs.sparkSession, "simhash")
    prints = store(fingerprints(docs, key, text), f"{path}/prints")
    distinct = store(prints.groupBy("fp").agg(F.min(key).alias("least")), f"{path}/distinct")
    found = components(near_links(distinct.select("fp"), path, radius), f"{path}/components")
    member = store(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")), f"{path}/members")
    roots = store(member.groupBy("root").agg(F.min("least").alias("component_id")), f"{path}/roots")
    named = store(member.join(roots, "root").select("fp", "component_id"), f"{path}/named")
    return prints.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(key, version, shingles, bands) of every row of ``rows(key, version, text)``.

    ``shingles`` is a digest of the shingle set, so rows with equal sets are equal in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("version"),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], ["key", "version", "shingles", "bands"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, version string, shingles binary, bands array<long>")


def _members(rows: DataFrame, words: int) -> DataFrame:
    """(shingles, members): the shingle set of every row of ``rows(shingles, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shingles"), pa.array(sets, pa.list_(pa.int64()))], ["shingles", "members"])

    return rows.select("shingles", "text").mapInArrow(run, "shingles binary, members array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of shingle sets that share at least ``similarity`` of all their shingles."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(shared / (F.size("left") + F.size("right") - shared) >= similarity).select("a", "b")


def _copy_groups(rows: DataFrame, sketches: DataFrame, words: int, similarity: float, path: str) -> DataFrame:
    """(node, component) of the shingle sets that are near copies of others.

    Candidates agree in a band: each set is compared with the smallest one of each of its buckets,
    so a bucket of any size costs one comparison a member.
    """
    distinct = store(sketches.groupBy("shingles").agg(F.any_value("bands").alias("bands"), F.min(F.struct("version", "key")).alias("at")),
                     f"{path}/distinct")
    banded = store(distinct.select("shingles", F.posexplode("bands").alias("band", "bucket")), f"{path}/banded")
    buckets = store(banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("shingles").alias("least"))
                    .where("n > 1").drop("n"), f"{path}/buckets")
    stars = store(banded.join(buckets, ["band", "bucket"]).where("shingles <> least").select(
        F.col("least").alias("a"), F.col("shingles").alias("b")).distinct(), f"{path}/stars")
    # One text of each set that is compared: its smallest row, which the counting down has found.
    met = stars.select(F.explode(F.array("a", "b")).alias("shingles")).distinct()
    chosen = distinct.join(met, "shingles", "left_semi").select(
        "shingles", F.col("at.version").alias("_v"), F.col("at.key").alias("_k"))
    texts_of = rows.join(store(chosen, f"{path}/chosen"), (F.col("version") == F.col("_v")) & F.col("key").eqNullSafe(F.col("_k")))
    sets = store(_members(texts_of.dropDuplicates(["shingles"]), words), f"{path}/sets")
    return components(store(_confirmed(stars, sets, similarity), f"{path}/confirmed"), f"{path}/groups")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = COPY_WORDS,
                similarity: float = SIMILARITY) -> DataFrame:
    """(key, version, part) of every row: near copies, and what they reach, have one part.

    Near copies share at least ``similarity`` of all their distinct shingles of ``words`` words,
    counted exactly. Candidates agree in a band of MinHash values with the smallest set of a bucket.
    Two copies are missed if each only ever meets smaller sets that are unlike it; this is for
    samples in which copies should count once, not for finding all of them. ``version`` is a digest
    of the text. Texts without words are copies of each other.
    """
    path = new_path(docs.sparkSession, "copies")
    rows = docs.select(F.col(key).alias("key"), text_version(text).alias("version"), F.col(text).alias("text"))
    sketches = store(_sketches(rows, words), f"{path}/sketches")
    groups = _copy_groups(rows, sketches, words, similarity, path)
    return sketches.join(groups.toDF("shingles", "part"), "shingles", "left").select(
        "key", "version", F.coalesce("part", "shingles").alias("part"))


def text_version(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                         radius: int = RADIUS) -> DataFrame:
    """One row of each group of texts whose SimHash fingerprints are linked: the smallest key, a null key last.

    Links are those of ``near_duplicates``. Rows are told apart by key and text, so null and
    repeated keys are judged row by row; rows that repeat both are one. Texts without words are
    one group. Other columns stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    path = new_path(spark, "simhash")
    named = docs.select(F.struct(F.isnull(F.col(key)).alias("none"), F.col(key).alias("key"), row_print(key, text).alias("print")).alias("row"),
                        F.col(text).alias("text"))
    prints = store(fingerprints(named, "row", "text", words), f"{path}/prints")
    distinct = store(prints.groupBy("fp").agg(F.min("row").alias("row")), f"{path}/distinct")
    found = components(near_links(distinct.select("fp"), path, radius, max(BLOCKS, radius + 3)), f"{path}/components")
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    kept = store(roots.groupBy("root").agg(F.min("row").alias("row")).select("row.print"), new_path(spark, "kept"))
    release(spark, path)
    # One column names a row in the join and among its repeats, so the texts are shuffled once.
    whole = docs.select(F.struct("*").alias("whole"), row_print(key, text).alias("print"))
    return whole.join(kept, "print", "left_semi").dropDuplicates(["print"]).select("whole.*")
