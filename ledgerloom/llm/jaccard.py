"""N-gram Jaccard join: all documents whose sets of word shingles are similar, exactly.

1. Texts become sorted arrays of 64-bit shingle hashes. Documents with equal sets are one class,
   which goes on as its smallest doc_id.
2. Tiles. Two sets of Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of
   each, in any order that is the same for all sets. The order here puts shingles that a bounded
   sample of documents repeats last, and is by hash otherwise. A tile is one shingle and one band of
   sizes: what cannot be similar by size does not meet. Tiles of one class end here.
3. In each shingle's tiles every class is compared with the smallest one. A comparison first bounds the
   overlap from above by the bits that one hashed bitmap has and the other lacks, and only then
   intersects the sorted arrays. Pairs found are joined to components.
4. Tiles in which two components are left are compared in full, between components only, and in
   blocks, of which only pairs go on that their bitmaps leave. So copies are linked without all pairs
   of a group, and no link between different components is missed.

The similarity test is in integers: 100 * overlap >= percent * union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, components, in_tiles, listed_apart, only_listed, text_slices, tile_pairs

#: Documents sampled for the order of the shingles, and in how many of them a shingle is frequent. Only the speed depends on these.
SAMPLE_DOCS, FREQUENT = 16384, 2
#: Rows of a tile compared with each other at a time, and what makes a tile.
TILE, KEY = 512, ["shingle", "tile"]
#: Word hashes that a worker remembers.
REMEMBERED = 120_000
#: Pairs whose sets are compared at a time.
PAIR_ROWS = 500
_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()
_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i) | 1 for i in range(64)], np.uint64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``width`` words of a UTF-8 text.

    A-Z are lower-cased and words are separated by space and bytes 9 to 13. Fewer words make one
    shingle, no words none.
    """
    words = text.translate(_UPPER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    span = min(width, n)
    total = np.full(n - span + 1, (span * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(span):
        part = (h[i : n - span + 1 + i] ^ (h[i : n - span + 1 + i] >> np.uint64(29))) * _FACTORS[i]
        total = (total ^ part ^ (part >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i)
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x94D049BB133111EB)
    total ^= total >> np.uint64(30)
    return np.unique(total)


def band(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The band of sizes; similar sets are in the same band or in neighbouring ones."""
    out = np.floor(np.log(np.maximum(n, 1)) / -math.log(percent / 100)).astype(np.int64)
    return out if out.ndim else int(out)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A hashed bitmap of ``bits`` (a power of two) bits, as bytes."""
    out = np.zeros(bits, np.uint8)
    out[(hashes >> np.uint64(7)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little")


def bound(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """At most so many hashes are in both sets: each bit that only one has costs that one a member."""
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def bits_for(n: int) -> int:
    """The width of a size's bitmap."""
    return 1 << max(6, (2 * n).bit_length())


def folded(a: np.ndarray, to: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits: bit i stands for all that are i modulo the new width."""
    while len(a) > to:
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return a


def plausible(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two sets with these bitmaps and sizes may be similar."""
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    return bound(folded(x, width), folded(y, width), n, m) >= -(-percent * (n + m) // (100 + percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, for sorted arrays without repeats."""
    n, m = len(a), len(b)
    if not n or not m:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def _prefix(h: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    n = len(h)
    k = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        late = frequent[at] == h
        rare = h[~late]
        return rare[:k] if len(rare) >= k else np.concatenate((rare, h[late][: k - len(rare)]))
    return h[:k]


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that at least FREQUENT of SAMPLE_DOCS documents have, sorted. Bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("_text").cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_pydict({"s": pa.array(shingles(t, width).view(np.int64), pa.int64())})

    picked = texts.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    sample = texts.join(F.broadcast(picked.distinct()), "id", "left_semi")
    found = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT).select("s")
    got = found.toArrow().column("s").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def _sketches(texts: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, b band, digest of the set, bits its bitmap, prefix of the set) of every document."""
    order = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                sets = [shingles(t, width) for t in part.column("_text").cast(pa.binary()).to_pylist()]
                heads = [_prefix(h, order.value, percent) for h in sets]
                ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
                flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
                n = np.array([len(h) for h in sets], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"),
                        "n": pa.array(n),
                        "b": pa.array(band(n, percent)),
                        "digest": pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                        "bits": pa.array([bitmap(h, bits_for(len(h))).tobytes() for h in sets], pa.binary()),
                        "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    }
                )

    return texts.mapInArrow(run, "id long, n long, b long, digest binary, bits binary, prefix array<long>")


def _plausible(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "n", "m")]
            keep = pa.array([plausible(*row, percent) for row in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    a = signs.select(F.col("id").alias("u"), F.col("n"), F.col("bits").alias("a"))
    b = signs.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", "n", "m").mapInArrow(run, "u long, v long").distinct()


def _tile_pairs(rest: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different components in a tile that sizes and bitmaps leave.

    ``rest`` has shingle, b, id, n and root. A tile holds the rows of one shingle and band, and those of
    the next band to compare them with. A row knows all its shingles in ``rest``, so a pair leaves
    only the tile of the smallest shingle that both have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in tile_pairs(batches, KEY):
            a = _Block(one)
            b = a if two is None else _Block(two)
            for wide, rows in a.widths.items():
                for other, columns in b.widths.items():
                    x, y = a.folded(wide, min(wide, other)), b.folded(other, min(wide, other))
                    for k in range(0, len(rows), 64):
                        i = rows[k : k + 64]
                        shared = np.bitwise_count(x[k : k + 64, None, :] & y[None]).sum(2, dtype=np.int64)
                        n, m = a.n[i][:, None], b.n[columns][None]
                        most = np.minimum(n - np.bitwise_count(x[k : k + 64]).sum(1, dtype=np.int64)[:, None], m - np.bitwise_count(y).sum(1, dtype=np.int64)[None]) + shared
                        keep = (most * (100 + percent) >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                        keep &= (a.root[i][:, None] != b.root[columns][None]) & (a.own[i][:, None] | b.own[columns][None])
                        if two is None:
                            keep &= a.id[i][:, None] < b.id[columns][None]
                        p, q = np.nonzero(keep)
                        here = one.column("shingle")[0].as_py() if len(p) else 0
                        first = [min(a.all[x] & b.all[y]) == here for x, y in zip(i[p].tolist(), columns[q].tolist(), strict=True)]
                        if any(first):
                            u, v = a.id[i[p]][first], b.id[columns[q]][first]
                            yield pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    own = rest.withColumn("tile", F.explode(F.array(F.col("b"), F.col("b") - 1))).withColumn("own", F.col("tile") == F.col("b")).drop("b")
    every = rest.groupBy("id", "n").agg(F.collect_list("shingle").alias("every"))  # of a prefix, so bounded by its document
    tiles = in_tiles(own, KEY, F.xxhash64("id"), TILE, every.join(signs.select("id", "n", "bits"), ["id", "n"]), ["id", "n"])
    return tiles.select("shingle", "tile", "low", "high", "part", "id", "n", "root", "own", "bits", "every").mapInArrow(run, "u long, v long").where("u <> v").distinct()


class _Block:
    """The columns of a tile's rows, and their bitmaps by width."""

    def __init__(self, table: pa.Table):
        self.id, self.n, self.root = (table.column(c).to_numpy() for c in ("id", "n", "root"))
        self.own = table.column("own").to_numpy(zero_copy_only=False)
        self.all = [set(x) for x in table.column("every").to_pylist()]
        bits = table.column("bits").to_pylist()
        size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.widths = {w: np.flatnonzero(size == w) for w in np.unique(size).tolist()}
        self.maps = {w: np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1) for w, rows in self.widths.items()}

    def folded(self, wide: int, to: int) -> np.ndarray:
        x = self.maps[wide]
        while wide > to:
            wide //= 2
            x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
        return x


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of a saved table whose documents are similar. Only texts of documents in pairs move."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                sets = [shingles(t, width).tobytes() for t in part.column("_text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "set": pa.array(sets, pa.binary())})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PAIR_ROWS):
                batch = whole.slice(at, PAIR_ROWS)
                sets = zip(batch.column("a"), batch.column("b"), strict=True)
                keep = pa.array([similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in sets], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    ids = scratch.save(name, pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct())
    sets = only_listed(texts, ids).mapInArrow(hashed, "id long, set binary")
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(compared, "u long, v long").distinct()


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs`` whose key is not null.

    component_id is the smallest key reachable over links, the row's own included. Null text is empty
    text; a text without words has no shingles and links with nothing; rows with equal sets link
    whatever their texts; a key that occurs twice gets a row for each, and its texts' links hold for
    both. An empty table gives no rows. ``width`` is at most 64 words. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(docs, text, key)
    order = _frequent(texts, width)
    sketches = scratch.save("sketches", _sketches(texts, order, width, percent))

    # One class for each set. Saved, the sets that repeat are a plain side of the join, so a set that very
    # many documents have is dealt with like any skewed key.
    lowest = sketches.where("n > 0").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    lowest = scratch.save("lowest", lowest.select("n", "digest", "rep"))
    classes = scratch.save("classes", sketches.select("id", "n", "digest").join(lowest, ["n", "digest"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    # Sets that surely do not repeat stay where they are; of the others the class's row is picked by a join.
    once, again = listed_apart(sketches.where("n > 0").select("id", "n", "b", "digest", "prefix"), lowest, "digest")
    heads = again.join(lowest, ["n", "digest"], "left").where("rep is null or id = rep").dropDuplicates(["id", "n", "digest"])
    heads = scratch.save("heads", heads.select("id", "n", "b", "prefix"))

    # Tiles: a shingle and two neighbouring bands, so that every similar pair meets in one. Shingles are counted with
    # partial counts and joined to the rows, so a very common one is split like any skewed key.
    posting = once.select("id", "n", "b", "prefix").unionByName(heads).select("id", "n", "b", F.explode("prefix").alias("shingle"))
    shared = posting.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("head")).where("members > 1").drop("members")
    tiles = scratch.save("tiles", posting.join(shared, "shingle"))

    signs = scratch.save("signs", sketches.where("n > 0").select("id", "n", "bits"))
    scratch.drop("sketches", "lowest", "heads")
    scratch.release()

    sizes = tiles.where("id = head").select(F.col("id").alias("u"), F.col("n").alias("head_n")).distinct()
    star = tiles.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"), "n").distinct()
    star = scratch.save("star", star.join(sizes, "u").where(f"100 * least(n, head_n) >= {percent} * greatest(n, head_n)").select("u", "v").distinct())
    star1 = scratch.save("star1", _plausible(star, signs, percent))
    found = scratch.save("found", _verified(star1, texts, scratch, "asked", width, percent))
    scratch.drop("star1", "asked")
    scratch.release()
    joined = components(found, scratch, "cc1")

    # What is left: tiles that still hold two components.
    # Of tiles with the same members one is enough; a passage that documents share makes many such.
    h = F.xxhash64("id", "n")
    low32 = F.lit(0xFFFFFFFF).cast("long")
    members = [F.count(F.lit(1)).alias("c"), F.sum(h.bitwiseAND(low32)).alias("x"), F.sum(F.shiftrightunsigned(h, 32)).alias("y"), F.sum(F.xxhash64("n", "id").bitwiseAND(low32)).alias("z")]
    chosen = tiles.groupBy("shingle").agg(*members).groupBy("c", "x", "y", "z").agg(F.min("shingle").alias("shingle")).select("shingle")
    named = tiles.drop("head").join(chosen, "shingle", "left_semi").join(joined, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    named = scratch.save("named", named)
    mixed = named.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
    rest = scratch.save("rest", named.join(mixed, "shingle", "left_semi"))
    scratch.drop("tiles", "named")
    more = scratch.save("more", _tile_pairs(rest, signs, percent).join(star, ["u", "v"], "left_anti"))
    scratch.drop("rest", "star", "signs")
    found2 = scratch.save("found2", _verified(more, texts, scratch, "asked2", width, percent))
    scratch.release()

    # Copies have their class's root, so they are no links; only a key of several classes links those.
    several = classes.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id")
    same = classes.join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
    stars = joined.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(stars.unionByName(found2).unionByName(same), scratch, "cc2")
    scratch.keep("classes", "cc2-roots")
    out = classes.join(roots, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
