"""Embedding near-duplicates by Euclidean p-stable hashing, with exact cosine checks.

Equal vectors of a label are one class. A class's vector, normalised, is projected on Gaussian
directions, shifted and quantised; some such numbers make the bucket in each of several tables. How many
numbers and tables grows with the classes of a label (``hashings``), so that the classes that meet by chance in a bucket are at most about
``CROWD`` at any size, and a pair of cosine 0.93 still meets in some table with probability 0.9999, closer pairs more often.

What is dealt to the buckets is an id and the signs of 128 projections. A bucket is compared by signs first; only rows
with a partner whose signs differ in at most ``SIGNS_APART`` places (a pair at the threshold does with probability above 1 - 1e-7) fetch their
vector, and all pairs of those rows are compared by cosine in double precision, a pair only in the first
table where it meets. A bucket of more than ``TILE`` classes is split by hash into parts, and each pair
of parts is a task's work of its own, so a hot bucket is compared whole but nowhere gathered. What
leaves a tile is a row for each class with a link: its links' number and one edge of a spanning forest.

Results for odd input: a vector that is null, empty, zero or holds null or non-finite components, or
whose label is null, links with nothing, is its own component and kept (unless a vector of the same id links); vectors of
different lengths do not link; rows with a null id are left out; rows with the same id are vectors of their own, in one component; an
empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, by_tile, components, in_tiles, tile_pairs

#: Classes compared with each other at a time, rows of them whose signs are, and pairs whose buckets are.
TILE, BLOCK, PAIRS = 1024, 128, 1 << 16
#: Width of a quantisation step; how likely a pair at the threshold may be missed; classes of a bucket by chance.
WIDTH, MISSED, CROWD, LEAST_HASHES = 2.0, 1e-4, 1000, 4
#: Sign projections of a vector, and in how many of them similar vectors may differ.
SIGNS = 128
KEY = ["label", "size", "t", "bucket"]
TILE_KEY = [*KEY, "low", "high"]


def meets(cosine: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection of two unit vectors is the same."""
    c = sqrt(2 - 2 * cosine) / width
    return erf(1 / (c * sqrt(2))) - 2 * c / sqrt(2 * pi) * (1 - exp(-1 / (2 * c * c)))


def hashings(classes: DataFrame, threshold: float) -> DataFrame:
    """(label, size, hashes of a table, tables) by the number of a label's classes."""
    counts = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("crowd"))
    hashes = F.greatest(F.lit(LEAST_HASHES), F.ceil(F.log(F.col("crowd") / CROWD) / -log(meets(0.0)))).cast("int")
    tables = F.ceil(F.lit(log(MISSED)) / F.log1p(-F.pow(F.lit(meets(threshold)), F.col("hashes")))).cast("int")
    return counts.withColumn("hashes", hashes).withColumn("tables", tables).drop("crowd")


def signs_apart(threshold: float) -> int:
    """Signs that two vectors at the threshold differ in at most, but for one pair in ten million."""
    p = float(np.arccos(min(max(threshold, -1.0), 1.0))) / pi
    return ceil(SIGNS * p + 5.5 * sqrt(SIGNS * p * (1 - p)))


class Projections:
    """Random directions and shifts, the same in every process, for vectors of one length."""

    def __init__(self, size: int, tables: int, hashes: int, width: float):
        rng = np.random.default_rng([size, tables, hashes])
        self.a = rng.normal(size=(size, tables * hashes)) / width
        self.b = rng.uniform(size=tables * hashes)
        self.mix = rng.integers(1, 1 << 62, (tables, hashes)) * 2 + 1
        self.tables, self.hashes = tables, hashes
        self.plane = np.random.default_rng([size, SIGNS]).normal(size=(size, SIGNS))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) bucket numbers of normalised rows."""
        total = np.broadcast_to(self.b, (len(x), len(self.b))).copy()
        for j, direction in enumerate(self.a):  # in this order for any number of rows, so a vector's buckets never differ
            total += x[:, j : j + 1] * direction
        q = np.floor(total).astype(np.int64).reshape(len(x), self.tables, self.hashes)
        with np.errstate(over="ignore"):
            h = (q * self.mix).sum(2)
            return (h ^ (h >> 31)) * np.int64(0x1CE4E5B9BF58476D)

    def signs(self, x: np.ndarray) -> np.ndarray:
        """(n, SIGNS / 8) bytes: on which side of random planes the rows are."""
        return np.packbits(x @ self.plane > 0, axis=1)


def vectors(blobs: list[bytes], kind: str) -> np.ndarray:
    """Normalised double rows of equally long vectors, whose components are stored as ``kind``."""
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _valid(rows: DataFrame, kind: str) -> DataFrame:
    """(id, label, size, vec) of every row; vec holds the components as ``kind``, doubles scaled where their squares
    would not be finite, and is null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, vec = [], []
            for v, labelled in zip(batch.column("v"), batch.column("label").is_valid().to_pylist(), strict=True):
                flat = v.values
                x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64) if labelled and v.is_valid and len(flat) and not flat.null_count else np.zeros(1)
                top = np.abs(x).max()
                good = bool(np.isfinite(top)) and top > 0
                size.append(len(x) if good else 0)
                vec.append(((x if 1e-100 < top < 1e100 else x / top) + 0.0).astype(kind).tobytes() if good else None)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "size": pa.array(size, pa.int32()), "vec": pa.array(vec, pa.binary())})

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, label {label}, size int, vec binary")


def _screened(tiles: DataFrame, label: str, apart: int) -> DataFrame:
    """The rows of tiles that have a partner whose signs are about the same, without the signs."""
    names = [*TILE_KEY, "part", "id", "cid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in tile_pairs(batches, KEY):
            a = np.frombuffer(b"".join(one.column("signs").to_pylist()), np.uint64).reshape(len(one), -1)
            b = a if two is None else np.frombuffer(b"".join(two.column("signs").to_pylist()), np.uint64).reshape(len(two), -1)
            near_a, near_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for k in range(0, len(a), BLOCK):
                differ = np.bitwise_count(a[k : k + BLOCK, None, :] ^ b[None]).sum(2, dtype=np.uint16)
                near = differ <= apart
                if two is None:
                    near[np.arange(near.shape[0]), np.arange(k, k + near.shape[0])] = False
                near_a[k : k + BLOCK] = near.any(1)
                near_b |= near.any(0)
            for table, near in ((one, near_a),) if two is None else ((one, near_a), (two, near_b)):
                if near.any():
                    yield from table.select(names).filter(pa.array(near)).combine_chunks().to_batches()

    schema = f"label {label}, size int, t int, bucket long, low int, high int, part int, id long, cid long"
    return tiles.select(*names, "signs").mapInArrow(run, schema)


def _links(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(u, cid, v, n): in some tile, class (u, cid) links with n vectors, and hangs together with a class v."""
    made: dict[tuple[int, int, int], Projections] = {}

    def compare(one: pa.Table, two: pa.Table | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t, size, tables, hashes = (int(one.column(c)[0].as_py()) for c in ("t", "size", "tables", "hashes"))

        def parts(x: pa.Table):
            return vectors(x.column("vec").to_pylist(), kind), np.stack((x.column("id").to_numpy(), x.column("cid").to_numpy()), axis=1), x.column("n").to_numpy()

        a, ia, na = parts(one)
        b, ib, nb = parts(two) if two is not None else (a, ia, na)
        linked = a @ b.T >= threshold
        if two is None:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if not len(i):
            return
        # The pair counts in the first table where it meets; few rows have a link, so their buckets are worked out again.
        p = made.get((size, tables, hashes)) or made.setdefault((size, tables, hashes), Projections(size, tables, hashes, WIDTH))
        ra, wa = np.unique(i, return_inverse=True)
        rb, wb = np.unique(j, return_inverse=True)
        ka, kb = p.buckets(a[ra])[:, :t], p.buckets(b[rb])[:, :t]
        fresh = np.concatenate([~(ka[wa[k : k + PAIRS]] == kb[wb[k : k + PAIRS]]).any(1) for k in range(0, len(i), PAIRS)])
        i, j = i[fresh], j[fresh]
        if two is None:
            ids, n = ia, np.bincount(i, nb[j], len(ia))
            x, y = i, j
        else:
            ids, n = np.concatenate((ia, ib)), np.concatenate((np.bincount(i, nb[j], len(ia)), np.bincount(j, na[i], len(ib))))
            x, y = np.concatenate((i, j + len(ia))), np.concatenate((j + len(ia), i))
        low = np.arange(len(ids))
        while True:  # the smallest index reachable
            new = low.copy()
            np.minimum.at(new, x, low[y])
            new = new[new]
            if (new == low).all():
                break
            low = new
        has = n > 0
        if has.any():
            yield ids[has], ids[low[has], 0], n[has].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in tile_pairs(batches, KEY):
            for u, v, n in compare(one, two):
                yield pa.RecordBatch.from_pydict({"u": pa.array(u[:, 0]), "cid": pa.array(u[:, 1]), "v": pa.array(v), "n": pa.array(n)})

    return members.mapInArrow(run, "u long, cid long, v long, n long")


def near_duplicates(rows: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row whose key is not null: other vectors linked directly, the
    smallest key reachable by links (its own included), and whether that is its own."""
    scratch = Scratch(rows.sparkSession)
    given = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    element = rows.schema[vector].dataType.elementType.simpleString()
    stored = "<f4" if element == "float" else "<f8"
    valid = scratch.save("valid", _valid(given, stored))
    groups = ["label", "size", "vec"]
    own = valid.where("vec is not null")

    # A class is known by its smallest id; where a repeated id heads several classes, by its vector's hash as well.
    classes = own.groupBy(*groups).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("cid", F.xxhash64("vec"))
    classes = scratch.save("classes", classes)
    deal = hashings(classes, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int, int], Projections] = {}
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("size", "tables", "hashes")])
            for kind in np.unique(kinds, axis=1).T:
                part = batch.filter(pa.array((kinds == kind[:, None]).all(0)))
                size, tables, hashes = key = tuple(kind.tolist())
                p = made.get(key) or made.setdefault(key, Projections(size, tables, hashes, WIDTH))
                x = vectors(part.column("vec").to_pylist(), stored)
                keys, signs = p.buckets(x), pa.array([s.tobytes() for s in p.signs(x)], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(part), t, np.int32)), "bucket": pa.array(keys[:, t]), "signs": signs, **{c: part.column(c) for c in ("label", "size", "id", "cid")}})

    label_kind = valid.schema["label"].dataType.simpleString()
    heads = classes.select("label", "size", "vec", F.col("rep").alias("id"), "n", "cid").join(deal, ["label", "size"])
    put = heads.drop("n").mapInArrow(hashed, f"t int, bucket long, signs binary, label {label_kind}, size int, id long, cid long")
    near = _screened(in_tiles(put, KEY, F.xxhash64("id", "cid"), TILE), label_kind, signs_apart(threshold))
    members = by_tile(near.join(heads, ["label", "size", "id", "cid"]), KEY).select(*TILE_KEY, "part", "id", "cid", "n", "vec", "tables", "hashes")
    links = scratch.save("links", _links(members, threshold, stored))
    scratch.release()

    # Rows of a class link to its head; so do all rows of a repeated id, whatever their vectors.
    copies = own.join(classes.select(*groups, "rep"), groups).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(links.select("u", "v").unionByName(copies), scratch)
    others = links.groupBy(F.col("u").alias("rep"), "cid").agg(F.sum("n").alias("others"))
    linked = own.join(classes.select(*groups, "rep", "cid", "n"), groups).join(others, ["rep", "cid"], "left")
    counts = linked.select("id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    alone = valid.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"))
    out = counts.unionByName(alone).join(roots, F.col("id") == F.col("node"), "left")
    root = F.coalesce("root", "id")
    scratch.keep("valid", "classes", "links", "cc-roots")
    return out.select(F.col("id").cast(rows.schema[key].dataType).alias(key), F.col("n_links").cast("long"), root.cast("long").alias("component_id"), (F.col("id") == root).alias("kept"))
