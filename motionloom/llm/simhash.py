"""SimHash near-dedup with deletion-variant signatures.

Fingerprints: A-Z lower-cased, words between ASCII white space, four-word shingles
with repeats (fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is
1 if more than half the hashes have it. Two fingerprints are linked at ``MAX_BITS``
(4) differing bits or fewer.

Search: 64 bits are cut into three segments. Of four differing bits at most one
falls into one of them, so that two linked fingerprints agree in some segment after
one of its bits is blanked out. Each distinct fingerprint is therefore indexed under
all its segments with each bit blanked in turn (64 keys); those that share a key
meet in one bucket, where the distance is verified. A bucket of more than ``BUCKET``
fingerprints first gives up its dense groups, each absorbed at once, and is then cut
again by the same rule over the bits that its key leaves open, so that the
comparisons of a hot bucket stay far below all pairs. A bucket gives a spanning forest
of its links (fewer rows than fingerprints), never all pairs, and no link is lost:
components of the forests are components of the links.

Defined cases. Null and empty texts have fingerprint 0 and are linked like any
other. Rows that repeat a text or a doc_id each get their row; a repeated doc_id with another text doesn't link. A null doc_id gets
its fingerprint and the component of its link group, and links others like any row, but
names no component: a group of null doc_ids alone has a null one. ``dedup`` decides by row: of each group the row with the smallest doc_id (null last, ties by a hash of the text)
stays, and no other text goes with its doc_id. An empty table gives an empty result. Other columns pass through.

Scale. One scan of the text; from there on 16 bytes per row and 64 keys of 16 bytes per
distinct fingerprint are shuffled. Copies collapse into one fingerprint first. Each
task sorts its keys (spilling if need be) and holds one bucket at a time, eight
bytes per fingerprint. Components are found by distributed star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .graph import components

BITS, MAX_BITS, SHINGLE, SEED = 64, 4, 4, 42
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles that are hashed at once.
STEP = 1 << 14
BUCKET = 1024
#: Buckets up to this size are compared together, by the distance of their members' places.
SMALL = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each document."""
    n = len(offs) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, doc = c.words_of(data, offs)
    if not len(starts):
        return out
    # Words once more, one blank after each: a shingle is then one slice.
    width = ends - starts
    new_ends = np.cumsum(width + 1)
    new_starts = new_ends - width - 1
    packed = np.full(int(new_ends[-1]), 32, np.uint8)
    word = ~c.IS_SPACE[data]
    at = np.ones(len(packed), bool)
    at[new_ends - 1] = False
    packed[at] = _LOWER[data[word]]
    text = packed.tobytes()
    first = np.searchsorted(doc, np.arange(n), "left")
    count = np.searchsorted(doc, np.arange(n), "right") - first
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero(count):
        a, k = int(first[i]), int(count[i])
        end = a + max(k - SHINGLE, 0) + 1
        reach = min(SHINGLE, k) - 1
        ones = np.zeros(BITS, np.int64)
        for p in range(a, end, STEP):
            q = min(p + STEP, end)
            begin, stop = new_starts[p:q].tolist(), (new_ends[p + reach : q + reach] - 1).tolist()
            h = np.array([digest(text[x:y], SEED) for x, y in zip(begin, stop, strict=True)], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > end - a, bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint(batches):
    for batch in batches:
        found = [fingerprints(data, offs) for _, _, data, offs in c.text_blocks(batch.column(1))]
        fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["row", "fp"])


def _absorb(fp: np.ndarray, left: np.ndarray, join) -> np.ndarray:
    """Joins the whole link group of the first of left; the places that aren't in it stay."""
    root, left = left[0], left[1:]
    front = np.array([root])
    while len(front) and len(left):
        some = max(1, min(64, (1 << 22) // len(left)))
        near = (np.bitwise_count(fp[front[:some], None] ^ fp[None, left]) <= MAX_BITS).any(axis=0)
        found, left = left[near], left[~near]
        for x in found.tolist():
            join(int(root), x)
        front = np.concatenate([front[some:], found])
    return left


def linked(fp: np.ndarray, free: np.ndarray, join) -> None:
    """Joins all link groups of fp (distinct fingerprints that differ in the bits of free only).

    Dense groups are absorbed whole, at a cost that grows with their size only. If more than BUCKET others are
    left, they are cut by blanking one bit of a third of the free bits in turn, as the segments were.
    """
    left = np.arange(len(fp))
    for _ in range(16):
        if len(left) <= BUCKET:
            break
        left = _absorb(fp, left, join)
    if len(left) > BUCKET:
        for part in np.array_split(free, 3):
            mask = int(sum(1 << int(b) for b in part))
            for bit in part:
                key = fp[left] & np.uint64(mask & ~(1 << int(bit)))
                order = np.argsort(key, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(left)]])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    run = left[order[a:b]]
                    while len(run) > 1:
                        run = _absorb(fp, run, join)
        return
    while len(left) > 1:
        left = _absorb(fp, left, join)


class Forest:
    """Union-find over places; the root is the smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.fromiter(self.parent, np.int64, len(self.parent))
        return child, np.array([self.find(x) for x in child.tolist()], np.int64)


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the children and roots of each bucket's forest; key is sorted."""
    n = len(key)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [n]])
    size = np.diff(cuts)
    rest = np.repeat(cuts[1:], size) - np.arange(n)  # rows to the end of the bucket, itself included
    small = np.repeat(size, size) <= SMALL
    found = Forest()
    at = np.flatnonzero(small & (rest > 1))
    for d in range(1, SMALL):
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= MAX_BITS]
        for x in near.tolist():
            found.join(x, x + d)
        at = at[rest[at] > d + 1]
    for a, k in zip(cuts[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        linked(fp[a : a + k], _free(int(key[a]) & (1 << 64) - 1), lambda x, y, a=a: found.join(a + x, a + y))
    return found.edges()


def _free(key: int) -> np.ndarray:
    """Bits that a key leaves open; the key's top byte tells the blanked bit."""
    bit = key >> 56 & 0xFF
    start, width = next(s for s in SEGMENTS if s[0] <= bit < s[0] + s[1])
    return np.array([b for b in range(BITS) if b == bit or not start <= b < start + width])


def _links(batches):
    """Rows (key, fp, node) sorted by key, to edges of each bucket's forest."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        key, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
        child, root = bucket_links(key, fp.view(np.uint64))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp, node = (batch.column(k).to_numpy() for k in range(3))
        if held and held[-1][0][-1] != key[0]:
            yield flush()
        last = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
        if last:
            held.append((key[:last], fp[:last], node[:last]))
            yield flush()
        held.append((key[last:], fp[last:], node[last:]))
    if held:
        yield flush()


def _keys(batches):
    """64 rows for each fingerprint: a segment with one bit blanked, and which bit."""
    for batch in batches:
        fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for i in range(0, len(fp), 4096):
            part, own = fp[i : i + 4096], node[i : i + 4096]
            keys = []
            for start, width in SEGMENTS:
                for bit in range(start, start + width):
                    mask = ((1 << width) - 1 << start) & ~(1 << bit)
                    keys.append((part & np.uint64(mask)) >> np.uint64(start) | np.uint64(bit << 56))
            key = np.stack(keys, axis=1).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(part.view(np.int64), BITS)), pa.array(np.repeat(own, BITS))], ["key", "fp", "node"])


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp, group (a fingerprint of its link group) and component_id of each row."""
    given = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("row"), "text")
    prints = c.in_arrow(given, _fingerprint, "row struct<doc_id: long, h: long>, fp long")
    prints = c.written(prints.select("row.doc_id", "row.h", "fp"), "fingerprints")
    distinct = c.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    index = c.in_arrow(distinct.select("fp", F.col("fp").alias("node")), _keys, "key long, fp long, node long")
    sorted_keys = index.repartition("key").sortWithinPartitions("key")
    found = components(c.in_arrow(sorted_keys, _links, "a long, b long"))
    of = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    of = c.written(of, "groups")
    named = of.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(of.select("fp", "group").join(named, "group"), "fp").select("doc_id", "h", "fp", "group", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id (the smallest doc_id of its link group, null without any) of each row."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays, with all its columns: the one with the smallest doc_id (null last, ties by a hash of the text)."""
    names, rows = docs.columns, c.written(_grouped(docs).select("doc_id", "h", "group"), "rows")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("_doc"), F.col("k.h").alias("_h"))
    row = docs.select(F.struct(*(F.col(f"`{k}`") for k in names)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_own"))
    kept = row.join(first, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_h")), "left_semi")
    if not rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # rows that repeat both
        kept = kept.dropDuplicates(["_id", "_own"])
    return kept.select(*(F.col("_row").getField(k).alias(k) for k in names))
