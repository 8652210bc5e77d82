"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set: A-Z lower-cased, words between ASCII white space, distinct runs of ``SHINGLE`` words (fewer words: the whole
sequence), each as a 64-bit hash of its words' hashes. Documents are linked if ``100 * intersection >= PERCENT * union``.

Signature: one hash of each shingle says its bin (of ``BANDS * ROWS``) and its rank there; a bin keeps its least one. An empty
bin takes the value of the first filled one in its own random order of bins (the same for all documents), so that
two signatures agree in a bin with the probability of their similarity. ``ROWS`` bins make a band, documents with an equal band meet in a bucket: at
a similarity of 0.85 two documents miss each other in all bands with a probability of 10**-8.

Candidates: equal sets are one class from the start. A bucket gives a star, each member with the bucket's smallest one, and each class is
first held against the one centre with which it shares most buckets: a pair a class. Confirmed links make components. Where a bucket still
holds several components, the members outside of its largest one are held against members of the others: first against the best
few by their signatures, then more, at last against all. Pairs within one component are never needed, and of the others
only those are tried that two short digests let pass: signatures, two bits a bin (``SKETCH`` numbers), that differ in ``DIFFER`` bins at most (a pair of
similarity 0.85 differs in 27 of them on average), and maps of ``64 * MAP`` bits that have a bit for each member of a set: what is set in one map alone is a shingle that the other set lacks, which bounds the similarity and loses nothing.

Pairs are confirmed on the full sets, which are made again for the documents in buckets only; a centre's set meets those of its pairs in lots of at most ``GROUP``.

Defined cases. A document without words (or text) has an empty set and is linked with nothing. Rows that repeat a text or a doc_id each get their row; a repeated
doc_id doesn't link. A null doc_id names no component: a group of null doc_ids alone has a null one, and all its rows
count as kept. An empty table gives an empty result. Other columns aren't read.

Scale. The text is read twice, for signatures and for sets; what moves of it is 8 bytes a word, of documents that share a bucket. Copies collapse to
one class by an aggregate that combines in tasks; a class has BANDS rows of 16 bytes. Hot buckets are joins on a plain key, which adaptive
execution splits; the sketches are compared within the join, so that it gives no rows but likely pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .graph import components

SHINGLE, PERCENT = 3, 85
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Pairs of one centre that a task confirms in a row.
GROUP = 64
#: Members that one outside of its bucket's largest component is held against in the rounds after the first; the last round takes all.
WIDTHS = (4, 64, None)
#: Numbers of a sketch and of a map of members, and the bins in which likely pairs may differ.
SKETCH, MAP, DIFFER = 8, 16, 76
#: Random orders of bins, in lots of so many places.
LOTS = (16, 128, 1024)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PROBES = (c.mix(np.arange(sum(LOTS) * BINS, dtype=c.U64) + c.U64(1 << 40)) % c.U64(BINS)).astype(np.int64).reshape(-1, BINS)


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE):
    """The sorted set of each document; words and runs of them are hashed for the whole block at once."""
    starts, ends, doc = c.words_of(data, offs)
    n = len(offs) - 1
    if not len(starts):
        yield from (np.zeros(0, np.uint64) for _ in range(n))
        return
    words = c.word_hashes(_LOWER[data], starts, ends)
    first = np.searchsorted(doc, np.arange(n + 1), "left")
    many = np.diff(first)
    runs = np.maximum(many - shingle + 1, np.minimum(many, 1))  # of each document, its last words' places aside
    h = np.empty(len(words), np.uint64)
    whole = len(words) - shingle + 1
    if whole > 0:
        h[:whole] = _run(words[k : k + whole] for k in range(shingle))
    for k in np.flatnonzero((many > 0) & (many < shingle)).tolist():
        h[first[k]] = _run(words[p : p + 1] for p in range(first[k], first[k + 1]))[0]
    for a, b in zip(first[:-1].tolist(), (first[:-1] + runs).tolist(), strict=True):
        own = np.sort(h[a:b])
        if len(own) > 1:
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        yield own


def _run(words) -> np.ndarray:
    """Hashes of runs of words from those of their first, second and further words; runs of different lengths are told apart."""
    h = None
    for k, x in enumerate(words, 1):
        h = c.mix(x + c.U64(k)) if h is None else c.mix(h * c.U64(c.BASES[0]) + c.mix(x + c.U64(k)))
    return h


def signature(members: np.ndarray) -> np.ndarray:
    """BINS values of a set that isn't empty."""
    x = np.sort(c.mix(members + c.U64(0x5851F42D4C957F2D)))
    bins = ((x >> c.U64(32)) * c.U64(BINS) >> c.U64(32)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[at]], filled[bins[at]] = x[at], True
    empty = np.flatnonzero(~filled)
    source, begin = np.full(len(empty), bins[0]), 0
    if len(at) > 1:
        left = np.arange(len(empty))
        for lot in LOTS:
            if not len(left):
                break
            probes = _PROBES[begin : begin + lot, empty[left]]
            hit = filled[probes]
            some = hit.any(axis=0)
            source[left[some]] = probes[hit.argmax(axis=0)[some], np.flatnonzero(some)]
            left, begin = left[~some], begin + lot
    out[empty] = out[source]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature, or of each of several."""
    key = np.arange(1, BANDS + 1, dtype=c.U64)
    for x in np.moveaxis(values.reshape(*values.shape[:-1], BANDS, ROWS), -1, 0):
        key = c.mix(key * c.U64(c.BASES[0]) + x)
    return key


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each value of a signature, or of each of several, as SKETCH numbers: first the lower bits of all bins, then the upper ones."""
    planes = np.zeros((*values.shape[:-1], 2, 32 * SKETCH), bool)
    planes[..., 0, :BINS], planes[..., 1, :BINS] = values & c.U64(1), values >> c.U64(1) & c.U64(1)
    return np.packbits(planes.reshape(*values.shape[:-1], 64 * SKETCH), axis=-1, bitorder="little").view(np.int64)


def member_map(members: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """A bit of 64 * MAP for each member of a set, as MAP numbers; sizes: of several sets, one after another."""
    many = 1 if sizes is None else len(sizes)
    bits = np.zeros((many, 64 * MAP), bool)
    bits[0 if sizes is None else np.repeat(np.arange(many), sizes), (c.mix(members + c.U64(0xA0761D6478BD642F)) % c.U64(64 * MAP)).astype(np.int64)] = True
    out = np.packbits(bits, axis=-1, bitorder="little").view(np.int64)
    return out[0] if sizes is None else out


def _digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two signed numbers."""
    raw = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _lists(rows: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of numbers as lists, at the places that are known; the others are null."""
    ends = np.concatenate([[0], np.cumsum(known)]) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()), mask=pa.array(~known))


def _signer(shingle: int):
    def kernel(batches):
        for batch in batches:
            for first, last, data, offs in c.text_blocks(batch.column(1)):
                sets = list(shingle_sets(data, offs, shingle))
                sizes = np.array([len(x) for x in sets])
                known, full = sizes > 0, [x for x in sets if len(x)]
                values = np.stack([signature(x) for x in full]) if full else np.zeros((0, BINS), np.uint64)
                digests = np.array([_digest(x) for x in full], np.int64).reshape(-1, 2)
                place = np.maximum(np.cumsum(known) - 1, 0)
                maps = member_map(np.concatenate(full), sizes[known]) if full else np.zeros((0, MAP), np.int64)
                told = [pa.array(digests[place, k] if full else np.zeros(len(sets), np.int64), mask=~known) for k in (0, 1)]
                arrays = [batch.column(0).slice(first, last - first), pa.array(sizes), *told, _lists(np.concatenate([sketch(values), maps], axis=1), known), _lists(band_keys(values).view(np.int64), known)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "d1", "d2", "sketch", "keys"])

    return kernel


def _set_maker(known, shingle: int):
    """Kernel from texts to the sets (d1, d2, members) that the filter may know, each once a task."""

    def kernel(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, data, offs in c.text_blocks(batch.column(0)):
                sets = [x for x in shingle_sets(data, offs, shingle) if len(x)]
                digests, found = [_digest(x) for x in sets], []
                asked = c.passes(known.value, np.array([d[0] for d in digests], np.int64).view(np.uint64))
                for d, members, ask in zip(digests, sets, asked.tolist(), strict=True):
                    if ask and d not in seen:
                        seen.add(d)
                        found.append((*d, members.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["d1", "d2", "members"])

    return kernel


def _confirmer(percent: int):
    """Kernel from rows (a, lot, b, members), where a group's centre comes first with b null, to links (a, b)."""

    def kernel(batches):
        key, centre = None, None
        for batch in batches:
            found = []
            a, lot, b = (batch.column(k).to_pylist() for k in range(3))
            for i, members in enumerate(batch.column(3)):
                own = np.frombuffer(members.as_py(), np.uint64)
                if b[i] is None:
                    key, centre = (a[i], lot[i]), own
                    continue
                assert key == (a[i], lot[i])
                small, large = sorted((len(own), len(centre)))
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return kernel


def _asked_sets(known):
    """Kernel that passes the sets (node, members) on that the filter may know."""

    def kernel(batches):
        for batch in batches:
            yield batch.filter(pa.array(c.passes(known.value, c.mix(batch.column(0).to_numpy().view(np.uint64)))))

    return kernel


def _hashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(c.mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["h"])


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (node, members) are similar enough; a is the centre. Only sets in pairs are moved."""
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    lot = F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / GROUP).cast("long"))
    lots = pairs.join(many, "a").select("a", lot.alias("lot"), "b")
    roles = c.written(lots.select("a", "lot", "b", F.col("b").alias("node")).union(lots.select("a", "lot", F.lit(None).cast("long"), "a").distinct()), "roles")
    known = sets.sparkSession.sparkContext.broadcast(c.filter_of(c.in_arrow(roles.select("node").distinct(), _hashes, "h long")))
    asked = c.in_arrow(sets, _asked_sets(known), "node long, members binary")
    groups = roles.join(asked, "node").select("a", "lot", "b", "members").repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return c.written(c.in_arrow(groups, _confirmer(percent), "a long, b long"), "links")


def _likely(x: str, y: str, percent: int):
    """Whether rows x and y of the table of nodes can be similar enough, by sizes, sketches and maps of members; and the bins in which they differ."""
    differ = " + ".join(f"bit_count(({x}.s{k} ^ {y}.s{k}) | ({x}.s{k + SKETCH // 2} ^ {y}.s{k + SKETCH // 2}))" for k in range(SKETCH // 2))
    lacks = lambda p, q: " + ".join(f"bit_count({p}.s{k} & ~{q}.s{k})" for k in range(SKETCH, SKETCH + MAP))
    shared = f"least({x}.n - ({lacks(x, y)}), {y}.n - ({lacks(y, x)}))"
    sizes = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    return F.expr(f"{sizes} AND {differ} <= {DIFFER} AND {100 + percent} * {shared} >= {percent} * ({x}.n + {y}.n)"), F.expr(differ)


def _met(mixed: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b, differ) of members (key, node, component, largest, n, s0, ..., keys) of different components of a bucket.

    Copies with small changes share most of their buckets; a pair is made in the first one alone, by the order of keys.
    """
    likely, differ = _likely("x", "y", percent)
    x, y = mixed.where("component <> largest").alias("x"), mixed.alias("y")
    once = F.expr("x.key = y.key AND x.component <> y.component AND (y.component = y.largest OR x.node < y.node)")
    first = F.expr("x.key = array_min(array_intersect(x.keys, y.keys))")
    return x.join(y, once & likely & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), differ.alias("differ"))


def _grouped(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """node and component of the nodes (node, d1, d2, n, s0, ..., keys) that are linked; None without candidates."""
    index = nodes.select("node", F.explode("keys").alias("key"))
    shared = c.written(index.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("many")).where("many > 1").drop("many"), "shared")
    members = c.written(index.join(shared, "key").select("key", "node", "centre"), "members")
    held = c.written(nodes.join(members.select("node").distinct(), "node", "left_semi"), "held")
    if held.isEmpty():
        return None
    known = docs.sparkSession.sparkContext.broadcast(c.filter_of(held.select(F.col("d1").alias("h"))))
    sets = c.in_arrow(docs.select("text"), _set_maker(known, shingle), "d1 long, d2 long, members binary").groupBy("d1", "d2").agg(F.first("members").alias("members"))
    sets = c.written(held.select("node", "d1", "d2").join(sets, ["d1", "d2"]).select("node", "members"), "sets", short=False)
    short = held.drop("d1", "d2", "keys")
    likely, _ = _likely("x", "y", percent)

    star = members.where("node <> centre").groupBy("node", "centre").count().groupBy("node").agg(F.max(F.struct("count", -F.col("centre"))).alias("best")).select((-F.col("best.col2")).alias("a"), F.col("node").alias("b"))
    star = star.join(short.alias("x"), F.col("a") == F.col("x.node")).join(short.alias("y"), F.col("b") == F.col("y.node")).where(likely).select("a", "b")
    tried = c.written(star, "pairs")
    links = _confirmed(sets, tried, percent)
    group = c.written(components(links), "groups")
    for width in WIDTHS:
        table = c.written(members.join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "labelled")
        sizes = table.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", "count").alias("largest"), F.count("*").alias("many"))
        mixed = c.written(table.join(sizes.where("many > 1"), "key").join(held.drop("d1", "d2"), "node").drop("many"), "mixed")
        pairs = _met(mixed, percent)
        both = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = pairs.join(both, ["a", "b"], "left_anti")
        if width:
            pairs = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(width)).alias("class")).agg(F.min(F.struct("differ", "b")).alias("best")).select("a", "best.b")
        pairs = c.written(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():  # nothing is left to be tried
            break
        more = _confirmed(sets, pairs, percent)
        links, tried = links.union(more), tried.union(pairs)
        if not more.isEmpty():
            group = c.written(components(links), "groups")
    return group


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its link group) and kept of each row."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, keys array<long>"
    prints = c.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _signer(shingle), schema)
    prints = c.written(prints.withColumn("row", F.monotonically_increasing_id()), "signatures", short=False)
    classes = c.written(prints.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = prints.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = c.written(nodes.select(F.col("row").alias("node"), "d1", "d2", F.col("n_shingles").alias("n"), *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH + MAP)), "keys"), "nodes", short=False)
    group = _grouped(docs, nodes, shingle, percent)
    of = classes.select("d1", "d2", F.col("least").alias("component_id"))
    if group is not None:
        named = c.written(classes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
        of = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("d1", "d2", "component_id")
    found = prints.select("doc_id", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()).alias("kept"))
