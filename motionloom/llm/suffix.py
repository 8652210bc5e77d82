"""Removal of repeated passages: every byte covered by a LENGTH-byte string that starts twice or more.

The corpus is cut into shards so that equal strings always meet, and suffix arrays
(``sais``) are built per shard.

1. Anchors. A string of LENGTH bytes holds LENGTH - GRAM + 1 grams of GRAM bytes; the one with the smallest hash is its
   anchor, which depends on the string alone. Consecutive starts with one anchor form a piece; its region is what their
   strings cover. Equal strings have equal anchors, so only pieces whose gram stands twice or more matter.
2. Copies. Equal regions of a gram are one region that stands c times; if c > 1, all its strings are repeated. A gram with
   one region is done with that.
3. Shards. The other grams' regions meet by gram, one of each kind with its c. Their suffix array and permuted common
   prefixes (up to LENGTH, byte by byte) give the starts whose strings are equal, and so how often each stands.
4. More context. A gram with more than CROWD kinds of region (a common passage amid ever new text) would make a hot
   shard. Its regions are cut into parts of STEP starts at a fixed distance from the anchor, which meet by gram, distance and the bytes that
   all strings of such a part share. Parts go the way of regions: copies, then shards with suffix arrays. A part that is crowded
   again differs in less than STEP bytes on either side; it is cut into its single strings, of which all that
   meet are copies.
5. Removal. Intervals are gathered by document and applied to its bytes.

Grams meet by 64-bit hashes, which only decide what a shard holds. Copies are told by two 64-bit hashes, without a comparison of their bytes. Both
are polynomials modulo 2**64, so they aren't independent and there is no bound on their errors: texts built for it of 1,024 bytes are known to agree in both; a
region has fewer than 2 * LENGTH bytes, and none of that length is known to. Strings are judged on the
input, matches never cross documents, and overlaps of a string with itself count.

Defined cases. Null and empty texts have 0 bytes; texts shorter than LENGTH lose nothing. Rows that repeat a doc_id are
documents of their own, so that a repeated row of LENGTH bytes or more is removed whole in each; equal rows share their intervals. An empty
table gives no rows. Other columns pass through in ``_row`` if named in keep.

Scale. Two scans make pieces (48 bytes for about 50 bytes of text); those of single grams end in the first aggregate. The text is
shuffled once, to meet its intervals, and again for documents with a region for a shard (the first document of each
kind has it). No task holds a gram's pieces: they are aggregated with a map-side combine, and the joins are plain equality
joins, which adaptive execution splits. Kernels take and give slices of about a quarter of a megabyte of text as columns; a very long document
costs a few bytes for each of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .sais import common_prefixes, suffix_array

LENGTH, GRAM = 200, 100
#: Kinds of region above which a gram is cut by more context.
CROWD = 1024
#: Starts in a part of a crowded region: about the square root of the starts of an anchor.
STEP = 10
#: Bytes of regions that one suffix array takes; a shard ends with a gram.
SHARD = 1 << 19
#: Bytes of regions in a batch that a task returns.
OUT = 1 << 20
_AT = 20  # bits of a place in a block

_MARK = "struct<k:bigint,c:bigint,s:int,n:int,hot:boolean>"


def _order(prefix: np.ndarray) -> np.ndarray:
    """By place: a hash of the gram there, then the place."""
    low = prefix[GRAM:] - prefix[:-GRAM]
    low *= c.powers(len(prefix))[1][: len(low)]
    low *= np.uint64(0xBF58476D1CE4E5B9)
    low &= np.uint64(~((1 << _AT) - 1) & (1 << 64) - 1)
    low |= np.arange(len(low), dtype=np.uint64)
    return low


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first start, starts, gram hash and the two region hashes of each piece."""
    n, span = len(data), LENGTH - GRAM + 1
    if n > 1 << _AT:  # one long document: in overlapping segments, each start in one of them
        step, out = 1 << (_AT - 1), []
        for a in range(0, n - LENGTH + 1, step):
            part = data[a : a + step + LENGTH - 1]
            doc, s, *rest = anchors(part, np.array([0, len(part)]))
            out.append((doc, s + a, *rest))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    counts = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    prefix = c.prefix_hash(data)
    low = _order(prefix)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(doc)) + np.repeat(offs[:-1] - (np.cumsum(counts) - counts), counts)
    anchor = (low[starts] & np.uint64((1 << _AT) - 1)).astype(np.int64)
    first = np.ones(len(doc), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(doc)))
    s, a = starts[at], anchor[at]
    end = s + many - 1 + LENGTH
    return doc[at], s - offs[doc[at]], many, c.hash_between(prefix, a, a + GRAM), c.hash_between(prefix, s, end), c.hash_between(c.prefix_hash(data, 1), s, end, 1)


def anchor_of(region: np.ndarray) -> int:
    """Place of the anchor in a piece's region: the smallest gram, the first of equal ones."""
    return int(_order(c.prefix_hash(region)).argmin())


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _pieces(batches):
    for batch in batches:
        doc_id, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, _, data, offs in c.text_blocks(batch.column(2)):
            doc, s, n, k, r, q = anchors(data, offs)
            yield _batch({"doc": doc_id[first + doc], "key": key[first + doc], "k": k.view(np.int64), "r": r.view(np.int64), "q": q.view(np.int64), "s": s.astype(np.int32), "n": n.astype(np.int32)})


def _bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of data[start : start + size]."""
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(data[at])]).cast(pa.binary())


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _lots(sizes: np.ndarray, limit: int = OUT):
    """Runs (first, last) of rows whose sizes add up to about the limit."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, last
        first = last


def _fields(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Row of each element of a column of lists of structs, and the named fields of the elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), row), *(inner.field(k).to_numpy(zero_copy_only=False) for k in names)


def _removal(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
    """Columns of what each document loses; start and end are places in it."""
    order = np.lexsort((start, doc))
    doc, first, stop = doc[order], (offs[doc] + start)[order], np.maximum.accumulate((offs[doc] + end)[order])
    new = np.ones(len(doc), bool)
    new[1:] = (first[1:] > stop[:-1]) | (doc[1:] != doc[:-1])
    at, n = np.flatnonzero(new), len(offs) - 1
    own, first, stop = doc[at], first[at], stop[np.append(at[1:], len(doc)) - 1] if len(at) else at
    spans, sha, k = np.bincount(own, minlength=n), [], 0
    for a, b, many in zip(offs[:-1].tolist(), offs[1:].tolist(), spans.tolist(), strict=True):
        digest = hashlib.sha256()
        for x, y in zip(first[k : k + many].tolist(), stop[k : k + many].tolist(), strict=True):
            digest.update(data[a:x])
            a = y
        digest.update(data[a:b])
        sha.append(digest.hexdigest())
        k += many
    runs = pa.StructArray.from_arrays([pa.array(first - offs[own]), pa.array(stop - offs[own])], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)), runs)
    removed = np.bincount(own, stop - first, minlength=n).astype(np.int64)
    return {"n_bytes": np.diff(offs), "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(sha, pa.string()), "spans": lists}


_SPAN = "array<struct<start:bigint,end:bigint>>"
_RESULT = f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_SPAN}"
#: Rows of one table: documents that are done (0), documents that wait for a shard (1), and regions (2) or parts (3) for it.
_APPLIED = f"kind int, doc long, key long, {_RESULT}, text binary, sure {_SPAN}, k long, g long, r long, q long, c long, s int, n int, bytes binary"


def _parts(text: np.ndarray, s: int, n: int, weight: int) -> list[tuple]:
    """The parts of a crowded region: hashes of what their strings share (k, g) and of their own bytes (r, q), c, s and n."""
    region = text[s : s + n - 1 + LENGTH]
    anchor = anchor_of(region)
    prefix = c.prefix_hash(region), c.prefix_hash(region, 1)
    out, starts = [], np.arange(n)
    for lot in np.split(starts, np.flatnonzero(np.diff((anchor - starts) // STEP)) + 1):
        # Bytes in all strings that start at this part's distances from the anchor, whichever of them this region has.
        far = int((anchor - lot[0]) // STEP) * STEP
        a, b = anchor - far, anchor - far - STEP + 1 + LENGTH
        k, g = (int(c.hash_between(p, np.array([a]), np.array([b]), i).view(np.int64)[0]) for i, p in enumerate(prefix))
        r, q = (int(c.hash_between(p, lot[:1], lot[-1:] + LENGTH, i).view(np.int64)[0]) for i, p in enumerate(prefix))
        out.append((k, g ^ far, r, q, weight, s + int(lot[0]), len(lot)))
    return out


def _apply(schema: pa.Schema):
    """Documents without regions to shard are done; the others wait, and their regions and parts go out as rows of their own."""

    def rows(n: int, /, **columns) -> pa.RecordBatch:
        full = [pa.nulls(n, f.type) if f.name not in columns else (x if isinstance(x := columns[f.name], pa.Array) else pa.array(x)).cast(f.type) for f in schema]
        return pa.RecordBatch.from_arrays(full, schema=schema)

    def kernel(batches):
        for batch in batches:
            x = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            for first, last, data, offs in c.text_blocks(x["text"]):
                own = {k: v.slice(first, last - first) for k, v in x.items()}
                at, k, weight, s, n, hot = _fields(own["marks"], ("k", "c", "s", "n", "hot"))
                asked = weight > 0
                wait = np.zeros(last - first, bool)
                wait[at[asked]] = True
                end = s.astype(np.int64) + n - 1 + LENGTH
                done = np.flatnonzero(~wait)
                sure = ~asked & ~wait[at]
                found = _removal(data, offs, at[sure], s[sure], end[sure])
                ids = {"_row": own["_row"], "doc": own["doc"], "key": own["key"]}
                yield rows(len(done), kind=np.zeros(len(done)), **{k: v.take(pa.array(done)) for k, v in ids.items()}, **{k: (v if isinstance(v, pa.Array) else pa.array(v)).take(pa.array(done)) for k, v in found.items()})
                if not asked.any():
                    continue
                waiting = np.flatnonzero(wait)
                keep = np.flatnonzero(~asked & wait[at])
                keep = keep[np.argsort(at[keep], kind="stable")]
                held = pa.StructArray.from_arrays([pa.array(s[keep].astype(np.int64)), pa.array(end[keep])], ["start", "end"])
                counts = np.bincount(at[keep], minlength=len(wait))[waiting]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), held)
                text = _bytes(data, offs[waiting], np.diff(offs)[waiting])
                yield rows(len(waiting), kind=np.ones(len(waiting)), **{k: v.take(pa.array(waiting)) for k, v in ids.items()}, text=text, sure=lists)
                doc, key = own["doc"].to_numpy(), own["key"].to_numpy()
                plain = np.flatnonzero(asked & ~hot.astype(bool))
                for a, b in _lots((end - s)[plain]):
                    p = plain[a:b]
                    yield rows(len(p), kind=np.full(len(p), 2), doc=doc[at[p]], key=key[at[p]], k=k[p], c=weight[p], s=s[p], n=n[p], bytes=_bytes(data, offs[at[p]] + s[p], (end - s)[p]))
                crowded = np.flatnonzero(asked & hot.astype(bool))
                for a in range(0, len(crowded), 256):
                    cut = [(j, *part) for j in crowded[a : a + 256] for part in _parts(data[offs[at[j]] : offs[at[j] + 1]], int(s[j]), int(n[j]), int(weight[j]))]
                    j, pk, pg, pr, pq, pc, ps, pn = (np.array(v, np.int64) for v in zip(*cut, strict=True))
                    yield rows(len(j), kind=np.full(len(j), 3), doc=doc[at[j]], key=key[at[j]], k=pk, g=pg, r=pr, q=pq, c=pc, s=ps, n=pn, bytes=_bytes(data, offs[at[j]] + ps, pn - 1 + LENGTH))

    return kernel


def shard(data: np.ndarray, base: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of regions that begin at base: which of their first `starts` places begin a string that stands twice or more, one after another."""
    at = np.arange(int(starts.sum())) + np.repeat(base - (np.cumsum(starts) - starts), starts)
    sa = suffix_array(data)
    kind = np.empty(len(data), np.int64)
    kind[sa] = np.cumsum(common_prefixes(data, sa, LENGTH)[sa] < LENGTH)  # equal strings stand together
    kind = kind[at]
    return np.bincount(kind, np.repeat(times, starts))[kind] > 1


def _suffix(batches):
    """Regions sorted by k (and g), to runs of repeated starts; one suffix array for about SHARD bytes."""
    names = ("k", "g", "c", "s", "n", "doc", "key")
    held: list[tuple[dict, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        x = {k: np.concatenate([h[0][k] for h in held]) for k in names}
        sizes, data = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        held.clear()
        starts = x["n"].astype(np.int64)
        hit = shard(data, np.cumsum(sizes) - sizes, starts, x["c"])
        row = np.repeat(np.arange(len(starts)), starts)
        hit &= x["c"][row] == 1  # copies are removed already
        place = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        new, last = hit.copy(), hit.copy()
        new[1:] &= ~hit[:-1] | (place[1:] == 0)
        last[:-1] &= ~hit[1:] | (place[1:] == 0)
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        return _batch({"doc": x["doc"][row[a]], "key": x["key"][row[a]], "s": (x["s"][row[a]] + place[a]).astype(np.int32), "n": (b - a + 1).astype(np.int32)})

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {k: batch.column(i).to_numpy() for i, k in enumerate(names)}
        data, offs = _raw(batch.column(len(names)))
        sizes, at = np.diff(offs), 0
        new = np.ones(len(sizes), bool)
        new[1:] = (x["k"][1:] != x["k"][:-1]) | (x["g"][1:] != x["g"][:-1])
        if held:
            new[0] = held[-1][0]["k"][-1] != x["k"][0] or held[-1][0]["g"][-1] != x["g"][0]
        for cut in np.flatnonzero(new).tolist():
            if held and size + offs[cut] - offs[at] > SHARD:
                if cut > at:
                    held.append(({k: v[at:cut] for k, v in x.items()}, sizes[at:cut], data[offs[at] : offs[cut]]))
                yield flush()
                at, size = cut, 0
            elif offs[cut] - offs[at] > SHARD:
                held.append(({k: v[at:cut] for k, v in x.items()}, sizes[at:cut], data[offs[at] : offs[cut]]))
                yield flush()
                at, size = cut, 0
        if at < len(sizes):
            held.append(({k: v[at:] for k, v in x.items()}, sizes[at:], data[offs[at] :]))
            size += int(offs[-1] - offs[at])
    if held:
        yield flush()


def _strings(batches):
    """Parts to their single strings, with both hashes."""
    for batch in batches:
        doc, key, weight, s, n = (batch.column(i).to_numpy() for i in range(5))
        data, offs = _raw(batch.column(5))
        for a, b in _lots(np.diff(offs), c.SEGMENT // 2):
            part, starts = data[offs[a] : offs[b]], n[a:b].astype(np.int64)
            row = np.repeat(np.arange(a, b), starts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            at = offs[row] - offs[a] + place
            h, g = (c.hash_between(c.prefix_hash(part, i), at, at + LENGTH, i).view(np.int64) for i in (0, 1))
            yield _batch({"h": h, "g": g, "doc": doc[row], "key": key[row], "c": weight[row], "s": (s[row] + place).astype(np.int32)})


def _finish(batches):
    for batch in batches:
        x = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        for first, last, data, offs in c.text_blocks(x["text"]):
            own = {k: v.slice(first, last - first) for k, v in x.items()}
            at, start, end = _fields(own["sure"], ("start", "end"))
            more, s, n = _fields(own["found"], ("s", "n"))
            found = _removal(data, offs, np.concatenate([at, more]), np.concatenate([start, s]).astype(np.int64), np.concatenate([end, s.astype(np.int64) + n - 1 + LENGTH]).astype(np.int64))
            yield _batch({"_row": own["_row"], **found})


def _repeats(parts: DataFrame) -> DataFrame:
    """doc, key, s and n of the repeated starts of parts (k, g, r, q, c, doc, key, s, n, bytes): see the module's steps 2 to 4."""
    kinds = c.written(parts.groupBy("k", "g", "r", "q").agg(F.sum("c").alias("c"), F.min(F.struct("doc", "key", "s", "n")).alias("one")), "part-kinds")
    many = kinds.groupBy("k", "g").agg(F.sum("c").alias("m"), F.count("*").alias("kinds")).where("m > 1")
    info = c.written(kinds.join(many, ["k", "g"]).select("k", "g", "r", "q", F.col("c").alias("total"), "one", "kinds"), "part-info")
    key = ["k", "g", "r", "q"]
    # Copies: all strings of every member. Members of regions that are copies as a whole (c > 1) are removed already.
    sure = parts.where("c = 1").join(info.where("total > 1").select(*key), key).select("doc", "key", "s", "n")
    one = parts.join(info.where("kinds > 1").select(*key, "total", "one", "kinds"), key).where(F.struct("doc", "key", "s", "n") == F.col("one"))
    # A part's c is what its kind stands for; that of a lone member of a copied region must not come out of the shard either.
    one = c.written(one.select("k", "g", F.col("total").alias("c"), "s", "n", "doc", "key", "bytes", "kinds"), "part-shards")
    meet = one.where(F.col("kinds") <= CROWD).select("k", "g", "c", "s", "n", "doc", "key", "bytes")
    found = c.in_arrow(meet.repartition("k", "g").sortWithinPartitions("k", "g"), _suffix, "doc long, key long, s int, n int")
    strings = c.in_arrow(one.where(F.col("kinds") > CROWD).select("doc", "key", "c", "s", "n", "bytes"), _strings, "h long, g long, doc long, key long, c long, s int")
    strings = c.written(strings, "strings")
    twice = strings.groupBy("h", "g").agg(F.sum("c").alias("m")).where("m > 1").select("h", "g")
    single = strings.where("c = 1").join(twice, ["h", "g"]).select("doc", "key", "s", F.lit(1).alias("n"))
    return sure.union(found).union(single)


def remove_repeats(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``_row`` of the columns in keep, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of each row."""
    row = F.struct(*(F.col(f"`{k}`") for k in keep)).alias("_row")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc")
    base = docs.select(row, doc, F.xxhash64(F.col("doc_id").isNull(), "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = c.in_arrow(base.select("doc", "key", "text"), _pieces, "doc long, key long, k long, r long, q long, s int, n int")
    grams = c.written(pieces.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"), "grams", short=False)
    shared = c.written(pieces.join(grams, "k"), "pieces", short=False)
    kinds = c.written(shared.groupBy("k", "r", "q").agg(F.count("*").alias("c"), F.min(F.struct("doc", "key", "s", "n")).alias("one")), "regions", short=False)
    several = kinds.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1")
    sure = shared.join(kinds.where("c > 1").select("k", "r", "q"), ["k", "r", "q"]).select("doc", "key", F.struct(F.lit(0).alias("k"), F.lit(0).alias("c"), "s", "n", F.lit(False).alias("hot")).cast(_MARK).alias("mark"))
    asked = c.written(kinds.join(several, "k").select("one.doc", "one.key", F.struct("k", "c", "one.s", "one.n", (F.col("kinds") > CROWD).alias("hot")).cast(_MARK).alias("mark")), "asked", short=False)
    marks = sure.union(asked).groupBy("doc", "key").agg(F.collect_set("mark").alias("marks"))
    schema = T.StructType([T.StructField("_row", base.schema["_row"].dataType), *T.StructType.fromDDL(_APPLIED).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    applied = c.written(c.in_arrow(base.join(marks, ["doc", "key"], "left").select("_row", "doc", "key", "text", "marks"), _apply(to_arrow_schema(schema)), schema), "applied", short=False)
    regions = applied.where("kind = 2").select("k", F.lit(0).cast("long").alias("g"), "c", "s", "n", "doc", "key", "bytes")
    found = c.in_arrow(regions.repartition("k").sortWithinPartitions("k"), _suffix, "doc long, key long, s int, n int")
    if not asked.where("mark.hot").isEmpty():
        found = found.union(_repeats(applied.where("kind = 3").select("k", "g", "r", "q", "c", "doc", "key", "s", "n", "bytes")))
    found = found.groupBy("doc", "key").agg(F.collect_set(F.struct("s", "n")).alias("found"))
    rest = applied.where("kind = 1").select("_row", "doc", "key", "text", "sure").join(found, ["doc", "key"], "left").select("_row", "text", "sure", "found")
    names = [f.name for f in T.StructType.fromDDL(_RESULT).fields]
    late = c.in_arrow(rest, _finish, T.StructType([base.schema["_row"], *T.StructType.fromDDL(_RESULT).fields]))
    return applied.where("kind = 0").select("_row", *names).union(late)
