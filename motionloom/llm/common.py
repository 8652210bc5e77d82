"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import compact, in_arrow, materialised

__all__ = ["compact", "in_arrow", "written"]

#: ASCII white space as in the contracts: blank and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes at once; a single document may be longer.
BLOCK = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

U64 = np.uint64
#: Bits of a filter (filter_of), and how many stand for a key.
FILTER, HASHES = 1 << 26, 3


def written(df: DataFrame, name: str, *, short: bool = True) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. short: rows are a small digest of the texts."""
    return materialised(df, name, short=short)


def order_key(doc_id: Column) -> Column:
    """A pseudo-random order of ids in [0, 2**31) that any SQL engine can compute."""
    return F.pmod(F.pmod(doc_id.cast("long"), F.lit(1 << 31)) * F.lit(1103515245) + F.lit(12345), F.lit(1 << 31))


#: The same in SQL, for DuckDB; {0} is the id.
ORDER_KEY_SQL = "((((({0} % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648)"


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into runs of rows (first, last, bytes, offsets); null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values evenly."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A table of FILTER bits in which HASHES bits are set for each row of the column h (64 bits)."""
    width = FILTER.bit_length() - 1
    bits = [F.shiftrightunsigned("h", k * (64 - width) // (HASHES - 1)).bitwiseAND(FILTER - 1) for k in range(HASHES)]
    words = hashes.select(F.explode(F.array(*bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    out = np.zeros(FILTER // 64, np.int64)
    found = words.toArrow()  # at most FILTER / 64 rows
    out[found["at"].to_numpy()] = found["set"].to_numpy()
    return out


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may know each hash; it knows all that it was made of."""
    width, out = FILTER.bit_length() - 1, np.ones(len(h), bool)
    for k in range(HASHES):
        bit = (h >> U64(k * (64 - width) // (HASHES - 1)) & U64(FILTER - 1)).astype(np.int64)
        out &= (table[bit >> 6] >> (bit & 63) & 1).astype(bool)
    return out


#: Bytes that one prefix hash may cover; longer texts are hashed in segments.
SEGMENT = 1 << 20
#: Odd bases of the two polynomial hashes of byte strings, and the values of bytes in each.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = tuple(mix(np.arange(k, k + 256, dtype=U64) * U64(0xD1342543DE82EF95)) for k in (1, 301))
_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, kind: int = 0) -> list[np.ndarray]:
    """BASES[kind]**i and BASES[kind]**-i modulo 2**64 for i < n (at most SEGMENT + 1); the tables stay, at 16 MB or less each."""
    if n > SEGMENT + 1:
        raise ValueError(f"{n} bytes at once; hash in segments of {SEGMENT}")
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = min(1 << (n - 1).bit_length(), SEGMENT + 1)
        _powers[kind] = []
        for base in (BASES[kind], pow(BASES[kind], -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[kind].append(np.multiply.accumulate(steps))
    return _powers[kind]


def prefix_hash(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """P with n+1 entries; see hash_between."""
    n = len(data)
    out = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[kind][data] * powers(n + 1, kind)[0][:n], out=out[1:])
    return out


def hash_between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand; the two kinds make up 128 bits."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), kind)[1][start])


def words_of(data: np.ndarray, offs: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of each word; words don't cross documents. word: which bytes are in words (by default all but white space)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    if word is None:
        word = ~IS_SPACE[data]
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0], right[-1] = True, True
    left[1:] = ~word[:-1]
    right[:-1] = ~word[1:]
    inner = offs[(offs > 0) & (offs < n)]
    left[inner] = True
    right[inner - 1] = True
    starts, ends = np.flatnonzero(word & left), np.flatnonzero(word & right) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of mask over each document's bytes."""
    if len(offs) == 2:
        return np.array([np.count_nonzero(mask)])
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word (in text order), in segments of bounded size."""
    out = np.empty(len(starts), U64)
    long = np.flatnonzero(ends - starts > SEGMENT // 2)
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    for part in np.split(np.arange(len(starts)), np.unique(np.concatenate([long, long + 1]))):
        while len(part):
            base = starts[part[0]]
            k = int(np.searchsorted(ends[part[0] : part[-1] + 1], base + SEGMENT, "right"))
            own, part = part[:k], part[k:]
            if len(own) == 1 and own[0] in long:
                continue
            out[own] = hash_between(prefix_hash(data[base : ends[own[-1]]]), starts[own] - base, ends[own] - base)
    return out


def decoded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, and each document's number of them."""
    try:
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), per_doc((data & 0xC0) != 0x80, offs)
    except UnicodeDecodeError:
        each = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.array([len(x) for x in each], np.int64)


def overlapping(data: np.ndarray, offs: np.ndarray, points: int, limit: int = 4 * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """The block itself, or parts of one long document with up to `points` code points of what follows; how many, and whether they reach the end."""
    if len(offs) > 2 or len(data) <= limit:
        yield data, offs, 0, True
        return
    a, n = 0, len(data)

    def after(at: int) -> int:
        """The next place where a code point begins."""
        at += 1
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, n)

    while a < n:
        b = after(a + limit - 1)
        end, more = b, 0
        while end < n and more < points:
            end, more = after(end), more + 1
        yield data[a:end], np.array([0, end - a]), more, end == n
        a = b
