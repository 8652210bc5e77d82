"""Best-fit packing of tokenised documents into fixed-length sequences.

A document of up to ``LENGTH`` tokens is one piece; a longer one is cut into pieces
of LENGTH tokens, the remainder first. Packing works on the histogram of piece
lengths, at most LENGTH counts at any size of corpus, in two steps. Exact
complements: an index (``Sums``) holds the available single lengths and the pairs and triples by their
sums. The gap that a piece leaves is looked up there, first among singles for all lengths, longest first, then among
pairs, then among triples, and combinations that fill it exactly are consumed as often as the available counts
allow, those with the longest part first; pairs and triples that would take a piece below a reserve are left,
since only short pieces fill the odd gaps later (see plan). Best fit: what is left goes, longest first, into the open sequence with the smallest gap that
holds it. The plan is a list of slots (length, ranks from, sequences from, offset);
it has a few thousand rows at most, since each step uses up one length or one kind
of open sequence. A piece finds its slot by its rank among pieces of its length.

Ranks need no shuffle of rows by length: each task numbers its own pieces, and
offsets come from the counts per task and length.

Defined cases. Null and empty texts are one piece that holds the end token only.
Rows that repeat a doc_id are packed one by one. An empty table gives no rows. A very long text is
tokenised in parts (see Tokens), with the same ids.
Other columns are not used, whatever their names.

Scale. One scan of the text (tokenising); pieces (about 60 bytes each) are written
once and joined with the counts per task and length. The plan (bounded) goes to
the tasks with their code. A worker holds one batch of texts, the ids of one document (4 bytes a token) and ROWS rows.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LENGTH, END = 1024, 2
#: The vocabulary's only special token, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters of a part of a text, and white space of which a longer run is a part of its own.
PART, RUN = 1 << 18, 1 << 12
#: Rows of a batch that a task returns.
ROWS = 4096
#: Pairs and triples take no piece below one of these shares of the length.
RESERVES = (0.0, 0.03, 0.06, 0.08, 0.095, 0.1, 0.11, 0.125, 0.16, 0.2, 0.25)
#: White space of the vocabulary's pattern.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}]{{{RUN},}}")
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


class Tokens:
    """Ids of the byte-level vocabulary ``name``.json, from the rank table ``name``.tiktoken, which holds the same merges.

    Texts are cut where the vocabulary's own pattern always cuts, so that the parts' ids make up the text's: around the
    special token's name, before white space that follows something else, and inside a run of white space before its
    last character (the pattern gives the last one to what follows, or, at the end of the text, takes the whole run). So
    a part has about PART characters, but for a longer run of other characters, and the pattern's look-ahead never walks a long run.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.table = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = public_tokenizers.path(f"{name}.json")

    @cached_property
    def full(self):
        """The json's own tokenizer, to compare with; packing doesn't load it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def array(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for k, plain in enumerate(text.split(SPECIAL)):
            if k:
                parts.append(np.array([SPECIAL_ID], np.uint32))
            if len(plain) <= RUN:
                parts.append(self.table.encode_to_numpy(plain, disallowed_special=()))
                continue
            at = 0
            for run in _RUN.finditer(plain):
                parts += self._parts(plain[at : run.start()])
                at = run.end() if run.end() == len(plain) else run.end() - 1
                parts.append(np.array(self.table._core_bpe.encode_single_piece(plain[run.start() : at].encode()), np.uint32))
            parts += self._parts(plain[at:])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) > at + PART else None
            end = cut.start() if cut else len(text)
            yield self.table.encode_to_numpy(text[at:end], disallowed_special=())
            at = end


@lru_cache(maxsize=2)
def tokens(name: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(name)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, the remainder first."""
    first = n % length or min(n, length)
    return [(0, first), *((a, length) for a in range(first, n, length))]


def _tokenise(name: str, length: int, with_ids: bool):
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    def kernel(batches):
        known, task, seen, rows = tokens(name), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), []
        end = np.array([END], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), np.concatenate([known.array(text.as_py() or ""), end]).astype("<u4", copy=False)
                for k, (start, size) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + size]
                    rows.append((doc, k, start, size, zlib.crc32(own), task, int(seen[size]), *[own.astype(np.int32)] * with_ids))
                    seen[size] += 1
                    if len(rows) >= (ROWS >> 4 if with_ids else ROWS):
                        yield made(rows)
        yield made(rows)

    return kernel


class Sums:
    """Index of available lengths: of each sum up to `length` its single, its pairs and its triples, longest part first.

    free[x] pieces of length x are left. Combinations leave the index when a length of theirs is used up, which is for good;
    each is looked at only while it stands at the end of its list.
    """

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.length, self.free = length, [counts.get(x, 0) for x in range(length + 1)]
        self.sizes = [x for x in range(length, 0, -1) if self.free[x]]
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        for a in reversed(self.sizes):
            for b in self.sizes:
                if b <= a and a + b <= length:
                    self.pairs[a + b].append((a, b))
        self.firsts = [[a for a in reversed(self.sizes) if a < total] for total in range(length + 1)]  # of triples

    def times(self, parts: tuple[int, ...]) -> int:
        """How often the combination can be taken from what is left."""
        return min(self.free[x] // parts.count(x) for x in parts)

    def single(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.times((*others, total)) else None

    def pair(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        pairs = self.pairs[total]
        while pairs and not self.times(pairs[-1]):
            pairs.pop()
        return next((x for x in reversed(pairs) if self.times((*others, *x))), None)

    def triple(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        firsts = self.firsts[total]
        while firsts and not self.free[firsts[-1]]:
            firsts.pop()
        for a in reversed(firsts):
            if 3 * a < total:  # the longest of three has a third at least
                break
            if self.free[a] and (x := self.pair(total - a, (*others, a))):
                return (a, *x)
        return None


class _Plan:
    """Slots as (length, rank, times, sequence, offset)."""

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.index = Sums(counts, length)
        self.length, self.used, self.sequences = length, [0] * (length + 1), 0
        self.slots: list[tuple[int, int, int, int, int]] = []

    def take(self, size: int, times: int, sequence: int, offset: int) -> None:
        self.slots.append((size, self.used[size], times, sequence, offset))
        self.used[size] += times
        self.index.free[size] -= times

    def consume(self, parts: tuple[int, ...], times: int) -> None:
        offset = 0
        for x in parts:
            self.take(x, times, self.sequences, offset)
            offset += x
        self.sequences += times


def _exact(p: _Plan, reserve: int) -> None:
    """Consumes combinations that fill a sequence exactly: a piece and one, two or three others."""
    index, length = p.index, p.length
    if index.free[length]:
        p.consume((length,), index.free[length])
    for find, least in ((index.single, 1), (index.pair, reserve), (index.triple, reserve)):
        for size in index.sizes:
            while size < length and index.free[size]:
                parts = find(length - size, (size,))
                if not parts or min(parts) < least:
                    break
                p.consume((size, *parts), index.times((size, *parts)))


def _best_fit(p: _Plan) -> None:
    """Longest first, into the open sequence with the smallest gap that holds the piece."""
    open_: list[tuple[int, int, int]] = []  # gap, first sequence, sequences
    for size in p.index.sizes:
        while n := p.index.free[size]:
            k = bisect_left(open_, (size, -1, -1))
            if k < len(open_):
                gap, first, many = open_.pop(k)
                times = min(n, many)
                if many > times:
                    insort(open_, (gap, first + times, many - times))
                p.take(size, times, first, p.length - gap)
                gap -= size
            else:  # new sequences, each with as many pieces of this size as fit
                per = min(p.length // size, n)
                times, first = n // per, p.sequences
                for j in range(per):
                    p.take(size, times, first, j * size)
                p.sequences += times
                gap = p.length - per * size
            if gap:
                insort(open_, (gap, first, times))


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for a histogram of piece lengths, and how many sequences they make.

    Which reserve serves best depends on the histogram. The steps are run with each of RESERVES, until the
    sequences are as few as their tokens allow, and the plan with the fewest is taken; a run takes a
    tenth of a second, at any number of pieces.
    """
    best, bound = None, math.ceil(sum(x * n for x, n in counts.items()) / length)
    for share in RESERVES:
        p = _Plan(counts, length)
        _exact(p, round(share * length))
        _best_fit(p)
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences <= bound:
            break
    return best.slots, best.sequences


def _place(slots: list[tuple[int, int, int, int, int]]):
    size, rank, _, sequence, offset = (np.array(x, np.int64) for x in zip(*sorted(slots), strict=True))
    at = (size << 48) + rank

    def kernel(batches):
        for batch in batches:
            x = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            own = x["rank"].to_numpy() + x["before"].to_numpy()
            k = np.searchsorted(at, (x["length"].to_numpy().astype(np.int64) << 48) + own, "right") - 1
            out = {n: v for n, v in x.items() if n not in ("task", "rank", "before")}
            out |= {"sequence_id": pa.array(sequence[k] + own - rank[k]), "offset": pa.array(offset[k])}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return kernel


def pack(docs: DataFrame, *, length: int = LENGTH, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; with_ids adds its token ids."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECE + ", ids array<int>" * with_ids
    pieces = c.written(c.in_arrow(given, _tokenise(vocabulary, length, with_ids), schema), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `length` rows
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    if not total:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).select(*names, "task", "rank", "before")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return c.in_arrow(ranked, _place(plan(total, length)[0]), out)
