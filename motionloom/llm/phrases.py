"""Phrase collocation mining over dictionary-encoded text.

A-Z are lower-cased, texts fall into pieces at punctuation and line ends, pieces into words between blanks and tabs.
All counts are per language. A phrase of 2 to ``max_words`` words can be a candidate, with ``min_count`` occurrences or more, only if
all its words are that frequent, and all its shorter parts. So:

1. Words are counted, and those of ``min_count`` occurrences in their language become the dictionary: whole numbers
   of 32 bits, which tell the language too. 0 stands for all other words and for borders of pieces.
2. Texts are written once more as such numbers. The ``HEAD`` most frequent words are looked up in tasks, in a table of bounded
   size; words beyond it are joined with the rest of the dictionary, by word, and put in.
3. For each length m, runs of m numbers without a 0 are packed into keys of 4 m bytes, dealt out by ranges of the
   key (whose bounds a sample settles; they don't affect results), sorted by radix and counted by run length, first in the tasks
   that read the text, then in the tasks that own a range. From three words on, runs whose parts of m - 1 words aren't both frequent are
   passed over, by a filter of fixed size that never loses a frequent one.
4. A candidate's cuts are scored by joins of candidates with the counts of their parts. All arithmetic is in whole numbers, of up to 38 digits.

Candidates that a longer candidate contains and that occur outside of it at most as often as inside (``ABSORB`` percent) are dropped, and each
language's first ``top`` are ranked.

Defined cases. A null text counts as empty, a null lang as ``und``; rows that repeat a doc_id or a text count again. Ties in score and count go by the
phrase's bytes. A piece may be as long as a text, a word too (words of more than ``LONG`` bytes are left to the join). An empty table gives an empty result. Other columns aren't read.

Scale. The text is read twice and not shuffled; what moves is word counts, then one compressed block of sorted keys and counts for each task and
range. A hot word or phrase is one key with one count a task. No task holds more than a range (``RANGE`` words' runs) or a chunk, the
driver holds the head of the dictionary (HEAD words of at most LONG bytes), the filter and the ranges' bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

MAX_WORDS, MIN_COUNT, ABSORB, TOP = 3, 10, 50, 2000
UNIT = 1_000_000
#: Words that tasks look up by themselves, and the bytes that one of them may have.
HEAD, LONG = 1 << 19, 48
#: Different words that a task holds before it hands their counts on, and bytes of them.
HELD = 1 << 17
#: Runs that a task sorts at once, and words of text that make up one range.
CHUNK, RANGE = 1 << 20, 1 << 22
#: Keys in the sample that settles the bounds of ranges.
SAMPLE = 1 << 16
#: Parts by which words of the dictionary are numbered; salts of a language's ranking.
PARTS, SALTS = 1024, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte does: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


def words_and_breaks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of each word of lower-cased data, and whether a piece begins with it."""
    kind = _KIND[data]
    starts, ends, doc = c.words_of(data, offs, kind == 0)
    marks = np.concatenate([[0], np.cumsum(kind == 2)])
    first = np.ones(len(starts), bool)
    first[1:] = (marks[starts[1:]] != marks[starts[:-1]]) | (doc[1:] != doc[:-1])
    return starts, ends, doc, first


def _langs(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each row's language as a number, and the languages."""
    coded = column.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _counter(batches):
    """Rows (lang, word, n), words null for the number of all words of a language."""
    held: dict[tuple[str, bytes], int] = {}
    total: dict[str, int] = {}

    def flush():
        lang, word, n = [k[0] for k in held], [k[1] for k in held], list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    size = 0
    for batch in batches:
        code, names = _langs(batch.column(0))
        for first, last, data, offs in c.text_blocks(batch.column(1)):
            text = (data := _LOWER[data]).tobytes()
            starts, ends, doc, _ = words_and_breaks(data, offs)
            own = code[first:last][doc]
            for k in np.unique(own).tolist():
                lang, at = names[k], np.flatnonzero(own == k)
                total[lang] = total.get(lang, 0) + len(at)
                for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
                    key = lang, text[a:b]
                    n = held.get(key)
                    held[key] = 1 if n is None else n + 1
                    size += 0 if n else b - a
            if len(held) > HELD or size > 32 * HELD:
                yield flush()
                size = 0
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.nulls(len(total), pa.binary()), pa.array(total.values(), pa.int64())], ["lang", "word", "n"])


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, word (bytes) and n of each word of min_count occurrences; word is null for the number of a language's words."""
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return c.in_arrow(text, _counter, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("word").isNull())


def dictionary(counts: DataFrame, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Numbers from 1 for the words of counts: the head (at most that many words of at most LONG bytes, most frequent first), and the others.

    Both have lang, word, n and id. The others are numbered by parts, so that no task sees them all.
    """
    words = counts.where("word IS NOT NULL")
    first = words.where(F.length("word") <= LONG).orderBy(F.desc("n"), "lang", "word").limit(head)
    first = c.written(first.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "lang", "word")).cast("long")), "head")
    rest = words.join(first.select("lang", "word"), ["lang", "word"], "left_anti").withColumn("_part", F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("lang", "word")).cast("long") - 1
    return first, c.written(rest.select("lang", "word", "n", (place * PARTS + F.col("_part") + head + 1).alias("id")), "rest")


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b" " + word)


def _word_hashes(batches):
    for batch in batches:
        h = [_word_hash(k, w) for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])


_ENCODED = "ids binary, langs array<string>, words array<binary>, places binary, numbers binary"


def _encoder(head, rest):
    """Kernel from (lang, text) to one row for each block of texts: its numbers, and words to be looked up in the rest of the dictionary, with their places."""
    tables: dict[str, dict[bytes, int]] = {}

    def kernel(batches):
        if not tables:
            for part in head.value.to_batches(1 << 14):
                for k, w, i in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    tables.setdefault(k, {})[w] = i
        known = rest and rest.value
        for batch in batches:
            code, names = _langs(batch.column(0))
            for first, last, data, offs in c.text_blocks(batch.column(1)):
                text = (data := _LOWER[data]).tobytes()
                starts, ends, doc, begins = words_and_breaks(data, offs)
                ids, own = np.zeros(len(starts), np.uint32), code[first:last][doc]
                unknown: dict[tuple[str, bytes], list[int]] = {}
                for k in np.unique(own).tolist():
                    lang, at = names[k], np.flatnonzero(own == k)
                    get = tables.get(lang, {}).get
                    ids[at] = np.array([get(text[a:b], 0) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.uint32)
                    for i in at[ids[at] == 0].tolist() if known is not None else ():
                        unknown.setdefault((lang, text[starts[i] : ends[i]]), []).append(i)
                place = np.arange(len(starts)) + np.cumsum(begins)  # a 0 goes before each piece
                out = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.uint32)
                out[place] = ids
                asked = list(unknown)
                if asked:
                    maybe = c.passes(known, np.array([_word_hash(*x) for x in asked], np.uint64))
                    asked = [x for x, y in zip(asked, maybe.tolist(), strict=True) if y]
                at = np.array([place[i] for x in asked for i in unknown[x]], np.int64)
                number = np.repeat(np.arange(len(asked)), [len(unknown[x]) for x in asked])
                arrays = [[out.tobytes()], [[x[0] for x in asked]], [[x[1] for x in asked]], [at.tobytes()], [number.astype(np.int64).tobytes()]]
                types = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types, strict=True)], ["ids", "langs", "words", "places", "numbers"])

    return kernel


def _fill(batches):
    """Puts the numbers of looked-up words in their places."""
    for batch in batches:
        out = []
        for ids, places, numbers, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if found:
                ids = np.frombuffer(ids, np.uint32).copy()
                of = np.zeros(max(x["pos"] for x in found) + 1, np.uint32)
                of[[x["pos"] for x in found]] = [x["id"] for x in found]
                number = np.frombuffer(numbers, np.int64)
                inside = number < len(of)
                ids[np.frombuffer(places, np.int64)[inside]] = of[number[inside]]
                ids = ids.tobytes()
            out.append(ids)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])


def encoded(docs: DataFrame, first: DataFrame, rest: DataFrame) -> DataFrame:
    """Column ids: the texts as numbers of 32 bits, in blocks, 0 for words that aren't in the dictionary and before each piece."""
    share = docs.sparkSession.sparkContext.broadcast
    head = share(first.select("lang", "word", "id").toArrow())  # at most HEAD words of LONG bytes
    more = not rest.isEmpty()
    known = share(c.filter_of(c.in_arrow(rest.select("lang", "word"), _word_hashes, "h long"))) if more else None
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    blocks = c.in_arrow(text, _encoder(head, known), _ENCODED)
    if not more:
        return c.written(blocks.select("ids"), "encoded", short=False)
    blocks = c.written(blocks.withColumn("block", F.monotonically_increasing_id()), "encoded", short=False)
    asked = blocks.where(F.size("words") > 0).select("block", F.posexplode(F.arrays_zip("langs", "words")).alias("pos", "w")).select("block", "pos", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    got = asked.join(rest.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("found"))  # one block's words
    return c.written(c.in_arrow(blocks.join(got, "block", "left").select("ids", "places", "numbers", "found"), _fill, "ids binary"), "filled", short=False)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys of several 32-bit columns, by counting sorts of 16-bit digits from the last one."""
    order = None
    for x in reversed(columns):
        for digit in ((x & np.uint32(0xFFFF)).astype(np.uint16), (x >> np.uint32(16)).astype(np.uint16)):
            if digit.any():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def run_lengths(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different keys in their order, and the sum of n of each."""
    order = radix_order(columns)
    columns = [x[order] for x in columns]
    change = np.zeros(len(order), bool)
    change[:1] = True
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(change)
    return [x[at] for x in columns], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """Binary keys of 4 bytes a column, whose byte order is the columns' order."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">u4")).view(f"S{4 * len(columns)}").ravel()


def _run_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = c.mix(columns[0])
    for x in columns[1:]:
        h = c.mix(h * c.U64(c.BASES[0]) + x.astype(c.U64))
    return h


def _run_hashes(batches):
    for batch in batches:
        if batch.num_rows:
            ids = np.array(batch.column(0).to_pylist(), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(_run_hash(list(ids.T)).view(np.int64))], ["h"])


def _runs(ids: np.ndarray, m: int, known: np.ndarray | None) -> list[np.ndarray]:
    """Columns of all runs of m numbers without a 0 whose parts of m - 1 the filter knows."""
    n = len(ids) - m + 1
    if n <= 0:
        return [ids[:0]] * m
    good = np.ones(n, bool)
    for k in range(m):
        good &= ids[k : k + n] != 0
    if known is not None:
        part = np.flatnonzero(good)  # a run begins here; its second part begins one later
        need = np.unique(np.concatenate([part, part + 1]))
        passed = np.zeros(len(ids) + 1, bool)
        passed[need] = c.passes(known, _run_hash([ids[need + k] for k in range(m - 1)]))
        good &= passed[:n] & passed[1 : n + 1]
    at = np.flatnonzero(good)
    return [ids[at + k] for k in range(m)]


def _sampler(m: int, known, share: float):
    def kernel(batches):
        for batch in batches:
            found = []
            for ids in batch.column(0):
                columns = _runs(np.frombuffer(ids.as_py(), np.uint32), m, known and known.value)
                pick = np.random.default_rng(len(columns[0])).random(len(columns[0])) < share
                found += _keys([x[pick] for x in columns]).astype(object).tolist() if pick.any() else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["key"])

    return kernel


def _packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted keys and their counts as one compressed block, byte by byte of the key's width."""
    width = 4 * len(columns)
    return pa.compress(_keys(columns).view(np.uint8).reshape(-1, width).T.tobytes() + n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(block: bytes, rows: int, m: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(pa.decompress(block, rows * (4 * m + 8), "zstd", asbytes=True), np.uint8)
    keys = np.ascontiguousarray(raw[: rows * 4 * m].reshape(-1, rows).T).view(">u4").astype(np.uint32)
    return list(keys.T), np.ascontiguousarray(raw[rows * 4 * m :].reshape(8, rows).T).view(np.int64).ravel()


def _dealer(m: int, known, bounds: np.ndarray):
    """Kernel from numbers to sorted and counted blocks (part, rows, block), one for each range and CHUNK runs."""

    def kernel(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            columns, n = run_lengths(columns, np.ones(len(columns[0]), np.int64))
            cuts = np.concatenate([[0], np.searchsorted(_keys(columns), bounds, "left"), [len(n)]])
            some = np.flatnonzero(np.diff(cuts))
            blocks = [_packed([x[cuts[k] : cuts[k + 1]] for x in columns], n[cuts[k] : cuts[k + 1]]) for k in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cuts)[some].astype(np.int64)), pa.array(blocks, pa.binary())], ["part", "rows", "block"])

        size = 0
        for batch in batches:
            for ids in batch.column(0):
                ids = np.frombuffer(ids.as_py(), np.uint32)
                for a in range(0, max(len(ids) - m + 1, 0), CHUNK):  # a long text in parts that share m - 1 numbers
                    held.append(_runs(ids[a : a + CHUNK + m - 1], m, known and known.value))
                    size += len(held[-1][0])
                    if size >= CHUNK:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return kernel


def _merger(m: int, min_count: int):
    """Kernel from a range's blocks to the keys that occur min_count times (ids, n)."""

    def kernel(batches):
        held, size, limit = [], 0, CHUNK
        for batch in batches:
            for rows, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(_unpacked(block, rows, m))
                size += rows
                if size > limit:
                    held = [_merged(held)]
                    size = len(held[0][1])
                    limit = max(CHUNK, 2 * size)
        if held:
            columns, n = _merged(held)
            at = np.flatnonzero(n >= min_count)
            for lot in np.array_split(at, 1 + len(at) // 65536):
                ids = pa.ListArray.from_arrays(np.arange(len(lot) + 1, dtype=np.int32) * m, np.stack([x[lot] for x in columns], axis=1).ravel().astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[lot])], ["ids", "n"])

    return kernel


def _merged(held):
    return run_lengths([np.concatenate(x) for x in zip(*(columns for columns, _ in held), strict=True)], np.concatenate([n for _, n in held]))


def frequent_runs(numbers: DataFrame, m: int, words: int, shorter: DataFrame | None, min_count: int = MIN_COUNT) -> DataFrame:
    """ids (m numbers) and n of all runs that occur min_count times in the numbers (column ids), which hold about that many words.

    shorter: the frequent runs of m - 1 numbers, where parts are to be looked for in them.
    """
    spark = numbers.sparkSession
    known = spark.sparkContext.broadcast(c.filter_of(c.in_arrow(shorter.select("ids"), _run_hashes, "h long"))) if shorter is not None else None
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(words / RANGE))
    sample = np.sort(np.array([bytes(r[0]) for r in c.in_arrow(numbers, _sampler(m, known, min(1.0, SAMPLE / max(words, 1))), "key binary").collect()], f"S{4 * m}"))  # about SAMPLE keys
    bounds = sample[np.linspace(0, len(sample), parts + 1)[1:-1].astype(int)] if len(sample) else sample
    blocks = c.in_arrow(numbers, _dealer(m, known, bounds), "part int, rows long, block binary")
    own = blocks.repartitionById(parts, F.col("part")).select("rows", "block")
    return c.written(c.in_arrow(own, _merger(m, min_count), "ids array<long>, n long"), f"runs-{m}", short=False)


def _slice(start: int, size: int):
    return F.slice("ids", start + 1, size)


def scored(candidates: list[DataFrame], words: DataFrame, absorb: int = ABSORB) -> DataFrame:
    """lang, phrase, ids, a, l, r and score of each candidate that no longer one absorbs.

    candidates: ids and n of the frequent runs of 2, 3, ... words; words: lang, word, n and id of the dictionary.
    """
    counts = words.select(F.array(F.col("id").cast("long")).alias("part"), "n", "lang", F.col("word").cast("string").alias("word"))
    for x in candidates:
        counts = counts.unionByName(x.select(F.col("ids").alias("part"), "n"), allowMissingColumns=True)
    rows = None
    for m, x in enumerate(candidates, 2):
        inside = None
        for longer, y in enumerate(candidates[m - 1 :], m + 1):
            for start in range(longer - m + 1):
                z = y.select(_slice(start, m).alias("ids"), F.col("n").alias("most"))
                inside = z if inside is None else inside.union(z)
        if inside is not None:
            inside = inside.groupBy("ids").agg(F.max("most").alias("most"))
            x = x.join(inside, "ids", "left").where(F.expr(f"most IS NULL OR 100 * cast(most as decimal(38,0)) < {absorb} * cast(n as decimal(38,0))")).select("ids", "n")
        spans = sorted({(0, k) for k in range(1, m)} | {(k, m - k) for k in range(1, m)} | {(k, 1) for k in range(m)})
        of = F.array(*(F.struct(F.lit(i).alias("i"), _slice(*s).alias("part")) for i, s in enumerate(spans)))
        asked = x.select("ids", F.col("n").alias("a"), F.explode(of).alias("s")).select("ids", "a", "s.i", "s.part")
        got = asked.join(counts, "part").groupBy("ids", "a").agg(F.array_sort(F.collect_list(F.struct("i", "n", "lang", "word"))).alias("of"))  # a phrase's parts
        at = {s: F.col("of")[i] for i, s in enumerate(spans)}
        cuts = []
        for k in range(1, m):
            left, right = at[0, k]["n"], at[k, m - k]["n"]
            wide = lambda x: x.cast("decimal(38,0)")
            cuts.append(F.struct(F.call_function("div", wide(F.lit(UNIT)) * wide(F.col("a")) * wide(F.col("a")), wide(left) * wide(right)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        low = F.array_min(F.array(*cuts))
        phrase = F.concat_ws(" ", *(at[k, 1]["word"] for k in range(m)))
        found = got.select(at[0, 1]["lang"].alias("lang"), phrase.alias("phrase"), "ids", "a", low.alias("low")).select("lang", "phrase", "ids", "a", "low.l", "low.r", "low.score")
        rows = found if rows is None else rows.union(found)
    return rows


def collocations(docs: DataFrame, *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, absorb: int = ABSORB, top: int = TOP, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of 2 to max_words words."""
    counts = c.written(word_counts(docs, min_count), "words")
    first, rest = dictionary(counts, head)
    words = first.union(rest)
    total, last = words.agg(F.sum("n"), F.max("id")).first()
    if last and last >= 1 << 32:
        raise ValueError(f"{last} words of {min_count} occurrences don't fit into 32 bits; raise min_count")
    numbers = encoded(docs, first, rest)
    candidates: list[DataFrame] = []
    for m in range(2, max_words + 1):
        candidates.append(frequent_runs(numbers, m, total or 0, candidates[-1] if candidates else None, min_count))
    rows = scored(candidates, words, absorb)
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = Window.partitionBy("lang", "_salt").orderBy(*order)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # SALTS * top rows a language at most
    sizes = counts.where("word IS NULL").select("lang", F.col("n"))
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
