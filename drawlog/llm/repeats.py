"""Repeated passages: paragraph MinHash banding.

A paragraph is a line.  Bands of MinHash values bring similar paragraphs
together, the exact Jaccard similarity of their word shingles decides, and
components of the links are one class.  Runs of neighbouring paragraphs that
other documents repeat, and that are long enough together, are passages.

Passages that are not aligned to lines are found word by word: every window of
``passage`` words whose smallest gram occurs in another document is compared,
by its hash, with all other such windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlog.llm.components import components
from drawlog.llm.decontaminate import _FOLD, bit_filter, grams, has_bit, WordHashes, words
from drawlog.llm.scratch import Scratch


_REMEMBERED = 1 << 18
_FOLDED = np.frombuffer(_FOLD, dtype=np.uint8)
_LETTERS = np.random.default_rng(23).integers(0, 1 << 64, 256, dtype=np.uint64)
_COLUMNS = ["doc_id", "start", "end", "n_words", "class_doc_id", "class_start", "removed"]


@dataclass(frozen=True)
class Settings:
    """Shingles of ``width`` words; two paragraphs link from ``similar`` on.

    With 12 bands of 3 values a pair at similarity 0.8 meets with chance
    0.9997.  Paragraphs under ``width`` words are passed over; a passage has
    at least ``passage`` words.  Under a band with over ``dense`` members,
    pairs are compared in blocks of ``block`` members.  Word for word, windows
    of ``passage`` words meet by their smallest gram of ``gram`` words.
    """

    width: int = 5
    similar: float = 0.8
    bands: int = 12
    rows: int = 3
    passage: int = 50
    dense: int = 16
    block: int = 256
    gram: int = 25


def _lines(text: str | None, least: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the lines with enough words."""
    at = 0
    for line in (text or "").split("\n"):
        ws = words(line)
        if len(ws) >= least:
            yield at, at + len(line), ws
        at += len(line) + 1


def paragraph_name(ws: list[bytes]) -> int:
    """64 bits that stand for a paragraph's words (two of ten billion paragraphs share them by chance about thrice)."""
    return xxhash.xxh3_64_intdigest(b" ".join(ws))


def text_name(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _long(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def minhash_bands(counts: np.ndarray, hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Band keys of paragraphs with ``counts`` words each, one after the other in ``hashes``: a row per paragraph."""
    ends = counts.cumsum()
    inside = np.ones(len(hashes), dtype=bool)
    for back in range(1, s.width):
        inside[ends - back] = False
    shingles = grams(np.append(hashes, np.zeros(s.width - 1, dtype=np.uint64)), s.width)[inside]
    begins = np.concatenate([[0], (counts - s.width + 1).cumsum()[:-1]])
    rng = np.random.default_rng(11)
    keys = np.zeros((s.bands, len(counts)), dtype=np.uint64)
    for band in range(s.bands):
        key = np.full(len(counts), band + 1, dtype=np.uint64)
        for _ in range(s.rows):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            mixed = shingles * (a | np.uint64(1)) + b
            mixed ^= mixed >> np.uint64(31)
            key = (key ^ np.minimum.reduceat(mixed, begins)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[band] = key
    return keys.T


_PARAGRAPH = "uid long, text_id long, doc_id long, at int, start long, end long, n_words int, pid long, bands array<long>"


def first_reading(docs: DataFrame, s: Settings, scratch: Scratch, marks: bool = True) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and window marks of all texts, from one pass with one hash per word.

    ``uid, text_id, doc_id, at, start, end, n_words, pid, bands`` of every
    paragraph, ``uid`` numbering the rows of ``docs``; and, if asked for,
    ``hash, uid``: the smallest grams of every row's windows, each once.
    """
    names = [c.split()[0] for c in _PARAGRAPH.split(", ")] + ["hash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            flat: list[np.ndarray] = []
            found, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            held = 0

            def part() -> pa.RecordBatch:
                cols = list(zip(*rows))
                keys = minhash_bands(np.array(cols[6], dtype=np.int64), np.concatenate(flat), s).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, s.bands, dtype=np.int32)), pa.array(keys.ravel()))
                return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds[:7])), pa.array(_long(cols[7])), bands, pa.nulls(len(rows), pa.int64())], names)

            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, hashes = text_name(text), word_spans(text)[0]
                at, n = 0, 0
                for start, end, ws in _lines(text, 0):
                    if len(ws) >= s.width:
                        rows.append((uid, own, doc_id, n, start, end, len(ws), paragraph_name(ws)))
                        flat.append(hashes[at : at + len(ws)])
                        n, held = n + 1, held + len(ws)
                    at += len(ws)
                    if held > 1 << 20:
                        yield part()
                        rows, flat, held = [], [], 0
                if marks and len(hashes) >= s.passage:
                    found.append(np.unique(_window_marks(hashes, s)[0]))
                    owners.append(np.full(len(found[-1]), uid))
                uid += 1
            if rows:
                yield part()
            if len(found) > 1:
                hashes, uids = np.concatenate(found).view(np.int64), np.concatenate(owners)
                empty = {n: pa.nulls(len(uids), k) for n, k in zip(names, kinds)} | {"uid": pa.array(uids), "hash": pa.array(hashes)}
                yield pa.RecordBatch.from_arrays([empty[n] for n in names], names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PARAGRAPH + ", hash long")
    made = scratch.put(made)
    return made.where("pid is not null").drop("hash"), made.where("hash is not null").select("hash", "uid")


def shingle_sets(docs: DataFrame, bits: bytes, s: Settings) -> DataFrame:
    """``pid, shingles`` (sorted 32-bit hashes, each once) of the paragraphs that the bit filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        given: set[int] = set()  # a task gives a much-repeated paragraph once, as far as it remembers
        flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        for b in batches:
            pids: list[int] = []
            sets: list[np.ndarray] = []
            for text in b.column(0).to_pylist():
                for _, _, ws in _lines(text, s.width):
                    pid = paragraph_name(ws)
                    if has_bit(flags, pid) and pid not in given:
                        if len(given) >= _REMEMBERED:
                            given.clear()
                        given.add(pid)
                        pids.append(pid)
                        own = grams(np.array([seen[w] for w in ws], dtype=np.uint64), s.width) >> np.uint64(33)
                        sets.append(np.unique(own).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(_long(pids)), pa.array(sets, pa.list_(pa.int32()))], ["pid", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pid long, shingles array<int>")


def similar_links(distinct: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Links ``(u, v)`` that connect the paragraphs with similarity of at least ``s.similar``.

    ``distinct``: ``pid, bands``.  Bands with few members give pairs, each
    verified once.  Members of a dense band are dealt into blocks; every pair
    of blocks is compared in one step, which keeps a spanning forest of its
    links, so neither rows nor links grow with the square of the band.
    """
    keyed = distinct.select("pid", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.put(keyed.join(met, "key").select("key", "pid", "n"))
    wanted = shared.select("pid").distinct()
    sets = shingle_sets(docs, bit_filter(wanted, "pid"), s).groupBy("pid").agg(F.first("shingles").alias("shingles"))
    sets = scratch.put(sets.join(wanted, "pid", "left_semi"))
    light = shared.where(F.col("n") <= s.dense).select("key", "pid")
    pairs = light.alias("a").join(light.alias("b"), F.expr("a.key = b.key and a.pid < b.pid")).select(F.col("a.pid").alias("u"), F.col("b.pid").alias("v")).distinct()
    pairs = pairs.join(sets.select(F.col("pid").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("pid").alias("v"), F.col("shingles").alias("y")), "v")
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.where(both >= s.similar * (F.size("x") + F.size("y") - both)).select("u", "v")
    return links.union(_dense_links(shared.where(F.col("n") > s.dense), sets, s))


def _dense_links(shared: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    own = F.pmod(F.xxhash64("pid"), blocks).cast("int")
    dealt = shared.select("key", "pid", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "pid").join(sets, "pid")
    least = s.similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("key", "i", "j")):
            pids = t.column("pid").to_numpy()
            side = t.column("own").to_numpy() == t.column("i").to_numpy()[0]
            lists = t.column("shingles").combine_chunks()
            u, v = forest(pids, side, lists.offsets.to_numpy(), lists.values.to_numpy(), least)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    order = ["key", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "u long, v long")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys."""
    held: list[pa.RecordBatch] = []
    mark = None
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in by], axis=1)
        ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else []
        begin = 0
        for end in ends:
            now = tuple(key[begin])
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(b.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def forest(pids: np.ndarray, side: np.ndarray, offsets: np.ndarray, values: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the members of two blocks (or within one block, if all are on one side)."""
    n = len(pids)
    sizes = np.diff(offsets)
    member = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
    often = count[code] > 1
    code, member = code[often], member[often]
    renumber = np.cumsum(count > 1) - 1
    code = renumber[code]
    total = int(renumber[-1]) + 1 if len(renumber) else 0
    common = np.zeros((n, n), dtype=np.float32)
    step = 4096
    for at in range(0, total, step):
        own = (code >= at) & (code < at + step)
        x = np.zeros((n, min(step, total - at)), dtype=np.float32)
        x[member[own], code[own] - at] = 1
        common += x @ x.T
    linked = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    free = np.ones(n, dtype=bool)
    u, v = [], []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue:
            near = np.flatnonzero(linked[queue.pop()] & free)
            free[near] = False
            u += [int(pids[start])] * len(near)
            v += pids[near].tolist()
            queue += near.tolist()
    return u, v


def repeated_paragraphs(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """The paragraphs of passages that other documents repeat.

    ``doc_id, start, end, n_words, class_doc_id, class_start, removed``: a
    row per paragraph (a line; code points, end exclusive) of every passage.
    Paragraphs are one class if a chain of links (similarity of at least 0.8)
    joins them; a class counts as repeated if it occurs in two rows of
    ``docs``.  A passage is a run of neighbouring repeated paragraphs with at
    least 50 words together (lines under five words do not part a run).
    ``class_doc_id`` and ``class_start`` name the class's first occurrence, by
    doc_id (null last) and place, which stays; all others are ``removed``.
    Null and empty texts have no paragraphs; repeated rows repeat each other;
    a null doc_id is given out as null; other columns are not read; an empty
    table gives no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    rows, _ = first_reading(docs, settings, scratch, marks=False)
    return _found_lines(docs, rows, settings, scratch).select(*_COLUMNS)


def _found_lines(docs: DataFrame, rows: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """``_COLUMNS`` and ``text_id`` of the paragraphs of repeated passages; ``rows``: all paragraphs."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("uid"), F.col("at"), F.col("start"))
    known = scratch.put(rows.groupBy("pid").agg(F.first("bands").alias("bands"), F.min(place).alias("first"), F.min("uid").alias("low"), F.max("uid").alias("high")))
    links = similar_links(known.select("pid", "bands"), docs, s, scratch)
    roots = components(links, scratch)
    near = known.join(roots, known["pid"] == roots["u"]).select("pid", "root", "first", "low", "high")
    # Classes of one paragraph need no more than its own counts.
    groups = near.groupBy("root").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    alone = known.join(roots, known["pid"] == roots["u"], "left_anti").where("low <> high").select("pid", "first")
    several = near.select("pid", "root").join(groups.where("low <> high").select("root", "first"), "root").select("pid", "first")
    repeated = scratch.put(alone.union(several))
    found = rows.select("uid", "text_id", "doc_id", "at", "start", "end", "n_words", "pid").join(repeated, "pid")
    by_doc = Window.partitionBy("uid").orderBy("at")
    found = found.withColumn("run", F.col("at") - F.row_number().over(by_doc))
    found = found.withColumn("total", F.sum("n_words").over(Window.partitionBy("uid", "run"))).where(F.col("total") >= s.passage)
    removed = ~((F.col("uid") == F.col("first.uid")) & (F.col("at") == F.col("first.at")))
    return found.select("text_id", "doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("class_doc_id"), F.col("first.start").alias("class_start"), removed.alias("removed"))


def _kept_lines(docs: DataFrame, rows: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """``_found_lines``, written; the tables they are made from are removed."""
    steps = Scratch(docs.sparkSession, "repeats-lines")
    lines = scratch.put(_found_lines(docs, rows, s, steps))
    steps.clear()
    return lines


def _least(own: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        own = np.minimum(own[:-size], own[size:])
        size *= 2
    return np.minimum(own[: len(own) - (w - size)], own[w - size :])


def _window_marks(hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``s.passage`` words: its smallest gram, its own hash."""
    k, n = min(s.gram, s.passage), len(hashes) - s.passage + 1
    own = grams(hashes, k)
    whole = own[:n].copy()
    for at in [*range(k, s.passage - k, k), s.passage - k]:
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + own[at : at + n]
    return _least(own, s.passage - k + 1), whole ^ (whole >> np.uint64(32))


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (64 bits, of the letters and their places), starts and ends (code points) of the words of a text, in the order of ``words``."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    folded = _FOLDED[raw]
    solid = folded != 0x20
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    size = ends - starts
    begins = np.cumsum(size) - size
    powers = np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64).cumprod(dtype=np.uint64)
    letters = _LETTERS[folded[solid]] * powers[np.arange(int(size.sum())) - np.repeat(begins, size)]
    hashes = np.add.reduceat(letters, begins)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return hashes ^ (hashes >> np.uint64(29)), place[starts], place[ends]


def _filters(rows: DataFrame) -> list[bytes]:
    """Two bit filters of ``hash``, by different bits of it."""
    return [bit_filter(rows, "hash"), bit_filter(rows.select(F.shiftrightunsigned("hash", 24).alias("hash")), "hash")]


def _passes(filters: list[bytes]):
    """The test of an array of hashes against ``_filters``."""
    flags = [np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool) for bits in filters]
    mask = np.uint64(len(flags[0]) - 1)
    return lambda x: flags[0][(x & mask).astype(np.int64)] & flags[1][(x >> np.uint64(24) & mask).astype(np.int64)]


def _shared_marks(marks: DataFrame) -> DataFrame:
    """``hash``: the smallest grams of windows that occur in two rows."""
    return marks.groupBy("hash").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low <> high").select("hash")


_PIECE = "uid long, text_id long, doc_id long, at long, hashes array<long>, starts array<long>, ends array<long>"


def _pieces(docs: DataFrame, filters: list[bytes], s: Settings) -> DataFrame:
    """``_PIECE``: neighbouring windows that other rows may have; ``at`` numbers the words, ``starts`` and ``ends`` are theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        passes = _passes(filters)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes, starts, ends = word_spans(text)
                uid += 1
                if len(hashes) < s.passage:
                    continue
                marks, whole = _window_marks(hashes, s)
                kept = passes(marks)
                edge = np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8))
                if kept.any():
                    own = text_name(text)
                    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                        upto = hi + s.passage - 1
                        rows.append((uid, own, doc_id, lo, whole[lo:hi].view(np.int64), starts[lo:upto], ends[lo:upto]))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["uid", "text_id", "doc_id", "at", "hashes", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE)


_WINDOW = "hash long, uid long, doc_id long, at long, start long, end long"


def _windows(pieces: DataFrame, s: Settings, filters: list[bytes] | None = None) -> DataFrame:
    """``_WINDOW`` of the windows that the bit filters let through; without them, of those with a word outside the ``lines`` of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = filters and _passes(filters)
        for b in batches:
            parts: list[np.ndarray] = []
            names: list[tuple] = []
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r].values.to_numpy()  # noqa: B023, E731
                hashes, starts, ends = get("hashes"), get("starts"), get("ends")
                if passes:
                    kept = np.flatnonzero(passes(hashes.view(np.uint64)))
                else:
                    lines = b.column("lines")[r].as_py() or []
                    begins, stops = (np.array([x[c] for x in lines], dtype=np.int64) for c in ("start", "end"))
                    line = np.searchsorted(begins, starts, side="right") - 1
                    outside = (line < 0) | (starts >= stops[line]) if lines else np.ones(len(starts), dtype=bool)
                    sums = np.concatenate([[0], np.cumsum(outside)])
                    kept = np.flatnonzero(sums[s.passage :] > sums[: len(hashes)])
                parts.append(np.stack([hashes[kept], kept + b.column("at")[r].as_py(), starts[kept], ends[kept + s.passage - 1]]))
                names.append((b.column("uid")[r].as_py(), b.column("doc_id")[r].as_py()))
            hashes, at, start, end = np.concatenate([np.zeros((4, 0), dtype=np.int64), *parts], axis=1)
            times = pa.array(np.repeat(np.arange(len(parts)), [x.shape[1] for x in parts]).astype(np.int64))
            uids, docs = (pa.array([x[c] for x in names], pa.int64()).take(times) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), uids, docs, pa.array(at), pa.array(start), pa.array(end)], ["hash", "uid", "doc_id", "at", "start", "end"])

    return pieces.mapInArrow(run, _WINDOW)


def _found_runs(docs: DataFrame, lines: DataFrame, shared: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """``_COLUMNS`` of the runs of at least ``s.passage`` words with a word outside ``lines`` that another row has word for word."""
    pieces = scratch.put(_pieces(docs, _filters(shared), s))
    known = lines.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("lines"))
    asked = scratch.put(_windows(pieces.join(known, "text_id", "left"), s))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("uid"), F.col("at"), F.col("start"))
    met = _windows(pieces, s, _filters(asked)).groupBy("hash").agg(F.min(place).alias("first"), F.min("uid").alias("low"), F.max("uid").alias("high"))
    found = asked.join(met.where("low <> high").select("hash", "first"), "hash")
    # Windows one word apart whose first occurrences are one word apart as well make up a run.
    found = found.withColumn("apart", F.col("first.at") - F.col("at"))
    by_word = Window.partitionBy("uid", "first.uid", "apart").orderBy("at")
    found = found.withColumn("run", F.col("at") - F.row_number().over(by_word))
    runs = found.groupBy("uid", F.col("first.uid").alias("class_uid"), "apart", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.count("*") + s.passage - 1).cast("int").alias("n_words"), F.first("first.doc_id").alias("class_doc_id"), F.min("first.start").alias("class_start")
    )
    return runs.withColumn("removed", ~((F.col("uid") == F.col("class_uid")) & (F.col("apart") == 0))).select(*_COLUMNS)


def repeated_passages(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """``repeated_paragraphs``, and a row for every run of words that they leave out.

    Such a run has at least ``passage`` words (of any lines, short ones
    included), stands word for word in another row of ``docs``, wherever its
    lines begin and end, and is given from its first to its last word as far as
    its windows of ``passage`` words have a word outside the given paragraphs.
    ``class_doc_id`` and ``class_start`` name the first occurrence of its words
    in the order of ``repeated_paragraphs``; where that changes within a run, a
    new row begins, and the two rows overlap.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    lines, shared = _read(docs, settings, scratch)
    return lines.select(*_COLUMNS).union(_found_runs(docs, lines, shared, settings, scratch))


def _read(docs: DataFrame, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of repeated passages, and the shared window marks, both written."""
    reading = Scratch(docs.sparkSession, "repeats-reading")
    rows, marks = first_reading(docs, s, reading)
    shared = scratch.put(_shared_marks(marks))
    lines = _kept_lines(docs, rows, s, scratch)
    reading.clear()
    return lines, shared


def without_repeats(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the removed paragraphs and runs of words cut out of ``text``; rows and columns stay.

    A paragraph goes with the line break behind it.

    Rows share the cuts of their doc_id, so doc_ids must be unique; rows
    without a doc_id stay whole.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    lines, shared = _read(docs, settings, scratch)
    found = lines.select("doc_id", "start", (F.col("end") + 1).alias("end"), "removed").union(_found_runs(docs, lines, shared, settings, scratch).select("doc_id", "start", "end", "removed"))
    found = found.where("removed and doc_id is not null")
    # Runs overlap each other and lines: a cut begins where the one before it ends.
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(before), "start"))).where("start < end")
    cuts = found.groupBy(F.col("doc_id").alias("__drawlog_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__drawlog_cuts"))
    joined = docs.join(cuts, docs["doc_id"] == cuts["__drawlog_id"], "left")
    spots = F.col("__drawlog_cuts")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spots, lambda c: c["end"]))
    ends = F.concat(F.transform(spots, lambda c: c["start"]), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))), "")
    return joined.withColumn("text", F.when(spots.isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
