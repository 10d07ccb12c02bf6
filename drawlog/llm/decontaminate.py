"""Benchmark decontamination by winnowing.

Of the hashes of all k-word grams, the smallest of every ``w`` neighbours is
kept, so two texts that share ``k + w - 1`` words share a kept gram inside
them.  Kept grams of documents meet those of the benchmark in a join, and each
meeting is extended word by word to whole windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch

#: Bytes that are no word characters become blanks; A-Z become a-z; every byte of a letter beyond ASCII stays.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 1 << 24
_VOCABULARY = 1 << 19  # words whose hashes a task remembers
_STEP = 1 << 18  # words handled at once


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every k neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * _MULTIPLIER + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``w`` neighbours (all of them on a tie)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for i in range(1, w):
        np.minimum(least, grams[i : i + n], out=least)
    kept = np.zeros(len(grams), dtype=bool)
    for i in range(w):
        kept[i : i + n] |= grams[i : i + n] == least
    return np.flatnonzero(kept)


def _kept(ws: list[bytes], seen: WordHashes, size: int, k: int, flags: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(position, hash) of the kept grams for windows of ``size`` words, block by block; ``flags`` filters by hash."""
    reach = size - k
    for at in range(0, len(ws) - size + 1, _STEP):
        last = at + _STEP >= len(ws) - size + 1
        lo, hi = max(at - 2 * size, 0), len(ws) if last else at + _STEP + 2 * size
        own = grams(np.array([seen[x] for x in ws[lo:hi]], dtype=np.uint64), k)
        kept = winnow(own, reach + 1)
        if flags is not None:
            kept = kept[flags[(own[kept] & np.uint64(_FILTER_BITS - 1)).astype(np.int64)]]
        for p in kept.tolist():
            if lo + p >= at and (last or lo + p < at + _STEP):
                yield lo + p, int(own[p : p + 1].view(np.int64)[0])


def benchmark_grams(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``(size, k, hash, item_id, left, gram, right)``: kept grams of the items with their neighbours within a window.

    An item of at least ``window`` words has size ``window``; a shorter one is
    a single window of its own size, whose one gram is all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                size = min(window, len(ws))
                g = k if size == window else size
                reach = size - g
                for p, h in _kept(ws, seen, size, g) if ws else ():
                    rows.append((size, g, h, item, ws[max(p - reach, 0) : p], ws[p : p + g], ws[p + g : p + g + reach]))
            yield _batch(rows, ["size", "k", "hash", "item_id", "left", "gram", "right"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.binary())] * 3])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "size int, k int, hash long, item_id long, left array<binary>, gram array<binary>, right array<binary>")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


_MET = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("left", pa.list_(pa.binary())), ("gram", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))])
_MET_DDL = "array<struct<size:int,hash:bigint,at:bigint,left:array<binary>,gram:array<binary>,right:array<binary>>>"


def document_grams(docs: DataFrame, sizes: list[int], bits: bytes, window: int, k: int) -> DataFrame:
    """A row per document: ``uid, doc_id, text_key, n_words, met``.

    ``met`` holds the kept grams that the benchmark may have (a fixed-size bit
    filter tells), with their neighbours.  ``sizes`` are the window sizes that
    occur in the benchmark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        uid = TaskContext.get().partitionId() << 40
        flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        for b in batches:
            uids, counts, met = [], [], []
            for text in b.column("text").to_pylist():
                ws = words(text)
                rows = []
                for size in sizes:
                    g = k if size == window else size
                    reach = size - g
                    for p, h in _kept(ws, seen, size, g, flags):
                        rows.append({"size": size, "hash": h, "at": p, "left": ws[max(p - reach, 0) : p], "gram": ws[p : p + g], "right": ws[p + g : p + g + reach]})
                uids.append(uid)
                uid += 1
                counts.append(len(ws))
                met.append(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(counts, pa.int64()), pa.array(met, pa.list_(_MET))],
                ["uid", "doc_id", "k1", "k2", "n_words", "met"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_key("text"))
    return keyed.mapInArrow(run, f"uid long, doc_id long, k1 long, k2 int, n_words long, met {_MET_DDL}")


def text_key(column: str) -> list:
    """96 bits that name a text."""
    return [F.xxhash64(column).alias("k1"), F.hash(column).alias("k2")]


def bit_filter(rows: DataFrame, column: str) -> bytes:
    """Bit filter of a column of hashes: 2 MB at any number of rows."""
    spot = F.col(column).bitwiseAND(F.lit(_FILTER_BITS - 1))
    parts = rows.select(spot.alias("spot")).groupBy(F.expr("spot div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(spot % 32768)").alias("bits"))
    out = bytearray(_FILTER_BITS // 8)
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def has_bit(flags: np.ndarray, value: int) -> bool:
    return bool(flags[value & (_FILTER_BITS - 1)])


def _agree(a: str, b: str, last: bool):
    """How many neighbours of two lists agree, counted from the gram outwards."""
    x, y = (F.reverse(a), F.reverse(b)) if last else (F.col(a), F.col(b))
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(x, 1, n).alias("x"), F.slice(y, 1, n).alias("y")), lambda z: z["x"] == z["y"])
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: ``uid, doc_id, k1, k2, n_words, n_hit, items``.

    A word is hit if it lies in an occurrence of a benchmark window; ``items``
    are the ids of items with occurring windows, as strings in order.  Null or
    blank text has no words, a null or blank item no window, an item with a
    null id counts as hit but is not listed.  Repeated rows are judged one by
    one; other columns are ignored; an empty table gives no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "winnow")
    of_items = scratch.put(benchmark_grams(benchmark, window, k))
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect())
    rows = scratch.put(document_grams(docs, sizes, bit_filter(of_items, "hash"), window, k))
    met = rows.where(F.size("met") > 0).select("uid", F.explode("met").alias("m")).select("uid", "m.size", "m.hash", "m.at", F.col("m.left").alias("dl"), F.col("m.gram").alias("dg"), F.col("m.right").alias("dr"))
    # An executor may hold the small side; which side that is, is left to the sizes the optimizer sees.
    both = met.join(of_items, ["size", "hash"]).where("dg = gram")
    left, right = _agree("dl", "left", True), _agree("dr", "right", False)
    spans = both.select("uid", "item_id", (F.col("at") - left).alias("begin"), (F.col("at") + F.col("k") + right).alias("end"), "size").where(F.col("end") - F.col("begin") >= F.col("size"))
    hit = spans.groupBy("uid").agg(F.collect_set(F.struct("begin", "end")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], acc["upto"]))).alias("n"), F.greatest(s["end"], acc["upto"]).alias("upto")),
    )["n"]
    hit = hit.select("uid", covered.alias("n_hit"), "items")
    return rows.select("uid", "doc_id", "k1", "k2", "n_words").join(hit, "uid", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window.

    All rows of one text go or stay together, whatever their doc_id, null ones
    included.  Null or blank text stays, as does everything beside an empty
    benchmark; an empty table gives no row; columns stay.
    """
    found = contamination(docs, benchmark, scratch=scratch)
    bad = found.where("n_hit > 0").select(F.col("k1").alias("__drawlog_k1"), F.col("k2").alias("__drawlog_k2")).distinct()
    k1, k2 = text_key("text")
    return docs.join(bad, (k1 == bad["__drawlog_k1"]) & (k2 == bad["__drawlog_k2"]), "left_anti")
