"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.components import components
from drawlog.llm.scratch import Scratch

BITS, BLOCKS, SEED, NEAR = 64, 4, 42, 2
_STEP = 1 << 16  # shingles hashed at once, so a very long text needs no more memory


def folded_words(text: str | None) -> list[bytes]:
    """Words between blanks, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles: a bit is 1 if set in over half of the shingle hashes."""
    return simhash_of(folded_words(text), width)


def simhash_of(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - width + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _STEP):
        part = words[at : min(at + _STEP, n) + width - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(width)))], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots() -> list[list[int]]:
    """Reference fingerprints by block of bits.

    The first list holds the zero fingerprint; every block then has one
    reference for each of its bits: the bit with its next two, around the
    block.  A fingerprint's distance to a reference less its distance to zero
    depends on that block only, and a block's distances fix its bits.
    """
    size = BITS // BLOCKS
    return [[0]] + [[sum(1 << (b * size + (i + k) % size) for k in range(3)) for i in range(size)] for b in range(BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: DataFrame) -> DataFrame:
    """``(fp, near)``: the Hamming distances to all references, zero first."""
    refs = [r for block in pivots() for r in block]
    return fps.select("fp", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("byte") for r in refs)).alias("near"))


def near_links(fps: DataFrame, scratch: Scratch, dense: int = 48) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the distinct fingerprints within two differing bits.

    Such fingerprints have equal pivot coordinates in at least two of four
    blocks, so each pair of blocks gives one key.  Pairs that meet under a key
    are discarded if any pivot distance differs by more than two, and the rest
    are verified.  Where over ``dense`` fingerprints meet under a key, pairs
    would grow with the square: those fingerprints instead link to the points
    one bit away from them, which two of them share exactly if they differ in
    at most two bits.
    """
    size = BITS // BLOCKS
    part = [F.transform(F.slice("near", 2 + b * size, size), lambda d: d.cast("int") - F.col("near")[0].cast("int")) for b in range(BLOCKS)]
    keys = F.array(*(F.xxhash64(F.lit(a), F.lit(b), part[a], part[b]) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)))
    keyed = scratch.put(pivot_table(fps).select("fp", "near", F.explode(keys).alias("key")))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.put(keyed.join(met, "key"))
    scratch.drop(keyed)
    light = shared.where(F.col("n") <= dense).select("key", "fp", "near")
    close = F.forall(F.zip_with("a.near", "b.near", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d <= NEAR)
    pairs = light.alias("a").join(light.alias("b"), F.expr("a.key = b.key and a.fp < b.fp")).where(close & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= NEAR))
    points = shared.where(F.col("n") > dense).select("fp").distinct()
    spread = points.select("fp", F.explode(F.array("fp", *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))).alias("point"))
    hubs = spread.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select("point", "v")
    stars = spread.join(hubs, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Two documents link if their fingerprints differ in at most two bits;
    ``component_id`` is the smallest doc_id reachable.  Null or blank text has
    fingerprint zero, linked like any other.  Rows with a null doc_id link too
    and get the component of the named documents they reach (null if none);
    repeated rows stay; other columns are ignored; an empty table gives no row.
    Equal fingerprints are one node, so copies never meet in pairs.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, width))
    links = near_links(rows.select("fp").distinct(), scratch)
    return members(rows, "fp", components(links, scratch), scratch).select("doc_id", "fp", "component_id")


def members(rows: DataFrame, node: str, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with component_id: the smallest doc_id among the rows whose nodes have the same root."""
    nodes = scratch.put(rows.groupBy(node).agg(F.min("doc_id").alias("first")))
    named = nodes.join(roots, nodes[node] == roots["u"], "left").select(node, "first", F.coalesce("root", node).alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(scratch.put(named.join(least, "root").select(node, "component_id")), node)
