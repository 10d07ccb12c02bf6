"""Whole documents with similar word shingles: links for near-duplicates beyond a few fingerprint bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlog.llm.components import components
from drawlog.llm.decontaminate import WordHashes, bit_filter, grams, has_bit
from drawlog.llm.repeats import Settings, forest, groups, minhash_bands, paragraph_name
from drawlog.llm.scratch import Scratch
from drawlog.llm.simhash import folded_words, near_links, simhash_of

_KEPT, _NTH, _TEXT = "__drawlog_kept", "__drawlog_nth", "__drawlog_text_key"
#: 16 bands of 4 values: a pair at similarity 0.8 meets with chance 0.9998.
SIMILAR = Settings(bands=16, rows=4)


def profiles(docs: DataFrame, width: int, s: Settings = SIMILAR) -> DataFrame:
    """``doc_id, fp, pid, bands, tkey`` of whole texts; pid names the words, null for a text under ``s.width`` words; tkey names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            fps, pids, keys = [], [], []
            for text in b.column(1).to_pylist():
                ws = folded_words(text)
                fps.append(simhash_of(ws, width))
                if len(ws) < s.width:
                    pids.append(None)
                    keys.append([])
                else:
                    pids.append(int(np.uint64(paragraph_name(ws)).view(np.int64)))
                    keys.append(minhash_bands(np.array([len(ws)]), np.array([seen[w] for w in ws], dtype=np.uint64), s).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(pids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), b.column(2)],
                ["doc_id", "fp", "pid", "bands", "tkey"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key().alias("tkey"))
    return rows.mapInArrow(run, "doc_id long, fp long, pid long, bands array<long>, tkey long")


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _sets(docs: DataFrame, bits: bytes, s: Settings) -> DataFrame:
    """``pid, shingles`` of the texts that the bit filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").view(bool)
        for b in batches:
            pids, sets = [], []
            for text in b.column(0).to_pylist():
                ws = folded_words(text)
                if len(ws) >= s.width and has_bit(flags, pid := paragraph_name(ws)):
                    pids.append(pid)
                    own = grams(np.array([seen[w] for w in ws], dtype=np.uint64), s.width) >> np.uint64(33)
                    sets.append(np.unique(own).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(pids, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))], ["pid", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pid long, shingles array<int>")


def similar_links(rows: DataFrame, docs: DataFrame, scratch: Scratch, s: Settings = SIMILAR) -> DataFrame:
    """Links ``(u, v)`` between texts that meet under a band and have a similarity of at least ``s.similar``.

    ``rows``: ``pid, bands``.  Members of a small band are verified in pairs,
    those of a dense one against the member with most copies.  What that leaves
    apart in a dense band is compared, in blocks, with all its members; members
    that are one component already are never compared again, so the work grows
    with what is left over and not with the square of a group of copies.
    """
    known = scratch.put(rows.where("pid is not null").groupBy("pid").agg(F.first("bands").alias("bands"), F.count("*").alias("copies")))
    keyed = known.select("pid", "copies", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max_by("pid", F.struct("copies", "pid")).alias("hub")).where("n > 1")
    shared = scratch.put(keyed.join(met, "key").select("key", "pid", "n", "hub"))
    wanted = shared.select("pid").distinct()
    sets = _sets(docs, bit_filter(wanted, "pid"), s).groupBy("pid").agg(F.first("shingles").alias("shingles"))
    sets = scratch.put(sets.join(wanted, "pid", "left_semi"))
    light = shared.where(F.col("n") <= s.dense).select("key", "pid")
    pairs = light.alias("a").join(light.alias("b"), F.expr("a.key = b.key and a.pid < b.pid")).select(F.col("a.pid").alias("u"), F.col("b.pid").alias("v"))
    stars = shared.where((F.col("n") > s.dense) & (F.col("pid") != F.col("hub"))).select(F.col("pid").alias("u"), F.col("hub").alias("v"))
    sized = sets.select("pid", "shingles")
    both = pairs.union(stars).distinct().join(sized.select(F.col("pid").alias("u"), F.col("shingles").alias("x")), "u").join(sized.select(F.col("pid").alias("v"), F.col("shingles").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    links = scratch.put(both.where(common >= s.similar * (F.size("x") + F.size("y") - common)).select("u", "v"))
    dense = shared.where(F.col("n") > s.dense).select("key", "pid", "n")
    roots = components(links, scratch)
    dense = scratch.put(dense.join(roots, dense["pid"] == roots["u"], "left").select("key", "pid", "n", F.coalesce("root", "pid").alias("root")))
    counted = dense.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = scratch.put(counted.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("top")).where(F.col("all") > F.col("top")))
    open_rows = dense.join(main, "key")
    rest, whole = F.ceil((F.col("all") - F.col("top")) / s.block).cast("int"), F.ceil(F.col("all") / s.block).cast("int")
    block = lambda n: F.pmod(F.xxhash64("pid"), n).cast("int")
    apart = open_rows.where(F.col("root") != F.col("main")).select("key", block(rest).alias("i"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("j"), F.lit(True).alias("side"), "pid")
    members = open_rows.select("key", F.explode(F.sequence(F.lit(0), rest - 1)).alias("i"), block(whole).alias("j"), F.lit(False).alias("side"), "pid")
    least = s.similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("key", "i", "j")):
            lists = t.column("shingles").combine_chunks()
            u, v = forest(t.column("pid").to_numpy(), t.column("side").to_numpy().astype(bool), lists.offsets.to_numpy(), lists.values.to_numpy(), least)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    order = ["key", "i", "j"]
    units = apart.union(members).join(sets, "pid").repartition(*order).sortWithinPartitions(*order)
    return links.union(units.mapInArrow(run, "u long, v long"))


def similar_documents(docs: DataFrame, width: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """``near_duplicates`` with further links (and ``root``, which names the group, and ``tkey``, which names the text): five-word shingles with a Jaccard similarity of at least 0.8.

    Two bits are far nearer than that: documents at 0.8 to 0.9 differ in about
    seven.  So texts that meet under a MinHash band are verified too; both
    kinds of links join the same nodes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(profiles(docs, width))
    label = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    near = near_links(rows.select("fp").distinct(), scratch).select(label("f", "u").alias("u"), label("f", "v").alias("v"))
    alike = similar_links(rows.select("pid", "bands"), docs, scratch).select(label("p", "u").alias("u"), label("p", "v").alias("v"))
    own = rows.where("pid is not null").select(label("f", "fp").alias("u"), label("p", "pid").alias("v")).distinct()
    # Only texts with a link beside their own fingerprint matter.
    alike = scratch.put(alike)
    linked = alike.select(F.col("u").alias("v")).union(alike.select("v")).distinct()
    roots = components(near.union(alike).union(own.join(linked, "v", "left_semi").select("u", "v")), scratch)
    rows = rows.select("doc_id", "fp", "tkey", label("f", "fp").alias("node"))
    nodes = scratch.put(rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(scratch.put(nodes.join(least, "root").select("node", "root", "component_id")), "node").select("doc_id", "fp", "component_id", "root", "tkey")


def representatives(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar_documents`: the one with the smallest doc_id.

    Where rows of a group share that doc_id but not their text, one of the
    texts stays; texts of one doc_id that are no near copies are groups of
    their own, and each keeps a row.  Of repeated rows one stays.  Rows without
    a doc_id all stay: nothing names them, so nothing can stand for them.
    """
    found = similar_documents(docs, scratch=scratch).where("doc_id = component_id")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("k")).select(F.col("k.doc_id").alias(_KEPT), F.col("k.tkey").alias(_TEXT)).distinct()
    keyed = docs.withColumn(_NTH, _text_key())
    named = keyed.join(kept, (keyed["doc_id"] == kept[_KEPT]) & (keyed[_NTH] == kept[_TEXT]), "left_semi")
    at = Window.partitionBy("doc_id", _NTH).orderBy("doc_id")
    once = named.withColumn(_KEPT, F.row_number().over(at)).where(F.col(_KEPT) == 1).select(*docs.columns)
    return once.union(docs.where("doc_id is null"))
