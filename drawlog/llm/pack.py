"""Best-fit packing of token sequences.

Plan over a histogram: one pass counts pieces by length (at most ``capacity``
numbers), best fit decreasing runs over those counts, and every piece then
takes its planned slot by its rank among the pieces of its length.  The plan's
size depends on the number of lengths, not of documents.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlog.llm.scratch import Scratch

_PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, pid long, nth long"


def encoder(vocabulary: str, ranks: str):
    """``text -> ids`` of a public byte-level BPE vocabulary.

    The rank file is the same vocabulary as the tokenizer file and several
    times as fast; the tokenizer file is read only for a text that the fast
    reader refuses.  Special tokens written in a text become their ids, as
    the tokenizer file's own defaults have it.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={"<|endoftext|>": 50256})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            ids = Tokenizer.from_file(public_tokenizers.path(vocabulary)).encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, capacity: int = 2048, keep_ids: bool = False, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token pieces of all documents, with the partition that made them and their rank there within their length."""
    schema = _PIECES + (", ids array<int>" if keep_ids else "")
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        pid = TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), 0).astype("<u4")
                begin, number = 0, 0
                for end in range(len(ids) % capacity or capacity, len(ids) + 1, capacity):
                    n = end - begin
                    row = (doc_id, number, begin, n, zlib.crc32(ids[begin:end].tobytes()), pid, int(made[n]))
                    rows.append(row + ((ids[begin:end].astype(np.int32),) if keep_ids else ()))
                    made[n] += 1
                    begin, number = end, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over ``{length: count}``.

    Rows ``(length, rank_from, rank_to, seq_from, per_seq, offset)``: the piece
    of that length and rank goes to sequence ``seq_from + (rank - rank_from) //
    per_seq``, at ``offset + length * ((rank - rank_from) % per_seq)``.  Equal
    sequences are one group, so the work grows with the lengths only.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> groups (first sequence, sequences)
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def fill(length: int, rank: int, left: int, free: int, first: int, n: int, per: int) -> int:
        """Put ``per`` pieces into each sequence of a group as far as they go; returns the pieces placed."""
        full = min(n, left // per)
        if full:
            plan.append((length, rank, rank + full * per, first, per, capacity - free))
            room.setdefault(free - per * length, []).append((first, full))
        rest = left - full * per
        more = 0
        if full < n and rest:
            plan.append((length, rank + full * per, rank + left, first + full, rest, capacity - free))
            room.setdefault(free - rest * length, []).append((first + full, 1))
            more = 1
        else:
            rest = 0
        if full + more < n:
            room.setdefault(free, []).append((first + full + more, n - full - more))
        return full * per + rest

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(k for k in room if k >= length):
            groups = room.pop(free)
            while groups and left:
                first, n = groups.pop()
                placed = fill(length, rank, left, free, first, n, free // length)
                left, rank = left - placed, rank + placed
            if groups:
                room.setdefault(free, []).extend(groups)
            if not left:
                break
        if left:
            per = capacity // length
            n = -(-left // per)
            fill(length, rank, left, capacity, sequences, n, per)
            sequences += n
    return plan


def pack(docs: DataFrame, capacity: int = 2048, keep_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and ``ids`` with ``keep_ids``.  Null text counts as empty (the end
    token alone); repeated rows and repeated or null doc_ids are pieces of
    their own; columns besides ``doc_id`` and ``text`` are ignored; an empty
    table gives no row.  Which of two pieces of one length takes which slot
    depends on how the input is split; the number of sequences does not.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    made = scratch.put(pieces(docs, capacity, keep_ids))
    dealt = scratch.put(made.groupBy("pid", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "rank_from", "rank_to", "seq_from", "per_seq", "at")])
    plan = spark.createDataFrame(best_fit(counts, capacity), schema)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per partition and length: grows with the input, so it is never sent to every task.
    ranked = made.join(bases.hint("merge"), ["pid", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    slot = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(plan, "length")
        .where("rank >= rank_from and rank < rank_to")
        .select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("seq_from") + F.floor(slot / F.col("per_seq"))).alias("sequence_id"), (F.col("at") + F.col("length") * (slot % F.col("per_seq"))).alias("offset"), *(["ids"] if keep_ids else []))
    )
