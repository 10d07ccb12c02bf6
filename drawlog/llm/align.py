"""Alignment of two tokenizers: which tokens of one stand where which of the other do.

A text's tokens are cut into groups at the byte offsets where tokens of both
end; tokens of a group are linked.  How often a pair of ids is linked over the
corpus comes from an inverted index: a task numbers its documents in chunks,
and per pair and chunk keeps a compressed bitmap of the documents that hold
the pair (positions, or bits where these are smaller) with multiplicity
planes, bit planes over the bitmap's documents that hold in binary how often
each has the pair.  Batches of a chunk are OR-merged, popcounts give document
counts and, weighted by plane, link counts.  The postings then carry each
pair's count back to their documents.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """Vocabulary files, documents per chunk, pairs held before they are packed, links expanded at once."""

    a_vocabulary: str = "byte_bpe_50k.json"
    a_ranks: str = "byte_bpe_50k.tiktoken"
    b_model: str = "piece_bpe_32k.model"
    chunk: int = 1 << 13
    held: int = 1 << 22
    links: int = 1 << 20


# ---------------------------------------------------------------- bitmaps


def pack_docs(docs: np.ndarray, chunk: int) -> bytes:
    """A sorted set of document numbers below ``chunk``: 16-bit positions, or bits where those take less room."""
    if 2 * len(docs) < -(-chunk // 8):
        return docs.astype("<u2").tobytes()
    bits = np.zeros(chunk, dtype=np.uint8)
    bits[docs] = 1
    return np.packbits(bits).tobytes()


def unpack_docs(data: bytes, chunk: int) -> np.ndarray:
    if len(data) < -(-chunk // 8):
        return np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8))[:chunk])


def pack_planes(times: np.ndarray) -> bytes:
    """Bit planes of the multiplicities, lowest first, each over the documents of the bitmap."""
    return b"".join(np.packbits((times >> p & 1).astype(np.uint8)).tobytes() for p in range(int(times.max()).bit_length()))


def unpack_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(-1, -(-n // 8)), axis=1)[:, :n]
    return (planes.astype(np.int64) << np.arange(len(planes))[:, None]).sum(axis=0)


def pack_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """``pair, documents, bitmap, planes, links`` of every pair; ``(pair, doc)`` are distinct."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(heads, len(pair)))
    links = np.add.reduceat(times, heads) if len(heads) else np.zeros(0, dtype=np.int64)
    small, end = doc.astype("<u2").tobytes(), np.append(heads[1:], len(pair))
    sparse = 2 * n < -(-chunk // 8)
    bitmaps = [small[2 * b : 2 * e] if s or e - b == 1 else pack_docs(doc[b:e], chunk) for b, e, s in zip(heads.tolist(), end.tolist(), sparse.tolist())]
    # A plane of all pairs at once, each pair's bits beginning at a byte of its own.
    size = -(-n // 8)
    first = np.cumsum(size) - size
    place = np.repeat(first * 8 - heads, n) + np.arange(len(pair))
    planes = [b""] * len(heads)
    most = np.maximum.reduceat(times, heads) if len(heads) else np.zeros(0, dtype=np.int64)
    for p in range(int(most.max(initial=0)).bit_length()):
        bits = np.zeros(8 * int(size.sum()), dtype=np.uint8)
        bits[place] = times >> p & 1
        plane = np.packbits(bits).tobytes()
        for i in np.flatnonzero(most >> p).tolist():
            planes[i] += plane[first[i] : first[i] + size[i]]
    return pair[heads], n, bitmaps, planes, links


def merge_postings(parts: list[tuple], chunk: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """Postings of several batches of one chunk: the bitmaps of a pair are OR-merged, its planes laid over the merged bitmap."""
    if len(parts) == 1:
        return parts[0]
    pair, n, links = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 4))
    bitmaps, planes = ([x for p in parts for x in p[i]] for i in (2, 3))
    order = np.argsort(pair, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1])))
    ends = np.append(heads[1:], len(order))
    out_n, out_bitmaps, out_planes = [], [], []
    for begin, end in zip(heads.tolist(), ends.tolist()):
        at = order[begin]
        if end - begin == 1:
            out_n.append(n[at])
            out_bitmaps.append(bitmaps[at])
            out_planes.append(planes[at])
            continue
        times = np.zeros(chunk, dtype=np.int64)
        for at in order[begin:end]:
            held = np.frombuffer(bitmaps[at], dtype="<u2").astype(np.int64) if n[at] == 1 else unpack_docs(bitmaps[at], chunk)
            times[held] += unpack_planes(planes[at], n[at])
        docs = np.flatnonzero(times)
        out_n.append(len(docs))
        out_bitmaps.append(pack_docs(docs, chunk))
        out_planes.append(pack_planes(times[docs]))
    return pair[order][heads], np.array(out_n), out_bitmaps, out_planes, np.add.reduceat(links[order], heads)


# ---------------------------------------------------------------- one text


def _laid_out(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and places of the tokens' bytes in one array."""
    length = np.array([len(x) for x in tokens], dtype=np.int64)
    return length, np.cumsum(length) - length, np.frombuffer(b"".join(tokens), dtype=np.uint8)


def _same(whole: np.ndarray, size: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> bool:
    """Whether tokens of these sizes, from these places, make up the text."""
    if int(size.sum()) != len(whole):
        return False
    at = np.cumsum(size) - size
    return bool((flat[np.repeat(begin - at, size) + np.arange(len(whole))] == whole).all())


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, settings: Settings):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(settings.a_ranks), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(settings.b_model))
        self._settings, self._slow = settings, None
        size = max(ranks.values()) + 2
        self.a_bytes = [b""] * size
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        self._a_length, self._a_from, self._a_flat = _laid_out(self.a_bytes)
        self._b_length, self._b_from, self._b_flat = _laid_out(self.b_bytes)
        self.width = len(self.b_bytes)
        self._many = max(size, self.width)
        self._written = np.array([f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(self._many)])

    def a_ids(self, text: str) -> np.ndarray:
        """The rank file is the tokenizer file's vocabulary and several times as fast; a text it refuses goes to the latter."""
        try:
            return self._a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except (ValueError, UnicodeError, RecursionError, RuntimeError):
            if self._slow is None:
                import public_tokenizers
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(public_tokenizers.path(self._settings.a_vocabulary))
                self._slow.encode_special_tokens = True
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def align(self, text: str | None):
        """``(n_a, n_b, n_groups, n_links, sha256, pairs, times)``; None without tokens."""
        if not text:
            return None
        whole = np.frombuffer((" " + text).encode(), dtype=np.uint8)
        a, b = self.a_ids(" " + text), np.array(self._b.encode(text, num_threads=1), dtype=np.int64)
        a_size, b_size = self._a_length[a], self._b_length[b]
        if not (_same(whole, a_size, self._a_from[a], self._a_flat) and _same(whole, b_size, self._b_from[b], self._b_flat)):
            return None
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_upto, b_upto = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        na, nb = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        # Written form: a group's A tokens, then its B tokens, each with the mark that follows it.
        a_mark, b_mark = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_mark[a_upto - 1], b_mark[b_upto - 1] = 1, 2
        b_mark[-1] = 3
        written = np.empty(len(a) + len(b), dtype=np.int64)
        written[np.arange(len(a)) + np.repeat(b_upto - nb, na)] = a + a_mark * self._many
        written[np.arange(len(b)) + np.repeat(a_upto, nb)] = b + b_mark * self._many
        said = self._written[written].tobytes().translate(None, b"\0")  # of fixed width, filled up with zeros
        pairs, times = self._pairs(a, b, a_upto - na, b_upto - nb, na, nb)
        return len(a), len(b), len(ends), int((na * nb).sum()), hashlib.sha256(said).hexdigest(), pairs, times

    def _pairs(self, a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs of a text and how often each is linked."""
        links = na * nb
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for g in np.flatnonzero(links > self._settings.links):  # one group with very many links: by distinct ids
            x, xn = np.unique(a[a_from[g] : a_from[g] + na[g]], return_counts=True)
            y, yn = np.unique(b[b_from[g] : b_from[g] + nb[g]], return_counts=True)
            met.append(((x[:, None] * self.width + y[None]).ravel(), (xn[:, None] * yn[None]).ravel()))
        usual = np.flatnonzero(links <= self._settings.links)
        part = np.cumsum(links[usual]) // self._settings.links
        for cut in np.split(usual, np.flatnonzero(np.diff(part)) + 1):
            if not len(cut):
                continue
            n = links[cut]
            g = np.repeat(cut, n)
            at = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            key = a[a_from[g] + at // nb[g]] * self.width + b[b_from[g] + at % nb[g]]
            met.append(np.unique(key, return_counts=True))
        if len(met) == 1:
            return met[0]
        key, times = (np.concatenate(x) for x in zip(*met))
        pair, at = np.unique(key, return_inverse=True)
        return pair, _sums(at, times, len(pair))


def _sums(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, value)
    return out


# ---------------------------------------------------------------- the corpus

_MADE = "chunk long, nth int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs int, links long, bitmap binary, planes binary"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def index(docs: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents with their own figures, and the postings of all pairs, from one reading of the texts."""
    names = [c.split()[0] for c in _MADE.split(", ")]

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, _KINDS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(settings)
        chunk, number, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        packed: list[tuple] = []

        def pack() -> None:
            if held:
                packed.append(pack_postings(*(np.concatenate(x) for x in zip(*held)), settings.chunk))
                held.clear()

        def postings() -> pa.RecordBatch:
            pair, n, bitmaps, planes, links = merge_postings(packed, settings.chunk)
            packed.clear()
            return rows({"chunk": np.full(len(pair), chunk), "a": (pair // aligner.width).astype(np.int32), "b": (pair % aligner.width).astype(np.int32), "docs": n.astype(np.int32), "links": links, "bitmap": bitmaps, "planes": planes})

        for batch in batches:
            made: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = aligner.align(text)
                if got:
                    *figures, pairs, times = got
                    held.append((pairs, np.full(len(pairs), number), times))
                    size += len(pairs)
                made.append((chunk, number, doc_id, *(figures if got else (0, 0, 0, 0, ""))))
                number += 1
                if size > settings.held:
                    pack()
                    size = 0
                if number == settings.chunk:
                    pack()
                    if packed:
                        yield postings()
                    chunk, number, size = chunk + 1, 0, 0
            if made:
                yield rows(dict(zip(names, zip(*made))))
        pack()
        if packed:
            yield postings()

    made = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MADE))
    own = made.where("a is null").select("chunk", "nth", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own, made.where("a is not null").select("chunk", "a", "b", "docs", "links", "bitmap", "planes")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``a, b, count, links, best``: documents and links of every pair, and whether no pair of the same A id is in more documents.

    Chunks hold different documents, so the popcount of a pair's merged bitmap is the sum over its chunks.
    """
    counts = postings.groupBy("a", "b").agg(F.sum(F.col("docs").cast("long")).alias("count"), F.sum("links").alias("links"))
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("a", "b", "count", "links", (F.col("count") == F.col("most")).alias("best"))


def _scores(postings: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """``chunk, nth, n_best, count_sum``: every posting's count added up over its documents, chunk by chunk."""
    met = postings.select("chunk", "a", "b", "docs", "bitmap", "planes").join(counts.select("a", "b", "count", "best"), ["a", "b"])
    met = met.select("chunk", "docs", "bitmap", "planes", "count", "best").repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total, seen = None, None, None, None

        def result() -> pa.RecordBatch:
            nth = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(nth), now)), pa.array(nth.astype(np.int32)), pa.array(best[nth]), pa.array(total[nth])], ["chunk", "nth", "n_best", "count_sum"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("chunk", "docs", "bitmap", "planes", "count", "best")]
            for chunk, n, bitmap, planes, count, top in zip(*columns):
                if chunk != now:
                    if now is not None:
                        yield result()
                    now, best, total = chunk, np.zeros(settings.chunk, dtype=np.int64), np.zeros(settings.chunk, dtype=np.int64)
                    seen = np.zeros(settings.chunk, dtype=bool)
                if n == 1:
                    doc = bitmap[0] | bitmap[1] << 8
                    times = sum(1 << p for p, plane in enumerate(planes) if plane)
                else:
                    doc, times = unpack_docs(bitmap, settings.chunk), unpack_planes(planes, n)
                seen[doc] = True
                total[doc] += times * count
                if top:
                    best[doc] += times
        if now is not None:
            yield result()

    return met.mapInArrow(run, "chunk long, nth int, n_best long, count_sum long")


def align(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """Alignment figures of every document.

    ``doc_id, n_a, n_b, n_groups, n_links`` (tokens, groups and links),
    ``n_best`` (links whose pair is in as many documents as any pair of its A
    id), ``count_sum`` (documents that hold a link's pair, added over links)
    and ``groups_sha256`` of the groups as ``a1,a2|b1;a3|b2``.  A null or
    empty text, or one that either tokenizer does not give back byte for
    byte, has no tokens: zeros and ''.  Every row is a document of its own,
    also where doc_ids repeat or are null; texts of any length are read
    whole; columns besides ``doc_id`` and ``text`` are not read; an empty
    table gives no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "align")
    own, postings = index(docs, settings, scratch)
    counts = scratch.put(pair_counts(postings))
    scores = _scores(postings, counts, settings)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(scores, ["chunk", "nth"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def alignments(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """The corpus-wide table of pairs itself: ``a, b, count, links, best``, as ``pair_counts``."""
    scratch = scratch or Scratch(docs.sparkSession, "align")
    return pair_counts(index(docs, settings, scratch)[1])
