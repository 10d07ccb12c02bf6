"""Spelling variants: words one edit apart, found with bidirectional FM-index search schemes.

Words are counted with column functions.  Of two words that differ by one
edit, either half is the same in both: pairs whose first half agrees meet in
a group named by that half, all others in one named by the second half.
Groups are bundled into shards of bounded size.  A shard's words, delimited,
are one text under a bidirectional FM-index; a word's search matches its
exact half, extends across the other half allowing one error, and ends at a
delimiter, where the rank of the interval is the rank of the word found.
A group that is larger than a shard is cut by halving what is left between
its equal ends, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch

_EDGE = "\x01"  # between words; sorts before every letter
_END = "\x00"


@dataclass(frozen=True)
class Settings:
    """``least_length`` and ``least_count`` choose the words; ``ratio`` is how much commoner a form must be.

    ``shard`` bounds the words of a group (larger groups are cut) and is the
    mean number of words that one index holds; ``queries`` are searched at once.
    """

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    shard: int = 1 << 14
    queries: int = 1 << 13


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DROP_EVERY = 97  # fixed by the contract: a run whose checksum this divides loses one letter


def vocabulary(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, n``: the words of all texts that are long and common enough.

    A run of Latin letters is lower-cased (A-Z only); where 97 divides the
    checksum of its document and itself, it loses the letter that the
    checksum points to.  Null text holds no words, a null doc_id is written
    as empty in the checksum; repeated rows count each.  Runs that are too
    short stay so, and are not read.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{max(settings.least_length, 1)},}}"), F.lit(0))
    said = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    said = said.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    said = said.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    word = F.when(F.col("h") % _DROP_EVERY == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = said.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= settings.least_count) & (F.char_length("word") >= settings.least_length))


class _Side:
    """The suffix order of one text as a wavelet matrix over the letters before each suffix."""

    def __init__(self, codes: np.ndarray, bits: int):
        before = codes[_suffix_order(codes, bits) - 1]  # position 0 is preceded by the end
        self.bits, self.first = bits, np.searchsorted(np.sort(codes), np.arange(1 << bits))
        self.zeros, self.split = [], []
        for b in range(bits - 1, -1, -1):
            zero = (before >> b) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            before = np.concatenate((before[zero], before[~zero]))
        low, at = np.unique(before, return_index=True)
        self.start = np.zeros(1 << bits, dtype=np.int64)
        self.start[low] = at

    def extend(self, lo: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals extended by one letter each: ``lo, size`` here and how far the interval of the other side moves."""
        lo, hi, moved = lo, lo + size, np.zeros(len(lo), dtype=np.int64)
        for b, zeros, split in zip(range(self.bits - 1, -1, -1), self.zeros, self.split):
            one = (letter >> b) & 1 == 1
            zlo, zhi = zeros[lo], zeros[hi]
            moved += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, split + lo - zlo, zlo), np.where(one, split + hi - zhi, zhi)
        return self.first[letter] + lo - self.start[letter], hi - lo, moved

    def letters(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All letters by which the intervals can be extended: ``state, letter, lo, size, moved`` of each."""
        lo, hi = lo, lo + size
        state, letter, moved = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        for zeros, split in zip(self.zeros, self.split):
            zlo, zhi = zeros[lo], zeros[hi]
            zero, one = zhi > zlo, hi - zhi > lo - zlo
            more = (zhi - zlo)[one]
            state = np.concatenate((state[zero], state[one]))
            letter = np.concatenate((letter[zero] << 1, letter[one] << 1 | 1))
            moved = np.concatenate((moved[zero], moved[one] + more))
            lo, hi = np.concatenate((zlo[zero], split + (lo - zlo)[one])), np.concatenate((zhi[zero], split + (hi - zhi)[one]))
        return state, letter, self.first[letter] + lo - self.start[letter], hi - lo, moved


def _suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the sorted suffixes, by doubling; the last letter must be the smallest and occur once."""
    n, reach = len(codes), max(1, 62 // bits)
    rank = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((codes, np.zeros(reach, dtype=np.int64)))
    for i in range(reach):
        rank = rank << bits | padded[i : i + n]
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.concatenate(([0], np.cumsum(rank[order][1:] != rank[order][:-1])))
        if new[-1] == n - 1:
            return order
        place = np.empty(n, dtype=np.int64)
        place[order] = new
        after = np.concatenate((place[reach:] + 1, np.zeros(min(reach, n), dtype=np.int64)))[:n]
        rank, reach = place * (n + 1) + after, reach * 2


class Index:
    """Bidirectional FM-index over sorted, distinct words."""

    def __init__(self, words: list[str]):
        text = np.frombuffer((_EDGE + _EDGE.join(words) + _EDGE + _END).encode("utf-32-le"), dtype="<u4")
        self.points, codes = np.unique(text, return_inverse=True)
        bits = max(1, (len(self.points) - 1).bit_length())
        self.codes = codes.astype(np.int64)
        ends = np.flatnonzero(self.codes == 1)
        self.begin, self.length = ends[:-1] + 1, np.diff(ends) - 1
        self.ahead = _Side(self.codes, bits)
        self.back = _Side(np.concatenate((self.codes[-2::-1], self.codes[-1:])), bits)
        self.edges = len(ends)

    def search(self, word: np.ndarray, same_begin: np.ndarray, same_end: np.ndarray, rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` ranks of words one edit away from word ``word``; the edit lies between the first ``same_begin`` and the last ``same_end`` letters.

        Rightward searches start at the delimiter before the word, others at the one behind it.
        """
        main = self.back if rightward else self.ahead
        length, begin = self.length[word], self.begin[word]
        fixed, open_end = (same_begin, length - same_end) if rightward else (same_end, length - same_begin)

        def letter(q: np.ndarray, j: int) -> np.ndarray:
            """The next letter of each query after ``j``; the delimiter after the last."""
            inside = j < length[q]
            at = begin[q] + j if rightward else begin[q] + length[q] - 1 - j
            return np.where(inside, self.codes[np.where(inside, at, 0)], 1)

        # A state is a query with an interval on the side that grows and one on the other side.
        exact = (np.arange(len(word)), np.ones(len(word), dtype=np.int64), np.ones(len(word), dtype=np.int64), np.full(len(word), self.edges))
        wrong = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        known = 4 * len(word)

        def step(state: tuple, j: int) -> tuple:
            q, lo, other, size = state
            lo, size, moved = main.extend(lo, size, letter(q, j))
            on = size > 0
            return q[on], lo[on], (other + moved)[on], size[on]

        for j in range(int(length.max(initial=-1)) + 1):
            q, lo, other, size = exact
            may = (fixed[q] <= j) & (j <= open_end[q])
            later = []
            if may.any():
                fq, flo, fother, fsize = q[may], lo[may], other[may], size[may]
                state, c, clo, csize, moved = main.letters(flo, fsize)
                letters = c > 1
                state, c, clo, csize, moved = state[letters], c[letters], clo[letters], csize[letters], moved[letters]
                child = (fq[state], clo, fother[state] + moved, csize)
                wrong = tuple(np.concatenate(x) for x in zip(wrong, child))  # one letter more than the query
                within = j < open_end[fq]
                other_letter = within[state] & (c != letter(fq[state], j))
                later = [tuple(x[other_letter] for x in child), (fq[within], flo[within], fother[within], fsize[within])]
            wrong = step(wrong, j)
            over = j == length[wrong[0]]
            if over.any():  # the last step took the delimiter: the interval is one word
                rank = (wrong[2] if rightward else wrong[1])[over] - 2
                found.append((wrong[0][over], rank))
                wrong = tuple(x[~over] for x in wrong)
            exact = step(tuple(x[length[q] > j] for x in exact), j)
            if later:
                wrong = tuple(np.concatenate(x) for x in zip(wrong, *later))
            if len(wrong[0]) > 2 * known:  # in a run of one letter, edits at many places give one word
                once = np.unique(np.stack((wrong[0], wrong[1], wrong[3]), axis=1), axis=0, return_index=True)[1]
                wrong = tuple(x[once] for x in wrong)
                known = max(known, len(once))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that two words have in common at their beginning."""
        out, on, j = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
        least = np.minimum(self.length[a], self.length[b])
        while len(on):
            on = on[least[on] > j]
            on = on[self.codes[self.begin[a[on]] + j] == self.codes[self.begin[b[on]] + j]]
            out[on] += 1
            j += 1
        return out


def _children(rows: DataFrame) -> DataFrame:
    """Each group cut in two: the halves of what lies between its equal ends.

    ``shorter`` is the length of a pair's shorter word, ``a`` and ``z`` the
    letters equal at both ends, ``below`` what a pair's common beginning must
    stay under so that every pair belongs to one group.
    """
    free = F.col("shorter") - F.col("a") - F.col("z")
    mid = F.col("a") + F.floor(free / 2).cast("int")
    halves = F.array(
        F.struct(mid.alias("a"), F.col("z").alias("z"), F.col("below").alias("below")),
        F.struct(F.col("a").alias("a"), (F.col("shorter") - mid).alias("z"), F.least("below", mid).alias("below")),
    )
    out = rows.withColumn("half", F.explode(halves)).select("word", "n", "shorter", "half.a", "half.z", "half.below")
    return out.where("a < below")


def _groups(words: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """``word, n, shorter, a, z, below, key``: every word in the groups where it can meet a near word, none larger than a shard."""
    length = F.char_length("word")
    both = F.filter(F.array(length, length - 1), lambda x: x >= settings.least_length)
    rows = words.withColumn("shorter", F.explode(both)).withColumns({"a": F.lit(0), "z": F.lit(0), "below": F.col("shorter") + 2})
    ends = F.concat_ws("/", "shorter", "below", F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.char_length("word") - F.col("z") + 1, F.col("z")))

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.concat_ws(":", "a", "z", ends))

    done = None
    rows = scratch.put(named(_children(rows)))
    while True:
        large = rows.where("shorter - a - z > 1").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > settings.shard)
        large = scratch.put(large.select("key", F.lit(True).alias("large")))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(large, "key", "left")
        small = scratch.put(marked.where("large is null").drop("large"))
        done = small if done is None else done.unionByName(small)
        rows = scratch.put(named(_children(marked.where("large"))))


def near_words(words: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """``word, n_near, best_n, best``: words with near words, how many, and the commonest of them (ties: smallest)."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    rows = scratch.put(_groups(words, settings, scratch))
    total = rows.count()
    shards = max(1, -(-total // settings.shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "word", "n", "shorter", "a", "z", "below")
    dealt = dealt.repartition(min(shards, 1 << 15), "shard").sortWithinPartitions("shard")
    schema = "word string, n_near long, best_n long, best string"

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        held = dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist()))
        names = sorted(held)
        rank = {w: i for i, w in enumerate(names)}
        counts = np.array([held[w] for w in names], dtype=np.int64)
        index = Index(names)
        word = np.array([rank[w] for w in t.column("word").to_pylist()], dtype=np.int64)
        shorter, a, z, below = (t.column(c).to_numpy().astype(np.int64) for c in ("shorter", "a", "z", "below"))
        for rightward in (True, False):
            own = np.flatnonzero((a >= z) == rightward)
            own = own[np.argsort(index.length[word[own]], kind="stable")]
            for begin in range(0, len(own), settings.queries):
                part = own[begin : begin + settings.queries]
                q, x = index.search(word[part], a[part], z[part], rightward)
                q = part[q]
                same = index.common(word[q], x)
                keep = (np.minimum(index.length[word[q]], index.length[x]) == shorter[q]) & (same >= a[q]) & (same < below[q])
                q, x = q[keep], x[keep]
                order = np.lexsort((x, -counts[x], q))
                q, x = q[order], x[order]
                if not len(q):
                    continue
                heads, at, many = np.unique(q, return_index=True, return_counts=True)
                out = [[names[i] for i in word[heads]], many, counts[x[at]], [names[i] for i in x[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and shard[begin] != now:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                now = shard[begin]
                held.append(b.slice(begin, end - begin))
        if held:
            yield from solve(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last, twice as far each round.

    A form is at least twice as common as its word, so no chain is longer
    than the logarithm of the largest count, nor does one come back.
    """
    now = scratch.put(forms.select("word", F.col("form").alias("root")))
    while True:
        following = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = scratch.put(now.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(now)
        now = ahead
        if now.where("moved").isEmpty():
            return now.drop("moved")


def variants(words: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """Spelling variants of a vocabulary ``word, n``: ``word, form, root, n, n_near, form_n``.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point.  ``form`` is the near word of largest ``n`` (ties:
    smallest in code-point order) if that is at least ``ratio`` times the
    word's own, else null; ``root`` follows forms to the last.  Words are
    taken as they are: null words, words under the least length and words with
    control characters take no part; of a repeated word the counts are added; further columns are
    not read; an empty table gives no row.  A word of any length is searched whole.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    fit = F.col("word").isNotNull() & (F.char_length("word") >= settings.least_length) & ~F.col("word").rlike("[\\x00-\\x1F]")
    words = scratch.put(words.where(fit).groupBy("word").agg(F.sum("n").alias("n")))
    near = words.join(near_words(words, settings, scratch), "word", "left")
    common = F.col("best_n") >= settings.ratio * F.col("n")
    near = scratch.put(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")))
    roots = _roots(near.where("form is not null"), scratch)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """``variants`` of the ``vocabulary`` of all documents."""
    return variants(vocabulary(docs, settings), settings, scratch)
