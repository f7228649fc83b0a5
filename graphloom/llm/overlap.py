"""Records of evaluation splits that training holds too, exactly or almost, by a compressed full-text index.

Each distinct pair of ends is read twice, as (anchor, other): the anchors must be equal, the others equal or one edit apart. Readings are dealt to shards by the hash of
their anchor. Of each evaluation shard two FM-indexes are built, once: of its records, and of its records with `other` turned round (Burrows-Wheeler texts in wavelet matrices:
bits and sampled counts, less than a byte a letter; no suffix positions are kept but the record number at each record's start). All training
readings stream through their shard's indexes by backward search, without any join before it. The anchor is matched exactly, then half of `other` (the last half in the one index, the first
half in the other, as one edit leaves one of them whole), then the search goes on to the maximal match while one edit may branch off at each further
place. The spans both searches give for a pair of records, from its end and from its start, are merged and counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import entity_key
from graphloom.storage import materialize

#: Readings that one index holds, and that one task streams through it, at most (about).
SHARD_PAIRS, STREAM_PAIRS = 60_000, 200_000
#: Patterns searched together.
STEP = 20_000
_END, _BAR = 1, 2
#: 64-bit words between two full counts.
_SUPER = 1024


def _encode(texts: list[str], alphabet: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Codes (3 and up; 0 for characters outside a given alphabet) of all texts joined, and where each begins."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    if alphabet is None:
        alphabet = {int(c): i + 3 for i, c in enumerate(np.unique(points))}
    known = np.array(sorted(alphabet), dtype=np.uint32)
    codes = np.array([alphabet[int(c)] for c in known], dtype=np.int32)
    if not len(known):
        return np.zeros(len(points), np.int32), starts, alphabet
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    return np.where(known[at] == points, codes[at], 0).astype(np.int32), starts, alphabet


class Wavelet:
    """A text in a wavelet matrix: a row of bits for each bit of a code, and counts of ones by word (16 bits) and by _SUPER words (64 bits)."""

    def __init__(self, text: np.ndarray):
        self.depth = max(1, int(text.max(initial=0)).bit_length())
        words = len(text) // 64 + 1
        self.words = np.zeros((self.depth, words), dtype=np.uint64)
        self.near = np.zeros((self.depth, words), dtype=np.uint16)
        self.far = np.zeros((self.depth, words // _SUPER + 1), dtype=np.int64)
        self.zeros = np.zeros(self.depth, dtype=np.int64)
        symbols = np.arange(1 << self.depth)
        start = np.zeros(1 << self.depth, dtype=np.int64)
        for level in range(self.depth):
            bit = (text >> (self.depth - 1 - level)) & 1
            packed = np.packbits(np.concatenate((bit.astype(np.uint8), np.zeros(words * 64 - len(bit), np.uint8))), bitorder="little").view(np.uint64)
            self.words[level] = packed
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))[:-1]
            self.far[level] = ones[:: _SUPER][: self.far.shape[1]] if words % _SUPER else np.append(ones[::_SUPER], ones[-1])
            self.near[level] = ones - self.far[level][np.arange(words) // _SUPER]
            self.zeros[level] = len(bit) - int(bit.sum())
            text = np.concatenate((text[bit == 0], text[bit == 1]))
            up = ((symbols >> (self.depth - 1 - level)) & 1).astype(bool)
            r = self._ones(level, start)
            start = np.where(up, self.zeros[level] + r, start - r)
        self.start = start

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        part = self.words[level][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.far[level][word // _SUPER] + self.near[level][word] + np.bitwise_count(part)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for level in range(self.depth):
            r = self._ones(level, i)
            i = np.where((c >> (self.depth - 1 - level)) & 1, self.zeros[level] + r, i - r)
        return i - self.start[c]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        c = np.zeros(len(i), dtype=np.int64)
        for level in range(self.depth):
            bit = ((self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            r = self._ones(level, i)
            i = np.where(bit, self.zeros[level] + r, i - r)
            c = c << 1 | bit
        return c


class FMIndex:
    """An FM-index of the records `other|anchor` (others possibly turned round by the caller), each framed by an end mark."""

    def __init__(self, anchors: list[str], others: list[str]):
        n = len(anchors)
        parts = [x for pair in zip(others, anchors) for x in pair]
        codes, starts, self.alphabet = _encode(parts, None)
        lengths = np.diff(starts)
        # text: END other BAR anchor END other BAR anchor ... END
        size = int(starts[-1]) + 2 * n + 1
        text = np.empty(size, dtype=np.int32)
        where = np.arange(len(codes)) + np.repeat(np.arange(2 * n) + 1, lengths)
        text[where] = codes
        begins = starts[0:-1:2] + 2 * np.arange(n)
        text[begins] = _END
        text[starts[1::2] + 2 * np.arange(n) + 1] = _BAR
        text[size - 1] = _END
        self.sigma, self.size = int(text.max()) + 1, size
        suffixes = self._sort(text)
        bwt = text[suffixes - 1]
        self.first = np.zeros(self.sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(bwt, minlength=self.sigma), out=self.first[1:])
        record = np.full(size, -1, dtype=np.int32)
        record[begins] = np.arange(n)
        self.record = record[suffixes[self.first[_END] : self.first[_END + 1]]]
        self.bwt = Wavelet(bwt)

    @staticmethod
    def _sort(text: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling."""
        size, rank, k = len(text), text.astype(np.int64), 1
        while True:
            key = rank * (int(rank.max()) + 2)
            key[: size - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(size, dtype=np.int64)
            new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if new.max() == size - 1:
                return order
            rank, k = new, 2 * k

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each match with one more character to its left."""
        return self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by one letter of any kind: (which interval, letter, lo, hi); intervals of one row are read off, others tried by letter."""
        out = [[], [], [], []]
        one = np.flatnonzero(hi - lo == 1)
        if len(one):
            c = self.bwt.at(lo[one])
            one, c = one[c >= 3], c[c >= 3]
            a, b = self.extend(c, lo[one], hi[one])
            for part, x in zip(out, (one, c, a, b)):
                part.append(x)
        many = np.flatnonzero(hi - lo > 1)
        if len(many):
            for c in range(3, self.sigma):
                codes = np.full(len(many), c, dtype=np.int64)
                a, b = self.extend(codes, lo[many], hi[many])
                live = b > a
                for part, x in zip(out, (many[live], codes[live], a[live], b[live])):
                    part.append(x)
        if not out[0]:
            e = np.zeros(0, dtype=np.int64)
            return e, e, e, e
        return tuple(np.concatenate(x) for x in out)

    def find(self, anchors: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The interval of `|anchor` of each anchor, the same for records that are turned round; empty (0, 0) where no record has the anchor."""
        codes, starts, _ = _encode(anchors, self.alphabet)
        size = np.diff(starts)
        out_lo, out_hi = np.zeros(len(anchors), dtype=np.int64), np.zeros(len(anchors), dtype=np.int64)
        p = np.arange(len(anchors))
        lo, hi = np.full(len(p), self.first[_END], dtype=np.int64), np.full(len(p), self.first[_END + 1], dtype=np.int64)
        j = 0
        while len(p):
            over = size[p] == j
            c = np.full(len(p), _BAR, dtype=np.int64)
            c[~over] = codes[starts[p[~over]] + size[p[~over]] - 1 - j]
            lo, hi = self.extend(c, lo, hi)
            live = (hi > lo) & (c > 0)
            out_lo[p[live & over]], out_hi[p[live & over]] = lo[live & over], hi[live & over]
            p, lo, hi = p[live & ~over], lo[live & ~over], hi[live & ~over]
            j += 1
        return out_lo, out_hi

    def search(self, lo: np.ndarray, hi: np.ndarray, others: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, record, edits, span) of the records in the intervals of anchors that equal `other` but for at most one edit, none of it among its last `exact` characters.

        `span`: the characters from the end up to the edit, or all.
        """
        codes, starts, _ = _encode(others, self.alphabet)
        at, n = starts[:-1], np.diff(starts)
        p = np.flatnonzero(hi > lo)
        lo, hi = lo[p], hi[p]
        hits = [[], [], [], []]

        def step(c, lo, hi, *more):
            lo, hi = self.extend(np.maximum(c, 0), lo, hi)
            keep = (hi > lo) & (c > 0)
            return (lo[keep], hi[keep], *(x[keep] for x in more))

        def finish(p, lo, hi, edits, span):
            lo, hi, p, span = step(np.full(len(p), _END, dtype=np.int64), lo, hi, p, span)
            width = hi - lo
            row = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
            for part, x in zip(hits, (np.repeat(p, width), self.record[row - self.first[_END]], np.full(len(row), edits, dtype=np.int8), np.repeat(span, width))):
                part.append(x)

        # p, lo, hi: patterns without an edit so far, all of whose last j characters are matched; e...: with one, after es matched characters and eu used.
        none = np.zeros(0, dtype=np.int64)
        ep, eu, es, elo, ehi = none, none, none, none, none
        j = 0
        while len(p) or len(ep):
            if len(p):
                free = exact[p] <= j
                if free.any():
                    fp, flo, fhi = p[free], lo[free], hi[free]
                    inside = n[fp] > j
                    new = [(fp[inside], np.full(int(inside.sum()), j + 1), flo[inside], fhi[inside])]  # the pattern has a character more
                    pairs, back = np.unique(flo * (self.size + 1) + fhi, return_inverse=True)
                    which, letter, clo, chi = self.children(pairs // (self.size + 1), pairs % (self.size + 1))
                    order = np.argsort(which, kind="stable")
                    letter, clo, chi = letter[order], clo[order], chi[order]
                    count = np.bincount(which, minlength=len(pairs))
                    width = count[back]
                    row = np.repeat(np.arange(len(fp)), width)
                    child = np.repeat((np.cumsum(count) - count)[back] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                    new.append((fp[row], np.full(len(row), j), clo[child], chi[child]))  # the record has a character more
                    can = n[fp[row]] > j
                    row, child = row[can], child[can]
                    differs = letter[child] != codes[at[fp[row]] + n[fp[row]] - 1 - j]
                    row, child = row[differs], child[differs]
                    new.append((fp[row], np.full(len(row), j + 1), clo[child], chi[child]))  # one character in place of another
                    added = sum(len(x[0]) for x in new)
                    ep, eu, elo, ehi = (np.concatenate(x) for x in zip((ep, eu, elo, ehi), *new))
                    es = np.concatenate((es, np.full(added, j)))
                over = n[p] == j
                finish(p[over], lo[over], hi[over], 0, n[p[over]])
                p, lo, hi = p[~over], lo[~over], hi[~over]
                lo, hi, p = step(codes[at[p] + n[p] - 1 - j].astype(np.int64), lo, hi, p)
            if len(ep):
                over = n[ep] <= eu
                finish(ep[over], elo[over], ehi[over], 1, es[over])
                ep, eu, es, elo, ehi = (x[~over] for x in (ep, eu, es, elo, ehi))
                elo, ehi, ep, eu, es = step(codes[at[ep] + n[ep] - 1 - eu].astype(np.int64), elo, ehi, ep, eu, es)
                eu = eu + 1
            j += 1
        return tuple(np.concatenate(x) if x else none for x in hits)


class ShardIndex:
    """The evaluation readings of a shard, indexed from both sides."""

    def __init__(self, anchors: list[str], others: list[str]):
        self.anchors, self.others = np.array(anchors, dtype=object), np.array(others, dtype=object)
        self.forward, self.turned = FMIndex(anchors, others), FMIndex(anchors, [x[::-1] for x in others])

    def stream(self, anchors: pd.Series, others: pd.Series) -> pd.DataFrame:
        """Rows (anchor, eval_other, train_other, edits, prefix, suffix) of training readings; prefix, suffix: the spans from either side that are equal."""
        which, names = pd.factorize(anchors)
        lo, hi = self.forward.find(names.tolist())
        lo, hi = lo[which], hi[which]
        live = np.flatnonzero(hi > lo)
        mine = others.to_numpy()[live]
        size = np.array([len(x) for x in mine], dtype=np.int64)
        half = size // 2
        a = self.forward.search(lo[live], hi[live], mine.tolist(), size - half)
        b = self.turned.search(lo[live], hi[live], [x[::-1] for x in mine], half)
        p, r, e, span = (np.concatenate(x) for x in zip(a, b))
        side = np.repeat([0, 1], [len(a[0]), len(b[0])])
        order = np.lexsort((e, r, p))
        p, r, e, span, side = p[order], r[order], e[order], span[order], side[order]
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])))) if len(p) else np.zeros(0, np.int64)
        longest = lambda s: np.maximum.reduceat(np.where(side == s, span, 0), first) if len(p) else np.zeros(0, np.int64)
        suffix, prefix = longest(0), longest(1)
        p, r, e = p[first], r[first], e[first]
        return pd.DataFrame({"anchor": self.anchors[r], "eval_other": self.others[r], "train_other": mine[p], "edits": e.astype(np.int32), "prefix": prefix.astype(np.int64), "suffix": suffix.astype(np.int64)})


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "block": pdf["block"].iloc[:1], "data": [pickle.dumps(ShardIndex(pdf["anchor"].tolist(), pdf["other"].tolist()), 5)]})


_HITS = "anchor string, eval_other string, train_other string, edits int, prefix bigint, suffix bigint"


def _stream(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The training readings on the right through the one index on the left."""
    if not len(left) or not len(right):
        return pd.DataFrame({"anchor": pd.Series(dtype=object), "eval_other": pd.Series(dtype=object), "train_other": pd.Series(dtype=object), **{c: np.zeros(0, np.int64) for c in ("edits", "prefix", "suffix")}})
    index = pickle.loads(left["data"].iloc[0])
    return pd.concat([index.stream(right["anchor"].iloc[i : i + STEP], right["other"].iloc[i : i + STEP]) for i in range(0, len(right), STEP)])


def _readings(pairs: DataFrame) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.col("a").alias("anchor"), F.col("b").alias("other")), F.struct(F.col("b").alias("anchor"), F.col("a").alias("other"))))
    return pairs.select(sides.alias("x")).select("x.anchor", "x.other").distinct()


def near_pairs(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(ea, eb, ta, tb, edits, prefix, suffix): each distinct evaluation pair (ea <= eb) with each distinct training pair (ta <= tb) that equals it or has one
    end equal and the other within one edit; prefix, suffix: its equal characters from the start and from the end, as far as the searches went. Both inputs have columns a <= b without nulls.

    A shard with more readings than SHARD_PAIRS has several indexes, dealt by the hash of `other`; all its training readings stream through each of them,
    in as many tasks as STREAM_PAIRS asks for.
    """
    ev, tr = materialize(_readings(evaluation)), materialize(_readings(training))
    n, m = ev.count(), tr.count()
    shards = max(1, -(-n // SHARD_PAIRS), min(2 * evaluation.sparkSession.sparkContext.defaultParallelism, n // 2000 + 1, m // 2000 + 1))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    ev, tr = ev.withColumn("shard", shard), tr.withColumn("shard", shard)
    held = ev.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_PAIRS).cast("int").alias("blocks"))
    grid = held.join(tr.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAM_PAIRS).cast("int").alias("streams")), "shard")
    grid = materialize(grid)  # a row a shard: n / SHARD_PAIRS or 2 x cores
    hashed = F.xxhash64(F.lit(1), "other")
    index = ev.join(grid, "shard").select("anchor", "other", "shard", F.pmod(hashed, F.col("blocks")).cast("int").alias("block")).groupBy("shard", "block").applyInPandas(_index, "shard int, block int, data binary")
    index = materialize(index).join(grid, "shard").select("shard", "block", "data", F.explode(F.expr("sequence(0, streams - 1)")).alias("stream"))
    asked = tr.join(grid, "shard").select(
        "anchor", "other", F.col("shard").alias("to"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("to_block"), F.pmod(hashed, F.col("streams")).cast("int").alias("to_stream")
    )
    hits = index.groupBy("shard", "block", "stream").cogroup(asked.groupBy("to", "to_block", "to_stream")).applyInPandas(_stream, _HITS)
    return (
        hits.select(
            F.least("anchor", "eval_other").alias("ea"), F.greatest("anchor", "eval_other").alias("eb"), F.least("anchor", "train_other").alias("ta"), F.greatest("anchor", "train_other").alias("tb"), "edits", "prefix", "suffix"
        )
        .groupBy("ea", "eb", "ta", "tb")
        .agg(F.min("edits").alias("edits"), F.max("prefix").alias("prefix"), F.max("suffix").alias("suffix"))
    )


def _split(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _sides(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = edges.select(
        "interaction_id", entity_key(F.col("source_id")).alias("s"), entity_key(F.col("target_id")).alias("t"), _split(F.col("split_name")).alias("split_name"), _split(F.col("source_dataset")).alias("source_dataset")
    ).where("s is not null and t is not null and split_name in ('train', 'valid', 'test')")
    rows = materialize(rows.select("interaction_id", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "split_name", "source_dataset"))
    return rows.where("split_name <> 'train'"), rows.where("split_name = 'train'")


def overlaps(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched pairs of ends, evaluation rows, training rows), the base of `found` and `report`.

    Rows with a null or blank end or split take no part; repeated rows and ties count as one pair of ends. Empty tables give empty results.
    """
    held, train = _sides(edges)
    distinct = lambda df: df.select("a", "b").distinct()
    return materialize(near_pairs(distinct(held), distinct(train))), held, train


def found(edges: DataFrame) -> DataFrame:
    """`id_a` < `id_b`: an evaluation and a training interaction whose ends are equal, or have one end equal and the other within one edit."""
    hits, held, train = overlaps(edges)
    wide = hits.join(held.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("interaction_id").alias("e")), ["ea", "eb"])
    wide = wide.join(train.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("interaction_id").alias("t")), ["ta", "tb"])
    return wide.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def report(edges: DataFrame) -> DataFrame:
    """By evaluation `split_name` and `source_dataset`: `n_rows` with usable ends, `n_exact` and `n_near` of them that training holds exactly, or only almost."""
    hits, held, _ = overlaps(edges)
    best = hits.groupBy(F.col("ea").alias("a"), F.col("eb").alias("b")).agg(F.min("edits").alias("edits"))
    return held.join(best, ["a", "b"], "left").groupBy("split_name", "source_dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("edits") == 0, 1)).alias("n_exact"), F.count(F.when(F.col("edits") == 1, 1)).alias("n_near")
    )
