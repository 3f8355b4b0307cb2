"""Exact Jaccard join of shingle sets with token-combination prefixes.

Tokens (hashes of word n-grams) are ordered by document frequency, rare ones first. Two sets that are similar enough
differ in at most e(n) tokens of either, n being its size; so, of a prefix that would need more than e(n) differences to have nothing in
common, something is. Rare tokens are indexed alone. Frequent tokens are dealt into classes and indexed by pairs of one
class: a class of c tokens has no pair in common only if c - 1 tokens differ, so the prefix is extended until the
classes' c - 1 and the rare tokens add up to e(n) + 1. Few sets share a pair of frequent tokens, so lists stay short.

Frequencies are counted over all tokens of all sets, packed into blocks whose number follows from the number of tokens. A token
of frequency 1 can't be shared; a set that has more than e(n) of those is similar to nothing and leaves at once. What would
gather in one block is dealt apart: tokens that very many sets have are counted by slices first and go straight to their
sets, and of sets with very many copies one copy stands for all.

Equal sets are one node, named by 64 bits of a hash; where the other 64 bits differ, the name is made anew from both.
In a long list each set is compared with the most central one first; what that links
needs no more comparison among itself; of the rest, most pairs can't be similar by their sizes, their numbers of tokens that any other
set has, or by the triangle inequality of the Jaccard distance. What is left of lists with one center is compared as a whole where that is less
than list by list: near copies of one text share many lists. Tiles of sets are counted as matrices, so no pair is ever a row. Where
very much is left, prefixes are extended by one more token, so that similar sets have two keys in common, and sets meet by pairs of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import _hashing as H
from ledgerline.llm._common import many_to_one, whole_row, written
from ledgerline.llm.components import components

#: A token in more sets than this is frequent.
FREQUENT = 256
#: Lists up to this length are compared pair by pair.
SHORT = 24
#: A class of frequent tokens for so many tokens of a set.
PER_CLASS = 16
#: Tokens of a block, about.
BLOCK_TOKENS = 4_000_000
#: A token that so many sets of a slice have is counted apart; it is hot if its counts come to HOT, or to a millionth of all tokens.
OFTEN, HOT, HOT_SHARE = 4, 10_000, 1_000_000
#: A set has many copies from so many on, or from a hundred-thousandth of all rows.
COPIES, COPIES_SHARE = 1_000, 100_000
#: Lists are joined by broadcast from so many members on, or from a hundred-thousandth of all keys; their rests are dealt into parts of so many.
HOT_LIST, HOT_LIST_SHARE, TILE = 20_000, 100_000, 20_000
#: What is left is compared in tiles of so many sets and tokens at most, about, and so many pairs at once.
NEAR_TILE, NEAR_TOKENS, NEAR_PAIRS = 4_000, 2_000_000, 4_000_000
#: A list whose rest would make more pairs than this is gone through by pairs of keys.
FAR_PAIRS = 1_000_000_000
#: Bits of a set's first name.
NAME_BITS = 64


def _sets(batch: pa.RecordBatch, text: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles of a text, text after text (each sorted), and where each text's begin."""
    words, starts = H.split_words(batch.column(text), lower=True)
    h = H.word_hashes(words)
    tokens, n = np.zeros(len(h), np.uint64), np.diff(starts)
    grams = H.run_hashes(h, size)
    tokens[: len(grams)] = grams
    whole = n >= size
    for a, b in zip(starts[:-1][whole].tolist(), starts[1:][whole].tolist(), strict=True):
        tokens[a : b - size + 1].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[(starts[1:][whole][:, None] - np.arange(1, size)).ravel()] = False  # no shingle begins there
    for a, b in zip(starts[:-1][(n > 0) & ~whole].tolist(), starts[1:][(n > 0) & ~whole].tolist(), strict=True):
        # a sequence too short for a shingle is one of its own; its length keeps it apart
        tokens[a], keep[a:b] = H.run_hashes(h[a:b], b - a)[0] + np.uint64(b - a), False
    keep[starts[:-1][n > 0]] = True
    return tokens[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _digests(tokens: np.ndarray, starts: np.ndarray, factor: int = H.FACTORS[1]) -> np.ndarray:
    """A hash of each set, 0 where it is empty."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(H.mixed(tokens ^ np.uint64(factor)), dtype=np.uint64)])
    n = np.diff(starts).astype(np.uint64)
    out = H.mixed((sums[starts[1:]] - sums[starts[:-1]]) * np.uint64(H.FACTORS[0]) + n)
    return np.where(n > 0, np.where(out == 0, np.uint64(1), out), np.uint64(0))


def _named(sigs: np.ndarray, checks: np.ndarray, renamed: list[np.ndarray], bits: int) -> np.ndarray:
    """The names of sets: the first hash, mixed with the second for names that two different sets would have."""
    if bits < 64:
        sigs = np.where(sigs > 0, (sigs >> np.uint64(64 - bits)) + np.uint64(1), sigs)
    for names in renamed:
        mixed = H.mixed(sigs ^ H.mixed(checks))
        sigs = np.where(np.isin(sigs, names), np.where(mixed == 0, np.uint64(1), mixed), sigs)
    return sigs


def _described(size: int):
    """(id, text_hash, n_shingles, sig, check, often) of batches (id, text, text_hash); ``often``, once a slice: tokens that OFTEN sets of it have, and their counts."""
    often, bits = OFTEN, NAME_BITS

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.parts(batches, 1):
            tokens, starts = _sets(batch, 1, size)
            sigs, checks, n = _digests(tokens, starts), _digests(tokens, starts, H.FACTORS[0] ^ H.FACTORS[1]), np.diff(starts)
            many = [None] * len(batch)
            if len(batch) >= often:
                values, counts = np.unique(tokens[np.repeat(_first(sigs), n)], return_counts=True)
                if (counts >= often).any():
                    many[0] = values[counts >= often].tobytes() + counts[counts >= often].astype("<u8").tobytes()
            sigs = _named(sigs, checks, [], bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sigs.view(np.int64), pa.int64()), pa.array(checks.view(np.int64), pa.int64()), pa.array(many, pa.binary())], ["id", "text_hash", "n_shingles", "sig", "check", "often"])

    return found


def _first(sigs: np.ndarray) -> np.ndarray:
    """Whether a set is the first of its copies in a slice."""
    out = np.zeros(len(sigs), bool)
    out[np.unique(sigs, return_index=True)[1]] = True
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of batches (often)."""
    for batch in batches:
        pairs = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in batch.column(0)]
        if pairs:
            both = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["token", "n"])


def _renamed(renamed: list[np.ndarray]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, checks = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_named(sigs, checks, renamed[-1:], 64).view(np.int64), pa.int64()), batch.column(4)], schema=batch.schema)

    return found


def _packed(tokens: np.ndarray) -> np.ndarray:
    """The lower 48 bits of each, a row each; the block they are in stands for the upper ones."""
    return np.ascontiguousarray(tokens.view("<u2").reshape(-1, 4)[:, :3])


def _unpacked(raw: bytes, block: int) -> np.ndarray:
    out = np.full((len(raw) // 6, 4), block & 0xFFFF, "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view(np.uint64).ravel()


class Apart(NamedTuple):
    """What is dealt apart: hot tokens (sorted) with their counts, the names of sets with many copies, names that were made anew."""

    hot: np.ndarray
    counts: np.ndarray
    copied: np.ndarray
    renamed: list[np.ndarray]


def _in_blocks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by block, stable, and where each block begins in it."""
    block = (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.uint16 if blocks <= 1 << 16 else np.uint32)
    return np.argsort(block, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])


def _dealt(size: int, blocks: int, back: int, least: int, apart: Apart, copied: bool):
    """All tokens, dealt by hash into blocks: (block, sigs, sizes, owner of each token, tokens), of batches (id, text).

    Hot tokens, as numbers in their list, go to blocks after the others, by set. Sets with many copies are left out, or (``copied``) all others.
    """
    bits = NAME_BITS

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.parts(batches, 1):
            tokens, starts = _sets(batch, 1, size)
            sigs, n = _digests(tokens, starts), np.diff(starts)
            once = _first(sigs)  # copies within a slice count once anyway
            sigs = _named(sigs, _digests(tokens, starts, H.FACTORS[0] ^ H.FACTORS[1]) if apart.renamed else sigs, apart.renamed, bits)
            if len(apart.copied):
                once &= np.isin(sigs, apart.copied) == copied
            keep = np.repeat(once & (n >= least), n)
            owner, tokens = np.repeat(np.arange(len(n), dtype=np.uint16 if len(n) < 1 << 16 else np.uint32), n)[keep], tokens[keep]
            rows = []

            def add(first: int, own: np.ndarray, order: np.ndarray, ends: np.ndarray, packed: np.ndarray) -> None:
                # in a block tokens stay in the order of their sets: each change is a new one
                here = np.flatnonzero(np.diff(ends))
                own = own[order]
                new = np.ones(len(own), bool)
                new[1:] = own[1:] != own[:-1]
                new[ends[here]] = True
                rank = np.cumsum(new) - 1
                sets = own[new]
                names, sizes = sigs[sets], n[sets].astype("<u4")
                for b, i, j in zip(here.tolist(), ends[here].tolist(), ends[here + 1].tolist(), strict=True):
                    p, q = rank[i], rank[j - 1] + 1
                    rows.append((first + b, names[p:q].tobytes(), sizes[p:q].tobytes(), (rank[i:j] - p).astype("<u2" if q - p < 1 << 16 else "<u4").tobytes(), packed[i:j].tobytes()))  # noqa: B023

            if len(apart.hot):
                at = np.minimum(np.searchsorted(apart.hot, tokens), len(apart.hot) - 1)
                is_hot = apart.hot[at] == tokens
                if is_hot.any():
                    own, at = owner[is_hot], at[is_hot].astype("<u4")
                    order, ends = _in_blocks(sigs[own], back)
                    add(blocks, own, order, ends, at[order])
                    owner, tokens = owner[~is_hot], tokens[~is_hot]
            order, ends = _in_blocks(tokens, blocks)
            add(0, owner, order, ends, _packed(tokens[order]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "sigs", "sizes", "owner", "tokens"])

    return found


DEALT = "block int, sigs binary, sizes binary, owner binary, tokens binary"
COUNTED = "block int, sigs binary, sizes binary, tokens binary, frequency binary"


def _shared(blocks: int, back: int, apart: Apart):
    """Of one block's tokens those that two sets or more have, with their frequency, dealt by set."""

    def found(table: pa.Table) -> pa.Table:
        sigs, sizes, tokens = [], [], []
        hot = table.column("block")[0].as_py() >= blocks
        for row in table.to_pylist():
            s, n = np.frombuffer(row["sigs"], np.uint64), np.frombuffer(row["sizes"], "<u4")
            o = np.frombuffer(row["owner"], "<u2" if len(s) < 1 << 16 else "<u4")
            sigs.append(s[o])
            sizes.append(n[o])
            tokens.append(np.frombuffer(row["tokens"], "<u4") if hot else _unpacked(row["tokens"], row["block"]))
        tokens, sigs, sizes = np.concatenate(tokens), np.concatenate(sigs), np.concatenate(sizes)
        if not hot:
            order = np.argsort(tokens)
            t = tokens[order]
            same = t[1:] == t[:-1]
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
        order = np.lexsort((sigs, tokens))
        tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
        tokens, sigs, sizes = tokens[new], sigs[new], sizes[new]
        if hot:
            tokens, often = apart.hot[tokens], apart.counts[tokens]
        else:
            _, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            often = counts[which]
            tokens, sigs, sizes, often = (x[often > 1] for x in (tokens, sigs, sizes, often))
        order, ends = _in_blocks(sigs, back)
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            part = order[ends[b] : ends[b + 1]]
            rows.append((int(b), sigs[part].tobytes(), sizes[part].astype("<u4").tobytes(), tokens[part].tobytes(), np.minimum(often[part], 0xFFFFFFFF).astype("<u4").tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), *[pa.binary()] * 4))], ["block", "sigs", "sizes", "tokens", "frequency"])

    return found


def allowed(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-percent * n // 100)


def prefix_keys(tokens: np.ndarray, frequency: np.ndarray, n: int, percent: int, frequent: int = FREQUENT, extra: int = 0) -> tuple[np.ndarray, bool]:
    """The index keys of a set of n tokens, of which ``tokens`` are shared (in order: frequency, then hash).

    Similar sets have a key in common. With the prefix extended by ``extra``, they have 1 + ``extra`` if both have tokens enough, which
    the second value tells: each key that they have in common makes up for one token that they lack at most.
    """
    need = allowed(n, percent) + 1 + extra - (n - len(tokens))
    rare = tokens[: np.searchsorted(frequency, frequent, "right")][:need]
    keys = [H.mixed(rare)]
    need -= len(rare)
    whole = True
    if need > 0:
        common = tokens[np.searchsorted(frequency, frequent, "right") :]
        for classes in {1 << max(0, (m // PER_CLASS).bit_length() - 1) for m in (n, -(-percent * n // 100))}:
            cls = (common >> np.uint64(7)) % np.uint64(classes)
            seen = np.zeros(classes, bool)
            gain = np.zeros(len(common), np.int64)
            for i, c in enumerate(cls.tolist()):
                gain[i] = seen[c]
                seen[c] = True
            end = int(np.searchsorted(np.cumsum(gain), need)) + 1
            whole &= end <= len(common)
            for c in np.unique(cls[:end]):
                own = np.sort(common[:end][cls[:end] == c])
                i, j = np.triu_indices(len(own), 1)
                keys.append(H.mixed(H.mixed(own[i]) * np.uint64(3) + own[j] + np.uint64(classes)))
    return np.unique(np.concatenate(keys)), whole


#: Parts into which a set's shared tokens are counted, to bound how many two sets have in common.
PARTS = 64
VIABLE = "sig long, n int, lacking double, tokens array<long>, counts array<int>, keys array<long>, more array<long>, strong boolean"


def _viable(percent: int):
    """Of one block's sets those that can be similar to another: (sig, n, share of unshared tokens, shared tokens, their number in each part, keys, those of the longer prefix, whether two of all these are shared)."""
    frequent = FREQUENT

    def found(table: pa.Table) -> pa.Table:
        sigs, n, tokens, often = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("sigs", np.uint64), ("sizes", "<u4"), ("tokens", np.uint64), ("frequency", "<u4")))
        order = np.lexsort((tokens, often, sigs))
        sigs, n, tokens, often = sigs[order], n[order], tokens[order], often[order]
        starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(sigs)], strict=True):
            size = int(n[a])
            if size - (b - a) <= allowed(size, percent):
                keys, _ = prefix_keys(tokens[a:b], often[a:b], size, percent, frequent)
                two, strong = prefix_keys(tokens[a:b], often[a:b], size, percent, frequent, 1)
                parts = np.bincount((tokens[a:b] >> np.uint64(13)).astype(np.int64) % PARTS, minlength=PARTS)
                rows.append((int(sigs[a : a + 1].view(np.int64)[0]), size, (size - int(b - a)) / size, np.sort(tokens[a:b].view(np.int64)), parts, keys.view(np.int64), np.setdiff1d(two, keys).view(np.int64), strong))
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["sig", "n", "lacking", "tokens", "counts", "keys", "more", "strong"])

    return found


def _possible(n: Column, shared: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can be similar when so many of them are shared with any set at all."""
    most = F.least(shared, other)
    return 100 * most >= percent * (n + m - most)


def _overlapping(percent: int) -> Column:
    """Whether the sums of the smaller counts, part by part, allow two sets to be similar."""
    most = F.aggregate(F.zip_with("counts", "x_counts", lambda a, b: F.least(a, b)), F.lit(0), lambda a, c: a + c)
    return 100 * most >= percent * (F.col("n") + F.col("x_n") - most)


def _band(n: Column, percent: int) -> Column:
    """A number for sizes, by which those of similar sets differ by 1 at most."""
    return F.floor(F.log(n) / F.lit(log(100 / min(percent, 99)) + 1e-9)).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, far, linked): the Jaccard distance of each pair, from the shared tokens and the sizes."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("i"))
    union = F.col("na") + F.col("nb") - F.col("i")
    return both.select("a", "b", (1 - F.col("i") / union).alias("far"), (100 * F.col("i") >= percent * union).alias("linked"))


def _in_common(xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many tokens each x has in common with each y, some x at a time: (the first one's place, a row for each).

    Tokens that many of both sides have are counted by matrix products, the others pair by pair.
    """
    sizes = np.array([len(t) for t in (*xs, *ys)])
    owner, (values, token) = np.repeat(np.arange(len(sizes)), sizes), np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    is_x = owner < len(xs)
    n_x, n_y = (np.bincount(token[side], minlength=len(values)) for side in (is_x, ~is_x))
    work = n_x * n_y
    dense = np.flatnonzero(work * 128 > len(xs) * len(ys))
    column = np.full(len(values), -1)
    column[dense] = np.arange(len(dense))
    rare = is_x & (work > 0)[token] & (column < 0)[token]
    rare_x, rare_token = owner[rare], token[rare]
    order = np.argsort(token[~is_x], kind="stable")
    holders, begin = owner[~is_x][order] - len(xs), np.concatenate([[0], np.cumsum(n_y)])
    common = np.flatnonzero(column[token] >= 0)
    common = common[np.argsort(column[token[common]], kind="stable")]
    own, at = owner[common], column[token[common]]
    for first in range(0, len(xs), step := max(1, NEAR_PAIRS // len(ys))):
        last = min(len(xs), first + step)
        out = np.zeros((last - first, len(ys)), np.float32)
        for c in range(0, len(dense), 512):
            rows, columns = (v[slice(*np.searchsorted(at, [c, c + 512]))] for v in (own, at))
            left, right = (np.zeros((n, min(512, len(dense) - c)), np.float32) for n in (last - first, len(ys)))
            for side, here, base in ((left, (rows >= first) & (rows < last), first), (right, rows >= len(xs), len(xs))):
                side[rows[here] - base, columns[here] - c] = 1
            out += left @ right.T
        a, b = np.searchsorted(rare_x, [first, last])
        pairs = np.concatenate([[0], np.cumsum(n_y[rare_token[a:b]])])
        while pairs[-1] > pairs[0]:  # so many tokens that they make NEAR_PAIRS pairs, or one token's
            k = max(1, int(np.searchsorted(pairs, pairs[0] + NEAR_PAIRS, "right")) - 1)
            t, n = rare_token[a : a + k], n_y[rare_token[a : a + k]]
            y = holders[np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            np.add.at(out, (np.repeat(rare_x[a : a + k] - first, n), y), 1)
            a, pairs = a + k, pairs[k:]
        yield first, out


def _near(percent: int):
    """(a, b) of links between one tile's sets outside their list's main component (``outside``) and its others; of each set one to each component."""

    def found(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy()
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        links = []
        if len(x) and len(y):
            sig, n, root, main = (table.column(c).to_numpy() for c in ("sig", "n", "root", "in_main"))
            tokens = table.column("tokens").combine_chunks()
            flat, ends = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(tokens))])
            sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for first, common in _in_common([sets[i] for i in x], [sets[i] for i in y]):
                own = x[first : first + len(common)]
                least = -(-percent * (n[own].astype(np.int64)[:, None] + n[y]) // (100 + percent))
                linked = (common >= least) & (root[own][:, None] != root[y]) & (main[y] | (sig[y] > sig[own][:, None]))
                for i in np.flatnonzero(linked.any(axis=1)):
                    to = y[linked[i]]
                    links += [(min(int(sig[own[i]]), int(sig[j])), max(int(sig[own[i]]), int(sig[j]))) for j in to[np.unique(root[to], return_index=True)[1]]]
        return pa.Table.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return found


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links between viable sets; enough of them that every linked pair is in one component."""
    listed = written(sets.select("sig", "n", F.size("tokens").alias("s"), "lacking", F.explode("keys").alias("key")), "keys")
    lists = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("lacking", "sig", "n", "s")).alias("c")).where("size > 1")
    lists = written(lists.select("key", "size", F.col("c.sig").alias("center"), F.col("c.n").alias("center_n"), F.col("c.s").alias("center_s")), "lists")

    short = listed.join(lists.where(F.col("size") <= SHORT).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("sig", "n", "s")).alias("m"))
    met = short.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["sig"] > x["sig"]) & _possible(x["n"], x["s"], y["n"], y["s"], percent)), lambda y: F.struct(x["sig"].alias("a"), y["sig"].alias("b")))))).alias("p")).select("p.a", "p.b")
    # so few lists can be so long that these are broadcast: no task gets all members of one
    hot = max(HOT_LIST, listed.count() // HOT_LIST_SHARE)
    centers = lists.where(F.col("size") > SHORT).select("key", "size", "center", "center_n", "center_s")
    long = listed.join(F.broadcast(centers.where(F.col("size") > hot)), "key").union(listed.join(centers.where(F.col("size") <= hot), "key")).where("sig <> center")
    starred = long.where(_possible(F.col("n"), F.col("s"), F.col("center_n"), F.col("center_s"), percent)).select(F.least("sig", "center").alias("a"), F.greatest("sig", "center").alias("b"))
    first = written(_verified(met.union(starred).distinct(), sets, percent), "verified")
    links = first.where("linked").select("a", "b")
    if not lists.where(F.col("size") > SHORT).head(1):
        return links

    # what is left of long lists: sets that are not yet in one component and not too far apart by their distances to the center
    roots = written(components(links), "roots")
    far = first.select(F.col("a").alias("sig"), F.col("b").alias("center"), "far").union(first.select("b", "a", "far"))
    members = long.select("key", "sig", "n", "s", "center").union(centers.select("key", F.col("center").alias("sig"), F.col("center_n").alias("n"), F.col("center_s").alias("s"), "center"))
    members = members.join(far, ["sig", "center"], "left").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    members = written(members.select("key", "center", "sig", "n", "s", F.when(F.col("sig") == F.col("center"), F.lit(0.0)).otherwise(F.col("far")).alias("far"), F.coalesce("root", "sig").alias("root")), "members")
    split = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("far") == 0, F.col("root"))).alias("main"), F.count(F.lit(1)).alias("size")).where("low <> high")
    split = written(split.select("key", "main", "size", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "split-lists")

    def by_lists(rows: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(marks.where(F.col("size") > hot)), "key", how).union(rows.join(marks.where(F.col("size") <= hot), "key", how))

    # one side: the sets outside the component of the list's center, which is mostly the largest
    left = by_lists(members, split).select("key", "center", "sig", "n", "s", "far", "root", (F.col("root") == F.col("main")).alias("in_main"), "tiles", _band(F.col("n"), percent).alias("band"))
    left = written(left, "left")

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        out = F.when(~F.col("in_main"), F.col("s")).otherwise(0)
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("in_main")).alias("outside"), F.sum("s").alias("tokens"), F.sum(out).alias("out_tokens"))

    # lists with one center are compared as a whole where that makes fewer pairs: near copies of one text share many lists
    lists_left = written(sums(left, "key", "center"), "loads")
    whole = sums(left.select("center", "sig", "s", "in_main").distinct(), "center").select("center", *(F.col(c).alias(f"w_{c}") for c in ("size", "outside", "tokens", "out_tokens")))
    whole = whole.join(lists_left.groupBy("center").agg(F.sum(F.col("size") * F.col("outside")).alias("pairs")), "center")
    loads = lists_left.join(whole, "center").withColumn("together", F.col("w_size") * F.col("w_outside") <= F.col("pairs"))
    of = lambda c: F.when(F.col("together"), F.col(f"w_{c}")).otherwise(F.col(c))
    tiles = lambda n, t: F.greatest(F.lit(1), F.ceil(of(n) / NEAR_TILE), F.ceil(of(t) / NEAR_TOKENS)).cast("int")
    loads = loads.select("key", "size", F.when(F.col("together"), F.col("center")).otherwise(F.col("key")).alias("group"), "together", (of("size") * of("outside")).alias("pairs"), tiles("outside", "out_tokens").alias("x_tiles"), tiles("size", "tokens").alias("y_tiles"))
    loads = written(loads, "groups")
    heavy = written(loads.where(F.col("pairs") > FAR_PAIRS).select("key", "size"), "heavy-lists")

    # similar sets are of one band of sizes or of neighbouring ones; a group's two sides are dealt into tiles, each of which meets each
    near = by_lists(left.select("key", "sig", "n", "root", "in_main", "band"), loads.where(F.col("pairs") <= FAR_PAIRS))
    near = written(near.select("group", "together", "x_tiles", "y_tiles", "sig", "n", "root", "in_main", "band").distinct(), "near")
    tile = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    y = near.select("group", "together", each("x_tiles").alias("x"), tile("y_tiles").alias("y"), "band", F.lit(False).alias("outside"), "sig", "n", "root", "in_main")
    x = near.where("NOT in_main").select("group", "together", tile("x_tiles").alias("x"), each("y_tiles").alias("y"), "band", F.lit(True).alias("outside"), "sig", "n", "root", "in_main")
    x = x.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    close = x.union(y).join(sets.select("sig", "tokens"), "sig").groupBy("group", "together", "x", "y", "band").applyInArrow(_near(percent), "a long, b long")
    links = links.union(close)
    if not heavy.head(1):
        return links

    # in a list with very many left, sets meet only where they share another key, too; those that can't promise one meet all
    left = by_lists(left, heavy, "left_semi").join(sets.select("sig", "counts", "strong"), "sig")
    left = left.withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    limit = (100 - percent) / 100 + 1e-9

    def meet(rows: DataFrame, others: DataFrame, *on: str) -> DataFrame:
        """Pairs of which the first is outside the center's component, by lists; what can't be similar by any bound is left out."""
        x = rows.where("NOT in_main").select(*on, *(F.col(c).alias(f"x_{c}") for c in ("sig", "n", "s", "far", "root", "counts")), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "band")
        x = x.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
        near = F.col("far").isNull() | F.col("x_far").isNull() | (F.abs(F.col("far") - F.col("x_far")) <= limit)
        other = (F.col("root") != F.col("x_root")) & (F.col("in_main") | (F.col("sig") > F.col("x_sig")))
        pairs = x.join(others, [*on, "tile", "band"]).where(_possible(F.col("n"), F.col("s"), F.col("x_n"), F.col("x_s"), percent) & other & near & _overlapping(percent))
        return pairs.select(F.least("sig", "x_sig").alias("a"), F.greatest("sig", "x_sig").alias("b"))

    strong, weak = left.where("strong"), left.where("NOT strong")
    second = sets.select("sig", F.explode(F.concat("keys", "more")).alias("second"))
    dealt = strong.join(second, "sig").where(F.col("second") != F.col("key"))
    met = meet(dealt, dealt, "key", "second").union(meet(weak, left, "key")).union(meet(strong, weak, "key"))
    rest = met.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    return links.union(_verified(rest, sets, percent).where("linked").select("a", "b"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: id, text_hash, n_shingles, sig (a hash of the set; null if empty), component_id.

    A set is a text's distinct shingles of ``size`` words (A-Z lower-cased; a shorter text is one shingle). Sets link where
    100 * intersection >= ``percent`` * union; component_id is the smallest id that links reach. A null or empty text has
    no set and is its own component. Equal sets always link, so repeated rows share a component. A null id is never the
    smallest unless all are null; other columns are ignored; an empty table gives no rows. Tokens are 64-bit hashes, of which 48 bits and the block are
    compared; sets are told apart by 128 bits.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(given.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_described(size), f"id {kind}, text_hash long, n_shingles long, sig long, check long, often binary"), "sets")
    counts = rows.where("often IS NOT NULL").select("often").mapInArrow(_counts, "token long, n long")
    rows, renamed = rows.drop("often"), []
    while True:
        named = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("text_hash").alias("text_hash"))
        named = written(named, "names")
        double = [r[0] for r in named.where("low <> high").select("sig").collect()]  # two of 2**32 sets share a name
        if not double:
            break
        renamed.append(np.array(double, np.int64).view(np.uint64))
        rows = written(rows.mapInArrow(_renamed(renamed), rows.schema), "sets")
    sums = rows.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    n_rows, n_tokens = sums[0], sums[1] or 0
    copied = named.where(F.col("copies") >= max(COPIES, n_rows // COPIES_SHARE)).select("sig", "text_hash").collect()
    hot = sorted((r[0] % (1 << 64), r[1]) for r in counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT, n_tokens // HOT_SHARE)).collect())
    apart = Apart(np.array([t for t, _ in hot], np.uint64), np.array([c for _, c in hot], np.int64), np.array([r[0] for r in copied], np.int64).view(np.uint64), renamed)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back, blocks = max(partitions, -(-n_tokens // BLOCK_TOKENS)), max(2 * partitions, -(-n_tokens // BLOCK_TOKENS))
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))  # smaller sets link to equal ones only
    dealt = given.mapInArrow(_dealt(size, blocks, back, least, apart, False), DEALT)
    if copied:
        stand = spark.createDataFrame([(r[1],) for r in copied], "text_hash long")
        texts = given.where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(stand), "text_hash", "left_semi").select("text").distinct()
        dealt = dealt.union(texts.select(F.lit(None).cast(kind).alias("id"), "text").mapInArrow(_dealt(size, blocks, back, least, apart, True), DEALT))
    counted = dealt.groupBy("block").applyInArrow(_shared(blocks, back, apart), COUNTED)
    sets = written(counted.groupBy("block").applyInArrow(_viable(percent), VIABLE), "viable")
    roots = components(written(_links(sets, percent), "similar"))
    classes = named.select("sig", "first").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    classes = written(classes, "classes")
    least_id = classes.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = written(many_to_one(classes, "root", least_id, "r").select(F.col("sig").alias("s"), "component_id"), "components")
    out = rows.join(named, F.col("sig") == F.col("s"), "left")
    empty = F.col("n_shingles") == 0
    return out.select(F.col("id").alias(id_col), "text_hash", "n_shingles", F.when(~empty, F.col("sig")).alias("sig"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns (of any names), that stand for their component: those with its smallest id; of rows with equal id and text one stays."""
    found = written(similar_components(docs, id_col, text_col, size, percent).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("k"), "text_hash"), "kept")
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    # one shuffle by id serves the join and the equal rows
    named = rows.join(found.select(F.col("k").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "text"])
    unnamed = rows.where("id IS NULL").join(found.where("k IS NULL").select(F.col("text_hash").alias("text")).distinct(), "text", "left_semi").dropDuplicates(["text"])
    return named.select("row.*").union(unnamed.select("row.*"))
