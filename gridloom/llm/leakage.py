"""Evaluation texts leaking into training text.

A document holds an item if one or two passages of it carry at least `share` of the item's words in their order, a few
of them changed. Both sides are cut into windows of `width` words, one beginning at every word, and each window gets a
SimHash. Fingerprints are compared by multi-index Hamming blocks: of radius + 1 blocks, two fingerprints within the
radius agree in one, so none is missed. Pairs with as many matching windows as a leak must keep are verified exactly,
on whole texts: shared weighted shingles are chained into passages, and the best pair of passages is taken.

`width=None` makes windows as long as each item. Such windows find whole copies only: a passage of three tenths of an
item, or one with every fourth word changed, lies far outside any radius that Hamming blocks can serve. The default is
the longest run of words that is left whole when every fourth word is changed.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.storage import written

WIDTH, RADIUS, SHARE, SHINGLE = 3, 3, 0.3, 3
#: A passage's outermost words may be changed ones, which no shingle shows.
SLACK = 0.03
#: One word in so many may be changed; passages keep at least this share of the weight of their shingles.
CHANGED, LEAST_SIMILARITY = 4, 0.22
#: Words that are fingerprinted at a time.
LONG = 200_000
#: Words a passage may have lost or changed between two shingles it keeps.
GAP = 6
#: Items are held by every task in blocks of at most so many words; further blocks are further passes.
BLOCK_WORDS = 1_000_000

_MARKUP = re.compile(r"</?[a-zA-Z!][^<>]*>|&[a-zA-Z]{2,8};|&#\d+;")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words, markup and punctuation left out."""
    return _WORD.findall(_MARKUP.sub(" ", text).lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def simhashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of every window of `width` words; of the whole text if it is shorter. Empty for no words."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(hashes))
    if width == 1:
        return hashes
    if width == 3:  # the sign of a sum of three is their majority, bit by bit
        x, y, z = hashes[:-2], hashes[1:-1], hashes[2:]
        return (x & y) | (x & z) | (y & z)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.vstack([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(sums[width:] - sums[:-width] > 0, axis=1).view(np.uint64).ravel()


class BlockIndex:
    """Fingerprints found within a Hamming radius: radius + 1 bit blocks, one of which must agree."""

    def __init__(self, prints: np.ndarray, owners: np.ndarray, radius: int):
        self.radius, self.prints, self.owners = radius, prints, owners
        cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        self.blocks = []
        for low, high in zip(cuts, cuts[1:]):
            shift, mask = np.uint64(low), np.uint64((1 << (high - low)) - 1)
            keys = (prints >> shift) & mask
            order = np.argsort(keys, kind="stable")
            values, starts = np.unique(keys[order], return_index=True)
            self.blocks.append((shift, mask, order, values, np.append(starts, len(keys))))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `prints`, position in the index) of all matches; the same pair may come several times."""
        at, found = [], []
        for shift, mask, order, values, starts in self.blocks:
            if not len(values):
                continue
            keys = (prints >> shift) & mask
            slot = np.searchsorted(values, keys)
            slot[slot == len(values)] = 0
            hit = np.flatnonzero(values[slot] == keys)
            n = starts[slot[hit] + 1] - starts[slot[hit]]
            begin = 0
            while begin < len(hit):
                end = begin + max(1, int(np.searchsorted(np.cumsum(n[begin:]), 2_000_000, side="right")))
                m = n[begin:end]
                where = np.repeat(hit[begin:end], m)
                index = order[np.repeat(starts[slot[hit[begin:end]]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                close = np.bitwise_count(prints[where] ^ self.prints[index]) <= self.radius
                at.append(where[close])
                found.append(index[close])
                begin = end
        return (np.concatenate(at), np.concatenate(found)) if at else (np.empty(0, dtype=int), np.empty(0, dtype=int))


def shingles_at(item: list[str], k: int = SHINGLE) -> dict[tuple[str, ...], list[int]]:
    """The places of every shingle of an item; of the whole item if it is shorter than a shingle."""
    k, at = min(k, len(item)), defaultdict(list)
    for j in range(len(item) - k + 1):
        at[tuple(item[j : j + k])].append(j)
    return at


def passages(doc: list[str], item: list[str], weights: list[float] | None = None, places: Iterable[int] | None = None, at: dict | None = None, k: int = SHINGLE, gap: int = GAP) -> list[tuple[int, int, int, int, float]]:
    """(first, end) in the document, (first, end) in the item, and the weight of the shingles, of every passage.

    A passage is a chain of shared k-word shingles in the same order on both sides, each at most `gap` words beyond the
    last. For every shared shingle the heaviest chain that ends there is given (the beginnings of longer ones too). Each
    shingle looks back over k + gap words of both sides only, so the work is linear in the document's shared shingles.
    `weights`: of the item's shingles, by place (1 each if absent); `places`: the only places of the document to look at,
    ascending; `at`: the item's `shingles_at`.
    """
    k = min(k, len(item))
    at = shingles_at(item, k) if at is None else at
    out: list[tuple[int, int, int, int, float]] = []
    recent: deque[tuple[int, dict[int, tuple[int, int, float]]]] = deque()  # document positions in reach, their chains by item position
    for i in range(len(doc) - k + 1) if places is None else places:
        positions = at.get(tuple(doc[i : i + k]))
        if not positions:
            continue
        while recent and i - recent[0][0] > k + gap:
            recent.popleft()
        here = {}
        for j in positions:
            best = (i, j, 0.0)
            for _, chains in recent:
                if len(chains) <= k + gap:
                    for jj, c in chains.items():
                        if 0 < j - jj <= k + gap and c[2] > best[2]:
                            best = c
                else:
                    for jj in range(j - k - gap, j):
                        c = chains.get(jj)
                        if c is not None and c[2] > best[2]:
                            best = c
            here[j] = (best[0], best[1], best[2] + (weights[j] if weights else 1.0))
        recent.append((i, here))
        out += [(a, i + k, b, j + k, w) for j, (a, b, w) in here.items()]
    return out


class _Best:
    """Largest value over a prefix of positions (a Fenwick tree of maxima)."""

    def __init__(self, n: int):
        self.tree: list[tuple[int, int]] = [(0, -1)] * (n + 1)

    def put(self, at: int, value: tuple[int, int]) -> None:
        at += 1
        while at < len(self.tree):
            if value > self.tree[at]:
                self.tree[at] = value
            at += at & -at

    def up_to(self, at: int) -> tuple[int, int]:
        best, at = (0, -1), at + 1
        while at > 0:
            if self.tree[at] > best:
                best = self.tree[at]
            at &= at - 1
        return best


def held(doc: list[str], item: list[str], weights: list[float] | None = None, places: Iterable[int] | None = None, at: dict | None = None, k: int = SHINGLE, gap: int = GAP) -> tuple[float, float]:
    """(share of the item's words, weighted shingle similarity) of the best one or two passages of a document.

    The share counts an item's words from a passage's first shingle to its last; the similarity is the weight of the
    passages' shared shingles over that of all shingles of the item there (shingles that many items use weigh less).
    Of all passages and pairs of passages that overlap on neither side the longest is taken, exactly: passages are
    swept by their ends in the document, with the best earlier one before and after each place of the item. The
    further arguments are those of `passages`.
    """
    k = min(k, len(item))
    if not item:
        return 0.0, 0.0
    weights = weights or [1.0] * (len(item) - k + 1)
    spans = passages(doc, item, weights, places, at, k, gap)
    if not spans:
        return 0.0, 0.0
    n = len(item)
    before, after = _Best(n + 1), _Best(n + 1)
    by_end = sorted(range(len(spans)), key=lambda x: spans[x][1])
    best, chosen, done = 0, (), 0
    for y in sorted(range(len(spans)), key=lambda x: spans[x][0]):
        first, _, low, high, _ = spans[y]
        while done < len(by_end) and spans[by_end[done]][1] <= first:
            x = spans[by_end[done]]
            before.put(x[3], (x[3] - x[2], by_end[done]))
            after.put(n - x[2], (x[3] - x[2], by_end[done]))
            done += 1
        words, x = max(before.up_to(low), after.up_to(n - high))
        if words + high - low > best:
            best, chosen = words + high - low, (x, y) if x >= 0 else (y,)
    kept = sum(spans[x][4] for x in chosen)
    there = sum(sum(weights[spans[x][2] : spans[x][3] - k + 1]) for x in chosen)
    return best / n, kept / there if there else 0.0


def least_windows(n_words: int, share: float, width: int) -> int:
    """Windows of `width` words that a leak of an item of n words keeps at least, if one word in CHANGED is changed.

    The share may lie in two passages; each begins and ends anywhere between two changed words.
    """
    runs = n_words * share / CHANGED
    return max(1, math.floor(runs * max(1, CHANGED - width)) - 1) if width < CHANGED else 1


def least_weight(weights: np.ndarray, words: int) -> float:
    """The weight that passages of `words` words, in one or two pieces, must keep at least: that of the lightest such pieces."""
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    light = np.array([0.0] + [float((sums[m:] - sums[:-m]).min()) for m in range(1, min(words, len(weights)) + 1)])  # by number of shingles
    of_words = lambda n: light[min(max(0, n - SHINGLE + 1), len(light) - 1)]
    return LEAST_SIMILARITY * min(of_words(m) + of_words(words - m) for m in range(words // 2 + 1))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = SHARE, width: int | None = WIDTH, radius: int = RADIUS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, share, similarity): every document that holds at least `share` of an item's words, each pair once.

    All windows of all documents are compared with all windows of all items. Items are a query set that every task
    holds, read from a written table in blocks of `block_words` words at most (but for a single longer item), one after
    the other; the driver holds none. Null and empty texts hold nothing and are held by nothing; an item shorter than
    the width is one window. Repeated rows give a pair once. Nothing is shuffled but the result.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).dropna().distinct()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    n_words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, share double, similarity double"
    if not n_words:
        return spark.createDataFrame([], f"`{doc_id}` {d.schema['doc_id'].dataType.simpleString()}, `{item_id}` {items.schema['item_id'].dataType.simpleString()}, share double, similarity double")
    blocks = math.ceil(n_words / block_words)
    blocked = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "item_id")
    _, path = written(blocked, "items")
    out = d.mapInPandas(_finder(path, blocks, share, width, radius), schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("similarity").alias("similarity")).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "share", "similarity")


class _Items:
    """The items of one block, with an index of their windows for every width in use."""

    def __init__(self, rows: list[tuple], share: float, width: int | None, radius: int):
        self.ids, self.words = [], []
        for i, text in rows:
            words = words_of(text)
            if words:
                self.ids.append(i)
                self.words.append(words)
        used = Counter(s for w in self.words for s in {tuple(w[j : j + SHINGLE]) for j in range(len(w) - SHINGLE + 1)})
        self.at = [shingles_at(w) for w in self.words]
        self.weights = [[1 / used.get(tuple(w[j : j + SHINGLE]), 1) for j in range(max(1, len(w) - SHINGLE + 1))] for w in self.words]
        by_width = defaultdict(list)
        for n, w in enumerate(self.words):
            by_width[min(width or len(w), len(w))].append(n)
        self.indexes = []
        for wide, members in by_width.items():
            prints, owners, kept = [], [], []
            for n in members:
                p, where = np.unique(simhashes(word_hashes(self.words[n]), wide), return_index=True)
                prints.append(p)
                owners.append(np.full(len(p), n))
                kept.append(np.array(self.weights[n])[where] if wide == SHINGLE else np.ones(len(p)))
            self.indexes.append((wide, BlockIndex(np.concatenate(prints), np.concatenate(owners), radius), np.concatenate(kept)))
        self.least = np.array([least_windows(len(w), share, width) if width and len(w) >= width else 1 for w in self.words], dtype=np.int64)
        bound = width == SHINGLE
        self.least_weight = np.array([least_weight(np.array(x), math.ceil((share - SLACK) * len(w))) if bound and len(w) >= SHINGLE else 0.0 for x, w in zip(self.weights, self.words)])

    def candidates(self, hashes: np.ndarray, of: np.ndarray) -> list[tuple[int, int, list[int] | None]]:
        """(document, item, places in `hashes` of the matching windows) of the pairs that keep enough of them.

        `of` says which document a word belongs to. Places are None where windows are not shingles.
        """
        out = []
        for wide, index, kept in self.indexes:
            if len(hashes) < wide:
                continue
            at, found = index.near(simhashes(hashes, wide))
            inside = of[at] == of[at + wide - 1]
            at, found = at[inside], found[inside]
            if not len(at):
                continue
            pair = of[at].astype(np.int64) * len(self.ids) + index.owners[found]
            order = np.lexsort((found, pair))
            at, found, pair = at[order], found[order], pair[order]
            fresh = np.r_[True, (pair[1:] != pair[:-1]) | (found[1:] != found[:-1])]  # each window of an item once
            begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            ends = np.r_[begins[1:], len(pair)]
            n = np.add.reduceat(fresh.astype(np.int64), begins)
            weight = np.add.reduceat(fresh * kept[found], begins)
            item = pair[begins] % len(self.ids)
            for x in np.flatnonzero((n >= self.least[item]) & (weight >= self.least_weight[item] * (1 - 1e-9))):
                places = np.unique(at[begins[x] : ends[x]]).tolist() if wide == SHINGLE else None
                out.append((int(pair[begins[x]] // len(self.ids)), int(item[x]), places))
        return out


def _block(path: str, block: int) -> list[tuple]:
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, where = pafs.FileSystem.from_uri(path)
    table = ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"], filter=ds.field("block") == block)
    return list(zip(table["item_id"].to_pylist(), table["text"].to_pylist()))


def _finder(path: str, blocks: int, share: float, width: int | None, radius: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_block: tuple[int, _Items | None] = (-1, None)
        known: dict[str, int] = {}
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"].tolist()
            start = 0
            while start < len(texts):
                words, end, n = [], start, 0
                while end < len(texts) and n < LONG:
                    words.append(words_of(texts[end]))
                    n += len(words[-1])
                    end += 1
                if len(known) > 500_000:
                    known.clear()
                hashes = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for ws in words for w in ws), dtype=np.uint64, count=n)
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                of, first = np.repeat(np.arange(start, end), sizes), (np.cumsum(sizes) - sizes).tolist()
                found = []
                for block in range(blocks):
                    if held_block[0] != block:
                        held_block = (block, _Items(_block(path, block), share, width, radius))
                    items = held_block[1]
                    for doc, item, places in items.candidates(hashes, of):
                        own = None if places is None else [x - first[doc - start] for x in places]
                        s, similarity = held(words[doc - start], items.words[item], items.weights[item], own, items.at[item])
                        if s >= share - SLACK and similarity >= LEAST_SIMILARITY:
                            found.append((ids[doc], items.ids[item], s, similarity))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "share", "similarity"])
                start = end

    return find
