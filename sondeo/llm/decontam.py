"""Benchmark decontamination by spaced-seed hashing.

Test items and texts become sequences of normalised tokens.  Masks select some of the
tokens of a window and ignore the others, so a substituted token in an ignored place
leaves the hash as it was.  Where a text's seed hash meets one of a test item, both are
laid along that diagonal, and the overlap counts if within some stretch as long as
``min(item, window)`` tokens at least ``identity`` of the tokens agree.  The masks follow
from the item's length, the window and the identity: wherever an overlap counts, at least
one mask at one place meets agreeing tokens only, so no overlap that counts is missed.

The test set is joined in blocks of bounded size: each block of items is hashed, sorted
and sent to the tasks, and every text is read against it, so the corpus is never shuffled
and no key can be hot.  A seed that many items share, such as one of an instruction
template, is expanded and verified for all of them at once with arrays, and the items that
share a stretch are reported as one row.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, batches_of_texts, mix, powers

BLOCK_TOKENS = 500_000
#: Masks for a length at most, tokens that one selects at most, and the longest stretch and most patterns that are enumerated.
MOST_MASKS, MOST_WEIGHT, LONGEST, PATTERNS = 3, 8, 20, 50_000
_KEYS = np.random.default_rng(77).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that belong to a token: letters, digits and all of UTF-8 beyond ASCII, lower-cased.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Token hashes of each text."""
    out = []
    for t in texts:
        parts = []
        low = t.decode("utf-8", "replace").lower().encode() if not t.isascii() else t
        fold = _FOLD[np.frombuffer(low, np.uint8)]
        at = 0
        while at < len(fold):
            end = min(len(fold), at + (1 << 20))
            while end < len(fold) and fold[end] != 32:
                end += 1
            part = fold[at:end]
            inside = part != 32
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            first, lens = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
            if len(first):
                begin = np.cumsum(lens) - lens
                pos = np.arange(int(lens.sum())) - np.repeat(begin, lens)
                v = (part[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[pos]
                parts.append(mix(np.add.reduceat(v, begin) + lens.astype(np.uint64) * GOLDEN))
            at = end
        out.append(np.concatenate(parts) if parts else np.empty(0, np.uint64))
    return out


@lru_cache(maxsize=None)
def masks(n: int, changed: int) -> tuple[int, ...]:
    """Masks (bit j: token j is hashed) of which one at least, at some place of a stretch of
    ``n`` tokens, avoids all changed ones, wherever up to ``changed`` < n of them lie: few
    masks of the greatest weight for which a greedy choice meets every pattern."""
    if n > LONGEST:  # of the disjoint parts one has no more than its share
        return masks(LONGEST, changed // (n // LONGEST)) if changed // (n // LONGEST) < LONGEST else (1,)
    if math.comb(n, changed) <= PATTERNS:
        bad = np.array([sum(1 << i for i in c) for c in combinations(range(n), changed)], np.int64)
        for weight in range(min(MOST_WEIGHT, n - changed), 0, -1):
            tried = sorted((1 | sum(1 << i for i in c) for c in combinations(range(1, min(n, weight + 6)), weight - 1)), key=lambda x: (x.bit_length(), x))
            tried = tried[:: 1 + len(tried) // 400]
            hit = np.array([np.any([bad & (x << at) == 0 for at in range(n - x.bit_length() + 1)], axis=0) for x in tried])
            chosen: list[int] = []
            while hit.shape[1] and len(chosen) < MOST_MASKS:
                best = int(hit.sum(axis=1).argmax())
                chosen.append(tried[best])
                hit = hit[:, ~hit[best]]
            if not hit.shape[1]:
                return tuple(chosen)
    return ((1 << -(-(n - changed) // (changed + 1))) - 1,)  # the longest run of agreeing tokens


def masks_of(n_tokens: int, window: int, identity: float) -> tuple[int, ...]:
    """The masks for an item of so many tokens.  Lengths share those of the least length
    with as many changes, so that a text is hashed with few masks."""
    need = min(n_tokens, window)
    changed = lambda n: n - max(1, math.ceil(identity * n))
    if changed(need) == 0:
        return masks(min(need, MOST_WEIGHT), 0)
    while changed(need - 1) >= changed(need):
        need -= 1
    return masks(need, changed(need))


def seeds(t: np.ndarray, chosen):
    """(mask, hashes of the windows at 0, 1, ...) of a token sequence."""
    keyed: dict[int, np.ndarray] = {}
    for mask in chosen:
        n = len(t) - mask.bit_length() + 1
        if n > 0:
            h = np.full(n, mask * int(GOLDEN) & (1 << 64) - 1, np.uint64)
            for j in range(mask.bit_length()):
                if mask >> j & 1:
                    if j not in keyed:
                        keyed[j] = t * _KEYS[j]
                    h += keyed[j][j : j + n]
            yield mask, h


class TestBlock:
    """Different items of a block with the sorted seed hashes of all their windows.  Items of
    equal tokens are one class: the least of their ids, and how many they are."""

    __test__ = False

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int, identity: float):
        self.window, self.identity = window, identity
        classes: dict[bytes, list] = {}
        for item_id, t in items:
            if len(t):
                classes.setdefault(t.tobytes(), []).append(item_id)
        held = sorted((min(ids), len(set(ids)), np.frombuffer(raw, np.uint64)) for raw, ids in classes.items())
        self.ids = np.array([x[0] for x in held], np.int64)
        self.copies = np.array([x[1] for x in held], np.int64)
        self.size = np.array([len(x[2]) for x in held], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.tokens = np.concatenate([*(x[2] for x in held), np.empty(0, np.uint64)])
        h, item, pos, used = [], [], [], set()
        for i, (_, _, t) in enumerate(held):
            chosen = masks_of(len(t), window, identity)
            used.update(chosen)
            for _, x in seeds(t, chosen):
                h.append(x)
                item.append(np.full(len(x), i))
                pos.append(np.arange(len(x)))
        self.masks = sorted(used)
        self.hash = np.concatenate(h) if h else np.empty(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.concatenate(item)[order] if h else np.empty(0, int)
        self.pos = np.concatenate(pos)[order] if h else np.empty(0, int)
        self.low = np.zeros(1 << max(16, (16 * len(self.hash)).bit_length()), bool)  # tells most strangers at once
        self.mask = np.uint64(len(self.low) - 1)
        self.low[self.hash & self.mask] = True

    def diagonals(self, t: np.ndarray) -> np.ndarray:
        """(item, its place in the text) where some seed of both agrees, in order."""
        found = []
        for _, h in seeds(t, self.masks):
            at = np.flatnonzero(self.low[h & self.mask])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            n = hi - lo
            j = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            found.append(np.column_stack([self.item[j], np.repeat(at, n) - self.pos[j]]))
        found = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return np.unique(found, axis=0) if len(found) else found

    def overlaps(self, t: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int, int, int, int]]:
        """(item_id, n_items, first token, tokens, agreeing tokens) of the stretches of a
        text that overlap with items.  Of each item the best stretch counts (most agreeing
        tokens, then the first); items with one stretch are one row, under the least id."""
        best: dict[int, tuple[int, int, int]] = {}
        d = self.diagonals(t)
        if not len(d):
            return []
        i, at = d[:, 0], d[:, 1]
        need = np.minimum(self.window, self.size[i])
        a, z = np.maximum(0, at), np.minimum(len(t), at + self.size[i])
        ok = z - a >= need
        i, at, need, a, n = i[ok], at[ok], need[ok], a[ok], (z - a)[ok]
        ends, k = np.cumsum(n), 0
        while k < len(i):  # so many diagonals at a time that their overlaps have about ``most`` tokens
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
            part = slice(k, stop)
            size = n[part]
            start = np.cumsum(size) - size
            own = np.arange(int(size.sum())) - np.repeat(start, size)
            place = np.repeat(a[part], size) + own
            same = t[place] == self.tokens[place - np.repeat(at[part] - self.begin[i[part]], size)]
            total = np.concatenate(([0], np.cumsum(same)))
            runs = size - need[part] + 1  # stretches of the length that counts
            first = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
            left = np.repeat(start, runs) + first
            agree = total[left + np.repeat(need[part], runs)] - total[left]
            top = np.maximum.reduceat(agree, np.cumsum(runs) - runs)
            for q in np.flatnonzero(top >= self.identity * need[part]):
                low = int((np.cumsum(runs) - runs)[q])
                got = (-int(top[q]), int(a[part][q]) + int(np.argmax(agree[low : low + runs[q]])), int(need[part][q]))
                item = int(i[part][q])
                best[item] = min(best.get(item, got), got)
            k = stop
        rows: dict[tuple[int, int, int], list[int]] = {}
        for item, got in best.items():
            rows.setdefault(got, []).append(item)
        return sorted((int(self.ids[x].min()), int(self.copies[x].sum()), first, length, -agree) for (agree, first, length), x in rows.items())


def test_blocks(benchmark: DataFrame, window: int, identity: float, block_tokens: int = BLOCK_TOKENS):
    """The test set as blocks of at most about ``block_tokens`` tokens, judged by the items'
    characters (a token has two at least, with the space); null texts have no tokens."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / block_tokens))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        if part:
            yield TestBlock([(r["item_id"], t) for r, t in zip(part, tokens([r["text"].encode() for r in part]))], window, identity)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 20, identity: float = 0.8, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows ``(doc_id, item_id, n_items, first_token, n_tokens, n_agree)``: the stretches of
    each row's text that overlap with test items.  A stretch that several items share, such
    as a template, is one row with the least item_id and the number of items (in each block
    of the test set).  Texts or items that are null or have no tokens overlap with nothing,
    and a text that is shorter than the item and the window has no stretch that counts.  Repeated rows each give their rows; a
    null doc_id stays null; other columns are ignored."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_items long, first_token long, n_tokens long, n_agree long"
    src, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for block in test_blocks(benchmark, window, identity, block_tokens):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for first, texts in batches_of_texts(batch.column(1)):
                    for i, t in enumerate(tokens(texts)):
                        rows += [(ids[first + i], *x) for x in sent.value.overlaps(t)]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_items", "first_token", "n_tokens", "n_agree"])

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 20, identity: float = 0.8, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a test item; nothing else changes.
    Each row is judged by its own text as it passes (one pass for each block of the test
    set), so null, shared and repeated ids, null texts and any other column make no
    difference, and no text is shuffled."""
    at, out = docs.columns.index("text"), docs
    for block in test_blocks(benchmark, window, identity, block_tokens):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for first, texts in batches_of_texts(batch.column(at)):
                    clean = [not sent.value.overlaps(t) for t in tokens(texts)]
                    yield batch.slice(first, len(texts)).filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
