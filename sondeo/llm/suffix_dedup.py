"""Removal of repeated byte strings by suffix sorting with a difference cover.

A byte goes if some string of ``length`` (200) bytes that covers it starts anywhere else.
The positions where such strings start are found by sorting suffixes, in three steps.

1. *Dealing.*  Of each window of ``length`` bytes the k-gram with the least hash is its
   anchor (the first, if there are several).  The anchor depends on the window's bytes
   alone, so equal windows have equal anchors at equal places, and one in about 77 positions
   is an anchor.  The windows of one anchor are neighbours; their bytes together are its
   context.  Anchors whose k-gram occurs once are done: none of their windows repeats.
   Contexts with one 128-bit digest are a class, which two of its members speak for.
2. *Suffix sorting.*  The members that speak for the classes of an anchor are dealt to
   tasks by the anchor and held against each other by their bytes: all windows of equal
   ones repeat.  The suffixes of an anchor's different contexts are sorted by the
   difference-cover algorithm (DC3): the triples at positions 1 and 2 modulo 3 are sorted
   and named, names that aren't unique are sorted by recursion, the other suffixes are
   sorted by their first symbol and the rank of the next, and both are merged.  Adjacent
   suffixes whose first ``length`` bytes agree are repeats.  Where the two members of a
   class have equal bytes, the class's other members go as well; members of different
   bytes under one digest are judged by their own suffixes.
3. *Union.*  The repeated windows of each text are united, and their bytes go.

All suffixes with a common prefix of ``length`` bytes are in one task, so sorting task by
task finds what one global sort would find.  Anchors with over ``hot`` different contexts
are dealt finer: each of their windows is a context of its own, and those that share a
digest are compared as above.  Keys with very many rows are few, so they are broadcast to
the rows that have them, which stay where they are (``met``).  Texts are named by their
row's place in the table's files, which no two rows share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, filed, mix, row_places, staged, unstage

LENGTH, GRAM, HOT, DIGEST = 200, 48, 4000, 16
#: At most so many keys are broadcast for having more than their share of the rows.
HEAVY = 10_000
BLOCK = 1 << 20
_BYTES = np.random.default_rng(4242).integers(1, 2**63, 256, dtype=np.uint64)
INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
LEAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(GOLDEN, BLOCK + 4096), _powers(INVERSE, BLOCK + 4096)


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the strings of n bytes in a buffer of up to BLOCK + 4096 bytes."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _UP[: len(buf)], out=sums[1:], dtype=np.uint64)
    return mix((sums[n:] - sums[:-n]) * _DOWN[: len(sums) - n])


def window_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the first least value in each window of w values."""
    n = len(x)
    if n < w:
        return np.empty(0, np.int64)
    best, at, span = x, np.arange(n), 1
    while span < w:  # windows of a power of two, then one more overlapping step
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best, at, span = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step]), span + step
    return at


def anchors(buf: np.ndarray, length: int, gram: int, digest: int = DIGEST):
    """``(name, context, first window, windows)`` of a text's anchors: arrays, but for the
    contexts, which are the digests of their bytes one after another."""
    w, out, contexts, at = length - gram + 1, [], [], 0
    while at + length <= len(buf):  # blocks of window starts
        part = buf[at : at + BLOCK + length - 1]
        grams = gram_hashes(part, gram)
        place = window_argmin(grams, w)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        raw = memoryview(part)
        contexts += [hashlib.blake2b(raw[a:z], digest_size=digest).digest() for a, z in zip(first.tolist(), (last + length).tolist())]
        out.append((grams[place[first]], first + at, last - first + 1))
        at += len(place)
    if not out:
        return None
    name, first, n = (np.concatenate(c) for c in zip(*out))
    return name, contexts, first, n


def _anchor_rows(length: int, gram: int, digest: int, most: int = 20_000):
    """The anchors of the texts, some ``most`` or one text's at a time."""

    def flush(held):
        names, contexts, firsts, ns, files, places = zip(*held)
        size = [len(x) for x in names]
        packed = (np.concatenate(firsts).astype(np.int64) << 8) | np.concatenate(ns)
        place = [pa.array(np.repeat(np.array(x, np.int64), size)) for x in (files, places)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array([x for c in contexts for x in c], pa.binary()), *place, pa.array(packed)], names=["name", "context", "file", "row", "packed"])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                got = anchors(_buffer(batch.column(2), i), length, gram, digest)
                if got:
                    held.append((*got, batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                    size += len(got[1])
                if size > most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows


def _buffer(column, i: int) -> np.ndarray:
    v = column[i]
    raw = v.as_py() if v.is_valid else ""
    return np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of whole numbers from 0 in order, by the difference cover
    {1, 2} modulo 3: sort sampled triples, recurse on their names, merge the others."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(s[i:])), np.int64)
    base = int(s.max()) + 2
    t = np.concatenate([np.asarray(s, np.int64) + 1, np.zeros(3, np.int64)])  # 0: past the end
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    name = _names(t, sample, base)
    if name.max() + 1 < len(sample):
        order = suffix_array(name)
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.arange(len(sample))
    else:
        rank = name
    place = np.zeros(n + 3, np.int64)  # ranks from 1 of sampled suffixes
    place[sample] = rank + 1
    sampled = np.empty(len(sample), np.int64)
    sampled[rank] = sample
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * (n + 3) + place[rest + 1], kind="stable")]
    # merge: each suffix of the rest is held against sampled ones of either class by keys
    # that both classes have: (symbol, rank) at 1 mod 3, (symbol, symbol, rank) at 2 mod 3
    a = sampled[sampled % 3 == 1]
    b = sampled[sampled % 3 == 2]
    k1 = lambda i: t[i] * (n + 3) + place[i + 1]
    at_a = np.searchsorted(k1(a), k1(rest))
    pair = np.concatenate([_pairs(t, b, base), _pairs(t, rest, base)])
    pair = np.unique(pair, return_inverse=True)[1] * (n + 3) + np.concatenate([place[b + 2], place[rest + 2]])
    at_b = np.searchsorted(pair[: len(b)], pair[len(b) :])
    out = np.empty(n, np.int64)
    where = np.arange(len(rest)) + at_a + at_b
    out[where] = rest
    free = np.ones(n, bool)
    free[where] = False
    out[free] = sampled
    return out


def _pairs(t: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    return t[at] * base + t[at + 1]


def _names(t: np.ndarray, sample: np.ndarray, base: int) -> np.ndarray:
    """The ranks of the triples that start at sampled places, equal ones alike."""
    if base < 1 << 20:
        return np.unique(_pairs(t, sample, base) * base + t[sample + 2], return_inverse=True)[1]
    first = np.unique(_pairs(t, sample, base), return_inverse=True)[1].astype(np.int64)
    return np.unique(first * base + t[sample + 2], return_inverse=True)[1]


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the places where a string of ``length`` bytes starts that also starts
    somewhere else in the parts."""
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    ends = begin + size
    s = raw.astype(np.int64) + 1
    s[ends] = 0
    order = suffix_array(s)
    room = np.repeat(ends, size + 1) - np.arange(len(s))
    order = order[room[order] >= length]  # the others can't be equal over that length
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64)[:, 0]
    same = np.arange(len(order) - 1) if len(order) > 1 else np.empty(0, np.int64)
    for step in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same] + step] == words[order[same + 1] + step]]
    hit = np.zeros(len(s), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin, size)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of neighbouring numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))], starts[np.append(cut, len(starts) - 1)]))


def _context_rows(length: int, most: int = 4 << 20):
    """The bytes of the contexts that are asked of the texts, some ``most`` or one text's at a time."""
    kinds = {"deal": pa.int64(), "name": pa.int64(), "context": pa.binary(), "file": pa.int64(), "row": pa.int64(), "first": pa.int64(), "data": pa.binary()}

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw, file, place = _buffer(batch.column(2), i).tobytes(), batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for r in batch.column(3)[i].as_py():
                    first = r["packed"] >> 8
                    data = raw[first : first + (r["packed"] & 255) + length - 1]
                    held.append((r["deal"], r["name"], r["context"], file, place, first, data))
                    size += len(data)
                if size > most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows


def _sort_contexts(length: int, most: int = 1 << 20):
    """Over rows in the order of ``deal``: equal contexts are found by comparing their bytes,
    and one of each is sorted with all others that are dealt alike.  ``whole`` marks a span
    of a class whose two members have equal bytes."""

    def flush(groups):
        parts = [data for g in groups if len(g) > 1 for data in g]
        found, rows = iter(repeated_starts(parts, length) if parts else ()), []
        for g in groups:
            for data, holders in g.items():
                runs = _runs(next(found)) if len(g) > 1 else []
                if len(holders) > 1:
                    runs = [(0, len(data) - length)]
                seen = set()
                for name, context, file, place, first in holders:
                    whole = (name, context) in seen
                    seen.add((name, context))
                    rows += [(name, context, file, place, int(first + a), int(first + z + length), whole) for a, z in runs]
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["name", "context", "file", "row", "start", "end", "whole"])

    def rows(batches):
        groups, size, last = [], 0, None
        for batch in batches:
            for deal, *holder, data in zip(*(c.to_pylist() for c in batch.columns)):
                if not groups or deal != last:
                    if size > most:
                        yield flush(groups)
                        groups, size = [], 0
                    groups.append({})
                    last = deal
                groups[-1].setdefault(data, []).append(holder)
                size += len(data)
        if groups:
            yield flush(groups)

    return rows


def _window_digests(length: int, digest: int):
    """Each window of each context, as a context of one window."""

    def rows(batches):
        for batch in batches:
            for _, _, _, file, place, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                of = [hashlib.blake2b(data[i : i + length], digest_size=digest).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), *(pa.array(np.full(n, x)) for x in (file, place)), pa.array((np.arange(first, first + n) << 8) | 1)], names=["context", "file", "row", "packed"])

    return rows


def met(rows: DataFrame, counted: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is in ``counted`` (keys with ``n``, their number of rows), or with
    ``left_anti`` those whose key isn't.  Keys with over a ``HEAVY``-th of all rows are
    fewer than ``HEAVY``: they are broadcast, and their rows are not shuffled."""
    bound = max(1000, rows.count() // HEAVY)
    heavy, lean = F.broadcast(counted.filter(F.col("n") > bound).select(*by)), counted.filter(F.col("n") <= bound).select(*by)
    rest = rows.join(heavy, by, "left_anti").join(lean, by, how)
    return rest if how == "left_anti" else rest.unionByName(rows.join(heavy, by, how))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, digest: int = DIGEST) -> DataFrame:
    """``rows(file, row, text)``, one of each place -> ``(file, row, start, end)``: byte spans
    whose union is what repeated strings cover.  Digests have ``digest`` bytes."""
    place = ["file", "row"]
    member = F.struct(*place, "packed")
    first = F.shiftright("packed", 8)
    span = [*place, first.alias("start"), (first + F.col("packed").bitwiseAND(255) + (length - 1)).alias("end")]
    kind = "context binary, file long, row long, "

    def classes(found: DataFrame, *by: str) -> DataFrame:
        return found.groupBy(*by).agg(F.count("*").alias("n"), F.min(member).alias("low"), F.max(member).alias("high"))

    def asked(of: DataFrame, deal) -> DataFrame:
        """Two members of each class, or its only one."""
        both = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
        rows = of.select(deal.alias("deal"), "name", "context", F.explode(both).alias("m"))
        return rows.select("m.file", "m.row", F.struct("deal", "name", "context", "m.packed").alias("a"))

    def contexts(wanted: DataFrame) -> DataFrame:
        by_text = wanted.groupBy(*place).agg(F.collect_list("a").alias("asked"))
        return rows.join(by_text, place).select(*place, "text", "asked").mapInArrow(_context_rows(length), f"deal long, name long, {kind} first long, data binary")

    every = staged(rows.mapInArrow(_anchor_rows(length, gram, digest), f"name long, {kind} packed long"), "anchors")
    shared = staged(every.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "shared_names")
    found = staged(met(every, shared, ["name"]), "shared_anchors")
    unstage(every)
    known = staged(classes(found, "name", "context"), "classes")
    wide = staged(known.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "hot_names")
    of_context, windows = F.xxhash64("context"), None
    wanted = asked(met(known, wide, ["name"], "left_anti"), F.col("name"))
    if wide.take(1):
        split = staged(met(known, wide, ["name"]), "hot_classes")
        windows = staged(contexts(asked(split.withColumn("n", F.lit(1)), of_context)).mapInArrow(_window_digests(length, digest), f"{kind} packed long"), "windows")
        narrow = staged(classes(windows, "context").filter("n > 1").withColumn("name", F.lit(None).cast("long")), "window_classes")
        wanted = wanted.unionByName(asked(split.filter("n > 1").unionByName(narrow, allowMissingColumns=True), of_context))
    data = contexts(wanted).repartition("deal").sortWithinPartitions("deal")
    done = staged(data.mapInArrow(_sort_contexts(length), f"name long, {kind} start long, end long, whole boolean"), "sorted")
    spans, whole = done.select(*place, "start", "end"), done.filter("whole")
    more = staged(known.filter("n > 2").join(whole.select("name", "context"), ["name", "context"], "left_semi").select("name", "context", "n"), "copied")
    spans = spans.unionByName(met(found, more, ["name", "context"]).select(*span))
    if windows is not None:
        more = staged(narrow.filter("n > 2").join(whole.filter("name is null").select("context"), "context", "left_semi").select("context", "n"), "copied_windows")
        spans = spans.unionByName(met(windows, more, ["context"]).select(*span))
    return spans


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _cut(batches):
    for batch in batches:
        kept, sizes, spans = [], [], []
        for i in range(batch.num_rows):
            raw = _buffer(batch.column(1), i).tobytes()
            gone = _union((s["start"], s["end"]) for s in batch.column(2)[i].as_py() or ())
            at, parts = 0, []
            for a, z in gone:
                parts.append(raw[at:a])
                at = z
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            sizes.append(len(raw))
            spans.append([{"start": a, "end": z} for a, z in gone])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kind)], names=["doc_id", "kept", "n_bytes", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the remaining bytes ``kept`` (binary:
    a span may end within a character), ``n_bytes`` of the whole text and the removed
    ``spans`` (maximal, in order).  Texts count as UTF-8 bytes, null as empty; shorter texts
    than ``length`` lose nothing.  Equal texts in several rows, with one doc_id or many,
    repeat each other.  Null doc_ids stay null; an empty table gives no rows."""
    docs = filed(docs)
    rows = row_places(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", "place.file", "place.row")
    spans = repeated_spans(rows.select("file", "row", "text").filter(F.octet_length("text") >= length), length, **how)
    by_row = spans.groupBy("file", "row", "start").agg(F.max("end").alias("end")).groupBy("file", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows.join(by_row, ["file", "row"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, kept binary, n_bytes long, spans array<struct<start:long,end:long>>")


def digests(removed: DataFrame) -> DataFrame:
    """Counts, and the hash of the remaining bytes, of :func:`remove_repeats`' rows."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
