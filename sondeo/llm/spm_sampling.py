"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text is cut before each space; within such a unit every way of covering it with pieces
of the vocabulary is a path of the piece lattice.  A forward pass sums the weights of all
paths to each place; a backward pass draws, from the end, each piece in proportion to the
paths through it.  Pieces weigh ``(rank + offset) ** -power`` by their rank in the
vocabulary (its scores are merge ranks, not probabilities), sharpened by ``alpha``.  The
numbers come from a hash of the seed, the row's key and the place of the unit, so a row's
segmentation does not depend on partitions, batches or retries.

A space is the piece character U+2581.  Characters that no piece holds, and U+2581 itself,
become byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, batches_of_texts, extended, free_name, mix, powers

MARK = "▁"
#: Longer units are gone through in blocks of this many code points.
LONG_UNIT = 1 << 14
_CHAR_MUL = np.uint64(0xD6E8FEB86659FD93)


class Lattice:
    """The vocabulary as a trie of its pieces by length, with their weights."""

    def __init__(self, model_file: str, alpha: float = 1.0, power: float = 1.0, offset: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.long_unit = LONG_UNIT
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        shown = [of_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.piece_size = np.array([len(b) for b in shown])
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(shown), np.uint8)
        if len(self.byte) != 256:
            raise ValueError("the vocabulary must have all 256 byte pieces")
        used = np.array([i for i, p in enumerate(self.piece) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or MARK in p[1:])])
        size = np.array([len(self.piece[i]) for i in used])
        self.longest = int(size.max())
        cp = np.frombuffer("".join(self.piece[i].ljust(self.longest) for i in used).encode("utf-32-le"), np.uint32).reshape(len(used), -1).astype(np.uint64)
        self.table = {}
        node = np.zeros(len(used), np.uint64)
        for n in range(1, self.longest + 1):  # all prefixes of n code points, as the prefix before and the last one, and which of them are pieces
            step = node << np.uint64(32) | cp[:, n - 1]
            known = np.unique(step[size >= n])
            node = np.searchsorted(known, step).astype(np.uint64)
            ids = np.full(len(known), -1, np.int32)
            ids[node[size == n]] = used[size == n]
            self.table[n] = (known, ids)
        weight = (np.arange(len(self.piece)) + offset) ** (-alpha * power)
        self.byte_weight = float(weight.min() / 8)
        self.weight = np.append(weight, 0.0)  # the last one is that of -1

    def arcs(self, cp: np.ndarray) -> np.ndarray:
        """ids[end, n-1]: the piece of n code points that ends there, or -1.  Longer pieces
        are only looked up where the shorter prefix is one of some piece."""
        ids = np.full((len(cp) + 1, self.longest), -1, np.int32)
        alive, node = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        for n in range(1, self.longest + 1):
            ok = alive + n <= len(cp)
            alive, node = alive[ok], node[ok]
            if not len(alive):
                break
            step = node << np.uint64(32) | cp[alive + n - 1]
            known, piece = self.table[n]
            j = np.minimum(np.searchsorted(known, step), len(known) - 1)
            hit = known[j] == step
            alive, node = alive[hit], j[hit].astype(np.uint64)
            ids[alive + n, n - 1] = piece[j[hit]]
        return ids

    def sample(self, texts: list[bytes], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all texts one after another, and how many each has."""
        cps = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
        cp = np.concatenate([*cps, np.empty(0, np.uint64)])
        if not len(cp):
            return np.empty(0, np.int32), np.zeros(len(texts), int)
        size = np.array([len(c) for c in cps])
        text_at = np.cumsum(size) - size
        literal = cp == ord(MARK)
        cp = np.where(cp == 32, np.uint64(ord(MARK)), cp)
        cp[literal] = np.uint64(0xFFFFFFFF)  # no piece has it
        starts = cp == ord(MARK)
        starts[text_at[size > 0]] = True
        first = np.flatnonzero(starts)
        lens = np.diff(np.append(first, len(cp)))
        # equal units are one lattice: they meet by length and hash, their characters decide
        pos = np.arange(len(cp)) - np.repeat(first, lens)
        value = (cp + np.uint64(1)) * _CHAR_MUL
        value ^= value >> np.uint64(29)
        value *= powers(int(lens.max()))[pos]
        members, new = self._equal_units(cp, first, lens, pos, mix(np.add.reduceat(value, first)))
        # numbers by row key and place of the unit in its text
        units = np.add.reduceat(starts, text_at[size > 0]) if len(first) else np.empty(0, int)
        owner = np.repeat(np.flatnonzero(size > 0), units)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(units) - units, units)
        draw = mix(mix(keys[owner] ^ np.uint64(seed * int(GOLDEN) & (1 << 64) - 1)) + nth.astype(np.uint64) * _CHAR_MUL)
        unit_at = np.flatnonzero(new)  # where the uses of a unit begin in members, short units first
        unit_len = lens[members[unit_at]]
        unit_end = np.append(unit_at[1:], len(members))
        row = np.cumsum(new) - 1
        out_ids, out_unit, out_pos = [], [], []
        i = 0
        while i < len(unit_at):
            n = int(unit_len[i])
            if n > self.long_unit:
                use = members[unit_at[i] : unit_end[i]]
                self._sample_long(cp[first[use[0]] : first[use[0]] + n], use, draw, out_ids, out_unit, out_pos)
                i += 1
                continue
            j = min(int(np.searchsorted(unit_len, n, side="right")), i + max(1, (1 << 17) // n))
            use = slice(unit_at[i], unit_end[j - 1])
            self._sample_units(cp, first[members[unit_at[i:j]]], n, members[use], row[use] - i, draw, out_ids, out_unit, out_pos)
            i = j
        ids, unit_of, at = np.concatenate(out_ids), np.concatenate(out_unit), np.concatenate(out_pos)
        place = first[unit_of] + at
        sort = np.argsort(place, kind="stable")
        ids, place = ids[sort], place[sort]
        low = ids < 0  # a character without a piece: its bytes
        if low.any():
            parts, last = [], 0
            for k in np.flatnonzero(low):
                c = cp[place[k]]
                raw = (MARK if c == 0xFFFFFFFF else chr(int(c))).encode("utf-8", "surrogatepass")
                parts += [ids[last:k], np.array([self.byte[b] for b in raw], np.int32)]
                last = k + 1
            parts.append(ids[last:])
            place = self._spread(place, low, cp)
            ids = np.concatenate(parts)
        return ids, np.diff(np.searchsorted(place, text_at + size), prepend=0)

    @staticmethod
    def _equal_units(cp, first, lens, pos, name) -> tuple[np.ndarray, np.ndarray]:
        """The units, short ones first and equal ones next to one another, and which of them
        begin a new group.  A unit that only shares its group's name stands alone."""
        alone = np.zeros(len(first), int)
        while True:
            members = np.lexsort((alone, name, lens))
            new = np.concatenate(([True], np.any([x[members[1:]] != x[members[:-1]] for x in (alone, name, lens)], axis=0)))
            leader = np.empty(len(first), int)
            leader[members] = members[new][np.cumsum(new) - 1]
            other = np.logical_or.reduceat(cp != cp[np.repeat(first[leader], lens) + pos], first)
            if not other.any():
                return members, new
            alone[other] = 1 + np.flatnonzero(other)

    @staticmethod
    def _spread(place: np.ndarray, low: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """Places repeated for the bytes of characters without a piece."""
        c = np.where(cp[place] == 0xFFFFFFFF, np.uint64(ord(MARK)), cp[place])
        width = np.where(low, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
        return np.repeat(place, width)

    def _sample_units(self, cp, begin, n, use, row, draw, out_ids, out_unit, out_pos):
        """Forward pass over distinct units of n code points, backward pass over all uses."""
        k = min(self.longest, n)
        units = np.full((len(begin), n + 1), np.uint64(0xFFFFFFFE))  # an end mark after each
        units[:, :n] = cp[begin[:, None] + np.arange(n)]
        ids = self.arcs(units.ravel())[:-1].reshape(len(begin), n + 1, -1)[:, :, :k]
        forward = np.zeros((len(begin), n + 1))
        forward[:, 0] = 1.0
        cdf = np.zeros((len(begin), n + 1, k), np.float32)
        for e in range(1, n + 1):
            m = min(k, e)
            arc = ids[:, e, :m]
            p = self.weight[arc]  # 0 where there is none
            p[:, 0] = np.where(arc[:, 0] >= 0, p[:, 0], self.byte_weight)
            p *= forward[:, e - m : e][:, ::-1]
            np.cumsum(p, axis=1, out=p)
            forward[:, e] = p[:, -1]
            cdf[:, e, :m] = p / p[:, -1:]
            cdf[:, e, m - 1 :] = 2.0
            if e % 8 == 0:  # only the last few matter from here on, and only their ratios
                forward[:, max(0, e - k) : e + 1] /= forward[:, e : e + 1].copy()
        # a piece without weight is never drawn: its step of the sum has no height
        at, who, r, step = np.full(len(use), n), use, row, 0
        while len(who):
            u = (mix(draw[who] + np.uint64((step + 1) * int(GOLDEN) & (1 << 64) - 1)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            w = (cdf[r, at] <= u[:, None]).sum(axis=1) + 1
            lasting = at - w
            got = ids[r, at, w - 1]
            # rounding at the top of the sum: fall back to the longest drawable piece
            bad = (got < 0) & (w > 1)
            while bad.any():
                w[bad] -= 1
                lasting = at - w
                got = ids[r, at, w - 1]
                bad = (got < 0) & (w > 1)
            out_ids.append(got)
            out_unit.append(who)
            out_pos.append(lasting)
            going = lasting > 0
            at, who, r, step = lasting[going], who[going], r[going], step + 1

    def _block(self, cp, low, high, before):
        """Of a block's ends low + 1 to high: where each one's arcs begin in the lists of
        lengths, ids and weights; forward sums from ``longest`` places before the block on, as
        (value, power of two), so that sums of any size are exact relative to each other."""
        base = max(0, low - self.longest)
        ids = self.arcs(cp[base:high])[low - base + 1 :]
        lone = ids[:, 0] < 0  # a character without a piece
        end, n = np.nonzero(ids >= 0)
        end, n, got = np.concatenate([end, np.flatnonzero(lone)]), np.concatenate([n + 1, np.ones(int(lone.sum()), int)]), np.concatenate([ids[end, n], np.full(int(lone.sum()), -1, np.int32)])
        order = np.lexsort((n, end))
        at = np.searchsorted(end[order], np.arange(high - low + 1)).tolist()
        n, got = n[order].tolist(), got[order]
        w = np.where(got < 0, self.byte_weight, self.weight[got]).tolist()
        value, power = ([x for x, _ in before], [p for _, p in before])
        shift, now = len(before), before[-1][1]
        for e in range(high - low):
            total = 0.0
            for i in range(at[e], at[e + 1]):
                j = shift + e - n[i]
                v = value[j]
                if power[j] != now:
                    v = math.ldexp(v, power[j] - now)
                total += w[i] * v
            if total < 1e-150:
                now -= 400
                total = math.ldexp(total, 400)
            value.append(total)
            power.append(now)
        return at, n, got.tolist(), w, value, power

    def _sample_long(self, cp, use, draw, out_ids, out_unit, out_pos):
        """The same two passes over one unit too long for tables: forward by blocks, of which
        only the last few sums before each are kept, then backward from block to block, whose
        sums are made again from these.  Memory follows the block, time the unit."""
        size, k = len(cp), self.longest
        lows = list(range(0, size, LONG_UNIT))
        kept, before = [], [(1.0, 0)]
        for low in lows:
            kept.append(before)
            *_, value, power = self._block(cp, low, min(size, low + LONG_UNIT), before)
            before = list(zip(value[-k:], power[-k:]))
        at, step, base = [size] * len(use), [0] * len(use), [int(draw[u]) for u in use]
        found = [([], []) for _ in use]
        for low, before in zip(reversed(lows), reversed(kept)):
            arc, n, ids, w, value, power = self._block(cp, low, min(size, low + LONG_UNIT), before)
            shift = len(before)
            for m, (got, places) in enumerate(found):
                e, s = at[m], step[m]
                # the draws of all steps that the block may have
                many = np.uint64(base[m]) + np.arange(s + 1, s + 2 + e - low, dtype=np.uint64) * GOLDEN
                draws = ((mix(many) >> np.uint64(40)) / float(1 << 24)).tolist()
                first = s
                while e > low:
                    i, stop, now = arc[e - low - 1], arc[e - low], power[shift + e - low - 2]
                    parts = [w[j] * math.ldexp(value[shift + e - low - 1 - n[j]], power[shift + e - low - 1 - n[j]] - now) for j in range(i, stop)]
                    left = draws[s - first] * sum(parts)
                    last = i
                    for j, p in zip(range(i, stop), parts):
                        if p > 0:
                            last = j
                            left -= p
                            if left < 0:
                                break
                    e -= n[last]
                    got.append(ids[last])
                    places.append(e)
                    s += 1
                at[m], step[m] = e, s
        for u, (got, places) in zip(use, found):
            out_ids.append(np.array(got, np.int32))
            out_unit.append(np.full(len(got), u))
            out_pos.append(np.array(places))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of sequences of piece ids that lie one after another up to ``ends``."""
        size = self.piece_size[ids]
        last = np.cumsum(size)
        at = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(self.piece_at[ids] - (last - size), size)
        raw = self.piece_bytes[at].tobytes()
        cut = [0, *np.concatenate(([0], last))[ends]]
        return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(cut, cut[1:])]


_loaded: dict = {}


def lattice(model_file: str, **how) -> Lattice:
    """One lattice for each Python worker."""
    key = (model_file, tuple(sorted(how.items())))
    if key not in _loaded:
        _loaded[key] = Lattice(model_file, **how)
    return _loaded[key]


def encode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", seed: int = 0, decoded: str | None = None, **how) -> DataFrame:
    """``docs`` with ``piece_ids``, a sampled segmentation of ``text`` that the seed and the
    row's key fix, and on request the text that the pieces decode to, made in the same pass.
    Null texts: null; empty texts: no pieces; a null key is the key 0; rows with equal keys
    and texts get equal pieces.  Columns named like a new one are replaced, others pass
    through; an empty table gives no rows.  The model file must be on every machine (or be
    sent to all with ``spark.files``)."""
    base = [c for c in docs.columns if c not in ("piece_ids", decoded)]
    at, name = base.index(text), free_name("key", base)
    src = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in base], F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias(name))
    schema = extended(src.drop(name).schema, "piece_ids array<int>" + (f", `{decoded}` string" if decoded else ""))

    def run(batches):
        lat = lattice(model_file, **how)
        for batch in batches:
            keys = batch.column(len(base)).to_numpy(zero_copy_only=False).view(np.uint64)
            for first, texts in batches_of_texts(batch.column(at), 1 << 20):
                null = np.array(batch.column(at).slice(first, len(texts)).is_null())
                flat, size = lat.sample(texts, keys[first : first + len(texts)], seed)
                ends = np.cumsum(size)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat), mask=pa.array(null))
                more = [pa.array(lat.decode(flat, ends), pa.string(), mask=null)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:-1]), ids, *more], names=[*base, "piece_ids", *([decoded] if decoded else [])])

    return src.mapInArrow(run, schema)


def decode(docs: DataFrame, model_file: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of the piece ids as ``to``; null ids: null, no ids: an empty
    text.  A column named ``to`` is replaced, others pass through; repeated rows are decoded
    each, an empty table gives no rows."""
    base = [c for c in docs.columns if c != to]
    at = base.index(ids)
    src = docs.select(*[F.col(f"`{c}`") for c in base])
    schema = extended(src.schema, f"`{to}` string")

    def run(batches):
        lat = lattice(model_file)
        for batch in batches:
            column = batch.column(at)
            size = np.array(column.value_lengths().fill_null(0), np.int64)
            texts = lat.decode(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size))
            got = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*base, to])

    return src.mapInArrow(run, schema)
