"""b-bit MinHash near-duplicates of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set holds its distinct
five-word shingles (a shorter text is one shingle; a text without words has an empty set
and is linked with nothing).  Texts with equal sets are one class.  Classes meet as
candidates when a band of their minima agrees; of each minimum two low bits are kept and
packed, and the collision-corrected similarity that their bit counts give drops candidates
far below the threshold.  The rest is confirmed on the full sets.

Within a band bucket not all pairs are made.  First all members are held against the
bucket's most central class (the one with the largest buckets over all bands, such as the
text that the others are copies of).  Buckets that then lie in several components are
finished by prefix filtering on the full sets: of two classes that need ``k`` shared
shingles for the threshold, the first common one is among the ``m - k + 1`` rarest of the
``m`` shared shingles of either, and what lies after it must suffice.  So a class outside a
bucket's largest component is held against those only that meet it so, and no link that
could join two components is left out, however large a bucket is.  A pair of similarity 0.85
shares none of the 32 bands of six rows with a probability of 3e-7; the bit-count filter
stands six deviations below the threshold.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_texts, extended, mix, row_places, staged, words_by_text
from .components import connected_components

BANDS, ROWS, BITS = 32, 6, 2
MINIMA = BANDS * ROWS
#: Texts that are held against one sending of a text.
PARTNERS = 200
_rng = np.random.default_rng(20240229)
SHINGLE_KEYS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PERM_MUL = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
PERM_XOR = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
BAND_KEYS = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return mix(np.array([(words * SHINGLE_KEYS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    s = words[: n - width + 1] * SHINGLE_KEYS[0]
    for j in range(1, width):
        s = s + words[j : n - width + 1 + j] * SHINGLE_KEYS[j]
    return np.unique(mix(s))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the permutations over a set, in blocks of the set."""
    h, best = (shingles >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(h), 2048):
        m = ((h[None, i : i + 2048] ^ PERM_XOR) * PERM_MUL).min(axis=1)
        best = m if best is None else np.minimum(best, m)
    return best


def set_hash(shingles: np.ndarray) -> np.uint64:
    return mix(shingles.sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + np.bitwise_xor.reduce(shingles, keepdims=True) + np.uint64(len(shingles)))[0]


def _packed(low: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, 32 to a 64-bit word."""
    bits = (low & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def _signatures(batches):
    for batch in batches:
        for first, texts in batches_of_texts(batch.column(2)):
            rows = []
            for words in words_by_text(texts):
                s = shingle_set(words)
                if len(s) == 0:
                    rows.append((0, None, None, None))
                    continue
                m = minima(s)
                band = mix((m.reshape(BANDS, ROWS).astype(np.uint64) * BAND_KEYS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                rows.append((len(s), int(set_hash(s).view(np.int64)), band.view(np.int64), _packed(m).view(np.int64)))
            n, node, bands, sketch = zip(*rows)
            keys = [c.slice(first, len(texts)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "place", "n_shingles", "node", "bands", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, n_shingles, node, bands, sketch)`` of the rows of ``docs(doc_id,
    place, text)``; ``node`` names the set."""
    schema = extended(docs.select("doc_id", "place").schema, "n_shingles long, node long, bands array<long>, sketch array<long>")
    return docs.select("doc_id", "place", "text").mapInArrow(_signatures, schema)


def _confirm(percent: int):
    """Over rows ``(center, node, text)`` that begin with the center's own, for each center:
    the nodes whose sets meet the threshold with the center's.  One set is held."""

    def confirm(batches):
        held, center = None, None
        for batch in batches:
            of, node, a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for first, texts in batches_of_texts(batch.column(2)):
                for i, words in enumerate(words_by_text(texts), first):
                    s = shingle_set(words)
                    if node[i] == of[i]:
                        held, center = s, of[i]
                    elif center == of[i]:
                        both = len(np.intersect1d(held, s, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(s) - both):
                            a.append(node[i])
                            b.append(center)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm


def _shingle_rows(batches):
    for batch in batches:
        node = batch.column(0).to_numpy()
        for first, texts in batches_of_texts(batch.column(1), 1 << 20):
            sets = [shingle_set(w) for w in words_by_text(texts)]
            size = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[first : first + len(texts)], size)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "h"])


def estimated_similarity(x: str, y: str):
    """Collision-corrected similarity of two packed sketches, from bit counts."""
    words = MINIMA * BITS // 64
    differ = None
    for i in range(words):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = d if differ is None else differ + d
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows ``(doc_id, place, n_shingles, component_id, kept, chosen)``, one for each row of
    ``docs``; ``place`` is the row's place in its table (see ``row_places``).

    Two texts are linked if ``100 * intersection >= percent * union`` of their sets;
    ``component_id`` is the least doc_id that links reach, ``kept`` says that it is the
    row's own, and ``chosen`` is true for exactly one row of each group of linked texts,
    the one with the least doc_id and place.  Null or blank texts: no shingles, linked with
    nothing, kept and chosen.  Rows that share a doc_id are judged by their own texts.  A
    null doc_id comes after all others: its texts are linked like any other, and
    ``component_id`` is null where a group has no doc_id.  An empty table gives no rows;
    other columns are ignored."""
    threshold = percent / 100
    match = threshold + (1 - threshold) * 2.0**-BITS
    least_estimate = threshold - 6 * math.sqrt(match * (1 - match) / MINIMA) / (1 - 2.0**-BITS)
    rows = row_places(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = staged(signatures(rows), "signatures")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    nodes = sig.filter("node is not null").groupBy("node").agg(F.min(own).alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = staged(nodes, "nodes")
    member = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    # what is aggregated by bucket is staged before it is joined, so that joins of large buckets can be split
    size = staged(member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "bucket_sizes")
    member = staged(member.join(size, "bucket"), "members")
    weight = member.groupBy("node").agg(F.sum("size").alias("weight"))
    center = staged(member.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("center")), "centers")
    first = member.join(center, "bucket").filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    sketch = nodes.select("node", "n", "sketch")

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(sketch.toDF("b", "nb", "sb"), "b").join(sketch.toDF("a", "na", "sa"), "a")
        return pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).filter(estimated_similarity("sa", "sb") >= least_estimate).select("a", "b")

    met = member.select("node").distinct().join(nodes.select("node", "rep.place"), "node")
    text = staged(rows.select("place", "text").join(met, "place").select("node", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The text of b is sent once for each ``PARTNERS`` of its pairs, before theirs."""
        load = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
        load = staged(load, "loads")
        lead = load.join(text.toDF("b", "text"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"), "text", F.lit(0).alias("turn"))
        other = pairs.join(load, "b").select("b", F.pmod(F.xxhash64("a"), "parts").alias("part"), F.col("a").alias("node")).join(text, "node").select("b", "part", "node", "text", F.lit(1).alias("turn"))
        both = lead.unionByName(other).repartition("b", "part").sortWithinPartitions("b", "part", "turn")
        return both.select("b", "node", "text").mapInArrow(_confirm(percent), "a long, b long")

    links = staged(confirmed(staged(candidates(first), "pairs")), "links")
    component = connected_components(links).transform(staged, "components")
    state = staged(member.join(component, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c")), "states")
    split = staged(state.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).filter("lo <> hi"), "split")
    state = staged(state.join(split.select("bucket", "least"), "bucket"), "open")
    if state.take(1):
        largest = staged(state.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main")), "mains")
        own = state.join(largest, "bucket").groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.min("least").alias("least"), F.bool_or(F.col("c") != F.col("main")).alias("asks"))
        sets = staged(text.join(own.select("node"), "node", "left_semi").mapInArrow(_shingle_rows, "node long, h long"), "open_sets")
        common = staged(sets.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "shared_shingles")
        sets = staged(sets.join(common, "h"), "open_sets")
        shared = sets.groupBy("node").agg(F.count("*").alias("m"))
        need = F.ceil((F.col("n") + F.col("least")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
        own = staged(own.join(shared, "node").withColumn("prefix", F.col("m") - need + 1).filter("prefix > 0").drop("least"), "open_nodes")
        rarest = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
        prefix = staged(sets.join(own, "node").withColumn("at", rarest).filter("at <= prefix").select("h", "node", "n", "c", "m", "at", "asks"), "prefixes")
        side = lambda rows, x: rows.select("h", F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "c", "m", "at")))
        # what both can share from their first common shingle on
        both = F.least(F.col("ma") - F.col("ata"), F.col("mb") - F.col("atb")) + 1
        met = side(prefix.filter("asks"), "b").join(side(prefix, "a"), "h").filter((F.col("ca") != F.col("cb")) & (both * 100 >= (F.col("na") + F.col("nb") - both) * percent))
        more = staged(confirmed(staged(candidates(met.select("a", "b")), "pairs")), "links")
        component = connected_components(links.unionByName(more)).transform(staged, "components")
    labelled = nodes.select("node", "rep").join(component, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = staged(labelled.groupBy("c").agg(F.min("rep").alias("least")), "least")
    label = labelled.join(least, "c").select("node", "least")
    found = sig.select("doc_id", "place", "n_shingles", "node")
    full = found.filter("node is not null").join(label, "node").select("doc_id", "place", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("least.place") == F.col("place")).alias("chosen"))
    blank = found.filter("node is null").select("doc_id", "place", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    return full.unionByName(blank).select("doc_id", "place", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "chosen")
