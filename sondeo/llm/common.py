"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MIX_1, MIX_2, GOLDEN = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.
    Where the session names none: a temporary folder of this machine if Spark runs on it
    alone (local tests), else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts the
    lineage, is computed once, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, *taken) -> str:
    """``name``, with underscores before it until no column of these lists is called so."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = "_" + name
    return name


def shielded(docs: DataFrame, work, own: tuple[str, ...], add: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``work(docs)`` with the columns of ``docs`` and those named in ``add``.
    All columns but ``own`` have other names meanwhile, so that none clashes with a column
    that ``work`` makes."""
    hidden = {c: c if c in own else f"c{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items())))
    return out.select(*(F.col(h).alias(c) for c, h in hidden.items()), *add)


def filed(docs: DataFrame) -> DataFrame:
    """``docs`` as rows that are read from files: staged first, if they aren't."""
    try:
        docs.select(docs.metadataColumn("_metadata"))
        return docs
    except AnalysisException:
        return staged(docs, "rows")


def row_places(docs: DataFrame, *columns, to: str = "place") -> DataFrame:
    """The columns and ``to``, the row's place in the table's files, which no two rows
    share: a hash of the file's name and the row's number in it.  What isn't read from
    files is staged first; a frame that explodes the rows of files must be staged by its maker."""
    docs = filed(docs)
    of = docs.metadataColumn("_metadata")
    return docs.select(*columns, F.struct(F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("row")).alias(to))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, P, P**2 ... modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 4096), GOLDEN, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers


def hash_words(buf: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 buffer and their byte offsets.  The
    buffer is read in blocks that end at white space, so memory follows the block."""
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + BLOCK)
        while end < len(buf) and not WORD_SPACE[buf[end]]:
            end = min(len(buf), end + 64) if not WORD_SPACE[buf[end : end + 64]].any() else end + int(np.argmax(WORD_SPACE[buf[end : end + 64]]))
        part = buf[at:end]
        inside = ~WORD_SPACE[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            lens = last - first
            chars = part[inside]
            if lower:
                chars = LOWER[chars]
            begin = np.cumsum(lens) - lens
            pos = np.arange(len(chars)) - np.repeat(begin, lens)
            value = (chars.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[pos]
            hashes.append(mix(np.add.reduceat(value, begin) + lens.astype(np.uint64) * MIX_1))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def batches_of_texts(texts, most: int = 4 << 20):
    """Runs ``(first, [bytes, ...])`` of a batch's texts with about ``most`` bytes each
    (null: empty), so that working memory follows this bound or one long text."""
    first, run, held = 0, [], 0
    for i, t in enumerate(texts):
        b = t.as_py() if hasattr(t, "as_py") else t
        b = b"" if b is None else b.encode("utf-8", "surrogatepass") if isinstance(b, str) else b
        if run and held + len(b) > most:
            yield first, run
            first, run, held = i, [], 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def words_by_text(texts: list[bytes], lower: bool = True) -> list[np.ndarray]:
    """The word hashes of each text, hashed in one go."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    h, s = hash_words(buf, lower)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(s, ends[:-1]))


def extended(schema: StructType, ddl: str) -> StructType:
    """The fields of a schema and those of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def held_out(doc_id="doc_id"):
    """True for the fifth of rows (by crc32 of the id as text) that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def share_by_hash(key, salt: int = 7):
    """A number in [0, 1) from a key, the same in every run and partitioning."""
    return (F.xxhash64(key, F.lit(salt)) / F.lit(2.0**64)) + F.lit(0.5)
