"""Helpers shared by the corpus operators: vectorised hashing, folds, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WORD = 0xD6E8FEB86659FD93 | 1
#: Rows of texts that a worker turns into Python objects at a time.
SLICE = 256
_pows: dict[str, np.ndarray] = {}
_alnum = np.zeros(0, dtype=bool)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}
#: Spark deletes the shuffle files of a query at its end, not when the driver's memory is collected some day.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where none is set a folder of this machine serves a local session; on a cluster that is an error,
    since each executor would write to a disk of its own and rows would be lost.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if context.applicationId not in _local:
        import atexit
        import shutil
        import tempfile

        path = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local[context.applicationId] = "file://" + path
    return _local[context.applicationId]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lineage ends there. ``discard``
    deletes what nothing reads any more; what a result reads stays in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")  # for this write alone: nothing reads its shuffles again
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``cut`` has made and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: The columns that tell a stored row from all others, whatever its values.
ROW = ("__file", "__row")


def with_rows(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(stored, keyed): ``docs`` as files hold it, and ``columns`` of it (all, if none) with the key
    ``ROW`` of each row: a hash of its file's path, and its place there. A frame that is no plain scan of
    Parquet files is written once, since only stored rows keep their places when tasks run again."""
    key = [F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1])]
    own = list(columns or docs.columns)
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet":
        return docs, docs.select(*key, *own)
    stored = cut(docs, "rows")
    return stored, stored.select(*key, *own)


def heavy_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, most: int = 1000) -> DataFrame:
    """The inner join of ``rows`` with ``keyed`` (unique in ``on``), whose column ``weight`` says how many
    rows a key has. Keys of more than one row in ``most`` of the ``total`` are fewer than ``most`` and are
    broadcast; so a key that is shuffled has at most that share of all rows."""
    hot = keyed.where(F.col(weight) * most > total)
    first = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(weight) * most <= total).hint("shuffle_merge"), on)
    return first.unionByName(rest)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols: Column) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows.get("up", ())) < n:
        size = max(1 << 14, 1 << n.bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _pows[name] = np.multiply.accumulate(full)
    return _pows["up"], _pows["down"]


def alnum(points: np.ndarray) -> np.ndarray:
    """Which code points ``str.isalnum`` accepts."""
    global _alnum
    if not len(_alnum):
        _alnum = np.fromiter((chr(i).isalnum() for i in range(1 << 17)), dtype=bool, count=1 << 17)
    return np.take(_alnum, points, mode="clip")


def _words(lowered: str) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Where words begin and end in the lower-cased text, and a hash of its spans."""
    c = codepoints(lowered)
    m = np.zeros(len(c) + 2, dtype=np.int8)
    m[1:-1] = alnum(c)
    edge = np.diff(m)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=total[1:])
    return start, end, lambda a, b: mix((total[b] - total[a]) * down[a])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each maximal run of letters and digits of the lower-cased text."""
    start, end, hashed = _words(text.lower())
    return hashed(start, end)


def word_and_prefix_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words, and of the beginnings, of so many characters, of longer words."""
    start, end, hashed = _words(text.lower())
    out = [hashed(start, end)]
    for n in sizes:
        long = start[end - start > n]
        out.append(mix(hashed(long, long + n) ^ np.uint64(n)))
    return np.concatenate(out)


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """A hash for each run of ``width`` words, in text order.

    A text of fewer words is one shingle of all its words; a text without any word is one
    shingle of its characters; an empty text has none.
    """
    w = word_hashes(text)
    if not len(w):
        if not text:
            return np.zeros(0, dtype=np.uint64)
        c = codepoints(text).astype(np.uint64) + np.uint64(1)
        return mix(np.sum(c * _powers(len(c))[0][: len(c)], dtype=np.uint64, keepdims=True))
    return _shingled(w, width)


def _shingled(w: np.ndarray, width: int) -> np.ndarray:
    n = max(1, len(w) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for j in range(min(width, len(w))):
        out += w[j : j + n] * np.uint64(factor)
        factor = factor * _WORD % (1 << 64)
    return mix(out)


def text_slices(texts: list[str], most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """From where to where ``texts`` are no more than ``most`` characters, or a single text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def shingles_of(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``shingle_hashes`` of each of ``texts``, one after the other, and where each one's begin and the last end.
    All are hashed at once: callers give a slice of texts."""
    lowered = [text.lower() for text in texts]  # one by one: it may change their lengths
    start, end, hashed = _words("\n".join(lowered))
    w = hashed(start, end)
    number = np.diff(np.searchsorted(start, np.cumsum([len(text) + 1 for text in lowered])), prepend=0)
    of, size = np.repeat(np.arange(len(texts)), number), np.maximum(number - width + 1, 0)
    out = _shingled(w, width)[of[: len(of) - width + 1] == of[width - 1 :]] if len(w) >= width else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero(size == 0)
    if len(short):
        few = [shingle_hashes(texts[i], width) for i in short]
        n = [len(x) for x in few]
        out = np.insert(out, np.repeat(np.cumsum(size)[short], n), np.concatenate(few))
        size[short] = n
    return out, np.append(0, np.cumsum(size))


def run_hashes(h: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` numbers of ``h`` from each of ``begin``, each from two sums over all before it."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h) * up[: len(h)], out=total[1:])
    return mix((total[begin + length] - total[begin]) * down[begin])


def tree_parents(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For the members of runs (``start``, ``size``), the place of each one's parent in a binary tree over
    its run, so that a run holds together and no member has more than three neighbours."""
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    return np.repeat(start, size) + np.maximum(place - 1, 0) // 2


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least node of each set of nodes that edges connect to its others: as many as they need."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            some = label != np.arange(len(nodes))
            return nodes[label[some]], nodes[some]
        label = new


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """``f`` over slices of ``rows`` rows of Arrow batches, without shuffles: what a worker holds beside
    the batch, its texts as Python strings and the results, is that of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                out = f(batch.slice(k, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
