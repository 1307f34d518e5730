"""Line dedup through a sharded minimal perfect hash.

Lines are counted by a 128-bit hash: batches of documents are packed once, each distinct line of a batch with the number of
its documents and their largest id, and the counts of batches are summed. The lines that stand in enough documents
are dealt into shards. A shard is a minimal perfect hash of its lines (levels of bits: a line that is alone at its bit
is placed, the others go on to the next level; its slot is the number of bits before its own) with three arrays
by slot: a 64-bit fingerprint of the line, the number of its documents, and the largest id. Batches send their distinct
lines to the shards, packed, and a task that holds one shard after the other probes its arrays, so no line is joined
with a line. What a line that was not indexed meets is a foreign fingerprint. A line that a third of all documents
hold is one probe per batch; shards, batches and the lines of a batch are bounded, and nothing passes through the driver but
two counts.

A line's key is the line without white space at its ends, A-Z in lower case; keys of fewer than ``least_chars`` code points never
go. Each row is a document. NULL and the empty text have one empty line. A row without an id counts as a document, and its id
as smaller than any other; rows that hold the largest id, or an equal one, keep their lines (all rows, if
none has an id). Repeated rows are counted and treated each. An empty table gives an empty result; other columns stay as they are.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from auditframe.llm.base import fresh, mix, runs_of_bytes, stored, table, text_of
from auditframe.llm.registry import query

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of texts in a packed batch, and the probes that a shard is made for.
BATCH, PROBES = 4 << 20, 1 << 22
#: Bits per line and level.
SPARSE = 2


def line_hash(line: bytes, least_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None where the key is too short."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or (len(key) < 4 * least_chars and not key.isascii() and len(key.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def halves(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def joined(high: np.ndarray, low: np.ndarray) -> bytes:
    return np.stack([high, low], axis=1).tobytes()


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys, as levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # each an array of booleans
        self.before = [np.concatenate([[0], np.cumsum(level)]) for level in levels]
        self.first = np.concatenate([[0], np.cumsum([int(b[-1]) for b in self.before])])

    @staticmethod
    def bit(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(low + mix(high + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            size = SPARSE * len(high) + 1
            at = cls.bit(high, low, len(levels), size)
            level = np.bincount(at, minlength=size) == 1
            levels.append(level)
            rest = ~level[at]
            high, low = high[rest], low[rest]
        return cls(levels)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not indexed, any slot, or -1."""
        found = np.full(len(high), -1, np.int64)
        rest = np.arange(len(high))
        for k, level in enumerate(self.levels):
            at = self.bit(high[rest], low[rest], k, len(level))
            placed = level[at]
            found[rest[placed]] = self.first[k] + self.before[k][at[placed]]
            rest = rest[~placed]
        return found

    def packed(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return sizes + b"".join(np.packbits(level).tobytes() for level in self.levels)

    @classmethod
    def unpacked(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes:
            width = -(-int(size) // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        return cls(levels)


def fingerprint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits of a key that its slot does not follow from."""
    return mix(high ^ mix(low))


def row_key(text_column: str) -> list:
    """Two independent hashes that stand for the text when rows are matched by id and text."""
    return [F.xxhash64(text_of(text_column)).alias("k1"), F.xxhash64(F.lit(1), text_of(text_column)).alias("k2")]


def pack(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """A stored row per batch of documents: ids and keys of those with lines to count, the batch's distinct line
    hashes, and for every document the places of its lines among them."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"batch string, ids array<{kind}>, k1 array<bigint>, k2 array<bigint>, ends binary, places binary, hashes binary, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1)
            for a, b in runs_of_bytes(texts, BATCH):
                known: dict[bytes, int] = {}
                takers, places, ends = [], [], []
                for k, text in enumerate(texts.slice(a, b - a).cast(pa.binary()).to_pylist()):
                    if len(text) < least_chars:
                        continue
                    found = {h for line in text.split(b"\n") if len(line) >= least_chars and (h := line_hash(line, least_chars))}
                    if found:
                        places.extend(known.setdefault(h, len(known)) for h in found)
                        takers.append(a + k)
                        ends.append(len(places))
                if takers:
                    ids, *keys = (pa.ListArray.from_arrays(pa.array([0, len(takers)], pa.int32()), rows.column(c).take(pa.array(takers))) for c in (0, 2, 3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uuid.uuid4().hex]), ids, *keys, pa.array([np.array(ends, np.int32).tobytes()]), pa.array([np.array(places, np.int32).tobytes()]),
                         pa.array([b"".join(known)], pa.binary()), pa.array([len(known)], pa.int64())],
                        ["batch", "ids", "k1", "k2", "ends", "places", "hashes", "n"],
                    )

    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_of(f"`{text_column}`").alias("text"), *row_key(f"`{text_column}`"))
    return stored(rows.mapInArrow(run, schema))


def postings(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a packed batch: the ids, and for each posting the place of its document and that of its line."""
    ends = np.frombuffer(batch.column("ends")[row].as_py(), np.int32)
    return batch.column("ids")[row].values, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.frombuffer(batch.column("places")[row].as_py(), np.int32)


def counts(packed: DataFrame, kind: str) -> DataFrame:
    """high, low, n (documents), last (largest id) of every distinct line; batches are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, document, place = postings(batch, row)
                found = pa.table({"place": place, "id": ids.take(pa.array(document))}).group_by("place").aggregate([("id", "max"), ([], "count_all")])
                high, low = halves(batch.column("hashes")[row].as_py())
                at = found["place"].to_numpy()
                columns = [pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), found["count_all"].combine_chunks(), found["id_max"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "n", "last"])

    lines = packed.select("ids", "ends", "places", "hashes").mapInArrow(run, f"high bigint, low bigint, n bigint, last {kind}")
    return lines.groupBy("high", "low").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


SHARD_ROW = "shard int, kind int, batch string, places binary, one binary, two binary, three binary, last array<{}>"


def index(lines: DataFrame, shards: int, kind: str) -> DataFrame:
    """A row per shard of ``lines`` (high, low, n, last): the perfect hash and the arrays by slot."""

    def build(group: pa.Table) -> pa.Table:
        high, low = (group[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        perfect = PerfectHash.of(high, low)
        order = np.argsort(perfect.slots(high, low))
        last = group["last"].combine_chunks().take(pa.array(order))
        return pa.table({
            "shard": group["shard"].slice(0, 1), "kind": pa.array([0], pa.int32()), "batch": pa.array([None], pa.string()), "places": pa.array([None], pa.binary()),
            "one": pa.array([perfect.packed()], pa.binary()), "two": pa.array([fingerprint(high, low)[order].tobytes()], pa.binary()),
            "three": pa.array([group["n"].to_numpy()[order].tobytes()], pa.binary()), "last": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), last),
        })

    dealt = lines.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "high", "low", "n", "last")
    return dealt.groupBy("shard").applyInArrow(build, SHARD_ROW.format(kind))


def probes(packed: DataFrame, shards: int, kind: str) -> DataFrame:
    """A row per batch and shard with the batch's distinct lines of the shard."""
    last = pa.list_(to_arrow_type(packed.schema["ids"].dataType.elementType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                high, low = halves(batch.column(1)[row].as_py())
                shard = high.view(np.int64) % shards
                order = np.argsort(shard, kind="stable").astype(np.int32)
                parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
                n, none = len(parts), [None] * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([1] * n, pa.int32()), pa.array([batch.column(0)[row].as_py()] * n),
                     pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([high[p].tobytes() for p in parts], pa.binary()),
                     pa.array([low[p].tobytes() for p in parts], pa.binary()), pa.array(none, pa.binary()), pa.nulls(n, last)],
                    ["shard", "kind", "batch", "places", "one", "two", "three", "last"],
                )

    return packed.select("batch", "hashes").mapInArrow(run, SHARD_ROW.format(kind))


def answers(rows: DataFrame, least_documents: int, kind: str) -> DataFrame:
    """batch, places and last of the lines found in the shards.

    ``rows`` are shards and probes; in a task they come shard by shard, the shard's arrays first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = perfect = prints = number = last = None
        for batch in batches:
            for row in range(len(batch)):
                own, what, name, places, one, two, three = (batch.column(c)[row].as_py() for c in range(7))
                if what == 0:
                    shard, perfect, prints, number = own, PerfectHash.unpacked(one), np.frombuffer(two, np.uint64), np.frombuffer(three, np.int64)
                    last = batch.column(7)[row].values
                elif own == shard:
                    high, low = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                    slot = perfect.slots(high, low)
                    hit = np.flatnonzero((slot >= 0) & (prints[slot] == fingerprint(high, low)) & (number[slot] >= least_documents))
                    if len(hit):
                        kept = pa.ListArray.from_arrays(pa.array([0, len(hit)], pa.int32()), last.take(pa.array(slot[hit])))
                        at = np.frombuffer(places, np.int32)[hit]
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.tobytes()], pa.binary()), kept], ["batch", "places", "last"])

    return rows.mapInArrow(run, f"batch string, places binary, last array<{kind}>")


def lost_lines(packed: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """doc_id, k1, k2, lost (packed line hashes) of every document that loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, document, place = postings(batch, row)
                answer = batch.column("found")[row].values
                at = np.concatenate([np.frombuffer(p, np.int32) for p in answer.field("places").to_pylist()])
                holder = pa.chunked_array([part.values for part in answer.field("last")]).combine_chunks()
                slot = np.full(int(place.max()) + 1, -1, np.int64)
                slot[at] = np.arange(len(at))
                hit = np.flatnonzero(slot[place] >= 0)
                document, place = document[hit], place[hit]
                own, largest = ids.take(pa.array(document)), holder.take(pa.array(slot[place]))
                same = pc.fill_null(pc.equal(own, largest), pc.and_(pc.is_null(own), pc.is_null(largest)))
                go = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
                if not len(go):
                    continue
                high, low = halves(batch.column("hashes")[row].as_py())
                takers, begin = np.unique(document[go], return_index=True)
                lost = [joined(high[part], low[part]) for part in np.split(place[go], begin[1:])]
                taken = pa.array(takers)
                keys = [batch.column(c)[row].values.take(taken) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([ids.take(taken), *keys, pa.array(lost, pa.binary())], ["doc_id", "k1", "k2", "lost"])

    both = packed.join(found.groupBy("batch").agg(F.collect_list(F.struct("places", "last")).alias("found")), "batch")
    return both.select("ids", "k1", "k2", "ends", "places", "hashes", "found").mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, lost binary")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, k1, k2, lost: the hashes of the lines that each document (by id and text) loses."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    packed = pack(docs, id_column, text_column, least_chars)
    probed = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-probed // PROBES))
    lines = counts(packed, kind).where(F.col("n") >= least_documents)
    both = index(lines, shards, kind).unionByName(probes(packed, shards, kind))
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return lost_lines(packed, answers(dealt, least_documents, kind), kind).dropDuplicates(["doc_id", "k1", "k2"])


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The documents without repeated lines: all columns, the text changed, and n_lines (before) and n_dropped.

    Lines that stand in at least ``least_documents`` documents stay in the one with the largest id only. A NULL text
    that loses nothing becomes the empty text. New columns get a leading underscore where ``docs`` has one of the name.
    """
    lost = stored(repeated_lines(docs, id_column, text_column, least_chars, least_documents))
    names = [fresh(docs, "n_lines"), fresh(docs, "n_dropped")]
    k1, k2, gone = fresh(docs, "_k1"), fresh(docs, "_k2"), fresh(docs, "_lost")
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(f"`{text_column}`")))).withColumn(text_column, text_of(f"`{text_column}`"))
    theirs = lost.select(F.struct("doc_id", "k1", "k2").alias(gone), F.col("lost").alias(f"{gone}_lines"))
    match = F.col(f"`{id_column}`").eqNullSafe(F.col(f"{gone}.doc_id")) & (F.col(k1) == F.col(f"{gone}.k1")) & (F.col(k2) == F.col(f"{gone}.k2"))
    rows = keyed.join(theirs, match, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{gone}_lines").alias(gone))
    own = docs.columns
    at = own.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = batch.column(at).to_pylist(), [], []
            for k, packed in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                n_lines.append(texts[k].count("\n") + 1)
                dropped = 0
                if packed is not None:
                    lines = texts[k].encode().split(b"\n")
                    out = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                    kept = [line for line in lines if len(line) < least_chars or line_hash(line, least_chars) not in out]
                    texts[k], dropped = b"\n".join(kept).decode(), len(lines) - len(kept)
                n_dropped.append(dropped)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*own, *names])

    fields = keyed.select(*[F.col(f"`{c}`") for c in own]).schema.fields
    return rows.mapInArrow(run, StructType([*fields, *[StructField(n, LongType()) for n in names]]))


@query("op11_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> last AS goes FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
