"""What the operators of this package share: tables, written intermediate results, words."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.session import materialise

#: Rows of ids (or other rows of a few numbers) up to which a counted side may be broadcast: 8 MB of longs.
BROADCAST_ROWS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: jobs that follow survive lost executors."""
    return materialise(df)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored side of a join, marked for broadcast when its counted rows are within the bound.

    Beyond the bound Spark's own choice (a shuffled join) stands.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_of(column: str = "text") -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    For texts of ASCII characters alone ``lower`` does that and is far faster.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_texts(docs: DataFrame, id_column: str, text_column: str, columns: dict[str, tuple[str, pa.DataType]], make: Callable, rows: int | None = None) -> DataFrame:
    """doc_id and ``columns`` (name: Spark type, Arrow type) made from texts in Arrow batches, ``rows`` texts at a time if given.

    ``make()`` is called once per task and gives a function from a list of texts (NULL is None) to a DataFrame with a
    row per text, or with a column ``at`` that names the text of each row. Ids pass as they are, NULLs included.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{name} {spark_type}" for name, (spark_type, _) in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in [whole] if rows is None else (whole.slice(k, rows) for k in range(0, len(whole), rows)):
                ids, made = batch.column(0), work(batch.column(1).to_pylist())
                if "at" in made:
                    ids = ids.take(pa.array(made["at"], pa.int64()))
                arrays = [pa.array(made[name], type=arrow, from_pandas=True) for name, (_, arrow) in columns.items()]
                yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *columns])

    picked = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, place: str, n: int) -> DataFrame:
    """At most ``n`` rows of a stored table, the first by the hash column ``place``.

    Rows beyond a share of the hashes that holds twice as many are left where they are, so tasks do not
    each send ``n`` rows to be compared.
    """
    total = df.count()
    near = df.where(F.pmod(F.col(place), F.lit(1 << 20)) < F.lit((1 << 21) * n // total)) if total > 2 * n else df
    return near.orderBy(F.pmod(F.col(place), F.lit(1 << 20)), place).limit(n)


def row_identity(id_column: str, text_column: str) -> Column:
    """struct(no_id, id, k1, k2): what a row is known by where its id may be NULL or stand on several texts."""
    own, text = F.col(f"`{id_column}`"), text_of(f"`{text_column}`")
    return F.struct(own.isNull().alias("no_id"), own.alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def crc_mod(number: Column, modulus: int) -> Column:
    """crc32 of the number's decimal text, modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of texts without NULLs, and the place where each text begins, with the end."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs_of_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes together; a longer text is a range of its own."""
    _, at = bytes_of(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last
