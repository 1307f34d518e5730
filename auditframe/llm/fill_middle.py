"""Fill-in-middle transformation by a displacement scatter.

A text is cut at two token borders into prefix, middle and suffix, and its three parts change places around marks.
All texts of a batch are one array of bytes. One scan finds the borders; a difference array, to which every part adds
its shift where it begins and takes it away where it ends, gives after a cumulative sum the distance that each byte
moves; one scatter writes all outputs. Restoring finds the marks, builds the same shifts, and gathers the
bytes back. Batches are worked on in runs of a bounded number of bytes (a longer text is a run of its own).

The draws are read from SHA-256(seed:id), so they depend on nothing but the id. NULL counts as the empty text;
an empty text, and one that holds a mark, stays as it is (form ``plain``). A NULL id is drawn as an empty one; repeated
rows are cut alike. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auditframe.llm.base import bytes_of, fresh, runs_of_bytes, table, text_of
from auditframe.llm.registry import query

#: Marks of prefix, suffix and middle, all of three bytes.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK = 3
#: The order of the parts in an output.
ORDERS = {"psm": "PSM", "spm": "SPM"}
#: Bytes of text that are worked on at a time.
RUN = 1 << 20
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTER = np.isin(np.arange(256), [ord(c) for c in MARKS])


def borders(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens end, and for every text the number of tokens that end before it (and after the last, all).

    A token is a word with the white space before it, or the white space at a text's end: it ends where white space
    follows a word, and at the text's end.
    """
    blank = BLANK[data]
    ends = ~blank
    ends[:-1] &= blank[1:]
    ends[at[1:][at[1:] > at[:-1]] - 1] = True
    places = np.flatnonzero(ends) + 1
    return places, np.searchsorted(places, at, "right")


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, and the text of each; a mark doesn't reach over a text's end."""
    found = np.flatnonzero((data[:-2] == ord("<")) & LETTER[data[1:-1]] & (data[2:] == ord(">"))) if len(data) >= MARK else np.zeros(0, np.int64)
    owner = np.searchsorted(at, found, "right") - 1
    inside = found + MARK <= at[owner + 1] if len(found) else np.zeros(0, bool)
    return found[inside], owner[inside]


def shifts(size: int, starts: list[np.ndarray], ends: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """The shift of every byte: each part adds its own at its start and takes it away at its end."""
    change = np.zeros(size + 1, np.int64)
    for start, end, move in zip(starts, ends, moves):
        np.add.at(change, start, move)
        np.subtract.at(change, end, move)
    return np.cumsum(change[:-1])


def layout(parts: dict[str, np.ndarray], forms: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Where each part's bytes begin in the outputs, by part, and where the outputs begin, with the end.

    ``parts`` has the lengths of P, S and M; a plain text is all prefix and has no marks.
    """
    moved = forms != "plain"
    size = sum(parts.values()) + np.where(moved, 3 * MARK, 0)
    out = np.concatenate([[0], np.cumsum(size)])
    place = {p: out[:-1].copy() for p in parts}
    for form, order in ORDERS.items():
        ahead = np.zeros(len(forms), np.int64)
        for part in order:
            ahead = ahead + MARK
            place[part] = np.where(forms == form, out[:-1] + ahead, place[part])
            ahead = ahead + parts[part]
    return place, out


def scatter(data: np.ndarray, at: np.ndarray, cuts: tuple[np.ndarray, np.ndarray], forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of texts cut at two places each, and where they begin."""
    first, second = cuts
    first, second = np.where(forms == "plain", at[1:], first), np.where(forms == "plain", at[1:], second)
    begin = {"P": at[:-1], "M": first, "S": second}
    end = {"P": first, "M": second, "S": at[1:]}
    place, out_at = layout({p: end[p] - begin[p] for p in "PSM"}, forms)
    out = np.zeros(out_at[-1], np.uint8)
    out[np.arange(len(data)) + shifts(len(data), [begin[p] for p in "PSM"], [end[p] for p in "PSM"], [place[p] - begin[p] for p in "PSM"])] = data
    moved = forms != "plain"
    for part, mark in MARKS.items():
        for k, byte in enumerate(mark):
            out[place[part][moved] - MARK + k] = byte
    return out, out_at


def gather(data: np.ndarray, at: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts from their outputs, and where they begin."""
    place, owner = marks(data, at)
    moved = np.flatnonzero(forms != "plain")
    mine = np.isin(owner, moved)
    place, owner = place[mine], owner[mine]
    if not np.array_equal(owner, np.repeat(moved, 3)):
        raise ValueError("an output that is not plain must hold each mark once")
    begin = {p: at[:-1].copy() for p in "PSM"}
    end = {p: at[:-1].copy() for p in "PSM"}
    end["P"] = np.where(forms == "plain", at[1:], end["P"])
    place = place.reshape(-1, 3)
    ahead = np.concatenate([place, at[1:][moved][:, None]], axis=1)
    for k in range(3):
        for part, mark in MARKS.items():
            here = data[place[:, k] + 1] == mark[1]
            begin[part][moved[here]] = place[here, k] + MARK
            end[part][moved[here]] = ahead[here, k + 1]
    sizes = {p: end[p] - begin[p] for p in "PMS"}
    out_at = np.concatenate([[0], np.cumsum(sum(sizes.values()))])
    start, starts, ends, moves = out_at[:-1], [], [], []
    for part in "PMS":
        starts.append(start)
        moves.append(begin[part] - start)
        start = start + sizes[part]
        ends.append(start)
    total = int(out_at[-1])
    return data[np.arange(total) + shifts(total, starts, ends, moves)], out_at


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Arrow texts over the bytes."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def transform(texts: pa.Array, draws: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a run of texts; ``draws`` has four columns."""
    data, at = bytes_of(texts)
    places, before = borders(data, at)
    n = before[1:] - before[:-1]
    low, high = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T
    edge = np.concatenate([places, [0]])
    first, second = (np.where(k == 0, at[:-1], edge[before[:-1] + k - 1]) for k in (low, high))
    _, held = marks(data, at)
    plain = (n == 0) | (draws[:, 2] % 100 >= rate)
    plain[held] = True
    forms = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm, "spm", "psm"))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, out_at = scatter(data, at, (first, second), forms)
    return {
        "n": pa.array(n, pa.int64()), "form": pa.array(forms.tolist(), pa.string()),
        "prefix_chars": pa.array(chars[first] - chars[at[:-1]], pa.int64(), mask=plain),
        "middle_chars": pa.array(chars[second] - chars[first], pa.int64(), mask=plain), "output": strings(out, out_at),
    }


def draws(id_column: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every row.

    ``rate`` percent of the texts are cut, ``spm`` percent of them in the order suffix, prefix, middle.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of_bytes(batch.column(1), RUN):
                numbers = np.stack([batch.column(2 + k).slice(a, b - a).to_numpy() for k in range(4)], axis=1)
                made = transform(batch.column(1).slice(a, b - a), numbers, rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made.values()], ["doc_id", *made])

    own = F.col(f"`{id_column}`")
    picked = docs.select(own.alias("doc_id"), text_of(f"`{text_column}`").alias("text"), *[d.alias(f"h{k}") for k, d in enumerate(draws(own, seed))])
    return picked.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, output_column: str = "output", form_column: str = "form") -> DataFrame:
    """All columns and the text that each output was made from; a NULL form counts as plain, a NULL output as empty."""
    name = fresh(made, "restored")
    at, form = (made.columns.index(c) for c in (output_column, form_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = batch.column(at).fill_null("")
            for a, b in runs_of_bytes(outputs, RUN):
                forms = np.array(batch.column(form).slice(a, b - a).fill_null("plain").to_pylist(), str)
                text = strings(*gather(*bytes_of(outputs.slice(a, b - a)), forms))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], [*batch.schema.names, name])

    return made.mapInArrow(run, StructType([*made.schema.fields, StructField(name, StringType())]))


@query("op12_fill_in_middle", r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), c AS (
  SELECT doc_id, t, w, len(w) AS n, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS x FROM d
), p AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain'
         WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), q AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
