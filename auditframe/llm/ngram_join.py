"""Near duplicates by the Jaccard similarity of word shingles, through trees over count vectors.

A document's set is its distinct shingles of five words as 64-bit hashes. The hashes fall into GROUPS groups, and
the counts per group are the document's point. The overlap of two sets is at most the sum of the smaller counts of
their points, and for a node that holds points below a corner the sum of the corner's smaller coordinates: pairs of
nodes and of points that cannot reach the overlap that the similarity asks for are dropped, all others are
verified on the sets themselves. Nodes and most pairs are tried on points of COARSE coordinates, those that pass on all GROUPS.

Points of unlike texts of one length lie on top of each other in any count space, so one tree over all points
cannot prune. The points are therefore kept in a forest: a tree per shingle of the documents' prefixes. In an
order of all shingles (commonest last, then by hash), two sets of similarity 3/4 share one of their first
floor(n / 4) + 1 shingles, so every pair that links meets in a tree; no other order or frequency
changes the result. What is asked for is components, so pairs that are known to be connected are not compared:

1. Equal sets become one node. Nodes that share the smallest hash of one of SKETCHES orders are compared with the
   first of them only; verified pairs are contracted. This folds large groups of near copies without all their pairs.
2. In a crowded tree (CROWD nodes or more) each node is compared with the tree's core: of the nodes of other components
   the one whose prefix has the fewest shingles that stand in no tree with others. Of copies that drift apart it is the nearest to
   their common text, so what links at all mostly links with it. A node has one core, that of most of its trees. Verified pairs are contracted.
3. The forest compares the nodes of different components. Trees of one component are dropped; a tree of more than
   LARGE nodes is split into blocks, and pairs of blocks are separate work. Trees of the same nodes, as a passage that some documents
   share makes one for each of its shingles, are one tree that counts as many.
4. Verified links of all steps give the components.

``near_duplicate_links`` leaves out the contraction and gives all links, also those inside components, and their number per document.

Sets need the whole text. A NULL or empty text, and one of white space alone, has the empty set and links with nothing. A text of
fewer than five words is one shingle. Repeated rows are one node and get the same component; a row with a NULL id gets
the component's smallest id, or NULL. An empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from auditframe.llm.base import BROADCAST_ROWS, fresh, map_texts, mix, row_identity, small_side, stored, table
from auditframe.llm.components import components
from auditframe.llm.registry import query

WIDTH = 5
#: The similarity is at least SHARE[0] / SHARE[1].
SHARE = (3, 4)
#: Coordinates of a point, a byte each, and of its coarse form, in which pairs are tried first.
GROUPS, COARSE = 512, 128
#: The largest count a coordinate can hold; points that reach it are not bounded by it.
FULL = 255
SKETCHES = 4
#: Nodes of a tree from which it is split into blocks, and of a block.
LARGE, BLOCK = 4096, 1024
#: Nodes of a tree from which they are first compared with its core.
CROWD = 16
#: Pairs of one task that are held at a time, and whose points are compared at a time.
HELD, SLICE = 1 << 18, 1 << 14
#: Nodes of a label whose sets meet in one place.
TEAM = 256
#: Points of a leaf.
LEAF = 16
#: Characters whose words are handled at a time.
PIECE = 1 << 21
#: Texts that a task takes out of a batch at a time.
TEXTS = 512
#: A shingle is common from so many documents on.
COMMON = 8
#: Counters of shingles, as a power of two, and packed counts that are added up at a time.
BUCKETS, FAN_IN = 26, 256
SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < PIECE):
            chars += len(texts[end] or "")
            end += 1
        yield from _sets(texts[at:end])
        at = end


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(pa.array([t or "" for t in texts], pa.large_string()))))
    ends = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxh3_64_intdigest(w) for w in names], np.uint64)
    words = hashes[coded.indices.to_numpy()] if names else np.zeros(0, np.uint64)
    empty = names.index("") if "" in names else None
    none = np.uint64(hashes[empty]) if empty is not None else None
    runs = np.zeros(0, np.uint64)
    if len(words) >= WIDTH:
        runs = words[: 1 - WIDTH]
        for k in range(1, WIDTH):
            runs = mix(runs * SALT + words[k : len(words) - WIDTH + 1 + k])
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a == 1 and none is not None and words[a] == none:
            yield np.zeros(0, np.uint64)
        elif b - a >= WIDTH:
            yield np.unique(runs[a : b - WIDTH + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short * SALT + words[k : k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def prefix_size(n):
    """How many first shingles of a set of ``n`` must be looked at: n - ceil(3 n / 4) + 1."""
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """The point of a set: its hashes counted by group."""
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS).clip(max=FULL).astype(np.uint8)


def gaps_of(places: np.ndarray) -> bytes:
    """Sorted places as their distances, a byte each; distances from 255 on take a byte 255 for each 255."""
    far, near = np.divmod(np.diff(places.astype(np.int64), prepend=0), 255)
    ends = np.cumsum(far + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = near
    return out.tobytes()


def places_of(gaps: bytes) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def packed_counts(total: np.ndarray) -> tuple[bytes, int]:
    """The counts of all places in the narrowest width that holds them, and that width in bytes."""
    kind = np.min_scalar_type(int(total.max(initial=0)))
    return total.astype(kind).tobytes(), kind.itemsize


def common_shingles(docs: DataFrame, text_column: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in order, how often each is met): buckets of shingle hashes that stand in COMMON documents or more, over all documents.

    Every shingle of every document is counted, in one of 2^BUCKETS counters: tasks send packed counts, which are added up
    in rounds of at most FAN_IN rows a group, so no group grows with the corpus. Shingles that share a counter count together, so a
    counter is common only beyond four times the mean. These counts decide the order of work, never the result. At most
    2^19 buckets (8 MB with their counts), the commonest, come to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            buckets = np.sort((np.concatenate(held) >> np.uint64(64 - BUCKETS)).astype(np.uint32))
            cuts = np.searchsorted(buckets, np.arange(0, (1 << BUCKETS) + 1, 1 << 16))
            parts = [(block, gaps_of(buckets[a:b] & 0xFFFF), int(b - a)) for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            lane = random.getrandbits(31)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([p[0] for p in parts], pa.int64()), "places": pa.array([p[1] for p in parts], pa.binary()), "width": pa.array([0] * len(parts), pa.int64()),
                "size": pa.array([p[2] for p in parts], pa.int64()), "lane": pa.array([lane] * len(parts), pa.int64()),
            })

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                for one in shingle_sets(batch.column(0).slice(at, TEXTS).to_pylist()):
                    held.append(one)
                    size += len(one)
                    if size > 1 << 21:
                        yield send()
                        held, size = [], 0
        if size:
            yield send()

    def summed(group: pa.Table) -> np.ndarray:
        """Counts by place: a row has the places of its shingles, or a count of so many bytes for every place."""
        total = np.zeros(1 << 16, np.int64)
        for raw, width in zip(group["places"], group["width"].to_pylist()):
            raw = raw.as_py()
            total += np.frombuffer(raw, f"u{width}") if width else np.bincount(places_of(raw), minlength=1 << 16)
        return total

    def add(group: pa.Table) -> pa.Table:
        total = summed(group)
        raw, width = packed_counts(total)
        return pa.table({
            "block": group["block"].slice(0, 1), "places": pa.array([raw], pa.binary()), "width": pa.array([width], pa.int64()),
            "size": pa.array([int(total.sum())], pa.int64()), "lane": pa.array([random.getrandbits(31)], pa.int64()),
        })

    schema = "block long, places binary, width long, size long, lane long"
    packed = stored(docs.select(F.col(f"`{text_column}`").cast("string")).mapInArrow(run, schema))
    mean = (packed.agg(F.sum("size")).first()[0] or 0) / (1 << BUCKETS)  # one number
    while (most := packed.groupBy("block").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:  # one number
        packed = stored(packed.groupBy("block", F.pmod("lane", F.lit(-(-most // FAN_IN)))).applyInArrow(add, schema))
    limit = max(COMMON, 4 * mean)

    def common(group: pa.Table) -> pa.Table:
        total = summed(group)
        at = np.flatnonzero(total >= limit)
        return pa.table({"h": pa.array((group["block"][0].as_py() << 16) + at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    seen = stored(packed.groupBy("block").applyInArrow(common, "h long, n long"))
    # The least count of the 2^19 commonest, found from a table of counts; ties may add or leave out some.
    wanted, total, least = 1 << 19, 0, COMMON
    if seen.count() > wanted:
        size = F.floor(F.log2("n")).cast("int")
        for r in sorted(seen.groupBy(size.alias("k")).agg(F.count("*").alias("c")).collect(), reverse=True):
            total += r["c"]
            if total > wanted:
                least = 2 ** (r["k"] + 1)
                break
    rows = seen.where(F.col("n") >= least).toArrow()
    h, n = rows["h"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def features(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Stored: row, doc_id, n, set_id, counts, sketches and prefix of every row of ``docs``."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_column))
    columns = {
        "n": ("long", pa.int64()), "set_id": ("long", pa.int64()), "counts": ("binary", pa.binary()), "sketches": ("array<long>", pa.list_(pa.int64())), "prefix": ("binary", pa.binary()),
    }
    seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * SALT)

    def make():
        hot, often = common.value

        def work(texts: list[str | None]) -> dict[str, list]:
            out = []
            for one in shingle_sets(texts):
                if not len(one):
                    out.append((0, None, None, None, None))
                    continue
                if len(hot):
                    bucket = one >> np.uint64(64 - BUCKETS)
                    at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
                    ordered = one[np.argsort(np.where(hot[at] == bucket, often[at], 0), kind="stable")]
                else:
                    ordered = one
                least = [mix(one ^ seed).min() for seed in seeds]
                out.append((len(one), set_id(one), counts_of(one).tobytes(), np.array(least, np.uint64).view(np.int64).tolist(), ordered[: prefix_size(len(one))].tobytes()))
            return {name: [o[k] for o in out] for k, name in enumerate(columns)}

        return work

    rows = map_texts(docs, id_column, text_column, columns, make, TEXTS)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def roomy(least: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima leave room for similarity 3/4: overlap >= 3/7 of both sizes."""
    return 7 * least.sum(axis=1, dtype=np.int64) >= 3 * (na + nb)


def bounded(va: np.ndarray, vb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    least = np.minimum(va, vb)
    return roomy(least, na, nb) | (least.max(axis=1, initial=0) == FULL)


def coarse_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points of COARSE coordinates, each the sum of those of its groups; whether a coordinate is FULL, so that the sums bound nothing)."""
    return points.reshape(len(points), GROUPS // COARSE, COARSE).sum(axis=1, dtype=np.uint16), (points == FULL).any(axis=1)


def near_pairs(points: np.ndarray, coarse: np.ndarray, full: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index pairs (a, b) that sizes and points leave room for, coarse points first."""
    ok = 4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(a), SLICE):
        x, y = a[at : at + SLICE], b[at : at + SLICE]
        ok = roomy(np.minimum(coarse[x], coarse[y]), n[x], n[y]) | (full[x] & full[y])
        x, y = x[ok], y[ok]
        ok = bounded(points[x], points[y], n[x], n[y])
        found.append(np.stack([x[ok], y[ok]], axis=1))
    return np.concatenate(found)


def tree_pairs(points: np.ndarray, n: np.ndarray, mine: np.ndarray | None = None, comp: np.ndarray | None = None) -> np.ndarray:
    """Index pairs (i < j) that pass the bounds, by a packed tree of two levels over one group.

    Points are packed by size, then by their largest-spread coordinates, into leaves of LEAF; leaves meet when
    their corners and sizes leave room. ``mine`` marks the points of a first block: then pairs are between blocks.
    With ``comp`` they are between components.
    """
    coarse, full = coarse_of(points)
    spread = np.argsort(-coarse.var(axis=0))[:2]
    n = n.astype(np.int64)
    order = np.lexsort((coarse[:, spread[1]], coarse[:, spread[0]], n))
    starts = np.arange(0, len(order), LEAF)
    corner, brim = np.maximum.reduceat(coarse[order], starts, axis=0), np.logical_or.reduceat(full[order], starts)
    low, high = n[order][starts], np.maximum.reduceat(n[order], starts)
    found = []
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for k in range(len(starts)):
        last = np.searchsorted(3 * low, 4 * high[k], side="right")  # leaves are in order of size
        near = np.arange(k, last)
        near = near[roomy(np.minimum(corner[near], corner[k]), low[near], low[k]) | (brim[near] & brim[k])]
        if not len(near):
            continue
        left = order[starts[k] : starts[k] + LEAF]
        right = np.concatenate([order[starts[m] : starts[m] + LEAF] for m in near])
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        ok = place[a] < place[b]
        if mine is not None:
            ok &= mine[a] != mine[b]
        if comp is not None:
            ok &= comp[a] != comp[b]
        found.append(near_pairs(points, coarse, full, n, a[ok], b[ok]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def small_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs inside consecutive groups of the given sizes."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = [np.zeros(0, np.int64)]
    right = [np.zeros(0, np.int64)]
    for m in np.unique(sizes):
        i, j = np.triu_indices(m, 1)
        at = starts[sizes == m]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def grouped(batches: Iterator[pd.DataFrame], key: list[str], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Sorted rows cut at borders of groups: (rows, True) holds whole groups; (rows, False) is a part of a group of over ``most``."""
    rest = None
    streaming = None
    for batch in batches:
        rows = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        codes = rows[key].to_numpy()
        last = len(rows) - 1
        change = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
        if streaming is not None:  # a large group that goes on
            same = (codes == streaming).all(axis=1)
            upto = len(rows) if same.all() else int(np.argmin(same))
            if upto:
                yield rows[:upto], False
            if upto == len(rows):
                rest = None
                continue
            rows, streaming = rows[upto:].reset_index(drop=True), None
            codes, last = rows[key].to_numpy(), len(rows) - 1
            change = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield rows[:cut], True
        rest = rows[cut:].reset_index(drop=True)
        if last + 1 - cut > most:
            yield rest, False
            streaming, rest = codes[last], None
    if rest is not None and len(rest):
        yield rest, True


def cross_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (token, comp, set_id and others) sorted by token: those of trees with several components, and the trees' sizes (LARGE + 1 for all beyond)."""
    for rows, whole in grouped(batches, ["token"], LARGE):
        if not whole:
            yield rows.assign(size=LARGE + 1)
            continue
        token, comp = rows["token"].to_numpy(), rows["comp"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        several = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        keep = np.repeat(several, sizes)
        if keep.any():
            yield rows[keep].assign(size=np.repeat(np.minimum(sizes, LARGE + 1), sizes)[keep])


def named_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cross_rows, and k1 and k2, two sums of hashes of the nodes that name them; a tree of more than LARGE nodes is named by its token."""
    seeds = mix(np.arange(1, 3, dtype=np.uint64) * SALT)
    for rows in cross_rows(batches):
        token, nodes = rows["token"].to_numpy(), rows["set_id"].to_numpy().astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        large = rows["size"].to_numpy() > LARGE
        k1, k2 = (np.where(large, token, np.repeat(np.add.reduceat(mix(nodes ^ seed), starts), sizes).view(np.int64)) for seed in seeds)
        yield rows.assign(k1=k1, k2=k2)


def core_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (token, comp, set_id, n, private) sorted by (token, private): each node b and the core a of its tree, where their sizes allow a link.

    The core is the first node of another component. Of a tree of more than LARGE nodes, nodes that come before a
    second component is met have none.
    """
    columns = ["token", "comp", "set_id", "n", "private"]
    heads = np.zeros((0, 5), np.int64)  # of a tree that goes on: its first node, and the first of another component
    for rows, whole in grouped(batches, ["token"], LARGE):
        values = rows[columns].to_numpy(np.int64)
        ahead = len(heads) if len(heads) and heads[0, 0] == values[0, 0] else 0
        if ahead:
            values = np.concatenate([heads, values])
        starts = np.flatnonzero(np.concatenate([[True], values[1:, 0] != values[:-1, 0]]))
        sizes = np.diff(np.concatenate([starts, [len(values)]]))
        first = np.repeat(starts, sizes)
        other = values[:, 1] != values[first, 1]
        second = np.minimum.reduceat(np.where(other, np.arange(len(values)), len(values)), starts)
        heads = np.zeros((0, 5), np.int64) if whole else values[[k for k in (0, int(second[0])) if k < len(values)]]
        at = np.where(other, first, np.repeat(second, sizes))
        ok = at < len(values)
        ok[:ahead] = False
        b, a = np.flatnonzero(ok), at[ok]
        near = 4 * np.minimum(values[a, 3], values[b, 3]) >= 3 * np.maximum(values[a, 3], values[b, 3])
        a, b = a[near], b[near]
        if len(a):
            yield pd.DataFrame({"a": values[a, 2], "b": values[b, 2], "private": values[a, 4]})


def tree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (token, i, j, comp, set_id, times, n, counts) sorted by (token, i, j): pairs a < b of different components that pass the bounds.

    na and nb are their sizes, c in how many trees of these rows they met, where a row stands for ``times`` trees.
    """
    for rows, _ in grouped(batches, ["token", "i", "j"], 1 << 60):
        comp, ids, n, times = (rows[name].to_numpy() for name in ("comp", "set_id", "n", "times"))
        points = np.frombuffer(b"".join(rows["counts"]), np.uint8).reshape(len(rows), GROUPS)
        codes = rows[["token", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        found, held = [], 0

        def made() -> pd.DataFrame:
            pairs = np.concatenate(found)
            one, two = ids[pairs[:, 0]], ids[pairs[:, 1]]
            swap = one > two
            rows = pd.DataFrame({
                "a": np.where(swap, two, one), "b": np.where(swap, one, two),
                "na": np.where(swap, n[pairs[:, 1]], n[pairs[:, 0]]), "nb": np.where(swap, n[pairs[:, 0]], n[pairs[:, 1]]),
                "c": times[pairs[:, 0]],
            })
            return rows.groupby(["a", "b", "na", "nb"], as_index=False).sum()

        small = sizes <= 2 * LEAF
        inside = np.flatnonzero(np.repeat(small, sizes))
        left, right = small_pairs(sizes[small])
        coarse, full = coarse_of(points) if len(left) else (None, None)
        first = rows["block"].to_numpy() == rows["i"].to_numpy()
        within = (rows["i"] == rows["j"]).to_numpy()
        for at in range(0, len(left), 1 << 16):
            a, b = inside[left[at : at + (1 << 16)]], inside[right[at : at + (1 << 16)]]
            ok = (comp[a] != comp[b]) & (within[a] | (first[a] != first[b]))
            found.append(near_pairs(points, coarse, full, n, a[ok], b[ok]))
            held += len(found[-1])
            if held > HELD:
                yield made()
                found, held = [], 0
        for start, size in zip(starts[~small], sizes[~small]):
            part = slice(start, start + size)
            found.append(tree_pairs(points[part], n[part], None if within[start] else first[part], comp[part]) + start)
            held += len(found[-1])
            if held > HELD:
                yield made()
                found, held = [], 0
        if held:
            yield made()


def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (label, i, j, pair) - sets before the pairs that need them - the pairs that link."""
    held, key = {}, None
    for batch in batches:
        ok = np.zeros(len(batch), bool)
        for k, (label, i, j, a, b, raw) in enumerate(zip(batch["label"], batch["i"], batch["j"], batch["a"], batch["b"], batch["shingles"])):
            if key != (label, i, j):
                held, key = {}, (label, i, j)
            if raw is not None:
                held[a] = np.frombuffer(raw, np.uint64)
                continue
            x, y = held[a], held[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[k] = SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)
        yield batch.loc[ok, ["a", "b"]]


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored: the pairs (a, b) of (label, a, b) whose sets have similarity 3/4 or more.

    Only texts in pairs are made into sets again. A set travels once to all pairs of its label, not once per pair; a
    label of more than TEAM nodes is split into blocks, and pairs meet by their two blocks.
    """
    members = pairs.select("label", F.col("a").alias("node")).union(pairs.select("label", "b")).distinct()
    blocks = members.groupBy("label").agg(F.ceil(F.count("*") / TEAM).alias("blocks"))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    placed = stored(pairs.join(blocks, "label").select("label", place("a").alias("i"), place("b").alias("j"), "a", "b"))
    needs = stored(placed.select("label", "i", "j", F.col("a").alias("need")).union(placed.select("label", "i", "j", "b")).distinct())
    # No more ids than rows of needs: their number decides for all three joins.
    few = F.broadcast if needs.count() <= BROADCAST_ROWS else lambda df: df
    ids = nodes.join(few(needs.select(F.col("need").alias("set_id")).distinct()), "set_id", "left_semi").select(F.col("doc_id").alias("_want")).distinct()
    kept = docs.join(few(ids), F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                sets = list(shingle_sets(batch["text"][at : at + 512].tolist()))
                yield pd.DataFrame([(set_id(s), s.tobytes()) for s in sets if len(s)], columns=["set_id", "shingles"])

    sets = kept.select("text").mapInPandas(make, "set_id long, shingles binary")
    sent = sets.join(few(needs), F.col("set_id") == F.col("need")).select("label", "i", "j", F.col("set_id").alias("a"), F.col("set_id").alias("b"), "shingles", F.lit(False).alias("pair"))
    both = sent.unionByName(placed.withColumn("shingles", F.lit(None).cast("binary")).withColumn("pair", F.lit(True)))
    met = both.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "pair")
    return stored(met.mapInPandas(checked, "a long, b long"))


def likely_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored: the pairs (a, b) whose sizes and points leave room for a link."""
    points = nodes.select("set_id", "n", "counts")
    of = lambda c: points.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"v{c}"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                va, vb = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), GROUPS) for c in ("va", "vb"))
                yield batch.loc[bounded(va, vb, batch["na"].to_numpy(), batch["nb"].to_numpy()), ["a", "b"]]

    return stored(pairs.join(of("a"), "a").join(of("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)").mapInPandas(bound, "a long, b long"))


def cut_trees(entries: DataFrame) -> DataFrame:
    """Stored: token, comp, set_id, times of the trees with several components, and the trees' sizes."""
    ordered = entries.select("token", "comp", "set_id", "times").repartition("token").sortWithinPartitions("token")
    return stored(ordered.mapInPandas(cross_rows, "token long, comp long, set_id long, times long, size long"))


def trees(with_comp: DataFrame) -> DataFrame:
    """Stored: the entries of the forest that may still make links; with_comp has set_id, prefix and comp of every node.

    A passage that some documents share gives a tree of the same nodes for each of its shingles: one of them stays and
    stands for them all, ``times`` in number, so its pairs are tried once.
    """
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                sizes = part["prefix"].map(len).to_numpy() // 8
                yield pd.DataFrame({
                    "token": np.frombuffer(b"".join(part["prefix"]), np.int64), "comp": np.repeat(part["comp"].to_numpy(), sizes), "set_id": np.repeat(part["set_id"].to_numpy(), sizes),
                })

    ordered = with_comp.mapInPandas(spread, "token long, comp long, set_id long").repartition("token").sortWithinPartitions("token")
    every = stored(ordered.mapInPandas(named_rows, "token long, comp long, set_id long, size long, k1 long, k2 long"))
    # A large tree is alone by its name; all others hold as many rows as their size.
    times = F.when(F.min("token") == F.max("token"), 1).otherwise((F.count("*") / F.col("size")).cast("long")).alias("times")
    stay = every.groupBy("k1", "k2", "size").agg(F.min("token").alias("token"), times).select("token", "times")
    return stored(every.select("token", "comp", "set_id", "size").join(small_side(stored(stay)), "token"))


def core_pairs(nodes: DataFrame, crossing: DataFrame) -> DataFrame:
    """(a, b): each node b of crowded trees and the core a of most of them."""
    held = crossing.groupBy("set_id").agg(F.sum("times").alias("held"), F.max("size").alias("most")).where(F.col("most") >= CROWD)
    # prefix_size(n) less the shingles that stand in a tree with others
    private = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1 - F.col("held")
    ranked = nodes.select("set_id", "n").join(small_side(stored(held)), "set_id").select("set_id", "n", private.alias("private"))
    entries = crossing.where(F.col("size") >= CROWD).join(ranked, "set_id").select("token", "comp", "set_id", "n", "private")
    ordered = entries.repartition("token").sortWithinPartitions("token", "private", "set_id")
    tried = ordered.mapInPandas(core_rows, "a long, b long, private long").groupBy("b", "a", "private").count()
    return tried.groupBy("b").agg(F.max(F.struct("count", -F.col("private"), "a")).alias("best")).select("best.a", "b")


def forest_links(docs: DataFrame, nodes: DataFrame, crossing: DataFrame) -> DataFrame:
    """Stored: the verified pairs (a, b) of sets of different ``comp`` in the trees ``crossing``.

    With every node as its own comp these are all links.
    """
    joined = crossing.withColumn("large", F.col("size") > LARGE).drop("size").join(nodes.select("set_id", "n", "counts"), "set_id")
    zero = F.lit(0).cast("long")
    usual = joined.where("not large").select("token", zero.alias("i"), zero.alias("j"), zero.alias("block"), "comp", "set_id", "times", "n", "counts")
    sizes = crossing.where(F.col("size") > LARGE).groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    split = joined.where("large").join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(zero, F.col("blocks") - 1))
    ).select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "set_id", "times", "n", "counts")
    forest = usual.unionByName(split).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    # Two sets meet in a tree for every shingle that both prefixes hold; all others that they share lie behind the
    # shorter-ending prefix, of whose set ceil(3 n / 4) - 1 are left. Pairs that met too seldom cannot link.
    met = forest.mapInPandas(tree_rows, "a long, b long, na long, nb long, c long").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    rest = F.floor((3 * F.greatest("na", "nb") + 3) / 4) - 1
    candidates = stored(met.where(7 * (F.col("c") + rest) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b"))
    # Families of candidates share most of their nodes: each is a label.
    family = components(candidates).select(F.col("node").alias("a"), "label")
    return verified(docs, nodes, candidates.join(small_side(family), "a"))


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first row of every set, stored: set_id and its number of rows as size)."""
    filled = rows.where("set_id is not null")
    firsts = stored(filled.groupBy("set_id").agg(F.min("row").alias("row"), F.count("*").alias("size")))
    # Rows that repeat a set drop out; their number decides whether the list of them travels or the rows do.
    repeats = stored(filled.select("row", "set_id").join(firsts.where("size > 1").select("set_id", F.col("row").alias("first")), "set_id").where("row <> first").select("row"))
    return filled.join(small_side(repeats), "row", "left_anti"), firsts.select("set_id", "size")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the documents that links reach), one row per row of ``docs``."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = features(docs, "doc_id", "text")
    nodes, _ = distinct_sets(rows)

    # 1. Stars: each node and the first node that shares a smallest hash.
    keyed = nodes.select("set_id", F.posexplode("sketches").alias("k", "h"))
    centres = stored(keyed.groupBy("k", "h").agg(F.min("set_id").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size"))
    stars = keyed.join(centres, ["k", "h"]).where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct()
    stars_folded = verified(docs, nodes, likely_pairs(nodes, stars).withColumn("label", F.col("a")))

    # 2. The cores of crowded trees, for nodes of different components.
    known = small_side(components(stars_folded).withColumnRenamed("node", "set_id"))
    own = F.coalesce("label", "set_id").alias("comp")
    crossing = trees(nodes.select("set_id", "prefix").join(known, "set_id", "left").select("set_id", "prefix", own))
    cores = verified(docs, nodes, likely_pairs(nodes, core_pairs(nodes, crossing)).withColumn("label", F.col("a")))
    folded = stars_folded.unionByName(cores)
    if not cores.isEmpty():
        known = small_side(components(folded).withColumnRenamed("node", "set_id"))
        crossing = cut_trees(crossing.select("token", "set_id", "times").join(known, "set_id", "left").select("token", "set_id", "times", own))

    # 3. The forest: a tree per shingle of the prefixes.
    linked = forest_links(docs, nodes, crossing)

    # 4. Components of all links, and their smallest ids.
    found = components(folded.unionByName(linked))
    labelled = rows.select("doc_id", "n", "set_id").join(small_side(found.withColumnRenamed("node", "set_id")), "set_id", "left").select(
        "doc_id", "n", F.coalesce("label", "set_id").alias("label")
    )
    labelled = stored(labelled)
    smallest = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    return labelled.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicate_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all links of the join, also those between documents of one component.

    pairs, stored: a < b, the ids of different sets of similarity 3/4 or more. members: doc_id, set_id, n_shingles, component_id and
    n_links, one row per row of ``docs``; n_links counts the other rows with the same set and all rows of linked sets,
    and is 0 for an empty set, whose set_id is NULL. Two rows are linked when their sets are equal or a pair.

    No pair is skipped as connected already, so the work and the result are as large as the number of pairs of
    different sets that link: in a group of near copies, its square. near_duplicates needs none of that.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = features(docs, "doc_id", "text")
    nodes, sizes = distinct_sets(rows)
    pairs = forest_links(docs, nodes, trees(nodes.select("set_id", "prefix", F.col("set_id").alias("comp")))).distinct()
    pairs = stored(pairs)
    both = pairs.union(pairs.select("b", "a"))
    reached = both.join(sizes.withColumnRenamed("set_id", "b"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("size").alias("others"))
    linked = sizes.join(reached, "set_id", "left").select("set_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    labels = components(pairs).withColumnRenamed("node", "set_id")
    labelled = stored(rows.select("doc_id", "set_id", "n").join(linked, "set_id", "left").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")))
    smallest = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return pairs, labelled.join(smallest, "label", "left").select(
        "doc_id", "set_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document with the smallest id of each component stays, columns unchanged. Rows are known by id and text: a NULL id
    sorts after all others, and of two texts under one id each is judged on its own."""
    own, key = fresh(docs, "_own"), fresh(docs, "_gone")
    known = docs.select(row_identity(id_column, text_column).alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    gone = near_duplicates(known).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.withColumn(own, row_identity(id_column, text_column)).join(small_side(stored(gone)), F.col(own).eqNullSafe(F.col(key)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
