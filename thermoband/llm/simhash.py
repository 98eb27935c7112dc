"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints with at most 2 x SEGMENTS - 1 differing bits agree in one
segment but for at most one bit. With 3 bits two segments of 32 suffice. Each
distinct fingerprint is indexed under each segment as it stands and under each
segment with one bit deleted; equal keys join, and what meets is verified on
all 64 bits. Fingerprints that meet under a deleted bit are compared only if
they differ in it, because the others meet under the segment as it stands.

Within a key no list of pairs is made: only links that still join two parts of
the key's fingerprints are given, which is enough for components. A key with
more than HOT fingerprints is not compared in one task: its fingerprints go on
under keys that also hold a segment of the remaining bits, in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.llm.common import LOWER, slices
from thermoband.llm.components import components
from thermoband.session import durable

SEED = 42
DISTANCE = 3
#: Fingerprints that one task compares with each other under one key.
HOT = 20_000
#: Fingerprints that one task unfolds into their keys, 66 each.
MARKS = 16_384
#: Rows of a block of comparisons: BLOCK x HOT x 8 bytes, 80 MB.
BLOCK = 512


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of `words` words with repeats, the whole text if it has fewer, nothing if it has none."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [b" ".join(tokens)]
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(pieces: list[bytes]) -> int:
    """Bit by bit whether more than half of the pieces' XXH64 have it."""
    if not pieces:
        return 0
    h = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(pieces), step):
        some = pieces[at : at + step]
        hashes = np.fromiter((h(p, SEED) for p in some), "<u8", len(some))
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(pieces), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, *kept: str) -> DataFrame:
    """doc_id and its fingerprint `mark` as a long (the 64 bits, signed), and the long columns in `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            marks = [fingerprint(shingles(t, words)) for t in rows.column(1).to_pylist()]
            rest = rows.columns[2:]
            mark = pa.array(np.array(marks, "<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([rows.column(0), mark, *rest], ["doc_id", "mark", *kept])

    schema = ", ".join(["doc_id bigint", "mark bigint", *(f"{c} bigint" for c in kept)])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *kept).mapInArrow(run, schema)


def _part(mark: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(mark, low).bitwiseAND((1 << width) - 1)


def _variants(mark: Column, low: int, width: int) -> Column:
    """Struct (bit, rest) for the segment as it stands (bit -1) and with each of its bits deleted."""
    part = _part(mark, low, width)
    whole = F.struct(F.lit(-1).alias("bit"), part.alias("rest"))
    less = [
        F.struct(F.lit(b).alias("bit"), part.bitwiseAND(((1 << width) - 1) ^ (1 << b)).alias("rest")) for b in range(width)
    ]
    return F.array(whole, *less)


def _keyed(rows: DataFrame, prefix: list[str], segments: list[tuple[int, int]]) -> DataFrame:
    """(key, side, mark): a row for each segment (low, width) and variant; `side` is the deleted bit's value, or -1."""

    def entries(low: int, width: int) -> Column:
        def entry(v: Column) -> Column:
            side = F.when(v["bit"] >= 0, _bit("mark", v["bit"] + low)).otherwise(-1).cast("int")
            return F.struct(F.xxhash64(*prefix, F.lit(low), v["bit"], v["rest"]).alias("key"), side.alias("side"))

        return F.transform(_variants(F.col("mark"), low, width), entry)

    every = F.flatten(F.array(*[entries(low, width) for low, width in segments]))
    return rows.select(F.explode(every).alias("e"), "mark").select("e.key", "e.side", "mark")


def _bit(mark: str, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(mark), at).bitwiseAND(F.lit(1).cast("bigint"))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signatures (the last axis holds their words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning_links(marks: np.ndarray, sides: np.ndarray, distance: int, known: bool = False) -> list[tuple[int, int]]:
    """Links within `distance` among the signatures (n x words) of one key that join its parts, as index pairs.

    Of side -1 all are compared, of sides 0 and 1 only those that differ in it.
    If `known`, all are compared and a side is the part that a signature is already in.
    """
    n = len(marks)
    part = np.unique(sides, return_inverse=True)[1] if known else np.arange(n)
    found = []
    if known and part.max() == 0:
        return found
    rows, columns = (np.arange(n), np.arange(n)) if known or sides[0] < 0 else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    for at in range(0, len(rows), BLOCK):
        some = rows[at : at + BLOCK]
        near = sum(np.bitwise_count(marks[some, k][:, None] ^ marks[columns, k][None, :]) for k in range(marks.shape[1])) <= distance
        for i in np.flatnonzero(near.any(axis=1)):
            others = columns[near[i]]
            parts, first = np.unique(part[others], return_index=True)
            new = parts != part[some[i]]
            if new.any():
                found += [(int(some[i]), int(others[f])) for f in first[new]]
                part[np.isin(part, parts)] = part[some[i]]
    return found


def compare_keys(distance: int, hot: int, words: int = 1, known: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (key, side, signature of `words` longs) sorted by key: links as (true, one signature, the other),
    rows of hot keys as (false, signature, key, zeros)."""
    names = ["link", *(f"a{k}" for k in range(words)), *(f"b{k}" for k in range(words))]

    def emit(kind: bool, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind)), *(pa.array(np.ascontiguousarray(c).view("<i8")) for c in columns)], names)

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return emit(True, *a.T, *b.T)

    def passed_on(key: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        return emit(False, *mark.T, key, *[np.zeros(len(key), np.int64)] * (words - 1))

    def groups(key: np.ndarray, side: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare whole keys; those of two rows all at once."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        two = first[size == 2]
        if len(two):
            ok = (differing(mark[two], mark[two + 1]) <= distance) & ((side[two] < 0) | (side[two] != side[two + 1]))
            if ok.any():
                yield linked(mark[two][ok], mark[two + 1][ok])
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            here = mark[at : at + n]
            if found := spanning_links(here, side[at : at + n], distance, known):
                a, b = np.array(found).T
                yield linked(here[a], here[b])

    def whole(key: np.ndarray, side: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        """As `groups`, but keys that are hot go on."""
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        big = count[back] > hot
        if big.any():
            yield passed_on(key[big], mark[big])
            key, side, mark = key[~big], side[~big], mark[~big]
        if len(key):
            yield from groups(key, side, mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        over: int | None = None  # the key whose rows are passed on
        for batch in batches:
            key, side, *parts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            mark = np.stack([p.view("<u8") for p in parts], axis=1)
            if over is not None:
                same = key == over
                if same.any():
                    yield passed_on(key[same], mark[same])
                key, side, mark = key[~same], side[~same], mark[~same]
                if not len(key):
                    continue
                over = None
            if not len(key):
                continue
            if held:
                key, side, mark = (np.concatenate([h[i] for h in held] + [x]) for i, x in enumerate((key, side, mark)))
                held = []
            tail = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - tail > hot:
                over = int(key[-1])
                yield passed_on(key[tail:], mark[tail:])
            else:
                held = [(key[tail:], side[tail:], mark[tail:])]
            if tail:
                yield from whole(key[:tail], side[:tail], mark[:tail])
        for key, side, mark in held:
            yield from whole(key, side, mark)

    return run


def links(marks: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (`mark`) that join all fingerprints within `distance` of each other."""
    if distance != 3:
        raise ValueError("two segments with one deleted bit find 3 differing bits")
    schema = "link boolean, a0 bigint, b0 bigint"

    def compared(keyed: DataFrame, limit: int) -> DataFrame:
        return durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare_keys(distance, limit), schema))

    found = compared(_keyed(marks, [], [(0, 32), (32, 32)]), hot)
    result = found.where("link").select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    rest = found.where("NOT link")
    if not rest.isEmpty():
        # 3 bits over both halves of the 32 bits that the key doesn't fix: one half differs by at most one bit.
        # Under a key of 16 further bits at most 2^17 fingerprints are left.
        again = rest.select(F.col("b0").alias("within"), F.col("a0").alias("mark")).distinct()
        result = result.union(
            compared(_keyed(again, ["within"], [(0, 16), (16, 16), (32, 16), (48, 16)]), 1 << 18).where("link").select("a0", "b0")
        )
    return result


def _grouped(marks: DataFrame, distance: int, hot: int) -> DataFrame:
    """Each of the distinct `marks`, which are written already, with the mark that stands for its component."""
    marks = marks.repartition(max(1, -(-marks.count() // MARKS)), "mark")
    reached = components(links(marks, distance, hot)).withColumnRenamed("node", "mark")
    return marks.join(reached, "mark", "left").select("mark", F.coalesce("component", "mark").alias("group"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, itself included).

    Null and empty texts and texts of white space have fingerprint zero, which
    links like any other. Repeated rows give a row each; rows with a null
    doc_id link and keep a null doc_id, and a component of those alone has a
    null component_id. Other columns are not read; an empty table gives no rows.
    """
    marked = durable(fingerprints(docs, words))
    least = durable(marked.groupBy("mark").agg(F.min("doc_id").alias("least")))
    named = least.join(_grouped(least.select("mark"), distance, hot), "mark")
    group_least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    known = named.join(group_least, "group").select("mark", "component_id")
    return marked.join(known, "mark").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = 3, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """`docs` with one row of each component of linked fingerprints, all columns as they are.

    The row with the least doc_id stays (one with a null id only if no other is there), of rows with that id the one
    with the least hash of its text, and of rows equal in both the one that is least as JSON. Fingerprints are those of
    `near_duplicates`. Only slim rows are grouped; rows equal in id and text are merged before any shuffle. An empty
    table gives no rows.
    """
    own = {"_own": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "_id": F.col("doc_id").cast("bigint"), "_tie": F.xxhash64("text")}
    whole = docs.select(*[c.alias(n) for n, c in own.items()])
    marked = durable(fingerprints(docs.select("doc_id", "text", own["_tie"].alias("tie")), words, "tie"))
    rows = marked.groupBy("mark", "doc_id", "tie").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tie", "n")).alias("best")
    least = durable(rows.groupBy("mark").agg(best))
    groups = least.join(_grouped(least.select("mark"), distance, hot), "mark").groupBy("group").agg(F.min("best").alias("best"))
    stays = durable(groups.select("best.doc_id", "best.tie", "best.n"))

    def staying(which: str) -> DataFrame:
        same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))
        return whole.join(stays.where(which), same, "left_semi")

    alone = staying("n = 1").select("_own.*")
    if stays.where("n > 1").isEmpty():
        return alone
    repeated = staying("n > 1").groupBy("_id", "_tie").agg(F.min_by("_own", F.to_json("_own")).alias("_own"))
    return alone.union(repeated.select("_own.*"))
