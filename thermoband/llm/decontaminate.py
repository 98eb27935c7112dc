"""Benchmark decontamination with suffix arrays over the training documents.

The documents of a task form shards of bounded size. Each shard's words become
one array of numbers and, sorted by what follows, its suffix array. Every
suffix of every benchmark item is searched in it by bisection, unless a look at
its first words, which are sorted once per block, shows that no suffix of the
shard begins with them; that gives the places where a window of the item
stands verbatim, and from there the longest match and its place are read off.
Documents with a window of an item are affected.

Words that no item holds get number 0, which matches nothing. A suffix can
only hold a window if it starts a run of known words at least as long as the
shortest window; only those suffixes are sorted, and the others could not be found.

The benchmark is the query set. It is broadcast in blocks of at most
BLOCK_BYTES of text (one longer item is a block), one after the other: each is
made, searched in all documents and given up before the next one is made. What
is found so far is written in between. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.session import durable

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Text and rows of a shard.
SHARD_BYTES, SHARD_ROWS = 4 << 20, 4096
#: Pairs of a place in the documents and one in the block that are looked at together.
PAIRS = 1 << 20
#: Bytes of words as they are, A-Z to a-z, everything else to a space.
WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Windows(NamedTuple):
    """The distinct windows of one length: the places of each in the block's words, and its items.

    Those of window k are place[place_start[k] : place_start[k + 1]] and item[item_start[k] : item_start[k + 1]]. `lead`
    has the packed first words of the windows in order, `order` the windows in that order.
    """

    length: int
    lead: np.ndarray
    order: np.ndarray
    place_start: np.ndarray
    place: np.ndarray
    item_start: np.ndarray
    item: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.place[self.place_start[:-1]]


class Block(NamedTuple):
    """Searchable items: word numbers, their concatenated texts (0 between items) and windows by length."""

    vocabulary: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray  # of the text that each place lies in
    end: np.ndarray
    owner: np.ndarray  # number of the item that each place lies in
    windows: list[Windows]
    items: list[str | None]

    @property
    def bits(self) -> int:
        return len(self.vocabulary).bit_length()

    @property
    def shortest(self) -> int:
        return min((w.length for w in self.windows), default=0)


def block(items: Iterable[tuple[str | None, str | None]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    text, start, end, owner = [0], [0], [0], [0]
    places: dict[int, dict[tuple, tuple[list[int], set[int]]]] = {}
    for name, content in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(content)]
        if not numbers:
            continue
        item = names.setdefault(name, len(names))
        size = min(window, len(numbers))
        here = places.setdefault(size, {})
        for at in range(len(numbers) - size + 1):
            where, owners = here.setdefault(tuple(numbers[at : at + size]), ([], set()))
            where.append(len(text) + at)
            owners.add(item)
        start += [len(text)] * len(numbers)
        text += numbers
        end += [len(text)] * len(numbers)
        owner += [item] * len(numbers)
        for one in (text, start, end, owner):
            one.append(0)
    numbers_, bits = np.array(text, np.int64), len(vocabulary).bit_length()
    windows = []
    for size, here in sorted(places.items()):
        flat = _flat(list(here[k][0] for k in here))
        first = flat[1][flat[0][:-1]]
        lead = _packed(numbers_, first, bits, min(size, _step(bits)))
        order = np.argsort(lead, kind="stable")
        windows.append(Windows(size, lead[order], order, *flat, *_flat(list(sorted(here[k][1]) for k in here))))
    return Block(vocabulary, numbers_, np.array(start), np.array(end), np.array(owner), windows, list(names))


def _step(bits: int) -> int:
    """Words that fit into one key."""
    return 62 // bits


def _packed(numbers: np.ndarray, places: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The n words from each place on as one key."""
    key = np.zeros(len(places), np.int64)
    for k in range(n):
        key = (key << bits) | numbers[places + k]
    return key


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each list starts in the concatenation (and the end), and the concatenation."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return starts, np.array([x for one in lists for x in one], np.int64)


def _spread(starts: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of `which` lists all its positions in the concatenation, PAIRS at a time: (index into `which`, position)."""
    n = np.diff(starts)[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PAIRS):
        nth = np.arange(low, min(low + PAIRS, total))
        k = np.searchsorted(ends, nth, "right")
        yield k, starts[which[k]] + nth - (ends[k] - n[k])


class SuffixArray:
    """Suffixes of `numbers` that start at `places`, sorted by their first `depth` words.

    Words are compared `step` at a time, packed into one 64-bit key. Only ties
    are compared further, and not beyond a 0, where no search goes on.
    """

    def __init__(self, numbers: np.ndarray, places: np.ndarray, bits: int, depth: int) -> None:
        self.bits, self.step = bits, _step(bits)
        self.numbers = np.concatenate([numbers, np.zeros(self.step, numbers.dtype)])
        key = self.key(places, 0)
        order = np.argsort(key, kind="stable")
        self.places, key = places[order], key[order]
        self.first = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        tied = np.arange(len(key))
        level = 1
        while level * self.step < depth and len(tied) > 1:
            same = key[1:] == key[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            more &= (key & ((1 << bits) - 1)) != 0
            group = np.cumsum(np.concatenate([[True], ~same]))[more]
            tied = tied[more]
            deeper = self.key(self.places[tied], level * self.step)
            order = np.lexsort((deeper, group))
            self.places[tied] = self.places[tied[order]]
            # groups stay apart in the next comparison of neighbours, since equal keys of two groups lie side by side
            key = deeper[order]
            starts = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else group
            level += 1
            if len(tied):
                tied, key = self._apart(tied, key, starts)

    def _apart(self, tied: np.ndarray, key: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put a row that ties with nothing (place -1) between groups."""
        at = np.flatnonzero(starts)[1:]
        if not len(at):
            return tied, key
        return np.insert(tied, at, -1), np.insert(key, at, 0)

    def key(self, places: np.ndarray, offset: int) -> np.ndarray:
        """The words from `offset` on after each place, packed; none beyond the end."""
        return _packed(self.numbers, np.minimum(places + offset, len(self.numbers) - self.step), self.bits, self.step)

    def possible(self, windows: Windows) -> np.ndarray:
        """The windows whose first words some suffix begins with: for each different beginning a look into `lead`."""
        begun = self.first >> (self.bits * (self.step - min(windows.length, self.step)))
        begun = begun[np.concatenate([[True], begun[1:] != begun[:-1]])] if len(begun) else begun
        low, high = np.searchsorted(windows.lead, begun, "left"), np.searchsorted(windows.lead, begun, "right")
        n = high - low
        return np.sort(windows.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    def bisect(self, low: np.ndarray, high: np.ndarray, offset: int, wanted: np.ndarray) -> np.ndarray:
        """Between low and high, the first place whose key at `offset` is not less than wanted."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = np.zeros(len(low), bool)
            less[open_] = self.key(self.places[middle[open_]], offset) < wanted[open_]
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with text[start : start + length], for each start."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.places))
        for offset in range(0, length, self.step):
            first = np.zeros(len(starts), np.int64)
            for k in range(self.step):
                first = (first << self.bits) | (text[starts + offset + k] if offset + k < length else 0)
            free = self.bits * max(0, offset + self.step - length)
            low, high = self.bisect(low, high, offset, first), self.bisect(low, high, offset, first + (1 << free))
            low = np.minimum(low, high)
        return low, high


class Found(NamedTuple):
    """Of one document: words, hit words, names of items, words of the longest match, hit ranges of words, and where
    the longest match starts (word of the document, item, word of the item's text)."""

    n_words: int
    n_hit: int
    items: list[str | None]
    longest: int
    spans: list[int]
    place: tuple[int | None, str | None, int | None] = (None, None, None)


def search(texts: list[str | None], searched: Block, hits_only: bool = False) -> list[Found]:
    """Find the block's windows in a shard of documents; if `hits_only`, without items and longest matches."""
    get = searched.vocabulary.get
    numbers, sizes = [np.zeros(1, np.int64)], []
    for text in texts:
        some = words(text)
        sizes.append(len(some))
        numbers.append(np.fromiter(map(get, some, repeat(0)), np.int64, len(some)))
        numbers.append(np.zeros(1, np.int64))
    sequence = np.concatenate(numbers)
    size = np.array(sizes, np.int64)
    begin = np.cumsum(size + 1) - size  # of each document
    zeros = np.flatnonzero(sequence == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(sequence)))] - np.arange(len(sequence))
    places = np.flatnonzero(run >= max(1, searched.shortest))
    found: list[Found | None] = [None] * len(texts)
    if len(places) and searched.windows:
        depth = max(w.length for w in searched.windows)
        array = SuffixArray(sequence, places, searched.bits, depth)
        change = np.zeros(len(sequence) + 1, np.int64)
        affected, owners = [], np.zeros(0, np.int64)
        longest = np.zeros((3, len(texts)), np.int64)  # words, place in the sequence and in the block's text
        for windows in searched.windows:
            possible = array.possible(windows)
            low, high = array.search(searched.text, windows.first[possible], windows.length)
            count = high - low
            if not count.sum():
                continue
            window = np.repeat(possible, count)
            at = array.places[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            np.add.at(change, at, 1)
            np.add.at(change, at + windows.length, -1)
            document = np.searchsorted(begin, at, "right") - 1
            affected.append(np.unique(document))
            if hits_only:
                continue
            pair = np.unique(np.stack([document, window]), axis=1)
            for k, position in _spread(windows.item_start, pair[1]):
                some = np.unique(pair[0][k] * len(searched.items) + windows.item[position])
                owners = np.union1d(owners, some)
            for k, position in _spread(windows.place_start, window):
                place = windows.place[position]
                _lengthen(longest, document[k], matched(sequence, at[k], searched, place, windows.length), at[k], place)
        if affected:
            hit = np.cumsum(change[:-1]) > 0
            for d in np.unique(np.concatenate(affected)):
                mine = hit[begin[d] : begin[d] + size[d]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                low, high = np.searchsorted(owners, [d * len(searched.items), (d + 1) * len(searched.items)])
                names = [searched.items[i] for i in owners[low:high] % len(searched.items)]
                words_, at_, place_ = longest[:, d].tolist()
                where = (at_ - int(begin[d]), searched.items[searched.owner[place_]], place_ - int(searched.start[place_])) if words_ else (None,) * 3
                found[d] = Found(sizes[d], int(mine.sum()), names, words_, edges.tolist(), where)
    return [f or Found(n, 0, [], 0, []) for f, n in zip(found, sizes, strict=True)]


def _lengthen(longest: np.ndarray, document: np.ndarray, total: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
    """Keep the longest match of each document; of equal ones the first in the document, then in the block."""
    order = np.lexsort((place, at, -total, document))
    order = order[np.concatenate([[True], document[order][1:] != document[order][:-1]])]
    d, new = document[order], np.stack([total[order], at[order], place[order]])
    old = longest[:, d]
    same = new[0] == old[0]
    better = (new[0] > old[0]) | (same & ((new[1] < old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))
    longest[:, d[better]] = new[:, better]


def matched(sequence: np.ndarray, at: np.ndarray, searched: Block, place: np.ndarray, length: int) -> np.ndarray:
    """How many words from `at` on equal the item's words from `place` on; the first `length` do."""
    total = np.full(len(at), length)
    going = np.arange(len(at))
    while len(going):
        a, p = at[going] + total[going], place[going] + total[going]
        going = going[(p < searched.end[place[going]]) & (sequence[a] == searched.text[np.minimum(p, len(searched.text) - 1)])]
        total[going] += 1
    return total


def shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most SHARD_ROWS rows and about SHARD_BYTES of text."""
    for batch in batches:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = int(np.searchsorted(size, base + SHARD_BYTES, "right"))
            to = min(max(to, at + 1), at + SHARD_ROWS)
            yield batch.slice(at, to - at)
            at = to


def in_blocks(
    docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, step: Callable[[DataFrame, Broadcast, bool, bool], DataFrame]
) -> DataFrame:
    """`step(docs, block, first, last)` for one block of the benchmark's items after the other.

    What a step gives is written before the next block is made, and its block is given up. Of the benchmark the driver
    holds one block at a time.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        found = block(((r.item, r.text) for r in part.toLocalIterator()), window)
        sent = docs.sparkSession.sparkContext.broadcast(found)
        docs = step(docs, sent, k == 0, k == n - 1)
        if k < n - 1:
            docs = durable(docs)
            sent.destroy()
    return docs


FOUND = (
    "n_words bigint, n_hit bigint, items array<string>, longest bigint, spans array<bigint>, "
    "longest_at bigint, longest_item string, longest_item_at bigint"
)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside an occurrence of a window), items (names of
    the items with such windows, as sorted texts), longest (words of the longest verbatim match), spans (the hit
    ranges as start, end, start, end ... in words), and where the longest match starts: longest_at (word of the
    document), longest_item and longest_item_at (word of that item's text); the first one in the document if there are more.

    A null or empty text has no words. An item shorter than a window is one window; one without words is never
    found. Items with the same id are one item, those without id are one, too, whose name is null. Rows are kept as
    often as they occur and null ids stay null; other columns are not read. An empty table gives no rows, an empty
    benchmark no hits.
    """

    def step(rows: DataFrame, one: Broadcast, first: bool, last: bool) -> DataFrame:
        kept = "doc_id bigint, " + ("" if last else "text string, ")
        return rows.mapInArrow(_report(one, first, last), kept + FOUND)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return in_blocks(rows, benchmark, window, block_bytes, step)


def _by_name(name: str | None) -> tuple[bool, str]:
    return name is not None, name or ""


def _report(one: Broadcast, first: bool, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = one.value
        for rows in shards(batches, 1):
            found = search(rows.column(1).to_pylist(), searched)
            if not first:
                before = (Found(*x[:5], tuple(x[5:])) for x in zip(*(rows.column(i).to_pylist() for i in range(2, 10)), strict=True))
                found = [_joined(a, b) for a, b in zip(before, found, strict=True)]
            n_words, n_hit, items, longest, spans, places = zip(*found, strict=True)
            columns = {"doc_id": rows.column(0)} | ({} if last else {"text": rows.column(1)})
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            columns |= {"items": pa.array([sorted(x, key=_by_name) for x in items], pa.list_(pa.string()))}
            columns |= {"longest": pa.array(longest, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))}
            at, item, item_at = zip(*places, strict=True)
            columns |= {"longest_at": pa.array(at, pa.int64()), "longest_item": pa.array(item, pa.string())}
            columns |= {"longest_item_at": pa.array(item_at, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _joined(a: Found, b: Found) -> Found:
    """What two blocks found in one document."""
    spans: list[list[int]] = []
    for start, end in sorted([*zip(a.spans[::2], a.spans[1::2], strict=True), *zip(b.spans[::2], b.spans[1::2], strict=True)]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    hit = sum(end - start for start, end in spans)
    best = min((a, b), key=lambda f: (-f.longest, f.place[0] or 0))
    return Found(a.n_words, hit, sorted({*a.items, *b.items}, key=_by_name), best.longest, [x for s in spans for x in s], best.place)


def remove_affected(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows whose text holds a window of an item; all columns and other rows as they are."""
    text = docs.columns.index("text")

    def keep(one: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in shards(batches, text):
                yield rows.filter(pa.array([not f.n_hit for f in search(rows.column(text).to_pylist(), one.value, hits_only=True)]))

        return run

    def step(rows: DataFrame, one: Broadcast, first: bool, last: bool) -> DataFrame:
        return rows.mapInArrow(keep(one), docs.schema)

    return in_blocks(docs, benchmark, window, block_bytes, step)
