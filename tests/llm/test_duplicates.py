"""SimHash, connected components, vectors and decontamination against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from thermoband.llm.common import LOWER
from thermoband.llm.components import components
from thermoband.llm.decontaminate import SuffixArray, block, find_benchmark, remove_affected, search, words
from thermoband.llm.simhash import compare_keys, links, near_duplicates, one_of_each, spanning_links
from thermoband.llm.vectors import near_duplicate_vectors


def parts(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))]
    pairs += [(1000 + k, 1001 + k) for k in range(40)]  # a path
    pairs += [(2000, 2001 + k) for k in range(200)] + [(2000, 2001), (7, 7), (None, 5)]  # a star; repeated, self and null links
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == parts({n for p in real for n in p}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def fingerprint(text, size=3):
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    pieces = [b" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def near(rows, size=3):
    """(doc_id, fingerprint, component) by comparing all rows."""
    marks = [fingerprint(r.text, size) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    group = parts(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        g = group[i]
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return Counter((r.doc_id, f"{m:016x}", least.get(group[i])) for i, (r, m) in enumerate(zip(rows, marks, strict=True)))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_near_duplicates(spark, odd_docs, documents, hot):
    for docs in (odd_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        assert Counter(map(tuple, near_duplicates(docs, hot=hot).collect())) == near(rows)


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert one_of_each(no_docs).count() == 0


def one_kept(rows, size=3):
    """The row kept of each component: rows (doc_id, text) as a Counter, and the components' ids and texts."""
    marks = [fingerprint(r.text, size) for r in rows]
    distinct = sorted(set(marks))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3]
    group = parts(distinct, pairs)
    held = {}
    for r, m in zip(rows, marks, strict=True):
        held.setdefault(group[m], []).append((r.doc_id is None, r.doc_id or 0, r.doc_id, r.text))
    return {g: sorted(x, key=lambda t: t[:2]) for g, x in held.items()}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_one_of_each(odd_docs, documents, hot):
    """One row of each component stays, with its least id and all its columns."""
    for docs in (odd_docs, documents):
        rows = docs.collect()
        kept = one_of_each(docs, hot=hot)
        assert kept.schema == docs.schema
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        groups = one_kept(rows)
        assert sum(got.values()) == len(groups)
        for members in groups.values():
            best = {x[2:] for x in members if x[:2] == members[0][:2]}
            assert sum(got[x] for x in best) == 1
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}


def test_one_of_each_of_nothing(no_docs):
    kept = one_of_each(no_docs)
    assert kept.count() == 0 and kept.schema == no_docs.schema


def test_equal_ids_and_texts_are_one_row(spark):
    """Rows equal in id and text, a third of all and more, with other columns that differ; ids that occur with several texts."""
    other = "quite another text of its own here"
    rows = [(7, "a text that is there again and again", f"s{k % 3}") for k in range(300)] + [(7, other, "z"), (8, other, "y"), (None, other, "x"), (None, None, "q"), (None, "", "p")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [rows[0][:2] + ("s0",), (7, other, "z"), next(tuple(r) for r in kept if r.doc_id is None)]))


@pytest.mark.parametrize("hot", [20_000, 5])
def test_links_join_all_close_fingerprints(spark, hot):
    random = np.random.default_rng(5)
    marks = set()
    for _ in range(60):
        base = int(random.integers(0, 1 << 63)) * 2 + 1
        for _ in range(int(random.integers(1, 12))):
            mark = base
            for bit in random.integers(0, 64, int(random.integers(0, 5))):
                mark ^= 1 << int(bit)
            marks.add(mark)
    marks = sorted(marks)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    found = links(spark.createDataFrame([(m,) for m in signed], "mark bigint"), hot=hot).collect()
    close = [(a, b) for i, a in enumerate(marks) for b in marks[:i] if (a ^ b).bit_count() <= 3]
    unsigned = lambda x: int(np.int64(x).astype(np.uint64))
    got = [(unsigned(r.a), unsigned(r.b)) for r in found]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert parts(marks, got) == parts(marks, close)


def test_a_large_group_gives_few_links():
    random = np.random.default_rng(2)
    marks = np.unique(np.array([1 << int(a) | 1 << int(b) for a, b in random.integers(0, 32, (2000, 2))], np.uint64))
    joined = spanning_links(marks[:, None], np.full(len(marks), -1), 3)
    assert len(joined) < len(marks)


def test_keys_over_batches():
    """Keys that reach over batches are compared whole; hot ones are passed on whole."""
    key = np.array([1, 1, 2, 2, 2, 2, 2, 2, 3, 3], np.int64)
    mark = np.array([0, 1, 10, 11, 12, 13, 14, 15, 100, 101], np.int64)
    side = np.full(10, -1, np.int32)
    for cut in range(1, 10):
        rows = [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (key, side, mark)], ["key", "side", "mark"]) for a, b in ((0, cut), (cut, 10))]
        out = pa.Table.from_batches(list(compare_keys(3, 4)(iter(rows)))).to_pylist()
        assert {(r["a0"], r["b0"]) for r in out if r["link"]} == {(0, 1), (100, 101)}
        assert sorted(r["a0"] for r in out if not r["link"]) == [10, 11, 12, 13, 14, 15]


def linked(rows):
    good = [
        (i, np.array(v, float), label) for i, (_, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    pairs = [
        (i, j) for k, (i, x, a) in enumerate(good) for j, y, b in good[:k]
        if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    ]
    group = parts(range(len(rows)), pairs)
    count = Counter(i for p in pairs for i in p)
    least = {}
    for i, (name, _, _) in enumerate(rows):
        if name is not None:
            least[group[i]] = min(least.get(group[i], name), name)
    return Counter((name, count[i], least.get(group[i]), name == least.get(group[i])) for i, (name, _, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [2048, 16])
def test_vectors(spark, tile):
    random = np.random.default_rng(8)
    rows = []
    for k in range(40):
        base = random.normal(size=12)
        for _ in range(int(random.integers(1, 9))):
            v = base + random.normal(size=12) * random.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * random.choice([0.01, 1, 1000])], int(k % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(60)]  # a group of copies
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 12, 1), (n + 2, [float("nan")] + [1.0] * 11, 1), (n + 3, [None] + [1.0] * 11, 1)]
    rows += [(n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [], 0), (n + 8, [float("inf")] * 12, 0)]
    rows += [rows[5], rows[5], (None, rows[7][1], rows[7][2]), (n + 9, [-0.0] * 12, 0)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id bigint, embedding array<float>, label int, n string, rep string")
    assert Counter(map(tuple, near_duplicate_vectors(df.repartition(3), tile=tile).collect())) == linked(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_duplicate_vectors(df).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [0.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, near_duplicate_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def contaminated(text, items, window=10):
    tokens = words(text)
    hit, names, longest, ends = set(), set(), 0, []
    for name, item in items:
        there = words(item)
        size = min(window, len(there))
        for j in range(len(there) - size + 1 if size else 0):
            for i in range(len(tokens) - size + 1):
                if tokens[i : i + size] == there[j : j + size]:
                    hit.update(range(i, i + size))
                    names.add(None if name is None else str(name))
                    n = size
                    while i + n < len(tokens) and j + n < len(there) and tokens[i + n] == there[j + n]:
                        n += 1
                    longest = max(longest, n)
                    ends.append((n, i, None if name is None else str(name), j))
    first = min((i for n, i, *_ in ends if n == longest), default=None)
    places = {x[1:] for x in ends if x[0] == longest and x[1] == first} or {(None, None, None)}
    return len(tokens), len(hit), sorted(names, key=lambda n: (n is not None, n or "")), longest, places


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "two THREE four five six seven eight nine ten eleven and some more words that follow here"),
    (3, "short item"), (4, None), (5, ""), (6, "é È ñ"), (6, "again the same id with other words in it, ten of them at least"),
    (10, "a a a a a a a a a a a a"), (None, "item without id but with many words that are quite long indeed yes"),
]
FOUND = [
    "Intro. one two three four five six seven eight nine ten eleven twelve thirteen",
    "x two three four five six seven eight nine ten eleven and some more",
    "this short-item! and short item again", "é È ñ", "É È ñ", "a " * 30, "nothing", "", None, "one two three four five six seven eight nine",
    "item without id but with many words that are quite long indeed yes",
]


@pytest.mark.parametrize("block_bytes", [1 << 25, 60])
def test_benchmark_passages(spark, odd_docs, block_bytes):
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(FOUND)], "doc_id bigint, text string, items string")
    named = ITEMS
    for some in (docs, odd_docs):
        rows = some.select("doc_id", "text").collect()
        if some is odd_docs:
            rows = [r for r in rows if len(r.text or "") < 10_000]
            some = some.where("text IS NULL OR length(text) < 10000")
        got = find_benchmark(some, items, block_bytes=block_bytes).collect()
        want = Counter((r.doc_id, *map(str, contaminated(r.text, named)[:4])) for r in rows)
        assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"]), str(r.longest)) for r in got) == want
        places = {}
        for r in rows:
            places.setdefault(r.doc_id, set()).update(contaminated(r.text, named)[4])
        for r in got:
            assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit
            assert (r.longest_at, r.longest_item, r.longest_item_at) in places[r.doc_id]
        clean = [r.doc_id for r in rows if not contaminated(r.text, named)[1]]
        kept = remove_affected(some, items, block_bytes=block_bytes)
        assert kept.schema == some.schema
        assert Counter(r.doc_id for r in kept.collect()) == Counter(clean)


def test_items_without_id_are_not_those_named_null(spark):
    items = spark.createDataFrame([("null", "one two three"), (None, "four five six"), (None, "seven eight")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "seven eight"), (3, "one two")], "doc_id bigint, text string")
    for block_bytes in (1 << 20, 8):
        got = {r.doc_id: r["items"] for r in find_benchmark(docs, items, block_bytes=block_bytes).collect()}
        assert got == {1: [None, "null"], 2: [None], 3: []}


def test_one_block_at_a_time(spark, monkeypatch):
    """Blocks are made one after the other, and each is given up before the next."""
    from thermoband.llm import decontaminate

    made, alive = [], set()
    one_block = decontaminate.block

    def counted(items, window):
        assert not alive
        made.append(one_block(items, window))
        alive.add(len(made))
        return made[-1]

    destroy = decontaminate.Broadcast.destroy
    monkeypatch.setattr(decontaminate, "block", counted)
    monkeypatch.setattr(decontaminate.Broadcast, "destroy", lambda self: (alive.clear(), destroy(self))[1])
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"a {t} b") for k, t in items], "doc_id bigint, text string")
    got = find_benchmark(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=400).collect()
    assert len(made) > 3 and sorted((r.doc_id, r["items"], r.n_hit, r.longest_at) for r in got) == sorted((k, [str(k)], 12, 1) for k, _ in items)


def test_first_words_decide_what_is_searched():
    """Only windows whose first words a shard has are searched, whatever their length."""
    random = np.random.default_rng(31)
    items = [(str(k), " ".join(f"w{x}" for x in random.integers(0, 50_000, random.integers(1, 40)))) for k in range(2000)]
    searched = block(items, 10)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 50_000, 50)) for _ in range(40)] + [f"x {items[k][1]} y" for k in range(0, 2000, 50)]
    numbers = [np.zeros(1, np.int64)]
    for t in texts:
        numbers += [np.array([searched.vocabulary.get(w, 0) for w in words(t)], np.int64), np.zeros(1, np.int64)]
    sequence = np.concatenate(numbers)
    array = SuffixArray(sequence, np.flatnonzero(sequence), searched.bits, 10)
    for windows in searched.windows:
        low, high = array.search(searched.text, windows.first, windows.length)
        possible = array.possible(windows)
        assert set(np.flatnonzero(high > low)) <= set(possible.tolist()) and len(np.unique(possible)) == len(possible)
    assert len(array.possible(searched.windows[-1])) < 0.2 * len(searched.windows[-1].first)


def test_no_benchmark(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 for r in find_benchmark(odd_docs, none).collect())
    assert find_benchmark(no_docs, none).count() == 0
    assert remove_affected(odd_docs, none).count() == odd_docs.count()


def test_suffix_array_order():
    random = np.random.default_rng(4)
    for vocabulary, n in ((1, 50), (2, 200), (40, 400), (5000, 300)):
        numbers = random.integers(1, vocabulary + 1, n)
        numbers[random.integers(0, n, n // 10)] = 0
        numbers[-1] = 0
        places = np.flatnonzero(numbers)
        array = SuffixArray(numbers, places, int(vocabulary).bit_length(), 10)

        def head(p, numbers=numbers):
            out = list(numbers[p : p + 10])
            return out[: out.index(0)] if 0 in out else out

        heads = [head(p) for p in array.places]
        assert heads == sorted(heads)
        assert sorted(array.places) == places.tolist()


def test_search_with_a_large_vocabulary():
    random = np.random.default_rng(6)
    items = [(str(k), " ".join(f"w{x}" for x in random.integers(0, 30_000, 40))) for k in range(300)]
    inside = " ".join(words(items[17][1])[i].decode() for i in range(5, 33))
    found = search(["foo " + inside + " bar", None, "w1 w2"], block(items, 10))
    assert (found[0].n_hit, found[0].items, found[0].longest, found[0].spans) == (28, ["17"], 28, [1, 29])
    assert [f.n_words for f in found] == [30, 0, 2]


def test_template_in_many_items_is_searched_in_slices(monkeypatch):
    """No more pairs than PAIRS at a time, and the same result; affected documents are told without any."""
    from thermoband.llm import decontaminate

    template = " ".join(f"t{k}" for k in range(15))
    searched = block([(str(k), f"{template} own{k}") for k in range(60)], 10)
    texts = [f"a{k} {template} own{k} b" for k in range(40)]
    sizes, matched = [], decontaminate.matched
    monkeypatch.setattr(decontaminate, "PAIRS", 100, raising=False)
    monkeypatch.setattr(decontaminate, "matched", lambda sequence, at, *rest: sizes.append(len(at)) or matched(sequence, at, *rest))
    found = search(texts, searched)
    assert sizes and max(sizes) <= 100
    assert [(f.n_hit, f.longest, len(f.items)) for f in found] == [(16, 16, 60)] * 40
    sizes.clear()
    assert all(f.n_hit == 16 for f in search(texts, searched, hits_only=True)) and not sizes
