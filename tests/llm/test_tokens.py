"""Token counts, packing and token files against the tokenizers library itself."""

from __future__ import annotations

import io
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thermoband.llm.common import Bounded, WordEncoder
from thermoband.llm.frames import FRAME_BYTES, FrameReader, FrameWriter, read_frames, round_trip, write_frames
from thermoband.llm.packing import SumOfSquares, pack
from thermoband.llm.token_count import TokenCounter, count_tokens, proven_tokens

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORDS_FILE = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
BYTES_FILE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def ids(text, end):
    return np.array([*WORDS.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def proven():
    return proven_tokens(BYTES_FILE)


def test_proven_tokens_encode_alone(proven):
    assert len(proven) > 40_000
    for string in proven[::97]:
        pieces = BYTES.pre_tokenizer.pre_tokenize_str(string)
        if len(pieces) == 1:  # else it is no pre-token
            assert len(BYTES.encode(string, add_special_tokens=False).ids) == 1


def test_counts(odd_docs, odd_rows, documents):
    for docs in (odd_docs, documents):
        want = Counter(
            (r.doc_id, len((r.text or "").encode()), n := len(BYTES.encode(r.text or "", add_special_tokens=False).ids), n > 1024)
            for r in docs.select("doc_id", "text").collect()
        )
        got = Counter(tuple(r) for r in count_tokens(docs).collect())
        assert got == want


def test_counts_of_nothing(no_docs):
    assert count_tokens(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert any_counter(text) == len(BYTES.encode(text, add_special_tokens=False).ids)
    assert any_encoder(text) == ids(text, 0)[:-1].tobytes()


any_counter = TokenCounter(BYTES_FILE, proven_tokens(BYTES_FILE))
any_encoder = WordEncoder(WORDS_FILE)


def test_all_of_latin_1():
    """Every pair of characters up to U+00FF, with letters around it."""
    letters = [chr(c) for c in range(256)]
    for a in letters:
        text = " ".join(f"x{a}{b}y {b}{a}" for b in letters)
        assert any_encoder(text) == ids(text, 0)[:-1].tobytes(), a


def test_memo_stays_bounded():
    encoder = WordEncoder(WORDS_FILE)
    encoder.pieces.LIMIT = 10
    text = " ".join(f"w{k}x" for k in range(100)) + " " + "y" * 100
    assert encoder(text) == ids(text, 0)[:-1].tobytes()
    assert len(encoder.pieces) <= 5 and len(encoder.pieces.older) <= 5


def test_frequent_entries_stay():
    """An entry that is used between others is made once, however many they are."""
    made = []

    class Memo(Bounded):
        LIMIT = 20

        def make(self, key):
            made.append(key)
            return key

    memo = Memo()
    for k in range(200):
        assert memo[f"k{k}"] == f"k{k}"
        if k % 5 == 0:
            assert memo["often"] == "often"
    assert made.count("often") == 1


def check_packing(rows, docs, window=2048):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= window
    for held in pieces.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *(r.length for r in held)])[:-1].tolist()
        assert sum(r.length for r in held) <= window
    wanted = Counter((r.doc_id, ids(r.text, 1).tobytes()) for r in docs)
    parts = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for (doc_id, content), n in wanted.items():
        size, at = len(content) // 4, 0
        cuts = sorted({k[1:3] for k in parts if k[0] == doc_id and k[4] == size})
        if n == 1:
            assert sum(length for _, length in cuts) == size
            for start, length in cuts:
                assert start == at
                at += length
                assert parts[doc_id, start, length, crc32(content[4 * start : 4 * at]), size] == 1
    assert sum(r.length for r in rows) == sum(len(c) // 4 * n for (_, c), n in wanted.items())
    return pieces


def test_packing(odd_docs, documents):
    for docs in (odd_docs, documents):
        rows = pack(docs).collect()
        pieces = check_packing(rows, docs.select("doc_id", "text").collect())
        assert len(pieces) == -(-sum(r.length for r in rows) // 2048)  # one task, see LEAST_ROWS


def test_packing_nothing(no_docs):
    assert pack(no_docs).count() == 0


def moves(windows, size, anew=True):
    """Every place for `size` ids with the sum of squares it leads to; a cut leaves its rest as a new window."""
    top = windows.window
    for level in range(top):
        if (level and not windows.count[level]) or (not level and not anew):
            continue
        count = windows.count.copy()
        count[level] -= level > 0
        end = level + size
        if end != top:
            count[end if end < top else end - top] += 1
        yield level, int((count**2).sum()) + (windows.cut if end > top else 0)


def test_least_sum_of_squares():
    """Each placement, cuts included, has the least sum of squares over all levels."""
    random = np.random.default_rng(1)
    for sizes in (lambda: random.integers(1, 16), lambda: random.integers(9, 12)):
        windows = SumOfSquares(16, 0, cut=6)
        for k in range(600):
            size = int(sizes())
            best = dict(moves(windows, size))
            assert best[windows.place_for(size)] == min(best.values())
            windows.add(k, bytes(4 * size))
            assert [len(x) for x in windows.at_level] == windows.count.tolist()
    assert windows.cuts


def held_rows(windows):
    out = {}
    for doc_id, start, length, _, total, sequence, offset in windows.closed:
        out.setdefault(doc_id, []).append((start, length, total))
    for pieces in out.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    return out


@pytest.mark.parametrize("sizes", [(68, 69), (75, 88), (1, 128), (120, 128), (37, 44)])
def test_open_windows_stay_few_for_any_sizes(sizes):
    """Sizes that never fit each other lead to cuts, not to ever more open windows; a task has no window too many."""
    random, windows, total = np.random.default_rng(3), SumOfSquares(128, 0), 0
    for k in range(20_000):
        size = int(random.integers(*sizes))
        total += size
        windows.add(k, bytes(4 * size))
        assert windows.count.sum() <= 128 * (windows.cut // 2 + 2)
    windows.finish()
    assert windows.sequence == -(-total // 128)
    assert sum(len(p) for p in held_rows(windows).values()) == 20_000 + windows.cuts


def test_only_the_end_cuts_where_sizes_fit():
    random, windows = np.random.default_rng(4), SumOfSquares(2048, 0)
    for k in range(20_000):
        windows.add(k, bytes(4 * int(random.lognormal(6, 1))))
    assert windows.cuts == 0
    left = int(windows.count.sum())
    windows.finish()
    assert windows.cuts <= left < 1000


def test_the_end_keeps_whole_what_fits():
    windows = SumOfSquares(100, 0)
    for k, size in enumerate((85, 10, 95)):  # three open windows, as earlier placements may leave them
        windows.at_level[size].append([(k, 0, bytes(4 * size), size)])
        windows.count[size] += 1
    windows.finish()
    assert windows.cuts == 0 and windows.sequence == 2


def test_tasks_have_a_least_size(spark, documents):
    docs = documents.repartition(16)
    for r in pack(docs).select("sequence_id").distinct().collect():
        assert r.sequence_id >> 36 == 0


def test_token_files(odd_docs, documents):
    for docs in (odd_docs, documents):
        source = sorted(
            (r for r in docs.select("doc_id", "text").collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0)
        )
        rows = round_trip(docs).collect()
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [r.doc_id for r in source]
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
        wanted = Counter((r.doc_id, len(x := ids(r.text, 2)), crc32(x.tobytes())) for r in source)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == wanted


def test_token_files_of_nothing(no_docs):
    assert round_trip(no_docs).collect() == []


def test_only_wanted_documents(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/ids"
    write_frames(documents, folder)
    got = {r.doc_id: r.ids_crc32 for r in read_frames(spark, folder, [3, 77, 10**9]).collect()}
    texts = {r.doc_id: r.text for r in documents.where("doc_id IN (3, 77)").collect()}
    assert got == {k: crc32(ids(t, 2).tobytes()) for k, t in texts.items()}


def test_frames():
    out = io.BytesIO()
    writer = FrameWriter(2, out)
    random = np.random.default_rng(0)
    docs = [(k * 2, random.integers(0, 49408, random.integers(1, 3000)).astype("<u4")) for k in range(400)]
    for doc_id, numbers in docs:
        writer.add(doc_id, numbers)
    writer.finish()
    content = out.getvalue()
    assert len(writer.seek) > 3

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            Counting.n += size
            return super().read(size)

    reader = FrameReader(Counting(content))
    one = list(reader.documents([400, 401]))
    assert [d.doc_id for d in one] == [400] and (one[0].ids == docs[200][1]).all()
    assert Counting.n < len(content) / 2  # only the frame asked for is read
    assert all(a.doc_id == b[0] and (a.ids == b[1]).all() for a, b in zip(reader.documents(), docs, strict=True))
    # any zstandard reader takes the whole file, and each frame alone
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert len(whole) == sum(size for _, size, _ in writer.seek) and writer.seek[0][1] >= FRAME_BYTES
    damaged = bytearray(content)
    damaged[reader.seek[0][0] // 2] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(FrameReader(io.BytesIO(bytes(damaged))).documents())


def test_files_are_closed_and_replaced(spark, documents, tmp_path):
    """Small files in order, written twice to the same folder as by a task that is run again, and nothing half-written left."""
    folder = f"{tmp_path}/a b"
    few = documents.select("doc_id", "text").coalesce(2)
    one = write_frames(few, folder, file_bytes=20_000).collect()
    names = sorted(p.name for p in (tmp_path / "a b").iterdir())
    two = write_frames(few, folder, file_bytes=20_000).collect()
    assert sorted(one) == sorted(two) and len(names) == len(one) > 1
    assert sorted(p.name for p in (tmp_path / "a b").iterdir()) == names
    rows = read_frames(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in few.collect())
    start = {}
    for r in sorted(rows, key=lambda r: (r.file, r.place)):
        assert r.before == start.get(r.file, 0)
        start[r.file] = r.before + r.n_tokens


def test_equal_rows_go_to_several_ranges(spark, tmp_path):
    same = spark.range(4000).selectExpr("CAST(5 AS BIGINT) AS doc_id", "'one and the same text' AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_frames(same, f"file://{tmp_path}/ids").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) > 4 and max(f.n_docs for f in files) < 2000
    rows = round_trip(same).orderBy("start").collect()
    assert [r.start for r in rows] == [k * rows[0].n_tokens for k in range(4000)]
