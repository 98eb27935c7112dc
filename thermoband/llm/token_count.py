"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, every string of the vocabulary is put through the merges alone. Those
that come out as one token are proven: a pre-token equal to one of them is one
token, whatever stands around it, because merges never cross pre-tokens. Texts
are cut into pre-tokens; proven ones count 1, and only the rest is merged (by
the library's own model, with a bounded memo).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thermoband.llm.common import Bounded, byte_letters, slices, spelled, tokenizer_file

#: The pre-tokens of byte_bpe_50k.json (fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points outside these ranges may have another class in the library's Unicode tables; the library counts such texts.
UNSURE = regex.compile("[^\\x00-\\u0557\\u0590-\\u0600\\u2010-\\u2070\\u3040-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]")


def proven_tokens(definition: str) -> list[str]:
    """The vocabulary strings, as texts, that the merges turn into exactly one token."""
    tokenizer = Tokenizer.from_str(definition)
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    proven = []
    for string in tokenizer.get_vocab(with_added_tokens=False):
        if len(tokenizer.model.tokenize(string)) != 1:
            continue
        try:
            proven.append(bytes(byte_of[letter] for letter in string).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character: no text of its own
            continue
    return proven


class _Merged(Bounded):
    """Number of tokens of a pre-token that isn't proven."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def make(self, piece: str) -> int:
        return len(self.model.tokenize(spelled(piece)))


class TokenCounter:
    def __init__(self, definition: str, proven: list[str]) -> None:
        self.library = Tokenizer.from_str(definition)
        self.proven = frozenset(proven)
        self.merged = _Merged(self.library.model)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if UNSURE.search(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = PRETOKEN.findall(text)
        rest = [p for p in pieces if p not in self.proven]
        return len(pieces) - len(rest) + sum(map(self.merged.__getitem__, rest))


_counters: dict[int, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. A null doc_id stays null,
    repeated rows are counted each, other columns are not read, and an empty
    table gives no rows. A text's tokens do not depend on other rows, so there
    is no shuffle. Special strings in a text are single tokens, as the library
    has them by default.
    """
    spark = docs.sparkSession
    file = tokenizer_file(spark, tokenizer)
    proven = spark.sparkContext.broadcast(proven_tokens(file.value))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file.value, proven.value)
        for rows in slices(batches):
            texts = rows.column(1).to_pylist()
            tokens = pa.array(list(map(counter, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    return (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            "text",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        )
        .mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def _counter(definition: str, proven: list[str]) -> TokenCounter:
    """One counter per worker process, so that later tasks find its memo filled."""
    key = hash(definition)
    if key not in _counters:
        _counters[key] = TokenCounter(definition, proven)
    return _counters[key]
