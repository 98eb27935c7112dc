"""What the corpus operators share: tables, tokenizers, batches of rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

#: Rows turned into Python objects at a time; Spark bounds the bytes of a whole Arrow batch.
ROWS = 256
#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def tokenizer_file(spark: SparkSession, name: str) -> Broadcast:
    """A public tokenizer's file, read on the driver and broadcast: it is a few MB whatever the corpus."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


def spelled(text: str) -> str:
    """`text` in the letters of a byte-level vocabulary."""
    return text.encode().decode("latin-1").translate(_LETTERS)


class Bounded(dict):
    """A memo of at most LIMIT entries in two generations, so that a worker's memory stays bounded.

    A full generation becomes the older one, and the one before is dropped. What is used again moves to the younger
    generation, so frequent entries stay. Subclasses say how an entry is made.
    """

    LIMIT = 300_000
    LONGEST = 64

    def __init__(self) -> None:
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.LIMIT // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Pieces(Bounded):
    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def make(self, piece: str) -> bytes:
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled(piece)))


class WordEncoder:
    """Ids of word_bpe_49k.json, equal to the library's, as little-endian 32-bit integers.

    A text is cut into pre-tokens, and repeated ones are looked up. That holds
    for Latin-1 texts, where normalising is lower-casing and Python's white
    space is the library's (but for four control characters). Every other text,
    and one with the start of a special token's string, is left to the library
    whole.
    """

    #: Letters and digits of Latin-1 in lower case (fixed values).
    LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    #: The pre-tokens of word_bpe_49k.json (fixed value) in such texts.
    PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
    PLAIN = regex.compile("[^\\x00-\\x1b\\x20-\\xff]|<\\|")
    #: The same for ASCII texts.
    UNLIKE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, definition: str) -> None:
        self.library = Tokenizer.from_str(definition)
        self.pieces = _Pieces(self.library.model)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.UNLIKE) if text.isascii() else self.PLAIN.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        return b"".join(map(self.pieces.__getitem__, self.PRETOKEN.findall(text.lower())))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(definition: str) -> WordEncoder:
    """One encoder per worker process, so that later tasks find its memo filled."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]
