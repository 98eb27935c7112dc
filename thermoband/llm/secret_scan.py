"""Secret scanning: candidate tokens, and a random forest that takes out the false positives.

Candidates are long tokens, and values given to a name like
`password`. The forest sees a candidate's length, how usual its character
transitions are (logarithms of the transition rates of all documents, or of
the documents given), how much of it a dictionary covers, where it comes from
(its path: the row's source, and slashes around it) and the words beside it.
It is trained from labelled findings: a bounded number, made by rule from
formats of credentials and of what looks like them. Spark ML fits the forest; its trees
are then evaluated where the candidates are found, in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thermoband.llm import trees
from thermoband.llm.common import byte_letters, slices, tokenizer_file

#: Labelled findings, trees of the forest and their depth.
FINDINGS, TREES, DEPTH = 6000, 24, 8
#: Characters looked at on either side.
CONTEXT = 40
MASK = "[SECRET]"

NAMES = r"pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|bearer"
TOKEN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9+/_~-]{16,}={0,2}")
SIGN = r"[ \t]*+(?::=|=>|={1,3}|:)[ \t]*+"
#: A name and what stands between it and its value, which may start with another name.
ASSIGNED = re.compile(rf"(?i:{NAMES})[\"']?(?:{SIGN}|[ \t]++)[\"']?(?=[^\s\"',;]{{6}})")
#: Each of the names holds one of these, whatever its case.
STEMS = ("pass", "pwd", "secret", "token", "api", "access", "auth", "credential", "private", "bearer")
#: Letters that the pattern takes for `s` and `i`, but that are not so in lower case.
FOLDED = ("\u017f", "\u0131", "\u0130")
VALUE_END = re.compile(r"[\s\"',;]")
NAMED = re.compile(rf"(?i:{NAMES})")
HARMLESS = re.compile(r"(?i:commit|sha1?|sha256|md5|checksum|digest|hash|uuid|guid|revision|rev|etag|build|version|example|dummy|placeholder|page|order|isbn|fingerprint)")
TEST_PATH = re.compile(r"(?i:test|example|sample|doc|fixture|mock|demo)")
WORD = re.compile(r"[A-Za-z]{4,}")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


class Candidate(NamedTuple):
    start: int
    end: int


def may_name(text: str) -> bool:
    """Whether a name can stand in the text: a quick look before the pattern, which is tried at every character."""
    lower = text.lower()
    return any(x in lower for x in STEMS) or (not text.isascii() and any(x in text for x in FOLDED))


def named_values(text: str) -> list[Candidate]:
    """Values given to names. In a value that holds further names, the value of the last of them is one of its own."""
    if not may_name(text):
        return []
    found, end, nested = [], 0, False
    for m in ASSIGNED.finditer(text):
        if m.end() >= end:
            stop = VALUE_END.search(text, m.end())
            end, nested = stop.start() if stop else len(text), False
        elif nested:
            found.pop()
        else:
            nested = True
        found.append(Candidate(m.end(), end))
    return found


def candidates(text: str) -> list[Candidate]:
    """Where candidates stand, in order; one that lies in another is left out, unless it has a name. Long words are proposed too: the forest takes them out."""
    found = {Candidate(*m.span()) for m in TOKEN.finditer(text)}
    named = set(named_values(text))
    kept: list[Candidate] = []
    for c in sorted(found | named, key=lambda c: (c.start, -c.end)):
        if not kept or c.end > kept[-1].end or c in named:
            kept.append(c)
    return kept


def transitions(docs: DataFrame) -> np.ndarray:
    """Logarithms of the rates of byte after byte over all texts of `docs` (256 x 256, one added to each count)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for rows in slices(batches):
            for text in rows.column(0).to_pylist():
                content = np.frombuffer((text or "").encode(), np.uint8)
                for at in range(0, max(0, len(content) - 1), 1 << 20):  # long texts in pieces
                    some = content[at : at + (1 << 20) + 1].astype(np.uint16)
                    total += np.bincount((some[:-1] << 8) | some[1:], minlength=1 << 16)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    counts = docs.select("text").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.ones(1 << 16)  # at most 65,536 rows come here
    for row in counts:
        table[row.pair] += row.n
    table = table.reshape(256, 256)
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def dictionary(spark: SparkSession, tokenizer: str = "byte_bpe_50k.json") -> frozenset[str]:
    """Words of four letters and more: the vocabulary strings that are whole words."""
    letters = {letter: byte for byte, letter in byte_letters().items()}
    words = set()
    for string in Tokenizer.from_str(tokenizer_file(spark, tokenizer).value).get_vocab():
        try:
            word = bytes(letters[x] for x in string).decode().strip()
        except (KeyError, UnicodeDecodeError):
            continue
        if WORD.fullmatch(word):
            words.add(word.lower())
    return frozenset(words)


def described(text: str, c: Candidate, path: str, logs: np.ndarray, words: frozenset[str]) -> list[float]:
    """The features of a candidate."""
    value = text[c.start : c.end]
    before, after = text[max(0, c.start - CONTEXT) : c.start], text[c.end : c.end + CONTEXT]
    content = np.frombuffer(value.encode(), np.uint8)
    steps = logs[content[:-1], content[1:]] if len(content) > 1 else np.zeros(1, np.float32)
    covered = sum(len(m[0]) for m in WORD.finditer(value) if m[0].lower() in words)
    covered = max(covered, sum(len(p) for p in PIECES.findall(value) if len(p) >= 4 and p.lower() in words))
    n = len(value)
    letters, digits = sum(map(str.isalpha, value)), sum(map(str.isdigit, value))
    upper, hexes = sum(map(str.isupper, value)), sum(x in "0123456789abcdef" for x in value)
    shares = np.unique(content, return_counts=True)[1] / max(1, len(content))
    left, right = NAMED.findall(before), before.split()[-2:]
    return [
        float(n),
        float(steps.mean()),
        float(steps.min()),
        covered / n,
        len(PIECES.findall(value)) / n,
        letters / n, digits / n, upper / n, hexes / n,
        -float((shares * np.log2(shares)).sum()),
        float(value.count("/") + value.count("_") + value.count("-")) / n,
        float(before.endswith("/") or after.startswith("/") or value.startswith("/")),
        float(bool(TEST_PATH.search(path))),
        float(bool(left)),
        float(bool(re.search(rf"(?i:{NAMES})[\"']?{SIGN}[\"']?$", before))),
        float(bool(HARMLESS.search(" ".join(right)))),
        float(before[-1:] in ("=", ":", '"', "'")),
        float(after[:1] in ('"', "'")),
        float(value.startswith(("AKIA", "ASIA", "ghp_", "sk_", "xox", "eyJ"))),
        float(bool(HARMLESS.search(value)) or "your" in value.lower() or "xxx" in value.lower()),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> Iterator[tuple[str, Candidate, str, int]]:
    """n findings (text, place, path, label): credentials (1) and what looks like them (0), by rule from the seed."""
    random = np.random.default_rng(seed)
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def some(alphabet: str, size: int) -> str:
        return "".join(alphabet[i] for i in random.integers(0, len(alphabet), size))

    def word() -> str:
        return "".join(syllables[i] for i in random.integers(0, len(syllables), random.integers(2, 5)))

    def longer(least: int) -> str:
        out = word()
        while len(out) < least:
            out += word()
        return out

    def glued(by: str, k: int) -> str:
        return by.join(word() for _ in range(k))

    hexes, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    size = lambda a, b: int(random.integers(a, b))
    signs = [" password:  ", " auth token: ", ' password => "', " db_password = ", " secret\t:=\t", " credential password: "]
    #: label, before, value, after
    forms = [
        lambda: (1, " ", "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), " "),
        lambda: (1, " ", "AKIA" + some(capitals, 16), "."),
        lambda: (1, ' token = "', some(hexes, 40), '" '),
        lambda: (1, " token: ", some(hexes, 32), " "),
        lambda: (1, " password=", some(hexes, 18), " "),
        lambda: (1, " password=", some(alnum + "!@#$%", size(8, 20)), " "),
        lambda: (1, signs[size(0, len(signs))], some(alnum + "!@#$%", size(8, 20)), " "),
        lambda: (1, ' api_key = "', some(alnum, size(24, 44)), '" '),
        lambda: (1, " secret: ", some(alnum + "+/", 40), " "),
        lambda: (1, " ", "ghp_" + some(alnum, 36), " "),
        lambda: (1, " Bearer ", "eyJ" + some(alnum, 33) + "-" + some(alnum, 30), " "),
        lambda: (1, " key ", some(alnum, size(32, 64)), " "),
        lambda: (1, " ", "AKIA" + some(capitals[:26], 16), " "),
        lambda: (1, " key ", some(lower, size(20, 44)), " "),
        lambda: (1, " key ", some(capitals[:26], size(20, 44)), " "),
        lambda: (0, " commit ", some(hexes, 40), " "),
        lambda: (0, " sha256 ", some(hexes, 64), " "),
        lambda: (0, " checksum: ", some(hexes, 32), " "),
        lambda: (0, " uuid ", "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), " "),
        lambda: (0, " ", some("0123456789", size(16, 20)), " "),
        lambda: (0, " /", glued("/", size(3, 6)) + str(size(1, 99)), " "),
        lambda: (0, " ", glued("_", size(2, 5)) + "_" + str(size(1, 99)), " "),
        lambda: (0, " ", "".join(word().capitalize() for _ in range(size(3, 6))), "("),
        lambda: (0, " ", glued("-", size(3, 6)), " "),
        lambda: (0, " password ", word() + word(), " "),
        lambda: (0, " password=", ["changeme", "your_password", "xxxxxxxxxx", "password123", "<password>"][size(0, 5)], " "),
        lambda: (0, " token = ", ["your_token_here", "None,", "example_token", "xxxxxxxxxxxxxxxx"][size(0, 4)], " "),
        lambda: (0, " secret ", word() + word(), ". "),
        lambda: (0, signs[size(0, len(signs))], ["changeme", "your_password", "xxxxxxxxxx", "password123", "<password>"][size(0, 5)], " "),
        lambda: (0, [" auth ", " credential ", " secret "][size(0, 3)], ["token:", "password:", "secret:", "password"][size(0, 4)], " "),
        lambda: (0, " ", word().upper() + "-" + word().upper() + "-" + word().upper() + "-" + str(size(1, 9)), " "),
        lambda: (0, " isbn ", "978" + some("0123456789", 13), " "),
        lambda: (0, " ", word() + word() + word() + word() + "1", " "),
        lambda: (0, " ", "-" * size(16, 40), " "),
        lambda: (0, " ", longer(size(16, 40)), " "),
        lambda: (0, " ", longer(size(16, 40)).upper(), " "),
        lambda: (0, " ", longer(size(16, 40)).capitalize(), ". "),
        lambda: (0, " key ", longer(size(16, 40)), " "),
        lambda: (0, " ", some(lower, size(1, 4)) * size(16, 40), " "),
    ]
    for k in range(n):
        label, before, value, after = forms[k % len(forms)]()
        lead, tail = glued(" ", 5), glued(" ", 4)
        start = len(lead) + len(before)
        yield lead + before + value + after + tail, Candidate(start, start + len(value)), f"src{size(0, 20)}", label


class Scanner(NamedTuple):
    """What a task needs to find and judge candidates; its size does not depend on the documents."""

    logs: np.ndarray
    words: frozenset[str]
    forest: list[trees.Node]

    def scores(self, x: list[list[float]]) -> np.ndarray:
        return np.array([sum(trees.leaf_value(t, row) for t in self.forest) / len(self.forest) for row in x])

    def find(self, text: str | None, path: str | None) -> list[tuple[Candidate, float]]:
        here = candidates(text) if text else []
        p = self.scores([described(text, c, path or "", self.logs, self.words) for c in here])
        return list(zip(here, p.tolist(), strict=True))


def fit(docs: DataFrame, n: int = FINDINGS, seed: int = 7) -> Scanner:
    """Transitions from all of `docs`, the dictionary, and the forest from n labelled findings."""
    spark = docs.sparkSession
    logs, words = transitions(docs), dictionary(spark)
    rows = [(Vectors.dense(described(t, c, p, logs, words)), float(y)) for t, c, p, y in labelled_findings(n, seed)]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(2)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1).fit(data)

    def share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    return Scanner(logs, words, [trees.tree(t, share) for t in model.trees])


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), value_sha256, score, is_secret (score of 0.5 or more).

    Texts that are null or empty have no candidates. Rows are searched as
    often as they occur; null ids stay null; a null or missing `source` is an empty path. Other columns are not
    read, and an empty table gives no rows. The values themselves are not given.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out = []
            for doc_id, text, source in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                for c, p in sent.value.find(text, source):
                    out.append((doc_id, c.start, c.end, hashlib.sha256(text[c.start : c.end].encode()).hexdigest(), p))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "value_sha256", "score"]
            )

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", path.alias("path")).mapInArrow(
        run, "doc_id bigint, start bigint, end bigint, value_sha256 string, score double"
    )
    return found.withColumn("is_secret", F.col("score") >= 0.5)


def mask_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """`docs` with every secret in `text` replaced by MASK, and `n_chars`, if there, counted anew for those rows. All other columns and rows as they are."""
    sent, names = docs.sparkSession.sparkContext.broadcast(scanner), docs.columns
    text, source = names.index("text"), names.index("source") if "source" in names else None
    length = names.index("n_chars") if "n_chars" in names else None

    def masked(content: str | None, path: str | None) -> str | None:
        at, out = 0, []
        for c, p in sent.value.find(content, path):
            if p >= 0.5:
                if c.start >= at:
                    out += [content[at : c.start], MASK]
                at = max(at, c.end)
        return "".join([*out, content[at:]]) if at else content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            columns = list(rows.columns)
            before = columns[text].to_pylist()
            paths = columns[source].to_pylist() if source is not None else [None] * len(before)
            after = [masked(t, None if p is None else str(p)) for t, p in zip(before, paths, strict=True)]
            columns[text] = pa.array(after, columns[text].type)
            if length is not None:
                counted = [len(a) if a != b else n for a, b, n in zip(after, before, columns[length].to_pylist(), strict=True)]
                columns[length] = pa.array(counted, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)
