"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn and then user and
assistant in turn, user first. Edits go over the rows in order: delete a row,
insert an empty turn before it, keep it or give it the other role. The search
is depth first, edits in ASCII order of their initials, under a cost bound that
rises by one until a path is accepted; that path is the cheapest one and, of
the cheapest, the least string. States (row, place in the grammar) that failed
are kept with the largest budget that they failed with.

A long conversation is cut into runs of RUN rows, searched from the last to
the first: what the rest costs from each place in the grammar is known by then
and is the exact estimate at the end of the run. So the work grows with the
number of rows, however long a conversation is. Inserted turns belong to the
row after them, so no run's path is the start of another one's and the least
path of the whole begins with the least path of its first run.

Two sorted passes stream over the rows. The first sees digests instead of
texts; of a conversation it holds a letter a row, a digest of each different
turn, and the searched runs. The second sees the edits, then the texts one by
one. An ordinary hot key is many conversations; the turns of a single one have
one order and one digest over them all, so they go through one task, as a
stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.llm.common import slices

RUN = 64
DELETE, KEEP_TRUNCATED, EDIT = 3, 1, 2
NEVER = 1 << 60
#: Places in the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place after a turn with this initial, where the grammar takes it.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The place after an inserted turn or one with a new role, and that role.
GIVEN = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: What may still follow costs nothing if the conversation can end here.
END = (0, NEVER, NEVER, 0)
#: Neighbouring initials that are in order.
LEGAL = frozenset(("su", "ua", "au"))
#: Code of a row that has to go. Others have their role's initial, in upper case if truncated.
GONE = "-"
#: Repairs remembered by their codes, per worker.
MEMO = 50_000


class _Run:
    """The search over one run of codes; `border` has the cost of the rest from each place."""

    def __init__(self, codes: str, border: tuple[int, ...], last: bool) -> None:
        self.codes, self.last = codes, last
        least = min(border)
        self.base, self.border = least, [b - least for b in border]
        self.failed: dict[tuple[int, int], int] = {}
        self.sure = [0] * (len(codes) + 1)  # what the rows from here on cost at least
        for i in range(len(codes) - 1, -1, -1):
            c = codes[i]
            self.sure[i] = self.sure[i + 1] + (DELETE if c == GONE else KEEP_TRUNCATED if c.isupper() else 0)

    def cheapest(self, start: int) -> tuple[int, str, int]:
        """Cost with all that follows, edits in this run, and the place after it."""
        bound = self.sure[0]
        while True:
            path: list[str] = []
            if (end := self._deepen(0, start, bound, path)) is not None:
                return bound + self.base, "".join(reversed(path)), end
            bound += 1

    def _deepen(self, i: int, place: int, left: int, path: list[str]) -> int | None:
        """The place at the end of the first path within the budget `left`, whose edits are put on `path` last first."""
        if left < self.sure[i]:
            return None
        at_end = i == len(self.codes)
        if at_end and self.border[place] <= left:
            return place
        if (at_end and not self.last) or self.failed.get((i, place), -1) >= left:
            return None
        code = GONE if at_end else self.codes[i]
        cost = KEEP_TRUNCATED if code.isupper() else 0
        given = GIVEN[place][0]
        tries = [] if at_end else [("D", i + 1, place, DELETE)]
        tries.append(("I", i, given, EDIT))
        if code != GONE:
            if (kept := NEXT[place].get(code.lower())) is not None:
                tries.append(("K", i + 1, kept, cost))
            tries.append(("R", i + 1, given, EDIT + cost))
        for edit, row, to, price in tries:
            if price <= left and (end := self._deepen(row, to, left - price, path)) is not None:
                path.append(edit)
                return end
        self.failed[(i, place)] = left
        return None


def cheapest_edits(codes: str, run: int = RUN) -> tuple[int, str]:
    """Least cost of a repair and its edits. `codes` has a letter per row: GONE, or the role's initial (anything but
    s, u, a fits nowhere), in upper case if the text is truncated."""
    border, found = END, []
    cuts = list(range(0, len(codes), run)) or [0]
    for at in reversed(cuts):
        search = _Run(codes[at : at + run], border, at == cuts[-1])
        found.append([search.cheapest(p) for p in (range(4) if at else (START,))])
        border = tuple(cost for cost, _, _ in found[-1])
    edits, place = [], START
    for options in reversed(found):
        _, path, place = options[place]
        edits.append(path)
    return border[START], "".join(edits)


def _code(initial: str, truncated: bool) -> str:
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if truncated else letter


class _Report:
    """Faults and codes of one conversation, row by row."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.turn = self.first = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        again = digest in self.seen
        self.seen.add(digest)
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated and not blank and not again
        self.codes.append(GONE if blank or again else _code(initial, truncated))

    def row(self, edits: Callable[[str], tuple[int, str]]) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.turns
        cost, audit = edits("".join(self.codes))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _remembering(run: int) -> Callable[[str], tuple[int, str]]:
    memo: dict[str, tuple[int, str]] = {}

    def edits(codes: str) -> tuple[int, str]:
        if len(codes) > run:
            return cheapest_edits(codes, run)
        if codes not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[codes] = cheapest_edits(codes, run)
        return memo[codes]

    return edits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


#: What counts as white space (fixed value).
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of one turn follow the initial of their role and a digest of role and text.
ORDER = ("turn", "initial", "digest")


def _known(turns: DataFrame) -> DataFrame:
    """conv_id, role and text without nulls, and the columns in ORDER."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumns({"initial": F.substring("role", 1, 1), "digest": F.unhex(F.sha2(both, 256))})


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of a conversation together and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def edits(turns: DataFrame, run: int = RUN) -> DataFrame:
    """A row per conversation: conv_id, the COUNTS (gaps in the turns, rows by their first fault, neighbours out of
    order, cost of the repair) and `audit`, the initials of its edits.

    Rows are taken by turn, nulls first, then by ORDER. A null role or text is one space; an empty
    role fits nowhere. Rows without a conv_id are
    one conversation. Repeated rows are duplicates of the first. Other columns are not read; an empty table gives no rows.
    """
    ended = F.rtrim("text", F.lit(BLANKS))
    slim = _known(turns).select(
        "conv_id", *ORDER, (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    names = ["conv_id", *COUNTS, "audit"]
    schema = pa.schema([*((n, pa.int64()) for n in names[:-1]), ("audit", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cheapest = _remembering(run)

        def reports() -> Iterator[tuple]:
            now, report = None, None
            for conv, turn, initial, digest, blank, truncated in _rows(batches):
                if report is None or conv != now:
                    if report is not None:
                        yield (now, *report.row(cheapest))
                    now, report = conv, _Report()
                report.add(turn, initial, digest, blank, truncated)
            if report is not None:
                yield (now, *report.row(cheapest))

        yield from _in_batches(reports(), schema)

    return _streamed(slim, *ORDER).mapInArrow(walk, ", ".join([*(f"{n} bigint" for n in names[:-1]), "audit string"]))


class _Repair:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def _next(self) -> str:
        self.at += 1
        return self.audit[self.at - 1 : self.at]

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns inserted here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.place, role = GIVEN[self.place]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What a row becomes, and the turns inserted before it."""
        yield from self.inserted()
        edit = self._next()
        if edit == "R":
            self.place, role = GIVEN[self.place]
        elif edit == "K":
            self.place = NEXT[self.place][role[:1]]
        if edit != "D":
            yield role, text


def _with_edits(turns: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of `told` (see `edits`), each followed by the rows of its conversation."""
    counts = F.struct(*COUNTS)
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(ORDER, ("bigint", "string", "binary"), strict=True)]
    first = told.select("conv_id", *none, F.lit("").alias("role"), F.col("audit").alias("text"), counts.alias("counts"), F.lit(0).alias("kind"))
    rest = _known(turns).select("conv_id", *ORDER, "role", "text", F.lit(None).cast(first.schema["counts"].dataType).alias("counts"), F.lit(1).alias("kind"))
    return _streamed(first.union(rest), "kind", *ORDER).select("conv_id", "kind", "role", "text", "counts")


def repaired(turns: DataFrame, run: int = RUN) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role and text of each turn. Cases as in `edits`."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns_() -> Iterator[tuple]:
            now, repair, place = None, None, 0
            for conv, kind, role, text, _ in _rows(batches):
                if kind == 0:
                    if repair is not None:
                        yield from ((now, n, *t) for n, t in enumerate(repair.inserted(), place))
                    now, repair, place = conv, _Repair(text), 0
                else:
                    for t in repair.row(role, text):
                        yield (conv, place, *t)
                        place += 1
            if repair is not None:
                yield from ((now, n, *t) for n, t in enumerate(repair.inserted(), place))

        yield from _in_batches(turns_(), schema)

    told = edits(turns, run)
    return _with_edits(turns, told).mapInArrow(walk, "conv_id bigint, place bigint, role string, text string")


def report(turns: DataFrame, run: int = RUN) -> DataFrame:
    """The rows of `edits` with `repaired_sha256`, the digest of the repaired turns (`role:text`, joined by newlines)."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([*((n, pa.int64()) for n in names[:-2]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports() -> Iterator[tuple]:
            told, repair, digest, glue = (), None, None, b""

            def add(turns: Iterator[tuple[str, str]]) -> None:
                nonlocal glue
                for role, text in turns:
                    digest.update(glue + f"{role}:{text}".encode())
                    glue = b"\n"

            def closed() -> tuple:
                add(repair.inserted())
                return (*told, repair.audit, digest.hexdigest())

            for conv, kind, role, text, counts in _rows(batches):
                if kind == 0:
                    if repair is not None:
                        yield closed()
                    told, repair, digest, glue = (conv, *(counts[n] for n in COUNTS)), _Repair(text), hashlib.sha256(), b""
                else:
                    add(repair.row(role, text))
            if repair is not None:
                yield closed()

        yield from _in_batches(reports(), schema)

    told = edits(turns, run)
    columns = ", ".join([*(f"{n} bigint" for n in names[:-2]), "audit string", "repaired_sha256 string"])
    return _with_edits(turns, told).mapInArrow(walk, columns)
