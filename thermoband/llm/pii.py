"""Personal data by candidates and gradient-boosted trees, in DataFrame functions only.

Generators with high recall propose spans, which may overlap. The strict ones
(`BASE`) are checked by rule and always kept; of the others (`MORE`) boosted
trees decide from the span's format and its surroundings, with one threshold
per kind, calibrated for precision on labelled texts that the trees did not
see. The labelled texts are made by rule (`labelled_texts`): personal data and
look-alikes between words, a bounded number. Only the trees are fitted; they become
one expression, so that every document is done in one pass without a shuffle.

Patterns use possessive quantifiers wherever a repeat can run long, so that
texts of any length are matched in linear time and constant stack.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoband.llm import trees

KINDS = ("email", "ip", "card", "phone")
#: Labelled texts, rounds and depth of the trees, and the precision that thresholds are set for.
TEXTS, ROUNDS, DEPTH, PRECISION = 6000, 12, 5, 0.98
#: Characters of context on either side of a candidate.
CONTEXT = 24

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


class Generator(NamedTuple):
    kind: str
    hint: str  # what a text must have to be searched at all
    pattern: str


#: The given patterns, leftmost and not overlapping; a look-behind stands in for starts that can only repeat an earlier failure.
BASE = (
    Generator("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Generator("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    Generator("card", r"[0-9](?:[ -]?[0-9]){15}", r"[0-9]++(?:[ -][0-9]++)*+"),
    Generator("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
MORE = (
    Generator("email", r"[(\[]at[)\]]", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?[(\[]at[)\]] ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    Generator("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    Generator("card", r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    Generator("card", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", r"(?<![0-9])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
    Generator("phone", r"[0-9]{4}", r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    # national numbers: a trunk 0, an area code, and groups of any size, nine to eleven digits in all
    Generator("phone", r"(?<![0-9])\(?0[0-9]{1,4}\)?[ ./-]", r"(?<![0-9])(?=[(]?(?:[0-9][ ()./-]{0,3}){9,11}(?![0-9]))(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ ./-]{1,2}[0-9]{2,8}(?:[ .-][0-9]{2,5}){0,4}(?![0-9])"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_total(digits: Column) -> Column:
    size = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.substring(digits, size - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x - F.when(x > 9, 9).otherwise(0))


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    return F.when(F.length(digits) > 0, _luhn_total(digits) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    """The rule that a match of the given pattern has to pass."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, generator: Generator) -> Column:
    """Array of (start, end, value) of the generator's matches, in code points.

    The pieces between matches give their places: a start is the length of all
    pieces and matches before it.
    """
    pattern = F.lit(generator.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, generator.pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["value"].alias("value"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    return F.when(text.rlike(generator.hint), F.aggregate(pairs, begin, step)["out"]).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of (start, end, value) that the given rules accept."""

    def accepted(g: Generator) -> Column:
        return F.filter(matches(text, g), lambda m: valid(g.kind, m["value"]))

    return {g.kind: accepted(g) for g in BASE}


def features(text: Column, kind: str, m: Column) -> Column:
    """Format and context of a candidate as an array of numbers."""
    value, digits = m["value"], _digits(m["value"])
    before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
    after = F.substring(text, m["end"] + 1, F.lit(CONTEXT))
    last, first = F.substring(before, F.length(before), F.lit(1)), F.substring(after, F.lit(1), F.lit(1))

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0)).cast("double")

    def near(words: str) -> Column:
        return flag(F.lower(before).rlike(rf"\b(?:{words})\b[^0-9]{{0,8}}$"))

    numbers = [
        F.lit(float(KINDS.index(kind))),
        F.length(value).cast("double"),
        F.length(digits).cast("double"),
        flag(value.startswith("+")),
        flag(value.contains("(")),
        F.length(F.regexp_replace(value, r"[^ .\-]", "")).cast("double"),
        flag(luhn(digits)),
        flag(value.rlike("^[3-6]")),
        flag(value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        flag(value.rlike(r"^\(?0[1-9]")),
        flag(value.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:19|20)[0-9]{2}(?![0-9])")),
        F.size(F.split(value, "[^0-9]+")).cast("double"),
        flag(value.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$")),
        flag(last.rlike("[A-Za-z0-9_]")),
        flag(first.rlike("[A-Za-z0-9_]")),
        flag(last.rlike(r"[.\-/#=\"':]")),
        flag(first.rlike(r"[\-/=\"':]") | after.rlike(r"^\.[0-9]")),
        flag(before.rlike("[0-9][ .-]?$")),
        flag(after.rlike("^[ .-]?[0-9]")),
        near("phone|tel|telephone|call|mobile|fax|contact|cell"),
        near("card|visa|pay|credit|debit"),
        near("ip|host|server|address|from|mail|email|write"),
        near("order|id|no|number|version|ref|invoice|ticket|part|serial|isbn|build|release|v"),
    ]
    return F.array(*numbers)


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, f) from all generators, the given ones too."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,f:array<double>>>")

    def proposed(g: Generator) -> Column:
        return F.transform(
            matches(text, g),
            lambda m: F.struct(
                F.lit(KINDS.index(g.kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                features(text, g.kind, m).alias("f"),
            ),
        )

    return F.concat(none, *[proposed(g) for g in MORE])


WORDS = (
    "the of and to call phone our host server mail card order no version at is was from with for that this invoice tel "
    "contact ip build serial ref pay by visa write address ticket number und der la el les que den von para"
).split()


def labelled_texts(spark: SparkSession, n: int = TEXTS) -> DataFrame:
    """n texts (id, text, own): personal data (kind, value) in `own`, or look-alikes, between words; by rule from the id."""

    def pick(seed: str, bound: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bound))

    def number(seed: str, size: int) -> Column:
        return F.lpad(pick(seed, 10**size).cast("string"), size, "0")

    def octet(seed: str) -> Column:
        return (pick(seed, 254) + 1).cast("string")

    def word(seed: str) -> Column:
        return F.element_at(F.array(*map(F.lit, WORDS)), (pick(seed, len(WORDS)) + 1).cast("int"))

    def sentence(seed: str) -> Column:
        return F.concat_ws(" ", *[word(seed + str(k)) for k in range(4)])

    head = F.concat((pick("first", 4) + 3).cast("string"), number("card", 14))
    check = F.pmod(F.lit(10) - _luhn_total(F.concat(head, F.lit("0"))), F.lit(10))
    card = F.concat(head, check.cast("string"))
    wrong = F.concat(head, F.pmod(check + 1 + pick("off", 9), F.lit(10)).cast("string"))

    def grouped(c: Column) -> Column:
        return F.regexp_replace(c, "([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})", "$1-$2-$3-$4")

    short_head = F.concat(F.lit("37"), number("amex", 12))
    short_check = F.pmod(F.lit(10) - _luhn_total(F.concat(short_head, F.lit("0"))), F.lit(10))

    def four_six_five(check: Column) -> Column:
        return F.regexp_replace(F.concat(short_head, check.cast("string")), "([0-9]{4})([0-9]{6})([0-9]{5})", "$1 $2 $3")

    amex, no_amex = four_six_five(short_check), four_six_five(F.pmod(short_check + 1 + pick("off15", 9), F.lit(10)))
    two = [F.lpad(pick(f"t{k}", 100).cast("string"), 2, "0") for k in range(5)]
    code = (pick("code", 8) + 1).cast("string")
    area, a, b = (pick("area", 800) + 200).cast("string"), number("a", 3), number("b", 4)
    ip = F.concat_ws(".", *[octet(f"o{k}") for k in range(4)])
    plain = F.concat_ws("", area, a, b)
    hexed = F.sha1(F.col("id").cast("string").cast("binary"))
    full = F.concat(F.lit("+1 ("), area, F.lit(") "), a, F.lit("-"), b)
    nothing, space = F.lit(""), F.lit(" ")
    hidden, handle = F.concat(word("u"), F.lit(" [at] "), word("w"), F.lit(" [dot] com")), F.concat(word("u"), F.lit("(at)"), word("w"), F.lit(".org"))
    dashed, dotted, short = F.concat_ws("-", area, a, b), F.concat_ws(".", area, a, b), F.concat(F.lit("("), area, F.lit(") "), a, F.lit("-"), b)
    long_ = F.concat(number("e", 9), number("g", 8))
    london = F.concat(F.lit("0"), code, F.lit("0 7"), a, space, b)
    paris = F.concat_ws(" ", F.concat(F.lit("0"), code), *two[:4])
    berlin = F.concat(F.lit("0"), code, F.lit("0/"), a, b)
    munich = F.concat(F.lit("(0"), code, F.lit("9) "), a, space, b)
    date = F.concat_ws(".", F.lpad((pick("dd", 28) + 1).cast("string"), 2, "0"), F.lpad((pick("mm", 12) + 1).cast("string"), 2, "0"), (pick("yy", 40) + 1985).cast("string"))
    noon = F.concat(F.lpad(pick("hh", 24).cast("string"), 2, "0"), F.lit("."), F.lpad(pick("mi", 60).cast("string"), 2, "0"))
    #: what stands between two halves of a sentence, and what of it is personal data
    cases = [
        ([full], [("phone", full)]),
        ([full, space, card], [("phone", full), ("card", card)]),
        ([full, space, ip], [("phone", full), ("ip", ip)]),
        ([full, space, wrong], [("phone", full)]),
        ([dashed], [("phone", dashed)]),
        ([short, F.lit(".")], [("phone", short)]),
        ([dotted, F.lit(",")], [("phone", dotted)]),
        ([F.lit("order "), plain], []),
        ([F.lit("id="), plain], []),
        ([F.lit("/"), dashed, F.lit("/x")], []),
        ([F.lit("a7"), plain, F.lit("c1")], []),
        ([number("c", 4), space, area, space, a, space, b, space, number("d", 4)], []),
        ([card], [("card", card)]),
        ([card, space, ip], [("card", card), ("ip", ip)]),
        ([card, space, card], [("card", card)]),
        ([grouped(card), F.lit(".")], [("card", grouped(card))]),
        ([wrong], []),
        ([wrong, space, ip], [("ip", ip)]),
        ([grouped(wrong)], []),
        ([F.lit("f1e"), card, F.lit("ab0")], []),
        ([F.lit("id="), long_], []),
        ([F.lit("0."), wrong], []),
        ([ip], [("ip", ip)]),
        ([F.lit("version "), octet("p"), F.lit(".0."), octet("q"), F.lit("."), (pick("r", 600) + 300).cast("string")], []),
        ([ip, F.lit("."), octet("s")], []),
        ([hidden], [("email", hidden)]),
        ([handle], [("email", handle)]),
        ([word("u"), F.lit(" (at) "), number("h", 2), F.lit(".30")], []),
        ([F.lit('token = "'), hexed, F.lit('"')], []),
        ([F.lit("2024-01-15 10:22:"), number("s", 2), F.lit("."), number("ms", 6)], []),
        ([F.lit("commit "), hexed], []),
        ([amex], [("card", amex)]),
        ([F.regexp_replace(amex, " ", "-"), F.lit(".")], [("card", F.regexp_replace(amex, " ", "-"))]),
        ([no_amex], []),
        ([london], [("phone", london)]),
        ([paris, F.lit(",")], [("phone", paris)]),
        ([berlin], [("phone", berlin)]),
        ([munich], [("phone", munich)]),
        ([date, space, noon], []),
        ([F.lit("0"), code, space, number("n8", 8), F.lit("-x")], []),
        ([F.lit("0."), number("n9", 9)], []),
        ([F.lit("id="), london], []),
        ([F.lit("/"), paris, F.lit("/x")], []),
        ([F.concat_ws(" ", *two, number("n7", 2), two[1])], []),
    ]
    none = F.array().cast("array<struct<kind:string,value:string>>")
    chosen = F.element_at(
        F.array(*[
            F.struct(
                F.concat(*parts).alias("value"),
                F.concat(none, *[F.array(F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in own]).alias("own"),
            )
            for parts, own in cases
        ]),
        (F.pmod(F.col("id"), F.lit(len(cases))) + 1).cast("int"),
    )
    rows = spark.range(n).select("id", chosen.alias("c"), sentence("l").alias("lead"), sentence("r").alias("tail"))
    return rows.select("id", F.concat_ws(" ", "lead", "c.value", "tail").alias("text"), F.col("c.own").alias("own"))


class Selector(NamedTuple):
    """Trees with their weights, and the least score by kind."""

    trees: list[trees.Node]
    weights: list[float]
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        """The probability that a candidate is personal data."""
        parts = [trees.expression(t, f) * w for t, w in zip(self.trees, self.weights, strict=True)]
        return 1 / (1 + F.exp(-2 * reduce(Column.__add__, parts)))

    def selects(self, c: Column) -> Column:
        least = F.element_at(F.array(*[F.lit(self.thresholds[k]) for k in KINDS]), c["kind"] + 1)
        return self.score(c["f"]) >= least


def fit(spark: SparkSession, n: int = TEXTS) -> Selector:
    """Fit the trees on half of the labelled texts and the thresholds on the other half: for each kind the
    least score from 0.5 on at which PRECISION of what is selected is personal data; a kind without one selects nothing."""
    found = labelled_texts(spark, n).select("*", F.explode(candidates(F.col("text"))).alias("c"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.kind") + 1)
    value = F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    rows = found.select(
        (F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0).alias("fitted"), name.alias("kind"),
        F.array_contains("own", F.struct(name.alias("kind"), value.alias("value"))).cast("double").alias("label"),
        array_to_vector("c.f").alias("features"),
    ).coalesce(2).cache()
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.4, seed=1).fit(rows.where("fitted"))
    grid = [x / 20 for x in range(10, 20)]
    scored = model.transform(rows.where("NOT fitted")).select(
        "kind", "label", vector_to_array("probability")[1].alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("least")
    )
    right = scored.where("p >= least").groupBy("kind", "least").agg(F.avg("label").alias("precision")).collect()
    thresholds = {k: min((r.least for r in right if r.kind == k and r.precision >= PRECISION), default=2.0) for k in KINDS}
    rows.unpersist()
    return Selector([trees.tree(t, lambda n: n.prediction()) for t in model.trees], list(model.treeWeights), thresholds)


def find_personal_data(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, base (for each kind its given spans) and spans (all of them, as (kind, start, end) in code points, sorted).

    A candidate that lies inside a given span adds nothing. A null text counts
    as empty; texts without personal data have empty arrays. Rows are kept as
    often as they occur, null ids stay null, other columns are not read, and an
    empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def of(kind: str) -> Column:
        return F.transform(
            F.col(kind), lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
        )

    def added(c: Column) -> Column:
        inside = F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
        return ~inside & selector.selects(c)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *[base[k].alias(k) for k in KINDS], candidates(F.col("text")).alias("more"))
    rows = rows.select("doc_id", F.concat(none, *[of(k) for k in KINDS]).alias("base"), "more")
    more = F.transform(
        F.filter("more", added), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    )
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", more))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; overlapping spans become one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        clear = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
        new = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["out"], clear, F.when(new, name).otherwise("")).alias("out"),
        )

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, begin, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def named(spans: Column) -> Column:
    """Spans as text: kind:start:end, by kind and start, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
