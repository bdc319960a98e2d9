"""Personal data: strict patterns, and boosted trees over the candidates of loose ones.

Base spans are the matches of four strict patterns that pass their checks. Loose generators
propose candidates around the same kinds of data, overlapping at will. A candidate that
holds a strict match is an example of its kind, any other is a counter-example, and boosted
depth-two trees learn from format and context alone (no checksum, no strict pattern) which
candidates look like the real ones. Half of the documents fit the trees, the other half
calibrates a threshold for each kind: the lowest score above which the lower confidence bound
of the share of real ones is at least ``PRECISION``. Candidates above it that hold no strict
match are added to the base spans. Fitting sums over all candidates of all documents, in
histograms of bounded size; nothing else reaches the driver.

Everything on rows is built-in functions. Offsets count code points. Defined results: a null
or empty text has no span; a null id is kept; repeated rows give equal results; where no
threshold reaches the precision, nothing is added for that kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import id_remainder, stored, table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
ROUNDS, RATE, BINS = 8, 0.5, 32

# The strict patterns. Each matches what its plain form matches (see the tests); anchors and
# possessive loops only keep a scan linear: a match can't begin inside a run of its
# own first class, unless the match before ended there.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth trying.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
LOOSE = {
    "email": r"(?<![^\s@])[^\s@]++@[^\s@]++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[(\[](?i:at)[)\]][\x20]?[A-Za-z0-9-]++[\x20]?[(\[](?i:dot)[)\]][\x20]?[A-Za-z]++",
    "ip": r"(?<![0-9.:A-Fa-f])(?:[0-9]{1,4}+(?:[.,][0-9]{1,4}+){3}+|(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+)",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,17}+",
}
LOOSE_HINT = {"email": "@|[(\\[](?i:at)[)\\]]", "ip": "[0-9][.,][0-9]|:[0-9A-Fa-f]+:", "card": "[0-9][\\x20.-]?[0-9]", "phone": "[0-9][\\x20().-]{0,2}[0-9]"}
CUES = "(?i)(tel|phone|call|fax|mobil|mail|contact|card|visa|pay|host|server|addr|\\bip)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def weight(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = 2 * d
        return F.when(i % 2 == 1, d).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    return F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check a strict match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(f"^{part}(?:\\.{part}){{3}}$")
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _running(lengths: Column) -> Column:
    """Sums of what stands before each element; blocks keep the work near linear."""
    block = 256
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    blocks = F.floor((F.size(lengths) - 1) / block).cast("int")

    def within(xs: Column, before: Column) -> Column:
        return F.transform(xs, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(xs, (F.floor(i / block) * block).cast("int") + 1, i % block)))

    def spread(xs: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), blocks), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        return _once(sums, lambda s: _once(before(s), lambda p: within(xs, p)))

    return F.when(F.size(lengths) > 0, _once(lengths, spread)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Matches of a pattern: start, end, value, before (16 characters at most), after (one)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(ms: Column, gaps: Column) -> Column:
        pairs = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def place(ends: Column) -> Column:
            return F.transform(
                ms,
                lambda m, i: F.struct(
                    (F.get(ends, i) + F.length(F.get(gaps, i))).alias("start"),
                    (F.get(ends, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    m.alias("value"),
                    F.right(F.get(gaps, i), F.lit(16)).alias("before"),
                    F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                ),
            )

        return _once(_running(pairs), place)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(hint), _once(found, lambda ms: _once(between, lambda gaps: spans(ms, gaps)))).otherwise(none)


def base_spans(text: Column) -> Column:
    """start, kind (its place in KINDS), end of the strict matches that pass, by start, then kind."""


    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, STRICT[kind], HINT[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _class(char: Column) -> Column:
    return (
        F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike("[0-9]"), 1).when(char.rlike("\\p{L}"), 2).when(char.rlike("\\s"), 3)
        .when(char.isin(*".,;:!?"), 4).when(char.isin(*"([{<\"'"), 5).when(char.isin(*"#*$%&|=/_-+"), 6).otherwise(7)
    )


FEATURES = ("kind", "digits", "letters", "groups", "opens", "at", "large", "dots", "blanks", "left", "right", "cue")


def _features(k: int, m: Column) -> Column:
    """Small whole numbers that describe a candidate and what stands beside it."""
    value = m["value"]
    count = lambda chars: F.length(value) - F.length(F.regexp_replace(value, chars, ""))
    capped = lambda c, most: F.least(c, F.lit(most)).cast("int")
    bins = (
        F.lit(k),
        capped(count("[0-9]"), BINS - 1),
        capped(F.floor(count("\\p{L}") / 4), 15),
        capped(F.size(F.split(value, "[^0-9A-Za-z]+", -1)), 9),
        _class(F.left(value, F.lit(1))),
        capped(count("@"), 2),
        F.when(value.rlike("(?<![0-9])(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})"), 1).otherwise(0),
        capped(count("\\."), 7),
        capped(count("\\s"), 7),
        _class(F.right(m["before"], F.lit(1))),
        _class(m["after"]),
        F.when(m["before"].rlike(CUES), 1).otherwise(0),
    )
    return F.struct(*(b.cast("int").alias(name) for b, name in zip(bins, FEATURES)))


def candidates(text: Column) -> Column:
    """start, kind, end, strict (holds a strict match that passes), f (features), in no set order."""

    def of(k: int, kind: str) -> Column:
        def one(m: Column) -> Column:
            inner = F.regexp_extract_all(m["value"], F.lit(STRICT[kind]), F.lit(0))
            return F.struct(
                m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"),
                F.exists(inner, lambda v: passes(kind, v)).alias("strict"), _features(k, m).alias("f"),
            )

        return F.transform(matches(text, LOOSE[kind], LOOSE_HINT[kind]), one)

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


@dataclass
class Tree:
    """Split on one feature, then on one feature at either side; four leaves."""

    feature: str
    cut: int
    sides: list[tuple[str, int, float, float]]

    def value(self, of: Callable[[str], Column]) -> Column:
        def side(s: tuple[str, int, float, float]) -> Column:
            return F.when(of(s[0]) < s[1], F.lit(s[2])).otherwise(F.lit(s[3]))

        return F.when(of(self.feature) < self.cut, side(self.sides[0])).otherwise(side(self.sides[1]))


@dataclass
class Model:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, of: Callable[[str], Column]) -> Column:
        """Estimated chance that a candidate is real."""
        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + tree.value(of)
        return F.lit(1.0) / (1.0 + F.exp(-margin))


def _best(rows: list, totals: tuple[float, float]) -> tuple[str, int, float, float]:
    """The split that lowers the loss most, with both leaf values; rows: feature, bin, g, h."""
    leaf = lambda g, h: RATE * g / (h + 1.0)
    best = (0.0, FEATURES[0], 0, leaf(*totals), leaf(*totals))
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
    for name in FEATURES:
        g = h = 0.0
        bins = sorted(by.get(name, []))
        for (_, dg, dh), (cut, _, _) in zip(bins, bins[1:]):
            g, h = g + dg, h + dh
            rest = (totals[0] - g, totals[1] - h)
            gain = g * g / (h + 1) + rest[0] ** 2 / (rest[1] + 1) - totals[0] ** 2 / (totals[1] + 1)
            if gain > best[0] + 1e-9:
                best = (gain, name, cut, leaf(g, h), leaf(*rest))
    return best[1:]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> Model:
    """Trees from one half of the documents, thresholds from the other."""
    rows = docs.select((id_remainder(docs[id_col], 2) == 0).alias("fit"), F.explode(candidates(F.coalesce(docs[text_col], F.lit("")))).alias("c"))
    names = [F.col(f"c.f.{n}").alias(n) for n in FEATURES]
    # Candidates with equal features count as one row with weights.
    seen = rows.select("fit", F.col("c.strict").cast("long").alias("y"), *names).groupBy("fit", *FEATURES)
    seen = stored(seen.agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "pii-features")
    half, other = seen.where("fit"), seen.where("NOT fit")
    model = Model()
    n, pos = half.agg(F.sum("n"), F.sum("pos")).first()
    if not n or pos in (0, n):
        return model
    model.start = math.log(pos / (n - pos))
    bins = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES)))
    for _ in range(ROUNDS):
        p = model.score(F.col)
        moved = half.select(*FEATURES, (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def histogram(node: Column, moved: DataFrame = moved) -> list:
            return moved.select(node.alias("node"), "g", "h", bins.alias("b")).groupBy("node", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()

        def totals(rows: list) -> tuple[float, float]:
            one = [r for r in rows if r["feature"] == FEATURES[0]]
            return math.fsum(r["g"] for r in one), math.fsum(r["h"] for r in one)

        top = histogram(F.lit(0))
        name, cut, _, _ = _best(top, totals(top))
        lower = histogram(F.when(F.col(name) < cut, 0).otherwise(1))
        sides = []
        for node in (0, 1):
            own = [r for r in lower if r["node"] == node]
            sides.append(_best(own, totals(own)))
        model.trees.append(Tree(name, cut, sides))
    # Scores in thousandths: 4 x 1001 rows at most.
    held = other.select("kind", F.floor(model.score(F.col) * 1000).cast("int").alias("s"), "n", "pos")
    held = held.groupBy("kind", "s").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    for k in range(len(KINDS)):
        n = pos = 0
        for r in sorted((r for r in held if r["kind"] == k), key=lambda r: -r["s"]):
            n, pos = n + r["n"], pos + r["pos"]
            if _lower(pos, n) >= precision:
                model.thresholds[k] = r["s"] / 1000
    return model


def _lower(good: int, n: int, z: float = 2.326) -> float:
    """Lower end of Wilson's interval for a share."""
    share = good / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _added(text: Column, model: Model) -> Column:
    """Candidates above their kind's threshold that hold no strict match."""

    def chosen(c: Column) -> Column:
        score = model.score(lambda n: c["f"][n])
        wanted = F.lit(False)
        for k, t in sorted(model.thresholds.items()):
            wanted = F.when(c["kind"] == k, score >= t).otherwise(wanted)
        return ~c["strict"] & wanted

    if not model.thresholds:
        return F.array().cast(_SPANS)
    out = F.transform(F.filter(candidates(text), chosen), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return out.cast(_SPANS)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) for every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    both = F.struct(base_spans(text).cast(_SPANS).alias("base"), _added(text, model).alias("added"))
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), both.alias("found"))
    return found.select(
        "doc_id", "found.base", _once(F.col("found"), lambda x: F.array_sort(F.concat(x["base"], x["added"]))).alias("spans")
    )


def _written(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first. Null texts stay null; all other columns stay.
    """
    text = docs[text_col]
    every = F.array_sort(F.concat(base_spans(text).cast(_SPANS), _added(text, model)))
    return docs.withColumn(text_col, F.when(text.isNotNull(), _once(every, lambda s: _replaced(text, s))))


def _replaced(text: Column, spans: Column) -> Column:
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    # Where the text before a span has already been dealt with.
    reach = F.transform(spans, lambda _, i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda x: x["end"])), F.lit(0)))

    def piece(done: Column) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= F.get(done, i),
                F.concat(F.substring(text, F.get(done, i) + 1, s["start"] - F.get(done, i)), F.get(marks, s["kind"])),
            ).otherwise(""),
        )

    end = F.array_max(F.transform(spans, lambda x: x["end"]))
    rest = F.substring(text, end + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(_once(reach, piece), ""), rest))


def op1_gradient_boosted_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )
