"""Personal data: base patterns, high-recall candidates, boosted trees, calibrated thresholds.

The base patterns give spans by rule. Wider patterns propose candidates that may
overlap them and each other. A candidate that is a base span is a positive example in a
form that the base patterns do not know (no '+', '@' as '(at)', ...), and, set between
word characters, a negative one; so is a candidate apart from the base spans that fails
a check (Luhn, a part over 255, ...). All others are no examples: trees trained on a
candidate's format and its surroundings score them, and per kind the lowest score that
keeps the asked precision on examples set aside selects what is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.llm import boosting
from collabnet.session import stored, union_all

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
SUPPORT = 20  # examples set aside that a threshold must rest on
BINS = 100
SAMPLE = 2_500  # rows of a kind and label that the trees are fitted on
CONTEXT = 24

#: Fixed patterns. Loops give nothing back, which changes no match as what follows them cannot begin inside.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a search of it to be worth while.
SIGN = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][ -]?){12}[0-9]", "phone": r"\+[0-9]"}

CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?| ?\. (?=[a-z])| ?\.)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?: ?[.,] ?[0-9]{1,4}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,}+",
    "phone": r"(?:\+|\b00)?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}+",
}
CANDIDATE_SIGN = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9] ?[.,] ?[0-9]", "card": r"(?:[0-9][ ./-]?){11}[0-9]", "phone": r"[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]"}

#: Other ways to write a base span: by kind, replacements made one after the other.
_AT, _DOT = "@", r"\.(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*$)"  # the dots of the host
_FOURS = [("[ -]", ""), ("([0-9]{4})(?=[0-9])", "$1.")]
MASKS = {
    "email": [
        [(_DOT, " (dot) "), (_AT, " (at) ")],
        [(_DOT, "(dot)"), (_AT, "(at)")],
        [(_DOT, " [dot] "), (_AT, " [at] ")],
        [(_AT, " (at) ")],
        [(_AT, " @ ")],
    ],
    "ip": [[(r"\.", " . ")], [(r"\.", ". ")], [(r"\.", " .")]],
    "card": [_FOURS, [*_FOURS, (r"\.", "/")]],
    "phone": [[(r"^\+", "")], [(r"^\+", "00")], [(r"^\+", ""), (r"[().]", ""), (" +", "-")]],
}

_HINTS = {"email": "mail|contact|write", "ip": r"\bip\b|addr|host|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax"}
_SPANS = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def spans(text: Column, pattern: str, sign: str) -> Column:
    """Leftmost matches that do not overlap, with places in code points and their surroundings."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)
    n = F.size(hits)
    none = F.array(F.lit(""))
    near = F.slice(F.concat(none, hits), 1, n).alias("last"), F.slice(F.concat(hits, none), F.lit(2), n).alias("next")
    parts = F.arrays_zip(hits.alias("hit"), F.slice(rest, 1, n).alias("before"), F.slice(rest, F.lit(2), n).alias("after"), *near)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["before"])
        end = start + F.length(part["hit"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            part["hit"].alias("value"),
            F.right(F.concat(part["last"], part["before"]), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(part["after"], part["next"]), F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    nothing = F.array().cast(_SPANS)
    initial = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("spans"))
    return F.when(F.rlike(text, F.lit(sign)), F.aggregate(parts, initial, step, lambda s: s["spans"])).otherwise(nothing)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check."""
    back = F.reverse(digits)

    def weighed(i: Column) -> Column:
        twice = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum, i: sum + weighed(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda part: (F.length(part) <= 3) & (F.left(part, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & luhn(digits_of(F.left(value, F.lit(64))))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _failed(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Can a candidate not be what its kind says: it fails a check or stands between word characters."""
    numbers = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
    n = F.length(digits_of(value)) - F.when(F.startswith(value, F.lit("00")), 2).otherwise(0)
    date = F.rlike(value, F.lit(r"^\(?(?:19|20)[0-9]{2}[ .-](?:0?[1-9]|1[0-2])[ .-](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])"))
    checks = {
        "email": ~F.rlike(value, F.lit("[A-Za-z]{2,}$")),
        "ip": F.exists(numbers, lambda x: (F.length(x) > 3) | (F.left(x, F.lit(3)).cast("int") > 255)) | F.contains(value, F.lit(", ")),
        "card": ~_valid("card", value),
        "phone": ~n.between(9, 15) | date,
    }
    wrong = reduce(lambda rest, i: F.when(kind == i, checks[KINDS[i]]).otherwise(rest), range(len(KINDS)), F.lit(False))
    return wrong | F.rlike(before, F.lit("[A-Za-z0-9]$")) | F.rlike(after, F.lit("^[A-Za-z0-9]"))


def _masked(kind: Column, value: Column, choice: Column) -> Column:
    """A base span written in one of the other ways of its kind."""
    made = value
    for i, name in enumerate(KINDS):
        forms = MASKS[name]
        for j, steps in enumerate(forms):
            form = reduce(lambda text, step: F.regexp_replace(text, *step), steps, value)
            made = F.when((kind == i) & (F.pmod(choice, F.lit(len(forms))) == j), form).otherwise(made)
    return made


def examples(judged: DataFrame) -> DataFrame:
    """Labelled rows: base spans in another form with 1, and between word characters with 0; failures apart from them with 0."""
    failure = F.struct(F.lit(0).alias("label"), "value", "before", "after")
    form = _masked(F.col("kind"), F.col("value"), F.xxhash64(F.lit("form"), "order"))
    good = F.struct(F.lit(1).alias("label"), form.alias("value"), "before", "after")
    glued = F.struct(F.lit(0).alias("label"), form.alias("value"), F.concat("before", F.lit("x")).alias("before"), F.lit("x").alias("after"))
    rows = F.when(F.col("is_base") & ~F.col("failed"), F.array(good, glued)).when(F.col("failed") & ~F.col("touches"), F.array(failure))
    return judged.select("kind", "order", F.explode(rows).alias("e")).select("kind", "order", "e.*")


def _of_kind(kind: int, found: Column, more: bool) -> Column:
    def row(x: Column) -> Column:
        place = [F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")]
        return F.struct(*place, *([x[c].alias(c) for c in ("value", "before", "after")] if more else []))

    return F.transform(found, row)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end): the base spans by kind and start; kind counts from 0."""

    def valid(kind: str) -> Column:
        return F.filter(spans(text, BASE[kind], SIGN[kind]), lambda x: _valid(kind, x["value"]))

    return F.concat(*[_of_kind(i, valid(kind), False) for i, kind in enumerate(KINDS)])


def candidate_spans(text: Column) -> Column:
    return F.concat(*[_of_kind(i, spans(text, CANDIDATES[kind], CANDIDATE_SIGN[kind]), True) for i, kind in enumerate(KINDS)])


def _number(value: Column) -> Column:
    return value.cast("double")


def _features() -> dict[str, Column]:
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    digits = digits_of(value)
    count = lambda pattern: _number(F.regexp_count(value, F.lit(pattern)))
    groups = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda x: x != ""), lambda x: F.length(x))
    short = F.length(value) <= 64
    made = {
        "f_length": F.least(_number(F.length(value)), F.lit(999.0)),
        "f_digits": _number(F.length(digits)),
        "f_letters": count("[A-Za-z]"),
        "f_spaces": count(" "),
        "f_dots": count(r"\."),
        "f_hyphens": count("-"),
        "f_brackets": count(r"[()\[\]]"),
        "f_other": count(r"[,/]"),
        "f_at": count("@"),
        "f_plus": _number(F.startswith(value, F.lit("+"))),
        "f_groups": _number(F.size(groups)),
        "f_longest": _number(F.coalesce(F.array_max(groups), F.lit(0))),
        "f_luhn": _number(F.when(short, luhn(digits)).otherwise(False)),
        "f_largest": _number(
            F.coalesce(F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda x: F.right(F.concat(F.lit("0"), x), F.lit(4)).cast("int"))), F.lit(0))
        ),
        "f_word_before": _number(F.rlike(before, F.lit(r"[A-Za-z0-9]$"))),
        "f_mark_before": _number(F.rlike(before, F.lit(r"[^A-Za-z0-9\s]$"))),
        "f_word_after": _number(F.rlike(after, F.lit(r"[A-Za-z0-9]"))),
        "f_mark_after": _number(F.rlike(after, F.lit(r"[^A-Za-z0-9\s]"))),
    }
    made |= {f"f_is_{kind}": _number(F.col("kind") == i) for i, kind in enumerate(KINDS)}
    return made | {f"f_hint_{kind}": _number(F.rlike(F.lower(before), F.lit(hint))) for kind, hint in _HINTS.items()}


def fitted_on(labelled: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` rows of each kind and label, so that no kind crowds out another; thresholds rest on all rows set aside."""
    groups = [(kind, label) for kind in range(len(KINDS)) for label in (0, 1)]
    return union_all([boosting.sample(labelled.where((F.col("kind") == k) & (F.col("label") == x)), "order", SAMPLE) for k, x in groups])


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[int, float]:
    """By kind, the lowest score from which the share of positives is at least ``precision``."""
    binned = scored.groupBy("kind", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts = binned.agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # kinds x bins
    chosen = {}
    for kind in {r.kind for r in counts}:
        good = n = 0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.bin):
            good, n = good + r.good, n + r.n
            if n >= SUPPORT and good >= precision * n:
                chosen[kind] = r.bin / BINS
    return chosen


def find(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Every row of ``docs`` less its text as ``row``, with ``base`` and ``spans``: arrays of (kind, start, end).

    Kind is a place in ``KINDS``, start and end count code points. ``spans`` holds the
    base spans and those added, which overlap no base span; both are sorted. A null
    text is an empty one, equal rows get equal spans, other columns pass inside
    ``row``; without base spans to learn from nothing is added, no rows give none.
    """
    content = F.coalesce(text, F.lit(""))
    others = [c for c in docs.columns if c != text]
    rows = docs.select(
        F.struct(*others).alias("row"),
        F.xxhash64(*others, text).alias("h1"),
        F.xxhash64(text, *others).alias("h2"),
        base_spans(content).alias("base"),
        candidate_spans(content).alias("candidates"),
    )
    rows = stored(rows)  # spans without texts: the texts are searched once
    exploded = rows.select("h1", "h2", "base", F.explode("candidates").alias("c")).select("h1", "h2", "base", "c.*")
    same = F.exists("base", lambda b: (b["kind"] == F.col("kind")) & (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    touches = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    failed = _failed(*[F.col(c) for c in ("kind", "value", "before", "after")])
    order = F.xxhash64("h1", "kind", "start")
    judged = stored(exploded.select("*", same.alias("is_base"), touches.alias("touches"), failed.alias("failed"), order.alias("order")).drop("base"))
    features = _features()
    labelled = examples(judged)
    aside = F.pmod("order", F.lit(4)) == 0
    model = boosting.train(stored(fitted_on(labelled.where(~aside)).withColumns(features)), list(features), "label")
    if model is None:
        return rows.select("row", "base", F.array_sort("base").alias("spans"))
    limits = thresholds(boosting.score(labelled.where(aside).withColumns(features), list(features), model), precision)
    limit = reduce(lambda rest, kind: F.when(F.col("kind") == kind, limits[kind]).otherwise(rest), limits, F.lit(2.0))
    fresh = boosting.score(judged.where("not touches and not failed").withColumns(features), list(features), model).where(F.col("score") >= limit)
    added = fresh.groupBy("h1", "h2").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    whole = rows.join(added, ["h1", "h2"], "left").withColumn("added", F.coalesce("added", none))
    return whole.select("row", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, one replacement for all."""
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(x["start"] - state["at"], F.lit(0)).cast("int"))
        shown = F.when(x["start"] >= state["at"], F.concat(gap, F.lit("["), name[x["kind"]], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], shown).alias("out"))

    initial = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, initial, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
