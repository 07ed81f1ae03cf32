"""Personal data by fixed forms and by bootstrapped contexts, in DataFrame functions only.

Fixed forms give the base spans. These seed a graph of patterns (the word before or after) and
instances (identifier-like tokens and digit groups). A pattern is as good as the share of its
instances that are known. A mention is as good as the better of its two patterns, so that an
ordinary word on one side does not speak against the other, and an instance as good as its mentions
on average; patterns and instances are scored in turns until no score changes. What stands in a
pattern of high confidence, is itself scored high and has the digits or the sign of the kind is added.

Scores are whole thousandths, rounded down. They only rise from turn to turn, so the turns end, and
no sum depends on the order of its rows. An instance below a half counts as unknown in its patterns;
else a pattern of few seeds would vouch for its unknown instances, which would then vouch for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.common import fresh, release
from assaylens.llm.exact import with_place
from assaylens.session import materialise

KINDS = ("email", "ip", "card", "phone")
# The base forms. Possessive repeats and the look-behinds leave out only attempts
# that fail anyway, so that long runs cost linear time and no recursion.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must have; spares the other texts a search.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TOKEN = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
#: Digit runs joined by blanks, dots, hyphens and parentheses, as phones and cards are often written.
RUN = r"[0-9]++(?![.-]*+[A-Za-z@_%+])"
GROUP = rf"(?<![A-Za-z0-9@_%])[+(]{{0,2}}+{RUN}(?:[\x20().-]++{RUN})++"
BLANK = "\x01"  # stands for a character of a base span; no form or group has it
#: Loose form of an added span of each kind.
LOOSE = {
    "email": r"[^@]+@[^@]+",
    "ip": r"(?:[0-9]+[.-]){3}[0-9]+",
    "card": r"(?:[^0-9]*[0-9]){12,19}[^0-9]*",
    "phone": r"(?:[^0-9@]*[0-9]){7,15}[^0-9@]*",
}
#: Characters searched for the neighbouring word, the whole text last; a longer search follows only
#: where a shorter one does not hold the whole word. Words longer than the first go by their digest.
SEARCHED = (64, 1024, 16_384)
PRIOR = 2  # unknown instances that every pattern counts besides its own
# Scores in thousandths.
CERTAIN = 1000
LIKELY = 500
CONFIDENT = 800
#: Parts into which the rows of one pattern or value are dealt in joins.
SALTS = 16

SPAN = "array<struct<start:int,end:int,ord:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(back, i, F.lit(1)).cast("int"), i),
    )
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.when(i % 2 == 0, twice).otherwise(d)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, form: str, hint: str | None, order: int) -> Column:
    """Spans of the matches of *form*, in code points, from the lengths of what lies between them."""
    none = F.array().cast(SPAN)
    values = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    between = F.slice(F.transform(F.split(text, form, -1), F.char_length), F.lit(1), F.size(values))
    pairs = F.arrays_zip(between.alias("gap"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.char_length(pair["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(order).alias("ord"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    found = F.when(F.size(values) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(none)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(none) if hint else found


def _base(text: Column, kind: str) -> Column:
    spans = _matches(text, FORMS[kind], HINTS.get(kind), KINDS.index(kind))
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(*[_base(text, k) for k in KINDS]), lambda a, b: _before(a, b))


def _before(a: Column, b: Column) -> Column:
    x, y = a["start"] * F.lit(4).cast("long") + a["ord"], b["start"] * F.lit(4).cast("long") + b["ord"]
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _tokens(text: Column, base: Column) -> Column:
    """Identifier-like tokens beside the base spans, without trailing marks."""
    spans = _matches(text, TOKEN, None, -1)

    def trim(s: Column) -> Column:
        value = F.regexp_replace(s["value"], "[._%+-]+$", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.char_length(value)).alias("end"), s["ord"].alias("ord"), value.alias("value"))

    return F.filter(F.transform(spans, trim), lambda s: ~_overlaps(base, s))


def _fits(value: Column) -> Column:
    return value.rlike(rf"^(?:{'|'.join(LOOSE.values())})$")


def _within(s: Column, spans: Column, larger: bool = False) -> Column:
    """Whether one of *spans* covers *s*; if *larger*, one that is not *s* itself."""
    longer = (lambda g: g["end"] - g["start"] > s["end"] - s["start"]) if larger else (lambda g: F.lit(True))
    return F.exists(spans, lambda g: (g["start"] <= s["start"]) & (s["end"] <= g["end"]) & longer(g))


def _groups(text: Column, base: Column) -> Column:
    """Maximal digit groups between the base spans that have the loose form of a kind."""
    blanked = _replaced(text, base, lambda s, at: F.repeat(F.lit(BLANK), s["end"] - F.greatest(at, s["start"])))
    between = F.when(F.size(base) > 0, blanked).otherwise(text)
    return F.filter(_matches(between, GROUP, None, -1), lambda s: _fits(s["value"]))


def _word(text: Column, s: Column, before: bool) -> Column:
    """Lower-cased whole word next to a span, long ones as digests; empty at the end of the text."""
    word, whole = (r"(?<!\S)(\S+)\s*$", r"\s\S+\s*$") if before else (r"^\s*(\S+)", r"^\s*\S+\s")
    size = F.char_length(text)

    def part(width: int | None) -> Column:
        if before:
            start = F.greatest(s["start"] - width, F.lit(0)) if width else F.lit(0)
            return F.substring(text, start + 1, s["start"] - start)
        return F.substring(text, s["end"] + 1, F.lit(width) if width else size)

    found = F.regexp_extract(part(None), word, 1)
    for width in reversed(SEARCHED):
        all_of_it = s["start"] <= width if before else size - s["end"] <= width
        found = F.when(all_of_it | part(width).rlike(whole), F.regexp_extract(part(width), word, 1)).otherwise(found)
    lower = F.lower(found)
    return F.when(F.char_length(lower) > SEARCHED[0], F.sha2(lower, 256)).otherwise(lower)


def mentions(rows: DataFrame) -> DataFrame:
    """``(_row, doc_id, base, seen)``: base spans, and all mentions with their contexts."""
    spotted = rows.select("_row", "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    spotted = spotted.withColumn("base", base_spans(F.col("_text")))
    spotted = spotted.withColumn("_groups", _groups(F.col("_text"), F.col("base")))
    spotted = spotted.withColumn("_tokens", _tokens(F.col("_text"), F.col("base")))
    # a token that is its own group stands once; parts of a group that fit no kind are no instances
    alone = F.filter("_tokens", lambda s: _fits(s["value"]) | ~_within(s, F.col("_groups")))
    wider = F.filter("_groups", lambda g: ~F.exists("_tokens", lambda s: (s["start"] == g["start"]) & (s["end"] == g["end"])))
    spotted = spotted.withColumn("_all", F.concat("base", alone, wider))
    context = F.transform(
        "_all",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord"), F.lower(s["value"]).alias("value"), _word(F.col("_text"), s, True).alias("left"), _word(F.col("_text"), s, False).alias("right")),
    )
    return spotted.select("_row", "doc_id", "base", context.alias("seen"))


def _dealt(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join in which the rows of one key of *large* are dealt by *by*; *small* stands in every part."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def discovered(found: DataFrame) -> DataFrame:
    """``(_row, added)``: spans that confident contexts add to the rows of :func:`mentions`."""
    flat = found.select("_row", F.explode("seen").alias("s")).select("_row", "s.*")
    patterns = F.array(F.concat(F.lit("< "), "left"), F.concat(F.lit("> "), "right"))
    linked = flat.withColumn("pattern", F.explode(F.filter(patterns, lambda p: F.length(p) > 2)))
    contexts = materialise(linked.groupBy("pattern", "value", "ord", "left", "right").agg(F.count(F.lit(1)).alias("n")), "contexts")
    edges = materialise(contexts.groupBy("pattern", "value", "ord").agg(F.sum("n").alias("n")), "edges")
    # mentions without any word beside them say nothing
    told = flat.where((F.col("ord") < 0) & ((F.col("left") != "") | (F.col("right") != "")))
    mentioned = materialise(told.groupBy("value").agg(F.count(F.lit(1)).alias("_mentions")), "mentioned")
    names = [f"s_{k}" for k in KINDS]
    # seeds keep their score; a value that is a seed anywhere is one
    marks = [F.max(F.when(F.col("ord") == i, CERTAIN).otherwise(0)).cast("long").alias(n) for i, n in enumerate(names)]
    seeds = materialise(edges.where("ord >= 0").groupBy("value").agg(*marks), "seeds")
    scores, totals, turn = seeds, None, 0
    while True:
        counted = scores.select("value", *[F.when(F.col(n) >= LIKELY, F.col(n)).otherwise(0).alias(n) for n in names])
        known = _dealt(edges, counted.where(F.greatest(*names) > 0), ["value"], ["pattern"], "left").fillna(0, names)
        shares = [F.expr(f"sum(n * {n}) div (sum(n) + {PRIOR})").alias(n) for n in names]
        confidence = materialise(known.groupBy("pattern").agg(*shares).where(F.greatest(*names) > 0), f"patterns{turn}")
        # the better side of each mention; a side without a pattern here counts 0
        sides = _dealt(contexts.where("ord < 0"), confidence, ["pattern"], ["value"])
        better = sides.groupBy("value", "left", "right").agg(F.first("n").alias("n"), *[F.max(n).alias(n) for n in names])
        summed = better.groupBy("value").agg(*[F.sum(F.col("n") * F.col(n)).alias(n) for n in names])
        instances = summed.join(mentioned, "value").select("value", *[F.expr(f"{n} div _mentions").alias(n) for n in names])
        instances = instances.where(F.greatest(*names) >= LIKELY).join(seeds, "value", "left_anti")
        scores = materialise(instances.union(seeds.select("value", *names)), f"instances{turn}")
        # scores only rise: equal sums are equal scores
        before, totals = totals, tuple(scores.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first())
        if totals == before or (turn == 0 and not scores.join(seeds, "value", "left_anti").take(1)):
            break
        turn += 1
    sure = confidence.where(F.greatest(*names) >= CONFIDENT)
    good = scores.where(F.greatest(*names) >= CONFIDENT)
    open_ = _dealt(edges.where("ord < 0").select("pattern", "value"), sure, ["pattern"], ["value"])
    open_ = open_.join(good.select("value", *[F.col(n).alias(f"v{n}") for n in names]), "value")
    best = F.lit(None)
    for i, kind in reversed(list(enumerate(KINDS))):
        fits = (F.col(names[i]) >= CONFIDENT) & (F.col(f"v{names[i]}") >= CONFIDENT) & F.col("value").rlike(rf"^(?:{LOOSE[kind]})$")
        best = F.when(fits, F.lit(i)).otherwise(best)
    # decided once for each pattern and value, then told to all their mentions
    chosen = materialise(open_.select("pattern", "value", best.cast("int").alias("_ord")).where("_ord is not null"), "confident")
    kept = _dealt(linked.where("ord < 0"), chosen, ["pattern", "value"], ["_row", "start"])
    spans = kept.groupBy("_row", "start", "end").agg(F.min("_ord").alias("ord"), F.first("value").alias("value"))
    added = spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "ord", "value")).alias("added"))
    return added.select("_row", F.filter("added", lambda s: ~_within(s, F.col("added"), larger=True)).alias("added"))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """*text* with what ``by(span, at)`` gives for each span by start, *at* the end of those before.

    For a span that overlaps an earlier one *by* gives what it adds to that one's, null for nothing.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, by(s, acc["at"]))).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))


def _told(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(rows: DataFrame) -> DataFrame:
    """Base and added spans of every one of ``rows(_row, doc_id, text)``.

    Returns ``_row, doc_id, base, added``: arrays of (start, end, ord, value), in code points with
    the end exclusive, ord the place in KINDS. Null counts as empty, and a text without a match has
    empty arrays. Spans of different kinds may overlap; added ones never overlap a base span, and of
    a digit group and a token inside it only the group is added.
    Repeated rows are searched each; contexts count every mention, so copies weigh by their number.
    An empty table gives no rows.
    """
    found = materialise(mentions(rows), "mentions")
    added = materialise(discovered(found), "added")
    return found.select("_row", "doc_id", "base").join(added, "_row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))


def _sorted(base: Column, added: Column) -> Column:
    return F.array_sort(F.concat(base, added), lambda a, b: _before(a, b))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`spans`: the n_ columns count base spans, n_added the others."""
    orders = F.transform("base", lambda s: s["ord"])
    counts = [(F.size(orders) - F.size(F.array_remove(orders, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(_sorted(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """*docs* with every span replaced by its kind, as ``[EMAIL]``; same columns.

    Overlapping spans become one mark, of the first kind. Where there is a column n_chars and a
    mark was set, it gets the new length; texts without a span stay as they are, null too.
    """
    row, held = fresh(docs, "_row"), fresh(docs, "_spans")
    rows = with_place(docs, row)
    found = spans(rows.select(F.col(row).alias("_row"), "doc_id", "text"))
    hit = found.select(F.col("_row").alias(row), _sorted(F.col("base"), F.col("added")).alias(held))
    hit = materialise(hit.where(F.size(held) > 0), "hits")
    release(docs.sparkSession)
    joined = rows.join(hit.hint("merge"), row, "left")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    cut = _replaced(text, F.col(held), lambda s, at: F.when(s["start"] >= at, F.element_at(marks, s["ord"] + 1)))
    masked = joined.withColumn("text", F.when(F.col(held).isNull(), text).otherwise(cut))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        masked = masked.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(length))
    return masked.select(*docs.columns)
