"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Patterns with checks find the base entities (mail and network addresses, card and phone numbers). They seed a bootstrap
over a graph of patterns and the values that they extract. Patterns of an identifier-like token are lexical: the word
before it with the marks between (``password=``), and the letters that it starts with (``AKIA``); its shape (classes of
characters and length) is a third, by which known values vouch for others of their form.

In each round a lexical pattern's confidence is the mean belief in the distinct values that it extracts, times the share
of its occurrences in the corpus at which an identifier stands, so that common words are none; a shape's is the share of
known values among its own. Both need SUPPORT. Belief in a long token starts at the share of seeds among long tokens with
digits. A value becomes known when the patterns that extract it, taken as independent witnesses, make it certain enough;
rounds go on until none is added. Known values are spans of the kind ``id`` wherever they stand in a confident pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import joined_to_keys, released, stored

#: The kinds in their order, and what finds them. A possessive form of the plain expression, which finds
#: the same, since what follows a run is never part of it. A run is tried at its start only, or where a match has ended.
KINDS = ("email", "ip", "card", "phone")
FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LEARNED = "id"
#: Identifier-like tokens: runs of letters and digits, joined by single hyphens or underscores, with a digit among the
#: first 64 characters; of these, the long ones and those with many digits.
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9](?:[_-]?[A-Za-z0-9])*+"
LONG, MANY_DIGITS = 12, 5
#: A word and the marks up to what follows; a pattern's part of the text.
GRAM = r"\p{L}+[^\p{L}\p{N}]{1,4}"
#: Letters of a token's start that are a pattern, and characters of context that are looked at.
PREFIX, LEFT = 4, 200
#: Matches that are added one by one to an array, before the array goes to the whole.
PART = 128
#: Distinct values with belief that a pattern needs, its least confidence, the belief of a known value, and rounds that no corpus should need.
SUPPORT, CONFIDENCE, CERTAIN, MOST_ROUNDS = 3, 0.5, 0.75, 50

SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"
FOUND = "array<struct<kind:string,start:int,stop:int,value:string,left:string>>"


def _in_parts(items: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The array that ``step(acc(at, out), item)`` builds up over ``items``, from at = 0 and an empty ``out`` of type ``kind``.

    It grows in parts of PART items, since an array that grows by one is copied each time.
    """
    none = F.array().cast(kind)

    def part(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))[0]

    # the items once, as the only element of an array, so that both uses below read one value
    parts = F.transform(F.array(items), lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(z) - 1, F.lit(0)) / PART).cast("int")), lambda i: F.slice(z, i * PART + 1, PART)))[0]
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), part, lambda acc: acc["out"])


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places in code points, and the end of what stands before each: what lies between matches gives both."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -LEFT, LEFT).alias("left")))
    # one gap more than there are matches; arrays_zip fills the last match with null
    zipped = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]["n"]
        b = a + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"), x["hit"].alias("value"), x["gap"]["left"].alias("left"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return _in_parts(zipped, step, FOUND)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' checksum is right: from the right, every second digit doubled and its digits summed."""
    digits = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), _small)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base entities of ``text``, by kind as listed and then by start, each with what stands before it; failing matches are dropped without a retry."""

    def of(kind: str) -> Column:
        valid = F.filter(_found(text, FIND[kind], kind), lambda x: _valid(kind, x["value"]))
        return F.when(text.rlike("@" if kind == "email" else "[0-9]"), valid).otherwise(F.array().cast(FOUND))

    return F.concat(*map(of, KINDS))


def _token_spans(text: Column, base: Column) -> Column:
    """Identifier-like tokens that touch no base entity."""
    tokens = F.filter(_found(text, TOKEN, LEARNED), lambda x: (F.length(x["value"]) >= LONG) | (F.length(_digits(x["value"])) >= MANY_DIGITS))
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))


def _gram(text: Column) -> Column:
    """White space as one space; marks that a number may start with are not the word's."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[+(]+$", ""), r"\s+", " ")


def _patterns(span: Column) -> Column:
    """A span's patterns: the word before it with the marks between, the letters it starts with, its shape."""
    value = span["value"]
    before = F.regexp_extract(span["left"], f"({GRAM})$", 1)
    first = F.regexp_extract(value, f"^[A-Za-z]{{{PREFIX}}}", 0)
    classes = [F.when(value.rlike(f"[{c}]"), name).otherwise("") for c, name in (("0-9", "9"), ("a-z", "a"), ("A-Z", "A"))]
    shape = F.concat(F.lit("shape|"), *classes, F.regexp_replace(value, "[0-9A-Za-z]", ""), F.lit(":"), F.length(value))
    return F.filter(
        # a word that fills the window may be the end of a longer one
        F.array(F.when((before != "") & (F.length(before) < LEFT), F.concat(F.lit("before|"), _gram(before))), F.when(first != "", F.concat(F.lit("prefix|"), first)), shape),
        lambda p: p.isNotNull(),
    )


def background(texts: DataFrame) -> DataFrame:
    """``(pattern, everywhere)``: how often each gram and each start of a word stands in ``texts(text)``, identifier or not."""
    grams = texts.select(F.explode(F.regexp_extract_all("text", F.lit(GRAM), F.lit(0))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    start = F.regexp_extract("gram", f"^[A-Za-z]{{{PREFIX}}}", 0)
    names = F.array(F.concat(F.lit("before|"), _gram(F.col("gram"))), F.when(start != "", F.concat(F.lit("prefix|"), start)))
    return grams.select(F.explode(names).alias("pattern"), "n").where("pattern IS NOT NULL").groupBy("pattern").agg(F.sum("n").alias("everywhere"))


def bootstrap(edges: DataFrame, rates: DataFrame, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(patterns(pattern, confidence, n), known(value))`` that the seeds lead to.

    ``edges(pattern, value, seed, long)`` has one row for each pattern and distinct value, ``rates(pattern, rate)`` the
    share of a lexical pattern's occurrences with an identifier. Each round is two aggregations of the edges, by pattern
    and by value; copies of a text add nothing, as values count once.
    """
    values = edges.groupBy("value").agg(F.max("seed").alias("seed"), F.max("long").alias("long"))
    prior = values.agg(F.coalesce(F.avg(F.when(F.col("long"), F.col("seed").cast("double"))), F.lit(0.0)).alias("prior")).first()["prior"]
    seeded = stored(values.select("value", F.when(F.col("seed"), 1.0).when(F.col("long"), F.lit(prior)).otherwise(0.0).alias("belief"), "seed", F.col("seed").alias("known")))
    counts = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).join(rates, "pattern", "left"))
    # patterns of too few values can't be confident ones
    graph = stored(joined_to_keys(edges.select("pattern", "value"), counts.select("pattern", "n"), "pattern", "n", edges.count(), "inner"))
    total, now, many = graph.count(), seeded, -1
    lexical = ~F.col("pattern").startswith("shape|")
    for _ in range(most_rounds):
        marked = graph.join(now, "value")
        scored = marked.groupBy("pattern", "n").agg(F.avg("belief").alias("mean"), F.avg(F.col("known").cast("double")).alias("share"), F.count_if(F.col("belief") >= CONFIDENCE).alias("support"), F.count_if("known").alias("sure"))
        scored = scored.join(counts.select("pattern", "rate"), "pattern")
        confidence = F.when(lexical, F.col("mean") * F.coalesce("rate", F.lit(0.0))).otherwise(F.col("share"))
        backed = F.when(lexical, F.col("support") >= SUPPORT).otherwise((F.col("sure") >= SUPPORT) & (F.col("share") >= CERTAIN))
        patterns = stored(scored.withColumn("confidence", confidence).where(backed & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence", "n"))
        # 1 - product of (1 - confidence), a pattern never being surer than its number of witnesses allows
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.95)))))
        met = joined_to_keys(graph.drop("n"), patterns, "pattern", "n", total, "inner").groupBy("value").agg(doubt.alias("doubt"))
        sure = 1 - (1 - F.col("belief")) * F.coalesce("doubt", F.lit(1.0))
        after = seeded.join(met, "value", "left").select("value", sure.alias("belief"), "seed", (F.col("seed") | (F.col("doubt").isNotNull() & (sure >= CERTAIN))).alias("known"))
        after = stored(after)
        more = after.where("known").count()
        if now is not seeded:
            released(now)
        now = after
        if more == many:  # known values only grow, as beliefs do
            return patterns, now.where("known").select("value")
        released(patterns)
        many = more
    raise RuntimeError(f"bootstrap: values are still added after {most_rounds} rounds")


def find_spans(documents: DataFrame) -> DataFrame:
    """``documents`` with ``base`` and ``spans``, arrays of (kind, start, stop, value), in place of columns of these names.

    Places count code points, stop exclusive; base entities come by kind as listed and then by start, and ``spans`` has
    the learned ones (kind ``id``) after them. Null and empty texts have none. A row comes for each row of
    ``documents``, also for repeated ones; other columns stay, whatever their names. An empty table gives an empty one.
    """
    rest = documents.drop("base", "spans")
    return _spans_of(rest, rest.columns)


def _spans_of(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` and ``spans`` of each row beside its ``columns``.

    The numbered rows are written once with their entities and read from there: a second scan may number rows otherwise.
    A row's own columns travel as one, so that none meets a column made here.
    """
    none = F.array().cast(FOUND)
    body = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), body.alias("text"), F.monotonically_increasing_id().alias("row"))
    holds = F.col("text").rlike("[0-9@]")
    rows = rows.withColumn("base", F.when(holds, base_spans(F.col("text"))).otherwise(none))
    rows = rows.withColumn("tokens", F.when(holds, _token_spans(F.col("text"), F.col("base"))).otherwise(none))
    every = F.transform(F.concat("base", "tokens"), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "stop", "value")], _patterns(s).alias("patterns")))
    keyed = stored(rows.select("own", "row", every.alias("found")))

    spans = stored(keyed.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*"))
    seed = F.col("kind") != LEARNED
    each = spans.select(F.explode("patterns").alias("pattern"), "value", seed.alias("seed"), ((F.length("value") >= LONG) & F.col("value").rlike("[0-9]")).alias("long"))
    here = each.where(~F.col("pattern").startswith("shape|")).groupBy("pattern").agg(F.count("*").alias("here"), F.count_distinct("value").alias("n")).where(F.col("n") >= SUPPORT)
    # a start stands in the counts only where no digit follows, a gram everywhere
    share = F.when(F.col("pattern").startswith("prefix|"), F.col("here") / (F.col("here") + F.coalesce("everywhere", F.lit(0)))).otherwise(F.col("here") / F.greatest("here", F.coalesce("everywhere", "here")))
    rates = stored(here.join(background(documents.select("text")), "pattern", "left").select("pattern", share.alias("rate")))
    edges = stored(each.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("long").alias("long")))
    patterns, known = bootstrap(edges, rates)

    tokens = spans.where(~seed)
    times = stored(tokens.groupBy("value").agg(F.count("*").alias("times")).join(known, "value", "left_semi"))
    learned = joined_to_keys(tokens, times, "value", "times", tokens.count(), "inner")
    # a value counts where one of the patterns stands around it
    learned = learned.select("row", "start", "stop", "value", F.explode("patterns").alias("pattern"))
    often = stored(learned.groupBy("pattern").agg(F.count("*").alias("often")).join(patterns.select("pattern"), "pattern", "left_semi"))
    learned = joined_to_keys(learned, often, "pattern", "often", learned.count(), "inner")
    learned = learned.groupBy("row", "start").agg(F.max("stop").alias("stop"), F.max("value").alias("value"))
    added = learned.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(LEARNED).alias("kind"), "start", "stop", "value"))).alias("added"))
    base = F.transform(F.filter("found", lambda s: s["kind"] != LEARNED), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "stop", "value")]))
    whole = keyed.select("own", "row", base.alias("base")).join(added, "row", "left")
    spans_of = F.concat("base", F.coalesce("added", F.array().cast(SPAN)))
    return whole.select(*[F.col("own").getField(c).alias(c) for c in columns], "base", spans_of.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


#: Characters of a text's pieces, from which a part is cut without a way from the text's start.
PIECE = 4096


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans go as one, by the kind of the first, then the longest."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        # ``since``: where the text before the span starts
        one = F.struct(acc["at"].alias("since"), s["start"].alias("start"), s["kind"].alias("kind"))
        wider = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], wider).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    apart = _in_parts(ordered, step, "array<struct<since:int,start:int,kind:string>>")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(all_: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        whole = F.array_join(F.slice(all_, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(whole, a - first * PIECE + 1, b - a)).otherwise("")

    def done(z: Column) -> Column:
        end = F.aggregate(z["spans"], F.lit(0), lambda at, s: F.greatest(at, s["stop"]))
        own = F.transform(z["apart"], lambda s: F.concat(cut(z["pieces"], s["since"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(own, ""), cut(z["pieces"], end, F.length(z["text"])))

    # each part once, in the only element of an array
    once = F.array(F.struct(text.alias("text"), apart.alias("apart"), pieces.alias("pieces"), spans.alias("spans")))
    return F.when(F.size(spans) > 0, F.transform(once, done)[0]).otherwise(text)


def digests(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of what find_spans returns."""
    found = _spans_of(documents.select("doc_id", "text"), ["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select(F.col("doc_id").cast("long"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
