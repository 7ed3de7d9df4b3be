"""Personal data by fixed patterns and bootstrapped contexts, in DataFrame operations only.

Base spans come from four patterns. A text is split at a pattern's matches, and the
lengths of the pieces and matches give the offsets. The patterns are the stated ones
with possessive repeats and a look-behind where a match can begin, which change no
match but keep long runs of text linear and off the regex engine's stack.

Candidates are the tokens that hold a digit or '@', and base spans, which are the seeds
of their kinds. Their lexical patterns are the two words before them, and the word
before with the word after. Patterns and token values form a graph that is scored
in rounds: a pattern's confidence for a kind is the mean score of the values it holds,
a value's score the noisy-or of its patterns. A value is discovered if its shape fits
the kind and its score reaches CONFIDENCE, where every pattern that counts has at least
MIN_SEEDS distinct seeds. Scores are sums by pattern and by value, made before the
shuffle; no pattern's values are ever gathered.

Defined cases: null and empty texts have no spans; ids may be null or repeated (spans
depend on the text alone); equal texts have equal spans; an empty table gives an empty
result; other columns are passed by or, in redact(), kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Stage

#: Kinds in the order of the digests.
KINDS = ("email", "ip", "card", "phone")

#: The stated patterns; see the module's text for what is added to them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

CONFIDENCE = 0.8
MIN_SEEDS = 5
ROUNDS = 3
#: Bytes up to which discovered spans are broadcast to the texts; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8 << 20

_SPAN = "struct<kind:string,first:int,last:int,value:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    digits = _digits(x)
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _located(matches: Column, pieces: Column, kind: str) -> Column:
    """Spans of matches, where pieces[i] is the text before match i."""

    def step(held, x):
        first = held["at"] + x["gap"]
        last = first + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    both = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("value"), F.length(p).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    return F.aggregate(both, start, step, lambda held: held["spans"])


def _spans(text: Column, kind: str) -> Column:
    pattern = F.lit(PATTERNS[kind])
    spans = _located(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1), kind)
    return spans if kind == "email" else F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """Array of kind, first, last, value by kind and first; empty for a null text."""
    none = F.array().cast(f"array<{_SPAN}>")
    digit = text.rlike("[0-9]")
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": text.contains("+") & digit}
    return F.concat(*[F.when(may[k], _spans(text, k)).otherwise(none) for k in KINDS])


def _text_key(text: Column) -> Column:
    return F.when(text.rlike("[0-9@]"), F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("c")))


def _tokens(text: Column) -> Column:
    """Tokens with a digit or '@': value, first, last and the words around them."""
    pieces = F.split(text, TOKEN, -1)
    spans = _located(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), pieces, "")
    return F.transform(spans, lambda s, i: F.struct(s["value"].alias("value"), s["first"].alias("first"), s["last"].alias("last"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))


_TOKEN = "struct<value:string,first:int,last:int,before:string,after:string>"


def instances(docs: DataFrame) -> DataFrame:
    """One row a candidate of each distinct text: key, value, first, last, kind (null if in no base span), patterns.

    A base span of several tokens is one candidate, told by its first token.
    """
    text = F.col("text")
    texts = docs.where(text.rlike("[0-9@]")).select(_text_key(text).alias("key"), base_spans(text).alias("spans"), _tokens(text).alias("tokens"))
    # tokens and spans of a text in one order: a token meets the span that reaches furthest of those begun before its end
    token = F.transform("tokens", lambda t: F.struct((t["last"] - 1).alias("at"), t.alias("t"), F.lit(None).cast("struct<last:int,first:int,kind:string,value:string>").alias("s")))
    span = F.transform("spans", lambda s: F.struct(s["first"].alias("at"), F.lit(None).cast(_TOKEN).alias("t"), F.struct(s["last"].alias("last"), s["first"].alias("first"), s["kind"].alias("kind"), s["value"].alias("value")).alias("s")))
    events = texts.dropDuplicates(["key"]).select("key", F.inline(F.concat(span, token)))
    upto = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("reach", F.max("s").over(upto)).where("t IS NOT NULL")
    rows = rows.withColumn("span", F.when(F.col("reach.last") > F.col("t.first"), F.col("reach"))).where("span IS NULL OR t.first <= span.first")
    left = F.lower(F.regexp_extract(F.col("t.before"), r"(?<!\S)(\S++)\s++$", 1))
    left2 = F.lower(F.regexp_replace(F.regexp_extract(F.col("t.before"), r"(?<!\S)(\S++\s++\S++)\s++$", 1), r"\s+", " "))
    # the words behind a span are known where its first token is its last one
    right = F.when(F.col("span").isNull() | (F.col("t.last") >= F.col("span.last")), F.lower(F.regexp_extract("t.after", r"^\s++(\S++)", 1))).otherwise("")
    found = F.array(F.when(left2 != "", F.concat(F.lit("< "), left2)), F.when((left != "") & (right != ""), F.concat(F.lit("<> "), left, F.lit(" "), right)))
    bare = F.regexp_replace("t.value", r"[.,;:!?]++$", "")
    return rows.select("key", F.lower(F.coalesce("span.value", bare)).alias("value"), F.col("t.first").alias("first"), (F.col("t.first") + F.length(bare)).alias("last"), F.col("span.kind").alias("kind"), F.array_compact(found).alias("patterns"))


def _fits(kind: Column, value: Column) -> Column:
    """Whether a token's shape is that of the kind."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", value.rlike(r"^\S+@\S+$"))
        .when(kind == "ip", value.rlike(r"^[0-9]+(\.[0-9]+){3}\W?$"))
        .when(kind == "card", value.rlike(r"^[0-9-]+\W?$") & n.between(12, 19))
        .when(kind == "phone", value.rlike(r"^[+(]?[0-9().-]+\W?$") & n.between(7, 15))
        .otherwise(False)
    )


def discover(tokens: DataFrame, stage: Stage, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """value, kind: values outside base spans that confident patterns name. tokens: from instances()."""
    edges = stage.write(tokens.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("held"))
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    usable = stage.write(seeds.where(F.col("seeds") >= min_seeds).join(sizes, "pattern"))
    unknown = stage.write(edges.where(F.col("kind").isNull()).select("pattern", "value").join(usable.select("pattern", "kind"), "pattern").where(_fits(F.col("kind"), F.col("value"))))
    scores = unknown.select("value", "kind").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        gained = unknown.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        sure = usable.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("held")).alias("sure"))
        miss = F.ln(F.greatest(F.lit(1e-12), 1 - F.col("sure")))
        # patterns that hold a kind by half or less say nothing of it
        scores = stage.write(unknown.join(sure.where(F.col("sure") > 0.5), ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(miss))).alias("score")))
    best = scores.where(F.col("score") >= confidence).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best


def discovered_spans(docs: DataFrame) -> DataFrame:
    """key, found (kind, first, last): what contexts add to the base spans of each text."""
    stage = Stage(docs.sparkSession, "pii")
    tokens = stage.write(instances(docs))
    new = tokens.where(F.col("kind").isNull()).drop("kind").join(discover(tokens, stage), "value")
    out = stage.write(new.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "first", "last"))).alias("found")))
    stage.keep(out)
    return out


def _bytes(df: DataFrame) -> int:
    """Of kinds and numbers alone, so that a length bounds a row's bytes."""
    return df.agg(F.coalesce(F.sum(F.size("found") * 64 + 64), F.lit(0))).first()[0]


_PLACED = "array<struct<kind:string,first:int,last:int>>"


def spanned(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), base and spans: kind, first and last of the base spans, and of all, by kind as listed, then first, then last.

    The columns of docs stay packed, whatever their names.
    """
    found = discovered_spans(docs)
    if _bytes(found) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    text = F.col("text")
    # rows without candidates meet nothing; the nulls of their key are spread
    key = F.coalesce(_text_key(text), F.struct(F.xxhash64(F.monotonically_increasing_id()).alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("int").alias("c")))
    short = F.transform(base_spans(text), lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), short.alias("base"))
    out = packed.join(found, "key", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    more = F.coalesce("found", F.array().cast(_PLACED))
    ranked = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    spans = F.when(F.size(more) == 0, F.col("base")).otherwise(F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"))))
    return out.select("row", "base", spans.alias("spans"))


def with_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with its spans (kind, first, last); a column of that name is replaced."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != name.lower()]
    return spanned(docs).select(*kept, F.col("spans").alias(name))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced by [KIND]; n_chars, if there, follows the text and stays null where it was."""
    found = spanned(docs).withColumn("shown", redacted(F.col("row").getField("text"), F.col("spans")))

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == "text":
            return F.col("shown").alias(c)
        return F.when(own.isNotNull(), F.length("shown").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else own.alias(c)

    return found.select(*[column(c) for c in docs.columns])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = spanned(docs.select("doc_id", "text"))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; of overlapping spans the first stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("back"), s["kind"].alias("kind"))))

    def step(held, s):
        within = s["first"] < held["at"]
        gap = F.substring(text, held["at"] + 1, s["first"] - held["at"])
        part = F.when(within, F.lit("")).otherwise(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(held["at"], -s["back"]).alias("at"), F.concat(held["parts"], F.array(part)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(ordered, start, step, lambda held: F.concat(F.array_join(held["parts"], ""), F.substring(text, held["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
