"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans (email, ip, card, phone) come from regular expressions and checks. They seed the bootstrapping:
words before a seed are lexical patterns (the last word, and the last two, numbers in them as 0); tokens with a digit or @ that no
base span covers are candidate instances. Keys and tokens of access are seeds as well, known by their form: but as
a checksum may look alike, they only lend their confidence to patterns, and are no spans unless a trusted pattern precedes them.
Patterns and instances form a graph. A pattern's score is the share of all its occurrences
in the corpus that an instance follows, each weighed by its confidence; an instance's confidence is 1 for base seeds, SECRET for
the others, and else the noisy-or of its trusted patterns. Rounds alternate the two until no pattern becomes trusted any more.
What follows a trusted pattern becomes a span of kind id, wherever it stands. Tokens with neither digit nor @ never do.

Everything is DataFrame code; the graph lives in tables. Corpus counts of patterns are taken over all words: a fixed-size bit set
drops words that are no pattern before they are counted. Possessive quantifiers and look-behinds keep matching linear
in the text, and free of recursion, on runs of any length.

Defined cases: null text is empty; a text without matches has no spans; repeated rows are treated alike; ties between
spans go by kind; an empty table gives no rows; offsets are code points; other columns are carried or ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, aside, but, cut, stored, table

LOCAL = "A-Za-z0-9._%+-"
#: Equal to the contract's expressions, with the backtracking taken out: a match starts where a run starts or the last match ended.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "id"]
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TOKEN = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
#: Keys and tokens of access: 32 hex digits or more, or 20 characters of three kinds; and how sure that form is.
KEYS = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])(?:[0-9a-fA-F]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_=.-]{20,})$"
SECRET = 0.8
#: A pattern needs so many different instances and this score; a candidate has so many characters at least.
LEAST_INSTANCES, TRUST, LEAST_LENGTH = 5, 0.5, 4
FILTER_BITS = 1 << 21
BLOCK = 256


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: an expression that is named within a lambda is evaluated for each element."""
    return F.transform(F.array(value), use)[0]


def running(lengths: Column) -> Column:
    """Sums of what comes before each element. Blocks keep the work far from the square of the number."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def starts(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
        return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(items: Column) -> Column:
        return bound(starts(items), lambda s: F.transform(items, lambda _, i: F.element_at(s, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(items, i - i % BLOCK + 1, i % BLOCK))))

    return bound(lengths, sums)


def with_matches(df: DataFrame, text: str, pattern: str, out: str, needs: str | None = None) -> DataFrame:
    """Adds out: array of (value, gap, start, end) of the leftmost non-overlapping matches; gap is the text since the last one."""
    values, gaps, before = f"{out}_values", f"{out}_gaps", f"{out}_before"
    there = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(values, F.when(F.contains(F.col(text), F.lit(needs)), there).otherwise(none) if needs else there)
    some = F.size(values) > 0
    df = df.withColumn(gaps, F.when(some, F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(values))).otherwise(none))
    sizes = F.zip_with(values, gaps, lambda v, g: F.length(v) + F.length(g))
    df = df.withColumn(before, F.when(some, running(sizes)).otherwise(F.array().cast("array<int>")))
    return df.withColumn(
        out,
        F.transform(
            F.arrays_zip(values, gaps, before),
            lambda x: F.struct(x[values].alias("value"), x[gaps].alias("gap"), (x[before] + F.length(x[gaps])).alias("start"), (x[before] + F.length(x[gaps]) + F.length(x[values])).alias("end")),
        ),
    ).drop(values, gaps, before)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits(value))
    twice = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), lambda a, i: a + twice(i) - F.when(twice(i) > 9, 9).otherwise(0)) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda v: F.length(digits(v)).between(14, 19) & luhn(v),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
}


def span(x: Column, kind: str) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), x["end"].alias("end"))


def checked(kind: str) -> Column:
    """The spans of a kind's matches that pass its check."""
    return F.transform(F.filter(f"pii_{kind}", lambda x: CHECKS[kind](x["value"])), lambda x: span(x, kind))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii_base: the base spans (start, no, end) by start and kind; no counts KINDS from 0."""
    df = docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    for kind, pattern in PATTERNS.items():
        df = with_matches(df, "pii_text", pattern, f"pii_{kind}", NEEDS.get(kind))
    return df.withColumn("pii_base", F.array_sort(F.concat(*map(checked, PATTERNS)))).drop(*(f"pii_{kind}" for kind in PATTERNS))


def as_word(text: Column) -> Column:
    """How words of patterns are told apart: in lower case, with numbers as 0."""
    return F.regexp_replace(F.lower(text), "[0-9]++", "0")


def context_ids(before: Column) -> Column:
    """Numbers of the patterns at the end of what stands before a token: its last word, and its last two."""
    plain = F.rtrim(F.translate(before, "\t\n\x0b\f\r", "     "))
    last = F.substring_index(plain, " ", -1)
    rest = F.rtrim(F.substring(plain, F.lit(1), F.length(plain) - F.length(last)))
    one, two = as_word(last), as_word(F.substring_index(rest, " ", -1))
    return F.when(last == "", F.array().cast("array<bigint>")).when(two == "", F.array(F.xxhash64(one))).otherwise(F.array(F.xxhash64(one), F.xxhash64(two, one)))


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds pii_tokens: (start, end, value, kind, prior, contexts) of tokens with a digit or @; kind is that of the base span that starts in the token, or -1; value is a hash of that span or of the token; prior is its confidence as a seed, or 0."""
    df = with_matches(df, "pii_text", TOKEN, "pii_found")
    edge = r"""["'()\[\]{}<>,.;:!?]"""

    def token(x: Column, previous: Column) -> Column:
        lead = F.length(x["value"]) - F.length(F.regexp_replace(x["value"], f"^{edge}++", ""))
        core = F.regexp_replace(x["value"], f"^{edge}++|(?<!{edge}){edge}++$", "")
        over = F.filter("pii_base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        kind = F.when(F.size(over) == 0, -1).when(over[0]["start"] >= x["start"], over[0]["no"]).otherwise(-2)
        prior = F.when(kind >= 0, 1.0).when((kind == -1) & core.rlike(KEYS), SECRET).otherwise(0.0)
        whole = F.substring(F.col("pii_text"), over[0]["start"] + 1, over[0]["end"] - over[0]["start"])
        value = F.xxhash64(F.when(kind >= 0, whole).otherwise(core))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), value.alias("value"), kind.alias("kind"), prior.alias("prior"), context_ids(F.concat(previous, x["gap"])).alias("contexts"))

    long = lambda t: (t["kind"] >= 0) | (t["end"] - t["start"] >= LEAST_LENGTH)
    def shifted(items: Column) -> Column:
        return F.concat(F.array(F.lit("")), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))

    def joint(a: Column, b: Column) -> Column:
        return F.concat(a, b)

    # the token before, what precedes it, and the token before that: the last two words are in there
    values, gaps = F.transform("pii_found", lambda x: x["value"]), F.transform("pii_found", lambda x: x["gap"])
    df = df.withColumn("pii_last", F.when(F.size("pii_found") > 0, F.zip_with(shifted(shifted(values)), F.zip_with(shifted(gaps), shifted(values), joint), joint)))
    found = F.when(F.size("pii_found") > 0, F.zip_with("pii_found", "pii_last", token))
    tokens = F.filter(found, lambda t: (t["kind"] >= -1) & long(t) & (F.size(t["contexts"]) > 0))
    return df.withColumn("pii_tokens", F.coalesce(tokens, F.array())).drop("pii_found", "pii_last")


def context_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often a word follows each pattern in all texts.

    The bit set is a table of FILTER_BITS / 64 rows at most, whatever the number of patterns, so it is broadcast.
    """
    bit = F.pmod(F.col("pattern"), F.lit(FILTER_BITS))
    bits = patterns.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pattern & 63 as int))")).alias("bits"))
    words = texts.select(F.filter(F.split(as_word(F.col("text")), f"[{WS}]+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    triples = words.where(n > 1).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))).alias("x"))
    one = F.when(F.col("x.b").isNotNull(), F.xxhash64("x.a"))
    two = F.when(F.col("x.c").isNotNull(), F.xxhash64("x.a", "x.b"))
    ids = triples.select(F.explode(F.array(one, two)).alias("pattern")).where("pattern is not null")
    held = ids.withColumn("at", F.shiftright(bit, 6)).join(F.broadcast(bits), "at").where("shiftright(bits, cast(pattern & 63 as int)) & 1 = 1")
    return held.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern", "left_semi")


def trusted_patterns(texts: DataFrame, tokens: DataFrame, least: int = LEAST_INSTANCES, trust: float = TRUST, rounds: int | None = None) -> DataFrame:
    """(pattern, score) of trusted patterns, after so many rounds or when no more get trusted. tokens: (value, prior, contexts)."""
    edges = tokens.select(F.explode("contexts").alias("pattern"), "value", F.col("prior").alias("seed"))
    edges = cut(edges.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    patterns = cut(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= least).select("pattern"))
    totals = stored(context_totals(texts, patterns), "totals")
    # what can't be trusted even if all its instances were is not scored again
    hopeful = edges.join(totals, "pattern").groupBy("pattern").agg(F.sum("n").alias("n"), F.first("total").alias("total")).where(F.col("n") >= trust * F.col("total")).select("pattern", "total")
    graph = cut(edges.join(hopeful, "pattern"))
    confident = cut(graph.select("value", F.col("seed").alias("confidence")).groupBy("value").agg(F.max("confidence").alias("confidence")))
    found, trusted = None, -1
    for done in itertools.count(1):
        scored = graph.join(confident, "value").groupBy("pattern").agg((F.sum(F.col("n") * F.col("confidence")) / F.max("total")).alias("score"), F.count(F.when(F.col("confidence") >= trust, 1)).alias("values"))
        found = cut(scored.where((F.col("score") >= trust) & (F.col("values") >= least)).select("pattern", "score"))
        # confidences only rise, so the trusted set only grows
        before, trusted = trusted, found.count()
        if trusted == before or trusted == 0 or done == rounds:
            return found
        step = graph.join(found, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("more"))
        confident = cut(confident.join(step, "value", "left").select("value", F.greatest("confidence", F.coalesce("more", F.lit(0.0))).alias("confidence")))


def with_spans(docs: DataFrame, text: str = "text", **graph) -> DataFrame:
    """docs with pii_base and pii_spans, arrays of (start, no, end) by start and kind; columns of these names are replaced.

    The scan is stored once, with the columns of docs, so that rows keep their numbers while the graph is scored.
    """
    docs = but(docs, "pii_")
    rows = with_candidates(with_base(docs, text)).drop("pii_text")
    rows = stored(rows.withColumn("pii_row", F.monotonically_increasing_id()), "spans")
    return joined(rows, rows.select(F.col(text).alias("text")), **graph)


def joined(rows: DataFrame, texts: DataFrame, **graph) -> DataFrame:
    """rows (pii_row, pii_base, pii_tokens and others) with pii_spans. texts: all texts, for the counts."""
    tokens = rows.select("pii_row", F.explode("pii_tokens").alias("t")).select("pii_row", "t.*")
    trusted = trusted_patterns(texts, tokens, **graph)
    unseen = tokens.where("kind = -1").select("pii_row", "start", "end", F.explode("contexts").alias("pattern")).join(trusted.select("pattern"), "pattern", "left_semi")
    spans = unseen.groupBy("pii_row").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("no"), "end")).alias("pii_more"))
    none = F.array().cast(rows.schema["pii_base"].dataType)
    out = rows.join(spans, "pii_row", "left").withColumn("pii_spans", F.array_sort(F.concat("pii_base", F.coalesce(F.col("pii_more").cast(rows.schema["pii_base"].dataType), none))))
    return out.drop("pii_row", "pii_tokens", "pii_more")


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["no"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", **graph) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one mark, that of the first. Same columns.

    n_chars, where there is such a column, becomes the length of a text that was changed.
    """
    docs, restored = aside(docs, ("doc_id", text, "n_chars"))
    rows = with_spans(docs, text, **graph)
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def add(a: Column, s: Column) -> Column:
        fresh = F.array(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), marks[s["no"]])
        return F.when(s["start"] >= a["at"], F.struct(F.concat(a["parts"], fresh).alias("parts"), s["end"].alias("at"))).otherwise(F.struct(a["parts"].alias("parts"), F.greatest(a["at"], s["end"]).alias("at")))

    tail = F.substring(F.col(text), F.col("pii_folded.at") + 1, F.length(text))
    rows = rows.withColumn("pii_folded", F.when(F.size("pii_spans") > 0, F.aggregate("pii_spans", start, add)))
    rows = rows.withColumn("pii_new", F.when(F.col("pii_folded").isNotNull(), F.concat(F.array_join("pii_folded.parts", ""), tail)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("pii_new").isNotNull(), F.length("pii_new").cast("long")).otherwise(F.col("n_chars")))
    return restored(rows.withColumn(text, F.coalesce("pii_new", text)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_spans: how many spans of any kind, those of trusted contexts included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_candidates(with_base(docs)).select("doc_id", "pii_base", "pii_tokens", F.monotonically_increasing_id().alias("pii_row"))
    rows = joined(stored(rows, "spans"), docs.select("text"))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(as_text("pii_base"), 256).alias("base_sha256"), as_text("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
