"""Personal data by patterns, and by contexts learned from them; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark.llm.shared import content_key, written

KINDS = ("email", "ip", "card", "phone")
# A match can begin where the one before ended, or where no character of its first class precedes. The runs are
# possessive: nothing they give back could be followed by what comes next. So long runs are read once.
_EMAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_EMAIL})){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an unseen identifier looks like: five characters or more, a digit or an @ among them.
LIKELY = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]{5,}+"
#: Rounds of scoring, distinct seeds a pattern needs, and the scores at which patterns spread and are believed.
ROUNDS, SUPPORT, SPREAD, BELIEVED = 3, 3.0, 0.5, 0.8
_BLOCK = 256
_ITEM = "array<struct<start:bigint,end:bigint,s:string,gap:string>>"


def with_matches(rows: DataFrame, text: Column, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add a column per name: the pattern's leftmost matches that don't overlap, as an array of (start, end, s, gap).

    Places are in code points; gap is the end of the text before, the match before and what precedes that included. The text is cut at its matches, so a match's place is the length
    of all pieces before it. Lengths are summed in blocks, which keeps long arrays cheap. Each step is a column of its own,
    because lambdas evaluate what stands inside them again for every element. A pattern's second part says
    which texts can hold a match at all.
    """
    mark = "\u0001"
    clean = F.translate(text, mark, "\u0002")
    cut = {c: F.split(F.regexp_replace(clean, f"({p})", f"{mark}$1{mark}"), mark, -1) for c, (p, _) in patterns.items()}
    rows = rows.withColumns({f"{c}_pieces": F.when(patterns[c][1], cut[c]).otherwise(F.array(F.lit(""))) for c in patterns})

    def blocks(c: str) -> Column:
        at = lambda i: F.element_at(f"{c}_pieces", i.cast("int"))
        end = lambda i: F.right(at(i), F.lit(84))
        before = lambda i: F.when(i > 1, F.concat(end(2 * i - 3), end(2 * i - 2), end(2 * i - 1))).otherwise(end(2 * i - 1))
        item = lambda i: F.struct(
            F.length(at(2 * i - 1)).cast("bigint").alias("g"), F.length(at(2 * i)).cast("bigint").alias("l"), at(2 * i).alias("s"), before(i).alias("gap")
        )
        n = F.floor(F.size(f"{c}_pieces") / 2).cast("int")
        some = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.transform(F.sequence(b * _BLOCK + 1, F.least((b + 1) * _BLOCK, F.floor(F.size(f"{c}_pieces") / 2).cast("int"))), item))
        return F.when(n > 0, some).otherwise(F.array().cast("array<array<struct<g:bigint,l:bigint,s:string,gap:string>>>"))

    rows = rows.withColumns({f"{c}_blocks": blocks(c) for c in patterns})
    zero = F.lit(0).cast("bigint")

    def placed(c: str) -> Column:
        sums = F.transform(f"{c}_blocks", lambda b: F.aggregate(b, zero, lambda a, x: a + x["g"] + x["l"]))
        bases = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        step = lambda a, x: F.struct(
            (a["p"] + x["g"] + x["l"]).alias("p"),
            F.concat(a["out"], F.array(F.struct((a["p"] + x["g"]).alias("start"), (a["p"] + x["g"] + x["l"]).alias("end"), x["s"].alias("s"), x["gap"].alias("gap")))).alias("out"),
        )
        start = lambda z: F.struct(z["p"].alias("p"), F.array().cast(_ITEM).alias("out"))
        pairs = F.zip_with(f"{c}_blocks", bases, lambda b, p: F.struct(b.alias("b"), p.alias("p")))
        full = F.filter(pairs, lambda z: z["b"].isNotNull())
        return F.flatten(F.transform(full, lambda z: F.aggregate(z["b"], start(z), step, lambda a: a["out"])))

    return rows.withColumns({c: placed(c) for c in patterns}).drop(*[f"{c}_{x}" for c in patterns for x in ("pieces", "blocks")])


def luhn(digits: Column) -> Column:
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def passes(kind: str):
    """Whether a match of the pattern counts, as a function of the match."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    digits = lambda x: F.regexp_replace(x["s"], "[^0-9]", "")
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.rlike(x["s"], F.lit(rf"^{part}\.{part}\.{part}\.{part}$")),
        "card": lambda x: F.when(F.length(digits(x)).between(14, 19), luhn(digits(x))).otherwise(False),
        "phone": lambda x: F.length(digits(x)).between(10, 15),
    }[kind]


def context(gap: Column) -> Column:
    """A hash of the last two words before a place, in lower case; null where the gap has fewer. Words with a digit or an @ are all one."""
    words = F.regexp_extract(F.lower(gap), r"(\S{1,40}\s+\S{1,40})\s*$", 1)
    words = F.regexp_replace(words, r"\S*[0-9@]\S*", "#")
    return F.when(words != "", F.xxhash64(F.regexp_replace(words, r"\s+", " ")))


def scan(rows: DataFrame) -> DataFrame:
    """uid, doc_id, n_chars, spans (start, k, end) by the fixed patterns, seeds and unseen (start, end, context, instance)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.rlike(text, F.lit("[0-9]"))
    may = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    wanted = {f"b{i}": (PATTERNS[k], may[k]) for i, k in enumerate(KINDS)} | {"likely": (LIKELY, digit | may["email"])}
    found = with_matches(rows.select("uid", "doc_id", "text"), text, wanted)
    found = found.withColumns({f"b{i}": F.filter(f"b{i}", passes(k)) for i, k in enumerate(KINDS)})
    plain = lambda i: F.transform(f"b{i}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end")))
    seed = lambda i: F.transform(f"b{i}", lambda x: F.struct(context(x["gap"]).alias("context"), F.xxhash64(x["s"]).alias("instance"), F.lit(i).alias("k")))
    found = found.withColumn("spans", F.array_sort(F.concat(*[plain(i) for i in range(len(KINDS))])))
    free = F.filter("likely", lambda x: ~F.exists("spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    unseen = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), context(x["gap"]).alias("context"), F.xxhash64(x["s"]).alias("instance")))
    return found.select("uid", "doc_id", "spans", F.concat(*[seed(i) for i in range(len(KINDS))]).alias("seeds"), unseen.alias("unseen"))


def scored_patterns(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """context, p0.. (share of its distinct instances' scores by kind), where SUPPORT instances are certain of one kind."""
    marks = [f"s{i}" for i in range(len(KINDS))]
    sums = edges.join(scores, "instance").groupBy("context").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in marks])
    share = [F.when(F.col(m) >= SUPPORT, F.col(m) / (F.col("n") + 1)).otherwise(0.0).alias(f"p{i}") for i, m in enumerate(marks)]
    return sums.select("context", *share)


def learned_patterns(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The bootstrap: contexts with their confidence by kind, after ``rounds`` of scoring the context-instance graph.

    Seeds are instances of score 1 for their kind. A context's confidence is the share of its distinct instances,
    weighted by score; an instance's score is the chance that one of its contexts of at least SPREAD is right.
    Edges are distinct, so copies of a document lend no weight.
    """
    seeds = scanned.select(F.explode("seeds").alias("x")).select("x.context", "x.instance", "x.k")
    unseen = scanned.select(F.explode("unseen").alias("x")).select("x.context", "x.instance", F.lit(None).cast("int").alias("k"))
    both = written(seeds.unionByName(unseen).distinct(), "pii-edges")
    edges = both.filter("context is not null").select("context", "instance").distinct()
    known = [F.max(F.when(F.col("k") == i, 1.0).otherwise(0.0)).alias(f"s{i}") for i in range(len(KINDS))]
    seeded = both.groupBy("instance").agg(*known)
    scores = seeded
    for _ in range(rounds):
        patterns = scored_patterns(edges, scores)
        doubt = [F.sum(F.when(F.col(f"p{i}") >= SPREAD, F.log1p(-F.col(f"p{i}"))).otherwise(0.0)).alias(f"d{i}") for i in range(len(KINDS))]
        spread = edges.join(patterns, "context").groupBy("instance").agg(*doubt)
        better = [F.greatest(f"s{i}", 1 - F.exp(F.coalesce(f"d{i}", F.lit(0.0)))).alias(f"s{i}") for i in range(len(KINDS))]
        scores = written(seeded.join(spread, "instance", "left").select("instance", *better), "pii-scores")
    return scored_patterns(edges, scores)


def find_spans(rows: DataFrame) -> DataFrame:
    """uid, doc_id, base and spans for rows (uid, doc_id, text): arrays of (start, k, end), k the place of the kind in KINDS.

    base: matches of the fixed patterns in the whole text, failing ones dropped. spans: base and, with the kind of the
    context's seeds, what looks like an identifier, overlaps no base span and stands in a context of at least BELIEVED
    confidence. Null and empty texts have no spans. Equal texts have equal spans; repeated rows stay apart
    by uid. An empty table gives no rows.
    """
    scanned = written(scan(rows), "pii-scan")
    patterns = learned_patterns(scanned)
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("k")) for i in range(len(KINDS))]))
    believed = patterns.select("context", best.alias("best")).filter(F.col("best.p") >= BELIEVED).select("context", (-F.col("best.k")).alias("k"))
    places = scanned.select("uid", F.explode("unseen").alias("x")).select("uid", "x.start", "x.end", "x.context").filter("context is not null")
    added = places.join(believed, "context").groupBy("uid").agg(F.collect_list(F.struct("start", "k", "end")).alias("added"))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    return scanned.join(added, "uid", "left").select(
        "uid", "doc_id", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("added", none))).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps a replaced span goes with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit(0).cast("bigint").alias("p"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, (a["p"] + 1).cast("int"), (x["start"] - a["p"]).cast("int")), F.get(names, x["k"]))
        return F.struct(F.greatest(a["p"], x["end"]).alias("p"), F.when(x["start"] >= a["p"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    whole = F.aggregate(spans, state, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["p"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, columns as they were, with personal data replaced in text (n_chars follows where there is such a column)."""
    # Equal texts have equal spans, so spans return by the text; a text without any needs none.
    key = lambda text: content_key(text, F.when(text.isNull(), F.col("doc_id")))
    scanned = find_spans(docs.select(F.monotonically_increasing_id().alias("uid"), key(F.col("text")).alias("doc_id"), "text"))
    found = scanned.filter(F.size("spans") > 0).groupBy(F.col("doc_id").alias("key")).agg(F.first("spans").alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), key(F.col("text")).alias("key"))
    clean = keyed.join(found, "key", "left").select("row.*", redacted(F.col("row.text"), F.col("spans")).alias("__clean"))
    new = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("bigint")}
    return clean.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
