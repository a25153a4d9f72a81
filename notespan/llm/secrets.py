"""Secret scans: known forms, and tokens that a Markov model finds more like random strings than like identifiers.

Everything is DataFrame expressions. The known forms are regular expressions; the places of their
matches follow from the lengths of the matches and of what stands between them. For the rest, two
character Markov models are trained from labelled samples of a bounded number of documents: values
that the known forms found are the random strings, other words the ordinary ones. A token is a
secret when the log-likelihood ratio of its character pairs is high enough, for each pair and in
all. Where a known form covers a part of a run, what is left on either side are tokens of their own. The table of ratios has 128 x 128 cells at any size of the input. Nothing else is shuffled:
each document is a row of its own. Spans come out of a generator (behind), so a filter on them, or on a
text that was masked, doesn't copy the expressions below it.

Null texts are empty, and empty texts have no spans. Places are code points, the end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import documents, named, names, table

# The forms of secrets, in the order in which spans of one start are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # whole runs: AKIA[A-Z0-9]+ of 16 or more
HEX = "[0-9a-f]{32,}"  # whole runs: [0-9a-f]+ of 32 or more
KINDS = ["assign", "access", "hex", "markov"]
LEAST_VALUE = 8

#: What the models look at: runs of these, of so many characters at least.
TOKEN = "[A-Za-z0-9+/_-]{20,}"
#: Ordinary words for training.
WORD = "[A-Za-z0-9_-]{8,}"
#: Documents that the models are trained on, by the hashes of their ids.
SAMPLE_DOCUMENTS = 4000
#: How much the distribution of single characters weighs beside the counts, in observed pairs after one character.
PRIOR = 40.0
SYMBOLS = 65
#: What every pair's count in ordinary words is lowered by.
DISCOUNT = 4
#: Least ratio (natural logarithm) for each pair of a token, and in all.
LEAST_MEAN, LEAST_TOTAL = 0.5, 12.0


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def behind(rows: DataFrame, **new: Column) -> DataFrame:
    """rows with new columns that come out of a generator of one row: each is worked out once, and no filter or projection above copies its expression."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in new.items())))))


def running(numbers: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of an array's numbers (long), that number and all before it put together: their sums, or what add makes of two.

    An array grows by copying, so this is done within stretches as long as the number of stretches, and then for the stretches.
    """
    empty = lambda: F.array().cast("array<bigint>")
    put = lambda last, x: F.coalesce(add(last, x), x)

    def each(values: Column) -> Column:
        start = F.struct(F.lit(None).cast("bigint").alias("last"), empty().alias("out"))
        return F.aggregate(values, start, lambda s, x: bound(put(s["last"], x), lambda y: F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out"))))["out"]

    def whole(values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(values))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda i: F.slice(values, i * size + 1, size))
        return bound(F.transform(parts, each), lambda ps: bound(each(F.transform(ps, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: put(F.get(ends, i - 1), x)))))))

    return bound(numbers, lambda values: F.when(F.size(values) > 64, whole(values)).otherwise(each(values)))


def matches(text: Column, pattern: str, group: int) -> Column:
    """start, end and value (the group) of every match, leftmost first, none inside another."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lens = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), whole, lambda a, b: F.when(b.isNotNull(), a.cast("long") + F.length(b)))
    ends = running(F.filter(lens, lambda x: x.isNotNull()))
    places = F.zip_with(ends, whole, lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end")))
    return F.zip_with(places, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))


NO_MATCH = "array<struct<start:bigint,end:bigint,value:string>>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(text.rlike(pattern), matches(text, pattern, group)).otherwise(F.array().cast(NO_MATCH))


def known_forms(docs: DataFrame) -> DataFrame:
    """docs with assign, access and hex: the matches of each form."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "assign": F.filter(found(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE),
        "access": found(text, ACCESS),
        "hex": found(text, HEX),
    })


def ratios(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> list[float]:
    """For each pair of characters (128 x the first + the second): log of its chance in random strings to that in ordinary words."""
    few = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = known_forms(docs.join(F.broadcast(few), "doc_id", "left_semi"))
    values = F.transform(F.concat("assign", "access", "hex"), lambda m: m["value"])
    plain = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), ASSIGN, " "), f"{ACCESS}|{HEX}", " "), F.lit(WORD), F.lit(0))
    tokens = own.select(F.lit(1).alias("random"), F.explode(F.array_distinct(values)).alias("token")).union(own.select(F.lit(0), F.explode(F.array_distinct(plain))))
    pairs = tokens.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1))), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where("length(pair) = 2").groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    # A pair seen a few times only among ordinary words may be a secret's that no known form shows.
    counts = {(kind, pair): n - (0 if kind else DISCOUNT) for (kind, pair), n in counts.items() if kind or n > DISCOUNT}
    after, alone, total = {}, {}, {}
    for (kind, pair), n in counts.items():
        after[kind, pair[0]] = after.get((kind, pair[0]), 0) + n
        alone[kind, pair[1]] = alone.get((kind, pair[1]), 0) + n
        total[kind] = total.get(kind, 0) + n

    def chance(kind: int, pair: str) -> float:
        """Beside the counts weighs, for random strings, that all characters are alike, and for ordinary words how frequent each is in them."""
        prior = 1 / SYMBOLS if kind else (alone.get((kind, pair[1]), 0) + 1) / (total.get(kind, 0) + SYMBOLS)
        return (counts.get((kind, pair), 0) + PRIOR * prior) / (after.get((kind, pair[0]), 0) + PRIOR)

    return [math.log(chance(1, chr(a) + chr(b)) / chance(0, chr(a) + chr(b))) for a in range(128) for b in range(128)]


def likely(token: Column, cells: Column) -> Column:
    """The log-likelihood ratio of a token."""
    codes = F.transform(F.split(token, ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: F.get(cells, a * 128 + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


#: Code points of the stretches that a text is cut into, so that a place in it is found without counting from its beginning.
STRETCH = 4096


def between(stretches: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end (exclusive) of a text that was cut into stretches."""
    first, last = F.floor(start / STRETCH).cast("int"), F.floor((end - 1) / STRETCH).cast("int")
    own = lambda i, a, n: F.substring(F.get(stretches, i), a.cast("int"), n.cast("int"))
    head = own(first, start - first * STRETCH + 1, F.least(end - start, F.lit(STRETCH)))
    middle = F.array_join(F.slice(stretches, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(first == last, head).otherwise(F.concat(head, middle, own(last, F.lit(1), end - last * STRETCH)))


def replaced(text: Column, spans: str, mask: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with a mask in place of each stretch that spans (sorted by start) cover. mask gets a span's start, its end and where the spans before it end."""

    def done(stretches: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        pairs = bound(reach, lambda r: F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(r, i - 1)).alias("at"))))
        piece = lambda x: F.when(x["end"] > x["at"], F.concat(between(stretches, x["at"], x["start"]), mask(x["start"], x["end"], x["at"]))).otherwise("")
        tail = between(stretches, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(pairs, piece), ""), tail)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), done)


def blanked(text: Column, spans: str) -> Column:
    """The text with blanks, as many as there were characters, in place of the spans (sorted)."""
    return replaced(text, spans, lambda start, end, at: F.repeat(F.lit(" "), (end - F.greatest(start, at)).cast("int")))


def scan(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """docs with spans: array of start, kind (its place in KINDS), end, sorted. docs has doc_id and text, and its other columns stay."""
    cells = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios(docs, sample))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    tokens = F.filter(found(F.col("_bare"), TOKEN), lambda m: likely(m["value"], cells) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_MEAN * (F.length(m["value"]) - 1)))
    as_spans = lambda ms, kind: F.transform(ms, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    base = known_forms(docs)
    base = behind(base, base_spans=F.array_sort(F.concat(as_spans(base["assign"], 0), as_spans(base["access"], 1), as_spans(base["hex"], 2)))).drop("assign", "access", "hex")
    base = behind(base, _bare=F.when(F.size("base_spans") > 0, blanked(text, "base_spans")).otherwise(text))
    return behind(base, spans=F.array_sort(F.concat("base_spans", as_spans(tokens, 3)))).drop("_bare")


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: numbers of known forms, a digest of their places, and all spans as text."""
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents(docs)).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by the mask; overlapping spans become one. Other columns stay; n_chars, if there, is counted anew."""
    cut = replaced(F.col("text"), "spans", lambda start, end, at: F.when(start >= at, F.lit(mask)).otherwise(""))
    own = {c: f"_row{i}" for i, c in enumerate(docs.columns)}  # plain columns: fields of a struct aren't found again behind several generators
    rows = docs.select(named("doc_id").alias("doc_id"), named("text").cast("string").alias("text"), *(named(c).alias(n) for c, n in own.items()))
    out = behind(scan(rows), _cut=F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))
    new = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return out.select(*(new.get(c, F.col(own[c])).alias(c) for c in docs.columns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
