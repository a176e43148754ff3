"""Secret scan: three fixed rules, and two character Markov models compared by log-likelihood ratio.

Native: DataFrame functions only. One model is of random strings, one of ordinary identifiers; both are first-order
over the characters of ALPHABET and are trained from labelled samples. A candidate is a run of 16 such characters or
more; it is a secret where the ratio of its likelihoods, in nats, is over a threshold, which is set from samples that
the models were not trained on. Nothing else decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import written

#: The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")
MARKOV = "markov"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run of characters that may be a secret; one in a UUID's form is an identifier by its form.
CANDIDATE = (
    r"(?<![\p{L}\p{N}+/_=-])(?![0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}(?![\p{L}\p{N}])"
)
#: Parts of ordinary identifiers, for the labelled samples.
PARTS = (
    "get set put add new old max min sum key map row col day net url doc tag log run user name data file path list item node tree page "
    "text word line code type size time date year hash sort join left right first last next prev count index value error event input "
    "output buffer string number object parser reader writer server client request response session config default handler manager"
).split()

#: Orders of letters and keys, and words of languages whose clusters of letters English has not.
SEQUENCES = ("abcdefghijklmnopqrstuvwxyzabcdefghijklmn", "qwertyuiopasdfghjklzxcvbnmqwertyuiop", "zxcvbnmasdfghjklqwertyuiop", "qazwsxedcrfvtgbyhnujmikolp", "0123456789012345678901234567890123456789")
FOREIGN = (
    "szczebrzeszyn chrzaszcz przedsiebiorstwo wszystkich zrzeszenie bezwzgledny krzyzowka zmrzlina ctvrtek vlastnost prst hrvatska krk yhteiskunta "
    "jarjestelma tyottomyys megszentseg koszonom egeszseg llanfair gwyngyll cymraeg rhyfedd schifffahrt gesellschaft wirtschaft rechtschutz angstschweiss "
    "slechtstschrijvend ontwikkeling vrijheid skjaergard bokstav gjennomsnitt ifjallraven oeuvre aujourdhui quelquechose ayuntamiento desarrollo conhecimento "
    "nguyen truong phuong xiongmao zhongguo shuangxi tsukuyomi shinkansen khrushchev vladivostok mkhedruli tbilisi gvprtskvni nkrumah mbongeni ndzwana"
).split()

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Spans that one step of a fold appends to; longer lists are folded block by block, as each append copies its list.
_BLOCK = 128


def _blocks(items: Column) -> Column:
    """0, 1, ... for each block of _BLOCK items; none of an empty list."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.ceil(F.size(items) / _BLOCK).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _block(items: Column, k: Column) -> Column:
    return F.slice(items, k * _BLOCK + 1, F.lit(_BLOCK))


def _lengths(text: Column, pattern: str, keep_group: int | None = None) -> Column:
    """Of each leftmost non-overlapping match: the lengths of the text before it, of itself, and of `keep_group`, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)) if keep_group else hits
    of = lambda c: F.transform(c, lambda x: F.length(x))
    rows = F.arrays_zip(of(F.split(text, pattern, -1)).alias("gap"), of(hits).alias("hit"), of(kept).alias("kept"))  # the text after the last match has no hit
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<gap:int,hit:int,kept:int>>"))


def _spans(rows: Column, rank: int, kind: str, least: int = 0) -> Column:
    """Spans from _lengths(), of which the kept group has `least` characters. Linear but for a list of the blocks' starts."""
    step = lambda at, row: at + row["gap"] + F.coalesce(row["hit"], F.lit(0))
    ends = F.transform(_blocks(rows), lambda k: F.aggregate(_block(rows, k), F.lit(0), step))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(ends, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def place(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + F.coalesce(row["hit"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.coalesce(row["kept"], F.lit(-1)) >= least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    def whole(start: Column, k: Column) -> Column:
        return F.aggregate(_block(rows, k), F.struct(start.alias("at"), F.array().cast(_SPAN).alias("out")), place, lambda s: s["out"])

    return F.flatten(F.transform(starts, whole))


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, *, text: str = "text", n_random: int = 4000, n_docs: int = 400) -> DataFrame:
    """(sample, random): strings made from digests, and ordinary ones: identifiers, numbers, dates, paths with short hashes, rulers.

    `n_docs` documents' ids, those of least hash, and all rows that have them, lend their words of letters and runs of
    three such words, joined as identifiers are, for names in their languages. Only their ids are read to choose them.
    """
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")).cast("binary"), 256)
    raw = F.unhex(digest)
    digits = lambda a: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(a), F.pmod(F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(a))) + 1, F.lit(1))), "")
    kinds = F.array(digest, F.upper(digest), F.base64(raw), F.rtrim(F.translate(F.base64(raw), "+/=", "-_ ")), digits(ALPHABET[26:62]), digits(ALPHABET[:62]), digits(ALPHABET[:52]))
    random = spark.range(n_random // 4).select(F.explode(kinds).alias("sample"), F.lit(True).alias("random"))
    ordinary = lambda df, *samples: df.select(F.explode(F.array(*samples)).alias("sample"), F.lit(False).alias("random"))
    parts, upper = F.lit(" ".join(PARTS)), lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 99))
    a, b, c = F.col("a"), F.col("b"), F.element_at(F.split(parts, " "), F.pmod(F.xxhash64("a", "b"), F.lit(len(PARTS))).cast("int") + 1)
    pairs = spark.range(1).select(F.explode(F.split(parts, " ")).alias("a")).select("a", F.explode(F.split(parts, " ")).alias("b"))
    names = ordinary(
        pairs, F.concat_ws("_", a, b), F.concat(a, upper(b)), F.concat_ws("-", b, a), F.upper(F.concat_ws("_", b, a)), F.concat_ws("/", a, b), F.concat(upper(a), upper(b), upper(c)),
        F.concat_ws("_", a, b, c, a), F.concat_ws("/", F.lit(""), a, b, c, b), F.concat_ws("-", c, b, a, c), F.upper(F.concat_ws("_", a, b, c)), F.concat(a, b, c),
    )
    number = F.translate(digest, "abcdef", "204816")
    cut = lambda at, n: F.substring(number, at, n)
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int") * 17 % 20000), "yyyy-MM-dd")
    numbers = ordinary(
        spark.range(n_random // 4), cut(1, 16), cut(5, 20), F.concat(F.lit("+"), cut(3, 15)), F.concat_ws("-", cut(1, 4), cut(5, 4), cut(9, 4), cut(13, 4)), F.concat(day, F.lit("T"), cut(1, 6)),
        F.concat_ws("_", day, cut(1, 2), cut(3, 2), cut(5, 2)), F.concat(F.translate(day, "-", "/"), F.lit("/"), cut(1, 8)), F.concat(F.lit("/data/part-"), cut(1, 5), F.lit("-of-"), cut(6, 5)),
        F.concat(F.lit("/static/js/main-"), F.substring(digest, 1, 8)), F.concat(F.lit("/cache/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 7), F.lit("/index")),
    )
    # References that look random at first sight; few, as many would make hex digits ordinary.
    hexes = lambda at, n: F.substring(digest, at, n)
    part = lambda at: F.element_at(F.split(parts, " "), F.pmod(F.conv(hexes(at, 4), 16, 10).cast("int"), F.lit(len(PARTS))) + 1)
    ids = ordinary(
        spark.range(40), F.concat_ws("/", part(1), hexes(5, 12)), F.concat(part(1), F.lit("/"), part(5), F.lit("-"), hexes(9, 7)), F.concat(part(1), F.lit("-"), part(5), F.lit("-"), hexes(9, 10)),
        F.concat(F.lit("IPv6-"), F.concat_ws("-", hexes(1, 4), hexes(5, 4), hexes(9, 4))),
    ).unionByName(ordinary(
        spark.range(n_random // 16),
        F.concat(F.upper(part(1)), cut(1, 2), F.lit("/"), F.upper(F.substring(part(5), 1, 3)), F.lit("-"), part(9), F.lit("-"), cut(3, 2), F.upper(F.substring(part(13), 1, 1)), F.lit("-"), F.upper(F.substring(part(17), 1, 4)), cut(5, 5)),
        F.concat(part(1), F.lit("/"), F.upper(part(5)), F.lit("-"), cut(1, 4), F.lit("-"), part(9), F.lit("-"), part(13)),
    ))
    lines = spark.range(1).select(F.explode(F.array(*map(F.lit, (*SEQUENCES, *map(str.upper, SEQUENCES[:-1]))))).alias("line"))
    at, size = F.col("at"), F.col("size")
    pieces = lines.select("line", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("at")).select("*", F.explode(F.sequence(F.lit(16), F.lit(30), F.lit(2))).alias("size"))
    sequences = ordinary(pieces, F.substring("line", at, size), F.reverse(F.substring("line", at, size)))
    foreign = ordinary(pieces.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FOREIGN))).alias("a")).crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, FOREIGN))).alias("b"))), F.concat_ws("_", a, b), F.concat(a, b), F.concat(upper(a), upper(b)), F.concat_ws("-", a, b))
    rulers = ordinary(spark.range(1).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("a")).filter("a <> ''"), *(F.repeat(a, F.lit(n)) for n in range(16, 32, 2)))
    out = random.unionByName(names).unionByName(numbers).unionByName(rulers).unionByName(ids).unionByName(sequences).unionByName(foreign)
    if docs is not None:
        ids = docs.select(F.xxhash64("doc_id").alias("h"))
        least = ids.distinct().orderBy("h").limit(n_docs).agg(F.max("h")).first()[0]
        some = (docs.filter(F.xxhash64("doc_id") <= least) if least is not None else docs.limit(0)).select(F.coalesce(F.col(text), F.lit("")).alias("raw"))
        word = "[A-Za-z]{3,24}"
        single = F.regexp_extract_all("raw", F.lit(rf"(?<![A-Za-z]){word}(?![A-Za-z])"), F.lit(0))
        triple = F.regexp_extract_all("raw", F.lit(rf"(?<![A-Za-z]){word}\x20{word}\x20{word}(?![A-Za-z])"), F.lit(0))
        joined = F.flatten(F.transform(triple, lambda t: F.array(F.translate(t, " ", "_"), F.translate(t, " ", "-"), F.translate(t, " ", "/"), F.translate(t, " ", ""))))
        joined = F.concat(joined, F.transform(joined, lambda t: F.upper(t)), F.transform(triple, lambda t: F.translate(F.initcap(t), " ", "")))
        found = some.select(F.explode(F.concat(single, joined)).alias("sample"))
        out = out.unionByName(found.distinct().select("sample", F.lit(False).alias("random")))
    return out


def _codes(sample: Column) -> Column:
    """Places in ALPHABET, from 1; a character that is repeated at once counts once, so that a ruled line is one character."""
    chars = F.split(F.regexp_replace(sample, r"(.)\1+", "$1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


@dataclass
class Markov:
    """log P(next | random) - log P(next | ordinary) by previous code * len(ALPHABET) + next code; and the threshold.

    Likelihoods are given the first character, which alone tells nothing.
    """

    ratios: list[float]
    threshold: float

    def ratio(self, sample: Column) -> Column:
        """Log-likelihood ratio of a string of ALPHABET's characters, in nats."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        start = F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("sum"))
        step = lambda s, c: F.struct(c.alias("code"), (s["sum"] + F.when(s["code"] > 0, F.element_at(table, s["code"] * len(ALPHABET) + c)).otherwise(0.0)).alias("sum"))
        return F.aggregate(_codes(sample), start, step, lambda s: s["sum"])


def train(samples: DataFrame, *, false_positives: float = 0.001, least_threshold: float = 13.0) -> Markov:
    """Both models from four fifths of the samples; the threshold from the ordinary rest of 16 characters or more.

    Of these, at most a share of `false_positives` has a ratio over the threshold, which is `least_threshold` at least.
    The counts brought to the driver are at most two by len(ALPHABET) squared, whatever the samples' number. Half a count is added to each.
    """
    samples = written(samples.filter("sample is not null and random is not null"), "samples")
    held_out = F.pmod(F.xxhash64("sample"), F.lit(5)) == 0
    codes = _codes(F.col("sample"))
    steps = F.arrays_zip(F.concat(F.array(F.lit(0)), codes).alias("a"), codes.alias("b"))
    counted = samples.filter(~held_out).select("random", F.explode(steps).alias("s")).filter("s.a > 0 and s.b > 0").groupBy("random", "s.a", "s.b").count()
    k = len(ALPHABET)
    counts = {True: [0.5] * (k * (k + 1)), False: [0.5] * (k * (k + 1))}
    for row in counted.collect():
        counts[row["random"]][row["a"] * k + row["b"] - 1] += row["count"]
    out = []
    for a in range(k + 1):
        rows = {kind: counts[kind][a * k : a * k + k] for kind in counts}
        out += [math.log(r / sum(rows[True])) - math.log(o / sum(rows[False])) for r, o in zip(rows[True], rows[False], strict=True)]
    model = Markov(out, least_threshold)
    ordinary = samples.filter(held_out & ~F.col("random") & F.col("sample").rlike(f"^(?:{CANDIDATE})$"))
    found = ordinary.select(model.ratio(F.col("sample")).alias("r")).agg(F.percentile("r", F.lit(1 - false_positives))).first()[0]
    return Markov(out, max(least_threshold, found if found is not None else least_threshold))


def secret_scan(docs: DataFrame, model: Markov, *, text: str = "text", threshold: float | None = None) -> DataFrame:
    """One row for each document: counts by kind, the digest of the base spans, and all spans.

    spans: kind:start:end by start, then kind, joined by commas; code points, end exclusive; a match is its whole span.
    The model adds spans of candidates whose ratio is over the model's threshold (or the one given) and that overlap no
    base span. Null and empty texts have no spans; repeated rows and ids are scanned each on its own; an empty table gives
    no rows; other columns are not read, whatever their names. Work grows with a text's length, its matches and, where
    one has thousands of both, candidates times a 128th of base spans.
    """
    raw = F.col("raw")
    threshold = model.threshold if threshold is None else threshold
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("raw"))
    rows = rows.select(
        "doc_id", _lengths(raw, ASSIGN, 2).alias("assign"), _lengths(raw, ACCESS).alias("access"), _lengths(raw, HEX).alias("hex"), _lengths(raw, CANDIDATE).alias("runs"),
        F.when(raw.rlike(CANDIDATE), F.regexp_extract_all(raw, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("samples"),
    )
    rows = rows.select(
        "doc_id", "samples", _spans(F.col("assign"), 0, "assign", 8).alias("assign"), _spans(F.col("access"), 1, "access").alias("access"),
        _spans(F.col("hex"), 2, "hex").alias("hex"), _spans(F.col("runs"), 3, MARKOV).alias("runs"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    whole = lambda k: _block(F.col("base"), k)
    bounds = F.transform(_blocks(F.col("base")), lambda k: F.struct(k.alias("k"), F.element_at(whole(k), 1)["start"].alias("start"), F.array_max(F.transform(whole(k), lambda b: b["end"])).alias("end")))
    rows = rows.withColumn("bounds", bounds)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda x: ~F.exists("bounds", lambda k: meets(k, x) & F.exists(whole(k["k"]), lambda b: meets(b, x)))
    likely = F.filter(F.arrays_zip(F.col("runs").alias("run"), F.col("samples").alias("sample")), lambda z: model.ratio(z["sample"]) > threshold)
    rows = rows.withColumn("added", F.transform(F.when(F.size("runs") > 0, F.filter(likely, lambda z: free(z["run"]))), lambda z: z["run"]))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS), F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))).alias("spans"),
        F.size(F.coalesce("added", F.array().cast(_SPAN))).cast("long").alias(f"n_{MARKOV}"),
    )
