"""Secret scans in DataFrame functions only: patterns, and a battery of randomness tests.

Spans of three kinds come from patterns. The battery adds spans of kind "random": runs of at least 20
symbols of an encoding (hex, base32, base36 of one case, base64) of which the index of coincidence is too low for text. Its
tests: chi-squared uniformity over the encoding's alphabet, against what text would give (that is the p
value of a discovery), and over its classes of symbols; runs above and below the middle of the alphabet and
within a class; serial correlation. None but the first may reject randomness. Discoveries are those that the Benjamini-Hochberg rule keeps within
their length class, over all candidates of all documents whose encoding is inferred: no others are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import text_of, written

#: The patterns of the kinds, the group that a kind's length is of, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same places, for the regular expressions of Spark: runs of a class are maximal, so their least length may stand in the pattern.
_FOUND = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}", "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"}
#: What a text must hold for a kind to be looked for: words of an assignment in small letters, or a run of 20 symbols.
_WORDS, _RUN = ("passw", "secret", "token", "api"), r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
_MAY = {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Code points of a text that are masked together.
BLOCK = 4096
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
LENGTH_CLASSES = (20, 28, 40, 64)
#: Share of false discoveries, the level at which runs or serial correlation reject, and the bins of -log10 p.
Q, REJECT, BIN, MOST = 0.05, 0.001, 0.05, 16.0
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,match:string>>"


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(values: Column, base: Column) -> Column:
    """base, and base with each value but the last added in turn. Each step copies what it has so far."""
    start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def sums_before(values: Column) -> Column:
    """For each of an array of longs the sum of those before it, in parts of about the root of their number: the time
    grows with its power 1.5 where a single fold, which copies its result at each step, takes the square."""

    def in_parts(v: Column) -> Column:
        step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
        last = F.greatest(F.ceil(F.size(v) / step).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * step + 1, step))
        zero = F.lit(0).cast("long")
        return _let(parts, lambda p: F.flatten(F.zip_with(p, _sums(F.transform(p, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero), _sums)))

    return _let(values, in_parts)


def _found(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, kind, end, match), in code points, end exclusive.

    The places come from the gaps that a split by the same pattern leaves.
    """
    pattern, rank = F.lit(_FOUND[kind]), ORDER[kind]
    parts = lambda group: F.regexp_extract_all(text, pattern, F.lit(group))
    # The split has a part more than there are matches: zipped, the last has none.
    pairs = F.zip_with(F.split(text, _FOUND[kind], -1), parts(0), lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("match"), F.length(m).cast("long").alias("size")))

    def placed(z: Column) -> Column:
        starts = sums_before(F.transform(z, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))))
        out = F.zip_with(z, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("match")))
        if kind != "assign":
            return F.filter(out, lambda x: x["match"].isNotNull())
        enough = F.transform(parts(2), lambda v: F.length(v) >= 6)
        both = F.zip_with(out, enough, lambda x, e: F.struct(x.alias("span"), e.alias("holds")))
        return F.transform(F.filter(both, lambda x: x["holds"]), lambda x: x["span"])

    return _let(pairs, placed)


def spans_of(text: Column, kind: str, may: Column | None = None) -> Column:
    """The matches of a kind; may: whether there can be one, as far as is known without looking."""
    may = _may(text)[kind == "assign"] if may is None else may
    if kind in _MAY:
        may = may & text.rlike(_MAY[kind])
    return F.coalesce(F.when(may, _found(text, kind)), F.array().cast(_SPAN))


def _may(text: Column) -> tuple[Column, Column]:
    """Whether the text has a run of 20 symbols, which all kinds but assignments need, and a word of assignments."""
    small, words = F.lower(text), F.lit(False)
    for word in _WORDS:
        words = words | F.contains(small, F.lit(word))
    return text.rlike(_RUN), words


#: A Chebyshev fit of the complementary error function, of a relative error below 1.2e-7 everywhere, so that
#: far tails, which the false-discovery rule compares, are right too.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _normal_below(z: Column) -> Column:
    """The normal distribution function."""

    def half_erfc(x: Column) -> Column:
        def fitted(t: Column) -> Column:
            total = F.lit(_ERFC[-1])
            for c in reversed(_ERFC[:-1]):
                total = total * t + c
            return t * F.exp(total - x * x) / 2

        return _let(1 / (1 + F.abs(x) / 2), fitted)

    return _let(-z / F.lit(2**0.5), lambda x: F.when(x >= 0, half_erfc(x)).otherwise(1 - half_erfc(x)))


_ALPHABET64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _changes(values: Column) -> Column:
    """How often one value differs from that before it."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: a != b)
    return F.size(F.filter(pairs, lambda x: x)).cast("double")


def battery(match: Column) -> Column:
    """-log10 of the p value that the match is text; null if its encoding isn't inferred, 0 if a test rejects randomness.

    What later tests use is bound by _let, each value computed once for a match.
    """
    return _let(F.rtrim(match, F.lit("=")), lambda body: _let(_encoding(body), lambda e: F.when(e["size"].isNotNull(), _let(_symbols(body, e), lambda s: _judged(s, e)))))


def _encoding(body: Column) -> Column:
    """Alphabet size (null: none inferred), the index of coincidence of text in it, the alphabet, and which it is."""
    hexa = body.rlike("^([0-9a-f]++|[0-9A-F]++)$") & body.rlike("[0-9]") & body.rlike("[a-fA-F]")
    base32 = body.rlike("^[A-Z2-7]++$") & body.rlike("[2-7]") & body.rlike("[A-Z]")
    base36 = body.rlike("^([0-9a-z]++|[0-9A-Z]++)$") & body.rlike("[0-9]") & body.rlike("[a-zA-Z]")
    base64 = body.rlike("[A-Z]") & body.rlike("[a-z]") & body.rlike("[0-9]")
    made = lambda size, alike, alphabet, kind: F.struct(F.lit(float(size)).alias("size"), F.lit(alike).alias("alike"), F.lit(alphabet).alias("alphabet"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("struct<size:double,alike:double,alphabet:string,kind:string>")
    small = "0123456789abcdefghijklmnopqrstuvwxyz"
    found = F.when(hexa, made(16, 0.10, small[:16], "hex")).when(base32, made(32, 0.066, _ALPHABET64[:26] + "234567", "base32"))
    return found.when(base36, made(36, 0.066, small, "base36")).when(base64, made(64, 0.060, _ALPHABET64, "base64")).otherwise(none)


def _symbols(body: Column, e: Column) -> Column:
    """n, the marks, their values in the alphabet and their classes (capitals, small letters, digits, others)."""
    case_blind = e["kind"].isin("hex", "base36")
    marks = F.split(F.translate(F.when(case_blind, F.lower(body)).otherwise(body), "-_", "+/"), "")
    classes = F.split(F.translate(F.translate(body, "-_", "+/"), _ALPHABET64, "A" * 26 + "a" * 26 + "0" * 10 + "++"), "")
    values = lambda m: F.transform(m, lambda c: F.instr(e["alphabet"], c).cast("double") - 1)
    return _let(marks, lambda m: F.struct(F.length(body).cast("double").alias("n"), m.alias("marks"), values(m).alias("values"), classes.alias("classes")))


def _judged(s: Column, e: Column) -> Column:
    n, size, marks, values, classes = s["n"], e["size"], s["marks"], s["values"], s["classes"]
    base64, base36 = e["kind"] == "base64", e["kind"] == "base36"
    # Chi-squared uniformity over the alphabet; as coincidences of pairs, against those of text.
    squares = F.aggregate(F.array_distinct(marks), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(marks, lambda x: x == c)).cast("double"), F.lit(2.0)))
    chi2 = size / n * squares - n
    mean = n * (n - 1) / 2 * e["alike"]
    coincidences = (n / size * (chi2 + n) - n) / 2
    evidence = F.least(-F.log10(F.greatest(_normal_below((coincidences + 0.5 - mean) / F.sqrt(mean)), F.lit(1e-16))), F.lit(MOST))

    # Runs above and below the middle of the alphabet.
    def by_runs(high: Column) -> Column:
        n1 = F.size(F.filter(high, lambda x: x)).cast("double")
        run_mean = 1 + 2 * n1 * (n - n1) / n
        run_var = (run_mean - 1) * (run_mean - 2) / F.greatest(n - 1, F.lit(1.0))
        return F.when(run_var > 0, 2 * _normal_below(-F.abs((_changes(high) + 1.0 - run_mean) / F.sqrt(run_var)))).otherwise(0.0)

    runs = _let(F.transform(values, lambda v: v >= size / 2), by_runs)
    # Text stays within a class longer than even shares of the alphabet would.
    few_changes = lambda p: _normal_below((_changes(classes) - p * (n - 1)) / F.sqrt((n - 1) * p * (1 - p)))
    class_runs = F.when(base64, few_changes(1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2)).when(base36, few_changes(1 - (26**2 + 10**2) / 36**2)).otherwise(1.0)

    # Chi-squared over the classes, by Wilson and Hilferty's cube root.
    def surprise(symbol: str, share: float) -> Column:
        return F.pow(F.size(F.filter(classes, lambda x: x == symbol)) - share * n, F.lit(2.0)) / (share * n)

    uneven = (F.pow((surprise("A", 26 / 64) + surprise("a", 26 / 64) + surprise("0", 10 / 64) + surprise("+", 2 / 64)) / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5
    digits = F.size(F.filter(classes, lambda x: x == "0")) - 10 / 36 * n  # more or fewer than even shares give
    uneven36 = (F.pow(digits * digits / (n * 10 / 36 * 26 / 36), F.lit(1 / 3)) - (1 - 2 / 9)) / (2 / 9) ** 0.5
    class_shares = F.when(base64, _normal_below(-uneven)).when(base36, _normal_below(-uneven36)).otherwise(1.0)

    # Serial correlation.
    def by_lag(around: Column) -> Column:
        spread = F.aggregate(around, F.lit(0.0), lambda a, v: a + v * v)
        lagged = F.aggregate(F.zip_with(F.slice(around, 1, F.size(around) - 1), F.slice(around, 2, F.size(around)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.when(spread > 0, 2 * _normal_below(-F.abs((lagged / spread + 1 / n) * F.sqrt(n)))).otherwise(0.0)

    average = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    serial = _let(_let(average, lambda m: F.transform(values, lambda v: v - m)), by_lag)
    return F.when((runs >= REJECT) & (class_runs >= REJECT) & (class_shares >= REJECT) & (serial >= REJECT), evidence).otherwise(0.0)


def _length_class(match: Column) -> Column:
    out = F.lit(0)
    for k in LENGTH_CLASSES[1:]:
        out = out + (F.length(match) >= k).cast("int")
    return out


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def scanned(docs: DataFrame, kept: list[str]) -> DataFrame:
    """A row for each of docs, by one scan of the texts: row (the kept columns), base (spans of the patterns, by start,
    then kind) and tested (candidates of the battery with bin of evidence and length class)."""
    text = F.col("_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_of().alias("_text"))
    run, words = _may(text)
    rows = rows.select("row", "_text", run.alias("_run"), words.alias("_words"))
    base = F.concat(*(_plain(spans_of(text, kind, F.col("_words" if kind == "assign" else "_run"))) for kind, *_ in KINDS))
    candidate = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.floor(battery(s["match"]) / BIN).cast("int").alias("bin"), _length_class(s["match"]).alias("length_class"))
    return rows.select("row", F.array_sort(base).alias("base"), F.transform(spans_of(text, "random", F.col("_run")), candidate).alias("tested"))


def thresholds(found: DataFrame) -> dict[int, int]:
    """For each length class the least bin of evidence that is a discovery, by Benjamini-Hochberg over all candidates
    (column tested) of all rows.

    What is gathered is a table of length classes by bins, a few thousand counts at most however many there are.
    """
    tested = found.select(F.explode("tested").alias("s")).where("s.bin is not null").groupBy("s.length_class", "s.bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.col("bin").desc())
    ranked = tested.withColumn("k", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("length_class")))
    kept = ranked.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") * BIN) <= Q * F.col("k") / F.col("m")))
    return {r["length_class"]: r["bin"] for r in kept.groupBy("length_class").agg(F.min("bin").alias("bin")).collect()}


def _spans(docs: DataFrame, kept: list[str]) -> DataFrame:
    """row, base and every, spans as (start, rank, kind, end): those of the patterns, and with the battery's too.

    The texts are scanned once: row and candidates are written, the thresholds read them, and so does the result.
    """
    found = written(scanned(docs, kept), "secret-candidates")
    least = thresholds(found)

    def discovered(s):
        enough = F.lit(False)
        for k, bin_ in least.items():
            enough = enough | ((s["length_class"] == k) & F.coalesce(s["bin"] >= bin_, F.lit(False)))
        return enough & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return found.select("row", "base", F.array_sort(F.concat("base", _plain(F.filter("tested", discovered)))).alias("every"))


def find(docs: DataFrame) -> DataFrame:
    """docs with base_spans and all_spans, arrays of (start, rank, kind, end) by start, then kind: spans of the patterns,
    and with the battery's too.

    A random span that overlaps a span of a pattern isn't added. A null text is empty and has none; rows and columns
    stay, whatever the columns' names (but for these two, which are replaced). One scan of the texts, no shuffle but
    of the thresholds' counts. Time grows with a text's length, and with the power 1.5 of its number of spans.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "all_spans")]
    return _spans(docs, kept).select("row.*", F.col("base").alias("base_spans"), F.col("every").alias("all_spans"))


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: how many spans of each pattern, a hash of their list, and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return _spans(docs, ["doc_id"]).select(
        "row.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("every")).alias("spans"),
    )


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with spans (start, rank, end) replaced by mark, overlapping ones by one, block by block: a block looks only
    at the spans that reach into it."""

    def block(part: Column, k: Column) -> Column:
        begin = (k * BLOCK).cast("long")
        end = begin + BLOCK

        def put(own: Column) -> Column:
            def step(acc, s):
                under = F.exists(own, lambda o: (o["end"] > s["start"]) & ((o["start"] < s["start"]) | (o["start"] == s["start"]) & (o["rank"] < s["rank"])))
                gap = F.substring(part, (acc["at"] - begin + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
                shown = F.when((s["start"] >= begin) & ~under, F.lit(mark)).otherwise("")
                return F.struct(F.greatest(acc["at"], F.least(s["end"], end)).alias("at"), F.concat(acc["out"], gap, shown).alias("out"))

            first = F.struct(begin.alias("at"), F.lit("").alias("out"))
            return F.aggregate(own, first, step, lambda acc: F.concat(acc["out"], F.substring(part, (acc["at"] - begin + 1).cast("int"), F.lit(BLOCK))))

        return _let(F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin)), lambda own: F.when(F.size(own) > 0, put(own)).otherwise(part))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(blocks, block), "")).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark, overlapping ones by one, and n_chars, where there is one, as long as
    the text then is. All rows and columns stay, whatever the columns' names; a null text stays null."""
    name = next(c for c in docs.columns if c.lower() == "text")
    text, columns = masked(F.col(f"row.`{name}`"), F.col("every"), mark), docs.columns
    out = _spans(docs, columns).select("row", "every", text.alias("masked"))
    put = {name: F.col("masked")}
    for c in columns:
        if c.lower() == "n_chars":
            put[c] = F.when(F.size("every") > 0, F.length("masked").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`"))
    return out.select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
