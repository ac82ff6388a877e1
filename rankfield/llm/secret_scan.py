"""Secrets in texts: fixed patterns, and runs of characters that pass for random.

Only DataFrame functions are used. Patterns are cut out of a text with ``split`` and
``regexp_extract_all`` (equal leftmost non-overlapping matches), and positions are sums of the
lengths between them, in code points.

A candidate is a maximal run of 20 or more characters of an encoded key. Its encoding (hex,
base 32 and base 36 of either case, letters of both, letters and digits, base 64) is the smallest
alphabet that holds its characters; hex with dashes is taken without them. Runs of letters of one
case alone are words and are not tested; runs of digits alone are base spans of kind ``hex``. A run
undergoes three tests of characters drawn uniformly from its alphabet: chi-squared uniformity over 8
classes of the alphabet, the number of runs above and below the alphabet's middle, and the serial
correlation of neighbouring characters. The smallest of the three p-values, taken as one of three
independent ones (1 - (1 - p)^3), is the run's score; keys have scores spread evenly over (0, 1].

False-discovery control: the null hypothesis is that a run is no key but an identifier. Its scores
come from a reference that does not depend on the table: names put together from common words,
abbreviations and numbers in the usual styles, and for hex from dates, counters and repeated fields,
``REFERENCE`` for each stratum (encoding and length), scored by the same tests. Runs of the table
that are full of the letter pairs of prose are known to be no keys and join them; hex is no prose. A
run's p-value is the share of null runs of its stratum with its score or a higher one, and the
Benjamini-Hochberg procedure on the other runs of the stratum gives the smallest score whose expected
share of false discoveries is within the level; how many of these are no keys is taken from those with
p-values above one half (Storey's estimate), of which keys have hardly any. Short runs, where the tests have less power, thereby
get stricter thresholds. Scores are counted by cells of their range, then ranked within a cell, so
p-values are exact and no stratum meets in one task; the driver gets one threshold for each stratum.
A level below about 1 / ``REFERENCE`` needs null runs of the table's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.llm.tables import staged

#: Base kinds in the order of the contract, as (kind, pattern, least length, group it applies to).
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = [("assign", ASSIGN, 12), ("access", "AKIA[A-Z0-9]{14,}", 18), ("hex", "[0-9a-f]{16,}", 16)]
KINDS = [kind for kind, *_ in BASE] + ["random"]

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: Encodings, smallest alphabet first; characters in the alphabet's order. The last one also stands for its URL form.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("upper_hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower_base32", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper_base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: The first of them are hex.
HEX_ENCODINGS = 2
#: Hex in groups joined by dashes, and the fewest digits of it that are tested.
DASHED_HEX, LEAST_DASHED = "^([0-9a-f]+(-[0-9a-f]+)+|[0-9A-F]+(-[0-9A-F]+)+)$", 16
CLASSES = 8
#: Length strata begin here.
STRATA = [20, 24, 32, 40, 64, 128]
#: No run with a lower score is called random; of keys, one in 200 has one.
LEAST_SCORE = 0.005
#: Cells of the range of scores, within which runs are ranked.
CELLS = 1024
#: Reference runs of each stratum.
REFERENCE = 256
#: Words of names that are no keys: the first ``FULL`` written out, the others short forms.
FULL = 41
WORDS = (
    "account action active array batch block branch buffer button cache client column config content context counter cursor customer default device "
    "document element entry event factory field filter handler header image index input invoice item language layer list manager message metadata method "
    "abs api arg attr auth bg blk btn buf bytes cb cfg char cnt conv cpu csv ctx db dbl dev dict diff dst env fmt fn gpu hdr html http hw idx img init "
    "int io ip jpg js json jwt kb key kv len lhs lib ln lvl max md mgr min msg mtx mux nav num obj pct phy pkg pkt pos ptr px qty ref reg req rhs rpc rx "
    "sql src sys tbl tcp tls tmp tx txt udp uid ui url usb utf util val vec vm ws xhr xls xml yaml zip"
).split()
#: Fields of hex that is no key.
HEX_FIELDS = "00000000 FFFFFFFF DEADBEEF CAFEBABE C0DE F00D FACE 12345678 ABCDEF 55AA A5A5A5A5 0001".split()
#: Frequent letter pairs of prose.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur co me li ri ro ic ne io ct la el us ge".split()
#: A run is full of them when they are this share of at least so many pairs of letters; a random run is so less than once in a thousand times.
PAIR_SHARE, LEAST_PAIRS = 0.3, 8
#: Matches whose positions are summed up together; keeps prefix sums from being quadratic in the matches.
BLOCK = 64
#: Code points of a chunk of a text that is cut up.
CHUNK = 4096
SPAN = "struct<start:int,kind:int,end:int>"


def _let(value: F.Column, body) -> F.Column:
    """``body`` of one evaluation of ``value``: names inside higher-order functions are evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(values: F.Column, fold, least: int) -> F.Column:
    """For each value ``fold`` (a sum or a maximum) of the values before it, in blocks, so that long arrays are not quadratic."""

    def placed(values: F.Column) -> F.Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), F.lit(least)))
        bases = F.aggregate(blocks, F.array(F.lit(least)), lambda done, x: F.concat(done, F.array(fold(F.array(x), F.element_at(done, -1)))))

        def before(bases: F.Column) -> F.Column:
            number = lambda i: F.floor(i / BLOCK).cast("int")
            return F.transform(values, lambda _, i: fold(F.slice(values, number(i) * BLOCK + 1, i % BLOCK), F.get(bases, number(i))))

        return _let(bases, before)

    return F.when(F.size(values) > 0, _let(values, placed)).otherwise(F.array().cast("array<int>"))


def _sum(values: F.Column, start: F.Column) -> F.Column:
    return F.aggregate(values, start, lambda s, x: s + x)


def _largest(values: F.Column, start: F.Column) -> F.Column:
    return F.aggregate(values, start, lambda s, x: F.greatest(s, x))


def _starts(gaps: F.Column, lengths: F.Column) -> F.Column:
    """Start of each match from the lengths of the matches and of the text before each."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda a, b: a + b)
    return F.transform(_running(steps, _sum, 0), lambda before, i: before + F.get(gaps, i))


def _matches(text: F.Column, pattern: str, extra: list[int]) -> F.Column:
    """Array of structs (start, end, hit, g<group>...) of the leftmost non-overlapping matches, in code points."""
    fields = "".join(f",g{n}:string" for n in extra)
    none = F.array().cast(f"array<struct<start:int,end:int,hit:string{fields}>>")

    def located(found: F.Column) -> F.Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        lengths = F.transform(found["hits"], lambda x: F.char_length(x))

        def zipped(both: F.Column) -> F.Column:
            starts = _starts(both["gaps"], both["lengths"])
            return _let(
                starts,
                lambda starts: F.transform(
                    found["hits"],
                    lambda hit, i: F.struct(
                        F.get(starts, i).cast("int").alias("start"),
                        (F.get(starts, i) + F.get(both["lengths"], i)).cast("int").alias("end"),
                        hit.alias("hit"),
                        *[F.get(found[f"g{n}"], i).alias(f"g{n}") for n in extra],
                    ),
                ),
            )

        return F.when(F.size(found["hits"]) > 0, _let(F.struct(gaps.alias("gaps"), lengths.alias("lengths")), zipped)).otherwise(none)

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(n)).alias(f"g{n}") for n in extra],
    )
    return _let(found, located)


def _base_spans(text: F.Column) -> F.Column:
    """The spans of the fixed patterns, by start, then kind."""
    def spans_of(number: int, kind: str, pattern: str, least: int) -> F.Column:
        extra = [2] if kind == "assign" else []
        value = "g2" if extra else "hit"
        kept = F.filter(_matches(text, pattern, extra), lambda m: F.char_length(m[value]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"], F.lit(number).alias("kind"), m["end"]))

    spans = [spans_of(number, *rule) for number, rule in enumerate(BASE)]
    return F.array_sort(F.concat(*[s.cast(f"array<{SPAN}>") for s in spans]))


def _upper_tail(z: F.Column) -> F.Column:
    """1 - the normal distribution function, by its logistic approximation (error below 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _encoding(hit: F.Column) -> F.Column:
    """Index into ENCODINGS of the smallest alphabet, -1 where the run has no letters or only letters of one case."""
    url = F.translate(hit, "-_", "+/")
    found = F.lit(-1)
    for number, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        found = F.when(F.translate(url, alphabet, "") == "", F.lit(number)).otherwise(found)
    mixed = (hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")) | (hit.rlike("[a-z]") & hit.rlike("[A-Z]"))
    return F.when(mixed, found).otherwise(F.lit(-1))


def _bare(hit: F.Column) -> F.Column:
    """The characters to be tested: those of hex with dashes without the dashes."""
    dashless = F.translate(hit, "-", "")
    return F.when(hit.rlike(DASHED_HEX) & hit.rlike("[A-Fa-f]") & (F.char_length(dashless) >= LEAST_DASHED), dashless).otherwise(hit)


def _p_value(hit: F.Column, encoding: F.Column) -> F.Column:
    """The score of the three tests for uniform randomness, for a run with an encoding."""
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    shares = [[sum(c * CLASSES // len(a) == k for c in range(len(a))) / len(a) for k in range(CLASSES)] for _, a in ENCODINGS]
    shares_of = F.array(*[F.array(*[F.lit(x) for x in row]) for row in shares])

    def measured(s: F.Column) -> F.Column:
        """What the tests read more than once: neighbours, the mean, and the share above the middle."""
        codes, n = s["codes"], F.size(s["codes"]).cast("double")
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = F.aggregate(codes, F.lit(0.0), lambda t, c: t + c) / n
        high = F.size(F.filter(codes, lambda c: 2 * c >= s["size"])) / n
        return F.struct(codes.alias("codes"), s["size"].alias("size"), s["share"].alias("share"), n.alias("n"), pairs.alias("pairs"), middle.alias("middle"), high.alias("high"))

    def tested(s: F.Column) -> F.Column:
        codes, size, share, n, pairs, middle, high = (s[c] for c in ("codes", "size", "share", "n", "pairs", "middle", "high"))
        counts = F.transform(share, lambda p, k: F.size(F.filter(codes, lambda c: F.floor(c * CLASSES / size) == k)) / n)
        chi = n * F.aggregate(F.zip_with(counts, share, lambda o, e: (o - e) * (o - e) / e), F.lit(0.0), lambda t, x: t + x)
        df = CLASSES - 1
        uniform = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.lit((2 / (9 * df)) ** 0.5))

        runs = 1 + F.size(F.filter(pairs, lambda p: (2 * p["a"] >= size) != (2 * p["b"] >= size)))
        mean_less_one = 2 * n * high * (1 - high)
        variance = mean_less_one * (mean_less_one - 1) / (n - 1)
        runs_p = F.when(variance > 0, 2 * _upper_tail(F.abs(runs - 1 - mean_less_one) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(0.0)

        spread = F.aggregate(codes, F.lit(0.0), lambda t, c: t + (c - middle) * (c - middle))
        product = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["a"] - middle) * (p["b"] - middle))
        serial_p = F.when(spread > 0, 2 * _upper_tail(F.abs(product / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(0.0)
        least = F.least(uniform, runs_p, serial_p)
        return 1 - F.pow(1 - F.greatest(F.least(least, F.lit(1.0)), F.lit(0.0)), F.lit(3.0))

    alphabet = F.get(alphabets, encoding)
    codes = F.transform(F.split(F.translate(hit, "-_", "+/"), ""), lambda c: F.call_function("locate", c, alphabet) - 1)
    known = F.struct(codes.alias("codes"), F.char_length(alphabet).alias("size"), F.get(shares_of, encoding).alias("share"))
    return _let(_let(known, measured), tested)


def _word_like(hit: F.Column) -> F.Column:
    """Whether the run is full of the letter pairs of prose."""
    said = F.lower(hit)
    pairs = F.regexp_count(said, F.lit("(?=[a-z]{2})"))
    frequent = F.regexp_count(said, F.lit(f"(?={'|'.join(PAIRS)})"))
    return (pairs >= LEAST_PAIRS) & (frequent >= PAIR_SHARE * pairs)


def _scored(found: F.Column, *places: F.Column) -> F.Column:
    """Struct (places, encoding, stratum, word_like, p) of a run."""

    def judged(run: F.Column) -> F.Column:
        n = F.char_length(run["hit"])
        stratum = sum((F.when(n >= least, 1).otherwise(0) for least in STRATA[1:]), F.lit(0))
        return F.struct(
            *places,
            run["encoding"].alias("encoding"),
            stratum.alias("stratum"),
            ((run["encoding"] >= HEX_ENCODINGS) & _word_like(run["hit"])).alias("word_like"),
            F.when(run["encoding"] >= 0, _p_value(run["hit"], run["encoding"])).otherwise(F.lit(-1.0)).alias("p"),
        )

    return _let(_let(_bare(found), lambda hit: F.struct(hit.alias("hit"), _encoding(hit).alias("encoding"))), judged)


def _candidates(text: F.Column) -> F.Column:
    """Array of structs (start, end, encoding, stratum, word_like, p) of the runs that have an encoding."""

    def tested(m: F.Column) -> F.Column:
        return _scored(m["hit"], m["start"].alias("start"), m["end"].alias("end"))

    return F.filter(F.transform(_matches(text, CANDIDATE, []), tested), lambda c: c["encoding"] >= 0)


def reference_runs(spark: SparkSession) -> DataFrame:
    """(encoding, stratum, p) of REFERENCE names or hex fields for each encoding and length; always the same."""
    n = len(STRATA)
    rows = spark.range(len(ENCODINGS) * n * REFERENCE).select(
        "id", F.expr(f"cast(id % {len(ENCODINGS)} as int)").alias("style"), F.expr(f"cast(id div {len(ENCODINGS)} % {n} as int)").alias("band")
    )

    def drawn(i: F.Column | int, below: F.Column | int) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(i) if isinstance(i, int) else i), F.lit(below) if isinstance(below, int) else below).cast("int")

    least = F.array(*map(F.lit, STRATA))
    span = F.array(*(F.lit(b - a) for a, b in zip(STRATA, [*STRATA[1:], 2 * STRATA[-1]], strict=True)))
    length = F.get(least, F.col("band")) + drawn(-1, F.get(span, F.col("band")))
    places = F.sequence(F.lit(0), F.floor(F.col("length") / 3).cast("int") + 2)
    number = lambda i: drawn(i + 10_000, 1000).cast("string")
    # One word in four is a short form; a number comes second and seldom again.
    short = lambda i: F.get(F.array(*map(F.lit, WORDS[FULL:])), drawn(i, len(WORDS) - FULL))
    word = lambda i: F.when(drawn(i + 50_000, 4) == 0, short(i)).otherwise(F.get(F.array(*map(F.lit, WORDS[:FULL])), drawn(i, FULL)))
    numbered = lambda i: (i == 1) | (drawn(i + 20_000, 10) == 0)
    item = lambda i: F.when(numbered(i), number(i)).otherwise(word(i))
    base32 = lambda i: F.when(numbered(i), F.translate(number(i), "0189", "2345")).otherwise(word(i))
    field = lambda i: (
        F.when(drawn(i + 30_000, 3) == 0, F.lpad(F.hex(drawn(i, 4096)), 8, "0"))
        .when(drawn(i + 30_000, 3) == 1, F.concat(F.lit("20"), F.lpad(drawn(i, 30).cast("string"), 2, "0"), F.lpad((drawn(i + 40_000, 12) + 1).cast("string"), 2, "0"), F.lit("15")))
        .otherwise(F.get(F.array(*map(F.lit, HEX_FIELDS)), drawn(i, len(HEX_FIELDS))))
    )
    joined = lambda items, mark="": F.array_join(F.transform(places, items), mark)
    camel = lambda of: lambda i: F.when(i == 0, of(i)).otherwise(F.initcap(of(i)))
    mark = F.get(F.array(F.lit("_"), F.lit("-"), F.lit("/")), drawn(-2, 3))
    styles = {
        "hex": F.lower(joined(field)),
        "upper_hex": joined(field),
        "base32": F.upper(joined(base32)),
        "lower_base32": joined(base32),
        "base36": joined(item),
        "upper_base36": F.upper(joined(item)),
        "letters": joined(camel(word)),
        "alnum": joined(camel(item)),
        "base64": F.array_join(F.transform(places, lambda i: F.concat(F.when(i > 0, mark).otherwise(""), item(i))), ""),
    }
    made = reduce(lambda rest, number: F.when(F.col("style") == number, styles[ENCODINGS[number][0]]).otherwise(rest), range(len(ENCODINGS)), F.lit(""))
    named = rows.withColumn("length", length).select(F.explode(F.array(F.substring(made, F.lit(1), F.col("length")))).alias("name"))  # evaluated once
    return named.select(F.explode(F.array(_scored(F.col("name")))).alias("c")).filter("c.encoding >= 0").select("c.encoding", "c.stratum", "c.p")


def thresholds(runs: DataFrame, level: float) -> dict[tuple[int, int], float]:
    """The least score of a run that is not word-like and counts as random, by (encoding, stratum); strata where none serves are missing.

    ``runs`` has a row for each run, as the struct ``c``. Runs of one score are counted together first.
    """
    names, cell, own = ["encoding", "stratum"], F.floor(F.col("p") * CELLS).alias("cell"), F.col("c.word_like").cast("long")
    both = runs.select("c.encoding", "c.stratum", "c.p", own.alias("null"), (1 - own).alias("tested")).union(
        reference_runs(runs.sparkSession).persist().select(*names, "p", F.lit(1).cast("long"), F.lit(0).cast("long"))  # some thousand rows, kept for the session
    )
    scores = both.groupBy(*names, "p").agg(F.sum("null").alias("null"), F.sum("tested").alias("tested")).withColumn("cell", cell)
    cells = scores.groupBy(*names, "cell").agg(F.sum("null").alias("cell_null"), F.sum("tested").alias("cell_tested"))  # at most CELLS a stratum
    whole, higher = Window.partitionBy(*names), Window.partitionBy(*names).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    based = cells.select(
        *names,
        "cell",
        *(F.sum(f"cell_{c}").over(whole).alias(f"all_{c}") for c in ("null", "tested")),
        *(F.coalesce(F.sum(f"cell_{c}").over(higher), F.lit(0)).alias(f"above_{c}") for c in ("null", "tested")),
    )
    inside = Window.partitionBy(*names, "cell").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nulls, found = (F.col(f"above_{c}") + F.sum(c).over(inside) for c in ("null", "tested"))
    ranked = scores.join(based, [*names, "cell"]).select(*names, "p", "tested", "all_null", "all_tested", nulls.alias("nulls"), found.alias("found"))
    ranked = ranked.withColumn("chance", (1 + F.col("nulls")) / (1 + F.col("all_null")))
    unlike = ranked.groupBy(*names).agg(F.sum(F.when(F.col("chance") > 0.5, F.col("tested")).otherwise(0)).alias("unlike"))  # a row for each stratum
    ranked = ranked.join(F.broadcast(unlike), names)
    names_among = F.least("all_tested", 2 * (F.col("unlike") + 1))
    within = names_among * F.col("chance") <= level * F.col("found")
    kept = ranked.filter((F.col("p") >= LEAST_SCORE) & (F.col("found") > 0) & within).groupBy(*names).agg(F.min("p").alias("least"))
    return {(row["encoding"], row["stratum"]): row["least"] for row in kept.collect()}  # encodings times strata at most


def _searched(docs: DataFrame, level: float) -> DataFrame:
    """``docs``, which have a text, with ``secrets``; texts are searched once and the rows staged with what was found."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _judged(staged(docs.withColumn("secrets", F.struct(_base_spans(text).alias("base"), _candidates(text).alias("runs"))), "searched"), level)


def _judged(searched: DataFrame, level: float) -> DataFrame:
    limits = thresholds(searched.select(F.explode("secrets.runs").alias("c")), level)
    base = F.col("secrets.base")
    if not limits:
        return searched.withColumn("secrets", base)
    passes = reduce(
        lambda rest, item: lambda c: ((c["encoding"] == item[0][0]) & (c["stratum"] == item[0][1]) & (c["p"] >= item[1])) | rest(c),
        sorted(limits.items()),
        lambda c: F.lit(False),
    )
    clear = F.filter("secrets.runs", lambda c: ~c["word_like"] & passes(c))
    extra = F.transform(clear, lambda c: F.struct(c["start"], F.lit(KINDS.index("random")).alias("kind"), c["end"]).cast(SPAN))
    return searched.withColumn("secrets", F.array_sort(F.concat(base, extra)))


def find_secrets(docs: DataFrame, level: float = 0.1) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind, end), by start, then kind; kind indexes KINDS.

    Offsets are code points of the whole text, ends exclusive. A run may be found by a base rule and
    by the method, and then has a span of each. Null and empty texts have no spans; repeated rows get
    equal spans; an empty table gives no rows; a column of ``docs`` named secrets is replaced.
    """
    return _searched(docs.drop("secrets"), level)


def secret_spans(docs: DataFrame, level: float = 0.1) -> DataFrame:
    """(doc_id, secrets) of every row of ``docs``, as ``find_secrets`` has them; texts are read once and not staged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", F.struct(_base_spans(text).alias("base"), _candidates(text).alias("runs")).alias("secrets"))
    return _judged(staged(found, "searched"), level)


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _piece(chunks: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """Code points start to end of a text that is given in chunks of CHUNK; only the chunks it lies in are touched."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    chunk = lambda n: F.coalesce(F.get(chunks, n), F.lit(""))
    inside = F.substr(chunk(first), start % CHUNK + 1, end - start)
    across = F.concat(
        F.substr(chunk(first), start % CHUNK + 1),
        F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substr(chunk(last), F.lit(1), end % CHUNK),
    )
    return F.when(first == last, inside).otherwise(across)


def _cut(text: F.Column, spans: F.Column, mark: str) -> F.Column:
    """The text with ``mark`` for every stretch covered by spans, in time linear in the text and its spans."""
    ends = _running(F.transform(spans, lambda s: s["end"]), _largest, 0)  # how far the spans before each reach

    def outer(s: F.Column) -> F.Column:
        opens = F.filter(F.zip_with(spans, s["reach"], lambda one, reach: F.struct(one["start"], reach.alias("reach"))), lambda x: x["start"] >= x["reach"])
        kept = F.transform(opens, lambda x: _piece(s["chunks"], x["reach"], x["start"]))
        tail = _piece(s["chunks"], F.array_max(F.transform(spans, lambda one: one["end"])), F.char_length(text))
        return F.array_join(F.concat(kept, F.array(tail)), mark)

    return _let(F.struct(ends.alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks")), outer)


def redact(docs: DataFrame, level: float = 0.1, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one.

    n_chars follows the new text where that column exists. Texts without secrets, nulls included,
    stay as they are; repeated rows stay; an empty table gives no rows; a column of ``docs`` named
    secrets stays, as all others do.
    """
    own = {c: f"_own_{n}" if c not in ("text", "n_chars") else c for n, c in enumerate(docs.columns)}
    found = _searched(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]), level)
    spans, text = F.col("secrets"), F.col("text")
    changed = F.size(spans) > 0
    new = {"text": F.when(changed, _cut(text, spans, mark)).otherwise(text)}
    cleaned = found.withColumns(new)
    if "n_chars" in own:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(name).alias(c) for c, name in own.items()])
