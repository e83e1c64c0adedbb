"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

Base spans come from three patterns.  Every other run of 20 or more token
characters is a candidate: its encoding is inferred from its alphabet, its
characters become symbol numbers, and three statistics are taken -

* chi-squared of the symbol counts against uniformity,
* the number of runs above and below the alphabet's middle,
* the serial correlation of neighbouring symbols.

The null hypothesis is ordinary text in that alphabet: a Markov chain over
classes of symbols (vowels, consonants, upper case, digits, signs).  The
evidence against it is the likelihood of uniform symbols over that of the
chain, times a weight of the three tests: POWER + 1 times their joint p-value
to that power, whose mean under uniform symbols is one.  So the mean of the
product under the chain is one as well, whatever the tests say, and its
inverse is a p-value of ordinary text (Markov's inequality): a token that is
unlike text but fails a test of randomness pays for it.  It goes through
Benjamini-Hochberg within strata of encoding and length, so short tokens,
which are many and say little, do not spend the error budget of long ones.

Only built-in DataFrame functions are used.  Matches become rows (of a few
numbers, or of one token), whose places are running sums of lengths, so work
is linear in a text.  The correction needs counts in p-value bins alone: one
aggregation to at most STRATA x BINS rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import materialise, null_to_empty

#: (kind, pattern, group whose length counts, least length), fixed by the query's contract
BASE = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of [0-9a-f]+ that reaches 24 is the same run
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: (encoding, pattern, alphabet), first fit wins
ENCODINGS = [
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("letters", r"^[a-z]+$", LOWER),
    ("base64", r"^[A-Za-z0-9+/]+=*$", LOWER.upper() + LOWER + "0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", LOWER.upper() + LOWER + "0123456789-_"),
]
#: Ordinary text: weights of letters (a mean of four languages, none under 0.3 %) and of digits (low ones lead numbers)
LETTERS = dict(zip(LOWER, (8.5, 1.5, 3, 4.2, 14, 1.3, 1.7, 3, 7.3, 0.5, 0.8, 4.6, 2.7, 7.7, 6.3, 2.6, 0.6, 6.8, 7, 7.2, 4, 1.3, 0.9, 0.3, 0.9, 0.6)))
DIGITS = dict(zip("0123456789", (22, 18, 14, 9, 8, 8, 6, 5, 5, 5)))
#: Class of the next symbol by class of the last: lower case, upper case, digit, sign
CASES = {"l": dict(l=0.87, u=0.06, d=0.03, s=0.04), "u": dict(l=0.45, u=0.45, d=0.05, s=0.05), "d": dict(l=0.15, u=0.10, d=0.70, s=0.05), "s": dict(l=0.60, u=0.20, d=0.15, s=0.05)}
#: The same where no lower case occurs, and for digits with the letters a to f
CAPITALS = {"u": dict(u=0.95, d=0.05), "d": dict(u=0.30, d=0.70)}
NIBBLES = {"l": dict(l=0.80, d=0.20), "d": dict(l=0.05, d=0.95)}
CHAINS = {"decimal": {"d": dict(d=1.0)}, "hex": NIBBLES, "base32": CAPITALS, "letters": {"l": dict(l=1.0)}, "base64": CASES, "base64url": CASES}
REPEATS = {"decimal": 0.15, "hex": 0.15}  # share of symbols that repeat the last one, beyond chance
VOWEL = {"v": 0.15, "c": 0.55, "": 0.40}  # share of vowels after a vowel, a consonant, no letter
POWER = 2  # of the battery's p-value in the evidence
LEAST_P = 1e-12  # of a single test
FALSE_RATE = 0.001
BINS = 2000  # of a tenth of a nat of -ln p


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the logistic approximation of the normal distribution."""
    bounded = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * bounded + 0.070565 * bounded * bounded * bounded))


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """array<struct(gap, hit, size)> of the leftmost non-overlapping matches, null without any.

    gap is the length of the text since the match before, size the length of
    the group.  The last element is the gap behind the last match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sizes.alias("size")))


def _placed(matches: DataFrame) -> DataFrame:
    """uid, kind_no, start, end, hit (null but for candidates) of base spans, and of candidates that overlap none.

    One shuffle by uid serves all windows; a text's matches are sorted there
    and streamed.  Code points, end exclusive.
    """
    rows = None
    for number, (_, _, _, least) in enumerate([*BASE, ("random", CANDIDATE, 0, 20)]):
        hit = F.col("m.hit") if number == len(BASE) else F.lit(None).cast("string")
        one = matches.select("uid", F.lit(number).alias("kind_no"), F.posexplode(f"k{number}").alias("place", "m")).filter("m.hit is not null")
        one = one.select("uid", "kind_no", "place", "m.gap", F.length("m.hit").alias("n"), (F.col("m.size") >= least).alias("long_enough"), hit.alias("hit"))
        rows = one if rows is None else rows.unionByName(one)
    by_kind = Window.partitionBy("uid", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("uid").withColumn("end", F.sum((F.col("gap") + F.col("n")).cast("long")).over(by_kind)).filter("long_enough")
    rows = rows.select("uid", "kind_no", (F.col("end") - F.col("n")).alias("start"), "end", "hit")
    is_base = F.col("kind_no") < len(BASE)
    upwards, downwards = Window.partitionBy("uid").orderBy("start", "kind_no"), Window.partitionBy("uid").orderBy(F.col("start").desc(), F.col("kind_no").desc())
    rows = rows.withColumn("reached", F.max(F.when(is_base, F.col("end"))).over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("next_base", F.min(F.when(is_base, F.col("start"))).over(downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next_base") >= F.col("end"), F.lit(True))
    return rows.filter(is_base | free).select("uid", "kind_no", "start", "end", "hit")


def _count(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_no"] == number)).cast("long")


def _ordinary(encoding: str, alphabet: str) -> tuple[list[int], list[float], list[float]]:
    """Class number of each symbol, share of each next class by last class (row after row), share of each symbol in its class."""

    def kind(c: str) -> str:
        case = "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s"
        return case + ("" if not c.isalpha() or encoding == "hex" else "v" if c.lower() in "aeiou" else "c")

    kinds = [kind(c) for c in alphabet]
    weights = [DIGITS.get(c, LETTERS.get(c.lower(), 1)) for c in alphabet]
    names = sorted(set(kinds))
    totals = {k: sum(w for w, x in zip(weights, kinds) if x == k) for k in names}

    def share(last: str, following: str) -> float:
        vowel = VOWEL[last[1:]]
        return CHAINS[encoding][last[0]][following[0]] * {"v": vowel, "c": 1 - vowel, "": 1.0}[following[1:]]

    return [names.index(k) for k in kinds], [share(a, b) for a in names for b in names], [w / totals[k] for w, k in zip(weights, kinds)]


def _battery(n: Column, k: Column, chi: Column, high: Column, runs: Column, joint: Column, spread: Column) -> list[Column]:
    """p-values of the three tests: Wilson-Hilferty for chi-squared, the normal limits of the other two."""
    df = k - 1
    z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    expected = 2 * high * (n - high) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, F.abs(runs - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(F.lit(8.0))
    z_serial = F.when(spread > 0, F.abs(joint / F.greatest(spread, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(8.0))
    return [F.greatest(p, F.lit(LEAST_P)) for p in (_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_serial))]


def _tested(candidates: DataFrame) -> DataFrame:
    """Candidates (uid, start, end, hit) with encoding, length stratum, p_chi, p_runs, p_serial, evidence and its bin.

    Counts and runs come from string functions; one fold over the symbols sums
    what depends on neighbours.
    """
    rows = candidates.withColumn("encoding", F.coalesce(*(F.when(F.col("hit").rlike(pattern), F.lit(name)) for name, pattern, _ in ENCODINGS))).filter("encoding is not null")
    which = lambda value: F.coalesce(*(F.when(F.col("encoding") == e[0], F.lit(value(e))) for e in ENCODINGS))
    rows = rows.withColumn("alphabet", which(lambda e: e[2])).withColumn("repeats", which(lambda e: REPEATS.get(e[0], 0.0)))
    for i, column in enumerate(("classes", "chain", "shares")):
        rows = rows.withColumn(column, which(lambda e: _ordinary(e[0], e[2])[i]))
    rows = rows.withColumn("bare", F.when(F.col("encoding") == "hex", F.lower("hit")).otherwise(F.regexp_replace("hit", "=+$", "")))
    rows = rows.withColumn("n", F.length("bare").cast("double")).withColumn("k", F.length("alphabet").cast("double")).filter("n >= 16")
    symbols = F.filter(F.split("alphabet", ""), lambda c: c != "")
    rows = rows.withColumn("counts", F.transform(symbols, lambda c: (F.col("n") - F.length(F.replace(F.col("bare"), c, F.lit("")))).cast("double")))
    halves = which(lambda e: "".join("01"[2 * i >= len(e[2])] for i in range(len(e[2]))))
    rows = rows.withColumn("halves", F.call_function("translate", F.col("bare"), F.col("alphabet"), halves))
    rows = rows.withColumn("codes", F.transform(F.filter(F.split("bare", ""), lambda c: c != ""), lambda c: (F.position(c, F.col("alphabet")) - 1)))
    number = lambda i: i.cast("double")
    place = F.sequence(F.lit(0), F.col("k").cast("int") - 1)
    weighed = lambda f: F.aggregate(F.zip_with("counts", place, lambda o, i: o * f(number(i))), F.lit(0.0), lambda t, x: t + x)
    rows = rows.withColumns({"total": weighed(lambda i: i), "squares": weighed(lambda i: i * i), "chi": F.aggregate("counts", F.lit(0.0), lambda t, o: t + o * o) * F.col("k") / F.col("n") - F.col("n")})
    rows = rows.withColumn("high", F.length(F.replace(F.col("halves"), F.lit("0"), F.lit(""))).cast("double"))
    rows = rows.withColumn("runs", F.length(F.regexp_replace(F.regexp_replace("halves", "0+", "0"), "1+", "1")).cast("double"))
    at = lambda column, where: F.get(F.col(column), where.cast("int"))
    width = F.sqrt(F.size("chain").cast("double"))

    def unlike(a: Column, b: Column) -> Column:
        """ln of the uniform share of symbol b over its share after a in ordinary text."""
        chained = at("chain", at("classes", a) * width + at("classes", b)) * at("shares", b)
        return -F.log(F.col("k") * (F.when(a == b, F.col("repeats")).otherwise(0.0) + (1 - F.col("repeats")) * chained))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("products"), F.lit(0.0).alias("unlike"))

    def step(s, c):
        first = s["last"] < 0
        return F.struct(c.alias("last"), F.when(first, 0.0).otherwise(s["products"] + s["last"] * number(c)).alias("products"), F.when(first, 0.0).otherwise(s["unlike"] + unlike(s["last"], c)).alias("unlike"))

    rows = rows.withColumn("pairs", F.aggregate("codes", start, step)).withColumn("mean", F.col("total") / F.col("n"))
    ends = F.get("codes", F.lit(0)) + F.element_at("codes", -1)
    joint = F.col("pairs.products") - F.col("mean") * (2 * F.col("total") - ends) + (F.col("n") - 1) * F.col("mean") * F.col("mean")
    spread = F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")
    names = ("p_chi", "p_runs", "p_serial")
    rows = rows.withColumns({"joint": joint, "spread": F.greatest(F.lit(0.0), spread)})
    rows = rows.withColumns(dict(zip(names, _battery(*map(F.col, ("n", "k", "chi", "high", "runs", "joint", "spread"))))))
    p = 3 / sum(1 / F.col(x) for x in names)  # harmonic mean
    rows = rows.withColumn("evidence", F.col("pairs.unlike") + F.log(F.lit(POWER + 1.0)) + POWER * F.log(p))
    rows = rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(10 * F.col("evidence")))).cast("int")).withColumn("stratum", F.floor(F.log2("n")).cast("int"))
    return rows.select("uid", "start", "end", "encoding", "stratum", *names, "evidence", "bin")


def thresholds(tested: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """Benjamini-Hochberg per encoding and length stratum, on bins: the smallest bin that is a discovery."""
    bins = tested.groupBy("encoding", "stratum", "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("encoding", "stratum")
    bins = bins.withColumn("at_least", F.sum("c").over(group.orderBy(F.col("bin").desc()))).withColumn("all", F.sum("c").over(group))
    return bins.filter(F.exp(-F.col("bin") / 10) <= false_rate * F.col("at_least") / F.col("all")).groupBy("encoding", "stratum").agg(F.min("bin").alias("from_bin"))


def scan(docs: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """doc_id, spans array<struct(start, end, kind_no, kind)> of every row of docs (doc_id, text).

    Sorted by start, then kind as listed, random last.  A random span overlaps
    no base span.  Null and empty texts have no spans; very long texts and
    tokens are read whole; repeated rows and null ids keep their rows; other
    columns are ignored.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), null_to_empty().alias("text"))
    matches = materialise(rows.select("doc_id", "uid", *(_pieces(F.col("text"), pattern, group).alias(f"k{i}") for i, (_, pattern, group, _) in enumerate([*BASE, ("random", CANDIDATE, 0, 20)]))), "matches")
    placed = materialise(_placed(matches), "placed")
    tested = materialise(_tested(placed.filter(F.col("kind_no") == len(BASE)).select("uid", "start", "end", "hit")), "tested")
    cut = thresholds(tested, false_rate)  # a row for an encoding and a power of two of length
    found = tested.join(F.broadcast(cut), ["encoding", "stratum"]).filter(F.col("bin") >= F.col("from_bin")).select("uid", F.lit(len(BASE)).alias("kind_no"), "start", "end")
    spans = placed.filter(F.col("kind_no") < len(BASE)).select("uid", "kind_no", "start", "end").unionByName(found)
    spans = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("s"))
    kinds = F.array(*(F.lit(k[0]) for k in BASE), F.lit("random"))
    ordered = F.transform(F.coalesce("s", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind_no"].alias("kind_no"), F.get(kinds, x["kind_no"]).alias("kind")))
    return matches.select("doc_id", "uid").join(spans, "uid", "left").select("doc_id", ordered.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    counts = [_count(i).alias(f"n_{kind[0]}") for i, kind in enumerate([*BASE, ("random",)])]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
