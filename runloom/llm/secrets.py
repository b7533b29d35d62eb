"""Secret scans in DataFrame functions only: fixed patterns, and a battery of randomness tests over long tokens.

Patterns give the base spans (kinds assign, access, hex). The battery looks at every other token of at least
``LEAST_TOKEN`` characters of ``[A-Za-z0-9+/_=-]``:

1. Encoding: the smallest alphabet that holds the token (10, 16, 26, 32, 36, 52 or 64 characters).
2. Tests: chi-squared of the alphabet's uniformity, runs (of character classes; of vowels and consonants where there are only
   letters), and the correlation of neighbours' places in the alphabet.
3. Each statistic is held against two hypotheses. Against a random token of the encoding: one that any test rejects at
   ``RANDOM_ALPHA`` isn't random. Against a written one (a word, a name, a number): ``WRITTEN`` has each statistic's mean
   for the encoding, and its deviation there grows with the token's length, so that a short token can't be found significant
   by luck. The three z-scores join into one p-value.
4. False-discovery control by length: the p-values of distinct tokens are counted in bins for each encoding and length
   class, and the Benjamini-Hochberg line of that class at ``FDR`` gives its cut. Counts are a bounded table.

Spans are in code points, end exclusive. Positions come from running sums over the gaps between matches, as rows: a text
with very many matches is no long array. Null text is the empty text: no spans. Rows that repeat a document each get its
result. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.shared import stored

#: Fixed patterns, in the order that kinds are listed; the least length is that of the whole match, for assign of group 2.
ASSIGN = "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?((?-i)[A-Za-z0-9+/_.=-]+)"
#: For these two the least length stands in the pattern: a match that is too short holds no longer one.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = {"assign": (ASSIGN, 12), "access": (ACCESS, 18), "hex": (HEX, 16)}
RANDOM = "random"
LEAST_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
#: A text without any of these has no span of any kind.
ANY = f"(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}|[A-Za-z0-9+/_=-]{{{LEAST_TOKEN}}}"
#: Written tokens by encoding: how often two characters are equal, the sum of cubed frequencies, how often the class changes
#: from one character to the next, and the neighbours' correlation.
WRITTEN = {
    "decimal": (0.12, 0.02, 0.12, 0.3),
    "hex": (0.1, 0.015, 0.12, 0.3),
    "letters": (0.065, 0.0055, 0.64, 0.0),
    "base32": (0.065, 0.0055, 0.2, 0.3),
    "base36": (0.065, 0.0055, 0.2, 0.3),
    "mixed": (0.065, 0.0055, 0.64, 0.0),
    "base64": (0.065, 0.0055, 0.3, 0.3),
}
#: Variance of the sum of the three z-scores of a written token.
JOINT_VARIANCE = 3.0
TESTS = ("uniform", "runs", "serial")
RANDOM_ALPHA, FDR = 1e-3, 0.01
#: Characters of the pieces that texts are redacted by.
PIECE = 4096
#: Bins of p-values per factor of ten, and their number.
BINS_A_DECADE, BINS = 10, 300
#: Alphabets by encoding, smallest first.
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "letters": ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "mixed": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal: the usual five-term polynomial in 1 / (1 + 0.2316419 |z|)."""

    def tail(v: Column) -> Column:
        poly = _let(1 / (1 + 0.2316419 * F.abs(v)), lambda t: reduce(lambda acc, c: (acc + c) * t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), F.lit(0.0)))
        return _let(F.exp(-v * v / 2) * 0.3989422804014327 * poly, lambda p: F.when(v >= 0, p).otherwise(1 - p))

    return _let(z, tail)


def _matches(kind: str, pattern: str) -> Column:
    """All matches of ``text`` in order: kind, pos, gap before, size, the size that is tested, token."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if kind == "assign" else found
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), found.alias("token"), tested.alias("tested"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(z["gap"]).alias("gap"), F.length(z["token"]).alias("size"), F.length(z["tested"]).alias("tested"), F.when(F.lit(kind == RANDOM), z["token"]).alias("token")))
    return F.when(F.col("text").rlike(pattern), F.filter(rows, lambda r: r["size"].isNotNull()))


def scan(rows: DataFrame) -> DataFrame:
    """Matches of all patterns with their places: doc, h, kind, start, end, token. ``rows``: doc, h (hash of the text), text."""
    patterns = [(k, p) for k, (p, _) in KINDS.items()] + [(RANDOM, TOKEN)]
    hit = rows.where(F.col("text").rlike(ANY))
    found = hit.select("doc", "h", F.explode(F.flatten(F.array_compact(F.array(*(_matches(k, p) for k, p in patterns))))).alias("m"))
    found = found.select("doc", "h", "m.*").dropDuplicates(["doc", "h", "kind", "pos"])
    before = Window.partitionBy("doc", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    least = F.create_map(*(F.lit(x) for k, (_, n) in KINDS.items() for x in (k, n)))
    keep = (F.col("kind") == RANDOM) | (F.col("tested") >= least[F.col("kind")])
    return found.where(keep).select("doc", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "token")


def battery(tokens: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """Column ``token`` with its encoding, the p-values of ``tests`` against a random token, and ``p``, theirs together against a written one."""
    # every value that others name is bound once: an expression put into a lambda would be worked out for each character
    encoding = lambda t: reduce(lambda acc, k: F.when(t.rlike(ENCODINGS[k][0]), k).otherwise(acc), [k for k in reversed(ENCODINGS) if ENCODINGS[k][0]], F.lit("base64"))
    alphabet = F.create_map(*(F.lit(x) for k, (_, a) in ENCODINGS.items() for x in (k, a)))
    named = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    one = _let(F.regexp_replace("token", "=+$", ""), lambda t: named(t=t, enc=encoding(t)))
    two = _let(one, lambda a: named(enc=a["enc"], alphabet=alphabet[a["enc"]], t=F.when(a["enc"].isin("hex", "letters", "base36"), F.lower(a["t"])).otherwise(F.translate(a["t"], "-_", "+/"))))
    places = lambda a: F.transform(F.filter(F.split(a["t"], ""), lambda c: c != ""), lambda c: F.call_function("locate", c, a["alphabet"]).cast("double"))
    three = _let(two, lambda a: named(enc=a["enc"], t=a["t"], k=F.length(a["alphabet"]).cast("double"), x=places(a)))
    add = lambda x, of=lambda c: c: F.aggregate(x, F.lit(0.0), lambda s, c: s + of(c))
    four = _let(three, lambda a: named(enc=a["enc"], t=a["t"], k=a["k"], x=a["x"], n=F.size(a["x"]).cast("double"), mean=add(a["x"]) / F.greatest(F.size(a["x"]), F.lit(1)), half=(a["k"] + 1) / 2))
    rest = lambda a: F.slice(a["x"], F.lit(2), F.size(a["x"]))
    head = lambda a: F.slice(a["x"], F.lit(1), F.greatest(F.size(a["x"]) - 1, F.lit(0)))
    five = _let(four, lambda a: named(
        enc=a["enc"], t=a["t"], k=a["k"], n=a["n"],
        squares=add(F.array_distinct(a["x"]), lambda c: F.pow(F.size(F.filter(a["x"], lambda y: y == c)).cast("double"), F.lit(2.0))),
        spread=add(a["x"], lambda c: (c - a["mean"]) * (c - a["mean"])),
        joint=add(F.zip_with(head(a), rest(a), lambda c, d: (c - a["mean"]) * (d - a["mean"]))),
        above=F.size(F.filter(a["x"], lambda c: c > a["half"])).cast("double"),
        runs=1 + F.size(F.filter(F.zip_with(head(a), rest(a), lambda c, d: (c > a["half"]) != (d > a["half"])), lambda d: d)).cast("double"),
    ))
    rows = tokens.withColumn("v", five).select(*tokens.columns, "v.*").where("n > 2")
    t = F.col("t")
    df, chi = F.col("k") - 1, F.col("k") / F.col("n") * F.col("squares") - F.col("n")
    z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    below = F.col("n") - F.col("above")
    expect = 1 + 2 * F.col("above") * below / F.col("n")
    var = (expect - 1) * (expect - 2) / (F.col("n") - 1)
    z_runs = F.when(var > 0, (F.col("runs") - expect) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("spread") > 0, F.col("joint") / F.greatest("spread", F.lit(1e-9)) * F.sqrt("n")).otherwise(F.lit(99.0))
    n = F.col("n")
    fixed = lambda k: F.create_map(*(F.lit(x) for e, v in WRITTEN.items() for x in (e, v[k])))[F.col("enc")]
    equal, cubes, changes, serial = (fixed(k) for k in range(4))
    pairs, hits = n * (n - 1) / 2, (F.col("squares") - n) / 2  # chi-squared is linear in the equal pairs
    w_chi = (pairs * equal - hits) / F.sqrt(pairs * (equal - equal * equal) + n * (n - 1) * (n - 2) * (cubes - equal * equal))
    spelled = F.col("enc").isin("letters", "mixed")
    kinds = F.when(spelled, F.regexp_replace(F.regexp_replace(t, "[AEIOUaeiouyY]", "0"), "[A-Za-z]", "1"))
    kinds = kinds.otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", ""))  # words joined by marks are still words
    turns = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1
    w_turns = (turns - (n - 1) * changes) / F.sqrt((n - 1) * changes * (1 - changes))
    w_turns = F.when(spelled, -w_turns).otherwise(w_turns)  # written letters alternate more than random ones
    w_serial = F.when(F.col("enc") == "letters", F.lit(0.0)).otherwise((serial - F.col("joint") / F.greatest("spread", F.lit(1e-9))) * F.sqrt(n))
    scores = {"uniform": w_chi, "runs": w_turns, "serial": w_serial}
    z = reduce(lambda x, y: x + y, [scores[k] for k in tests], F.lit(0.0)) / JOINT_VARIANCE**0.5
    p = F.when(F.col("enc") == "decimal", F.lit(1.0)).otherwise(normal_tail(F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))))  # digits alone are numbers, however they fall
    gates = {"uniform": normal_tail(z_chi), "runs": 2 * normal_tail(F.abs(z_runs)), "serial": 2 * normal_tail(F.abs(z_serial))}
    return rows.select("token", "enc", "n", *((gates[k] if k in tests else F.lit(1.0)).alias(f"p_{k}") for k in TESTS), p.alias("p"))


def _binned(tests: DataFrame) -> DataFrame:
    b = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-290))) * BINS_A_DECADE), F.lit(BINS)).cast("int")
    return tests.withColumn("length_class", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.greatest(b, F.lit(0)))


def discoveries(tokens: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """The distinct tokens that the battery finds: token."""
    # written once: a filter on its columns would otherwise be pushed below it with all their expressions put in
    tests = stored(_binned(stored(battery(tokens.select("token").distinct(), tests), "battery")), "tests")
    bins = tests.groupBy("enc", "length_class", "bin").agg(F.count("*").alias("c"))  # at most encodings x lengths' logarithms x bins rows
    group = Window.partitionBy("enc", "length_class")
    from_top = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("r", F.sum("c").over(from_top)).withColumn("m", F.sum("c").over(group))
    cuts = bins.where(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_A_DECADE))) <= FDR * F.col("r") / F.col("m")).groupBy("enc", "length_class").agg(F.min("bin").alias("cut"))
    random = (F.col("p_uniform") >= RANDOM_ALPHA) & (F.col("p_runs") >= RANDOM_ALPHA) & (F.col("p_serial") >= RANDOM_ALPHA)
    return tests.where(random).join(F.broadcast(cuts), ["enc", "length_class"]).where("bin >= cut").select("token")


def span_rows(rows: DataFrame) -> DataFrame:
    """Spans that count, a row each: doc, h, start, end, kind, ordinal, fresh (it begins at or after the end of all before it).

    ``rows``: doc, h, text. A random span that overlaps a base span is left out: the base span before it and the one after it
    decide that, by one sort in either direction, so a text with very many spans takes no pairs of them.
    """
    found = stored(scan(rows), "matches")
    extra = found.where(F.col("kind") == RANDOM)
    extra = extra.join(discoveries(extra), "token", "left_semi")
    ordinal = F.array_position(F.array(*(F.lit(k) for k in [*KINDS, RANDOM])), F.col("kind")).cast("int")
    spans = found.where(F.col("kind") != RANDOM).drop("token").unionByName(extra.drop("token")).withColumn("ordinal", ordinal)
    text = Window.partitionBy("doc", "h")
    on, back = text.orderBy("start", "ordinal", "end"), text.orderBy(F.desc("start"), F.desc("ordinal"), F.desc("end"))
    base = F.col("kind") != RANDOM
    before = F.max(F.when(base, F.col("end"))).over(on.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumns({"before": before, "after": after})
    spans = spans.where(base | (F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    ended = F.max("end").over(on.rowsBetween(Window.unboundedPreceding, -1))
    return spans.select("doc", "h", "start", "end", "kind", "ordinal", F.coalesce(ended <= F.col("start"), F.lit(True)).alias("fresh"), ended.alias("ended"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document that has any: doc, h, base and spans (arrays of start, ordinal of the kind, end, kind)."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    per = span_rows(rows).groupBy("doc", "h").agg(F.array_sort(F.collect_list(F.struct("start", "ordinal", "end", "kind"))).alias("spans"))
    return per.select("doc", "h", F.filter("spans", lambda s: s["kind"] != RANDOM).alias("base"), "spans")


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, sha-256 of the base spans, all spans."""
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    found = find(docs, id_col, text_col)
    out = keys.join(found, F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("h")), "left")
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint"), F.lit(0).cast("bigint"))
    return out.select("id", *(F.when(F.col("base").isNull(), F.lit(0).cast("bigint")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce(_said(F.col("base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_said(F.col("spans")), F.lit("")).alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """Stretches of overlapping spans, a row each: doc, h, start, end."""
    on = Window.partitionBy("doc", "h").orderBy("start", "ordinal", "end")
    opened = spans.withColumn("island", F.sum(F.col("fresh").cast("int")).over(on.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("doc", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``; touching spans each leave one mark, overlapping ones one.

    Only texts that some pattern can match at all are joined with their spans; all others pass as they are. A text is cut
    into pieces of ``PIECE`` characters once and what is between two spans is taken from the pieces that it spans, so the work is
    linear in the text and in its spans. Columns keep their names, order and values, whatever they are called.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    # under names of our own no column can clash
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    text, key = F.col(f"c{names.index(text_col)}"), F.col(f"c{names.index(id_col)}")
    flagged = inner.withColumns({"hit": F.coalesce(text.rlike(ANY), F.lit(False))})
    hit = flagged.where("hit").withColumn("hash", F.xxhash64(text))
    stretches = _merged(span_rows(hit.select(key.alias("doc"), text.alias("text"), F.col("hash").alias("h"))))
    found = stretches.groupBy("doc", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = hit.join(found, key.eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("h")), "left")

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    zero = F.array(F.lit(0).cast("bigint"))
    begins, ends = F.concat(zero, F.transform("spans", lambda s: s["end"])), F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = _let(cut, lambda pieces: F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda z: part(pieces, z["a"], z["b"])), mark))
    new = F.when(F.col("spans").isNull(), text).otherwise(clean).cast(kinds[text_col])
    done = joined.withColumn(f"c{names.index(text_col)}", new)
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    return flagged.where(~F.col("hit")).select(*back).unionAll(done.select(*back))
