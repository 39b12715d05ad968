"""Secret scans: fixed patterns plus a randomness test battery, in native DataFrame functions only.

Base kinds (leftmost, non-overlapping, per kind): ``assign``, ``access`` and ``hex``. Their places
come from ``split`` and ``regexp_extract_all`` over the same pattern: the gaps and the matches
alternate, so running sums of their lengths are code-point offsets.

The battery looks at every other run of at least ``MIN_RUN`` characters of the base64 alphabets
that holds a digit and a letter; ``=`` is padding at its end only, so NAME=VALUE is two runs. Its encoding is inferred from the characters it uses (hex, base32,
base36, base62, base64). Three statistics ask how well it fits the hypothesis "structured text":

* chi-squared uniformity over the alphabet, against the noncentral law of text whose characters
  coincide ``COINCIDENCE`` times as often as uniform ones;
* runs of character classes (digit, lower, upper, other), against text that changes class half as
  often as random characters of that alphabet;
* lag-one serial correlation of code values, against a correlation of ``CORRELATION``.

All three laws depend on the run's length, so a short run can't be convincing. The z values add up
(Stouffer) to one p value, and the Benjamini-Hochberg rule bounds the share of false discoveries
at ``FDR`` among the candidates of each stratum (encoding and octave of the length), over the whole
table: p values are counted in bins of a twentieth of a decade (a bin counts as its upper edge, so
the rule is only stricter), a bounded table of strata x bins gives the thresholds.

Cases: a null text is empty and has no spans; no span gives an empty list and the digest of the
empty text; very long texts and runs are scanned whole; repeated rows are scanned apart, each
counting as a candidate; an empty table gives an empty result. Input columns are kept as they are,
but for the output's own names, which replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.llm.common import Scratch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same places as AKIA[A-Z0-9]+ with 20 or more characters
HEX = r"[0-9a-f]{24,}"  # the same places as maximal runs of 24 or more
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_-]{%d,}=*" % MIN_RUN  # "=" pads a run at its end; an inner one ends it
COINCIDENCE = 1.75
CORRELATION = 0.25
FDR = 0.01
#: Items of a list that are put together one by one.
BLOCK = 128
#: (encoding, pattern of the whole run, alphabet in code order); the first that fits is inferred.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[0-9A-Za-z+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def blocks_of(items: Column) -> Column:
    """``items`` cut into arrays of ``BLOCK``: what is appended item by item stays short, so a list of n
    costs about n * BLOCK instead of n * n."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of the ints before each of ``values`` (of one number a block), from 0 on."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def places(text: Column, pattern: str, kind: str, keep: Column | None = None, groups: int = 0) -> Column:
    """array<struct<start, kind_no, end, kind, hit>> of the pattern's matches in ``text``.

    ``groups``: a group whose match is kept as ``hit`` instead of the whole. Offsets are running sums,
    block by block, so any number of matches is taken in about linear time.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else whole
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["part"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    cut = blocks_of(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part")))
    lengths = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["whole"])))
    zipped = F.arrays_zip(cut.alias("own"), running(lengths, lambda at, n: at + n).alias("at"))
    found = F.flatten(F.transform(zipped, lambda z: F.aggregate(z["own"], F.struct(z["at"].alias("at"), none.alias("out")), step)["out"]))
    # most texts have no match: one search decides that without lists
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """The base kinds' spans by start, then kind."""
    assign = F.filter(places(text, ASSIGN, "assign", groups=2), lambda s: F.length(s["hit"]) >= 6)
    return F.array_sort(F.concat(assign, places(text, ACCESS, "access"), places(text, HEX, "hex")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 1e-7; fixed coefficients."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z > 0, 1 - upper).otherwise(upper)


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, n, z values and p to rows with a string ``hit``; p is small for random runs."""
    first = lambda pick: F.coalesce(*(F.when(F.col("hit").rlike(p), F.lit(pick(e, a))) for e, p, a in ENCODINGS))
    body = F.regexp_replace("hit", "=+$", "")
    fold = F.when(F.col("encoding").isin("hex", "base36"), F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    d = runs.withColumn("encoding", first(lambda e, a: e)).withColumn("alphabet", first(lambda e, a: a)).where("encoding is not null")
    d = d.withColumn("body", fold).withColumn("n", F.length("body"))
    # counts per code, from the lengths left once a code is removed; the sums of codes follow from them
    count = lambda c: (F.length("body") - F.length(F.replace("body", c, F.lit("")))).cast("long")
    d = d.withColumn("counts", F.transform(F.split("alphabet", ""), count))
    total = lambda f: F.aggregate(F.transform("counts", f), F.lit(0).cast("long"), lambda acc, x: acc + x)
    d = d.withColumns({"squares": total(lambda m, k: m * m), "s1": total(lambda m, k: m * k), "s2": total(lambda m, k: m * k * k)})
    code = lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("long")
    step = lambda acc, c: F.struct(code(c).alias("last"), (acc["sum"] + acc["last"] * code(c)).alias("sum"))
    none = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    d = d.withColumns({"lag": F.aggregate(F.split("body", ""), none, step), "head": code(F.left("body", F.lit(1)))})
    k, n = F.length("alphabet").cast("double"), F.col("n").cast("double")
    chi, df, lam = k / n * F.col("squares") - n, k - 1, (n - 1) * (COINCIDENCE - 1)
    klass = F.translate("body", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a" * 26 + "A" * 26 + "0" * 10 + "++")
    changes = F.length(F.regexp_replace(klass, r"(.)(?=\1)", "")) - 1
    share = {"hex": [10, 6], "base32": [6, 26], "base36": [10, 26], "base62": [10, 26, 26], "base64": [10, 26, 26, 2]}
    change = F.coalesce(*(F.when(F.col("encoding") == e, F.lit(1 - sum((c / sum(s)) ** 2 for c in s))) for e, s in share.items()))
    q = change / 2
    # sums over the run give mean, variance and the products of neighbours without a second pass
    mean, var = F.col("s1") / n, (n * F.col("s2") - F.col("s1") * F.col("s1")) / n
    cov = F.col("lag.sum") - mean * (2 * F.col("s1") - F.col("lag.last") - F.col("head")) + (n - 1) * mean * mean
    corr = F.when(var > 0, cov / var).otherwise(1.0)
    d = d.withColumn("z_chi", (chi - df - lam) / F.sqrt(2 * (df + 2 * lam))).withColumn("z_runs", ((n - 1) * q - changes) / F.sqrt((n - 1) * q * (1 - q)))
    d = d.withColumn("z_serial", (F.abs(corr) - CORRELATION) * F.sqrt(n)).withColumn("z", (F.col("z_chi") + F.col("z_runs") + F.col("z_serial")) / F.lit(3.0**0.5))
    return d.withColumn("p", _normal_cdf(F.col("z"))).withColumn("octave", F.floor(F.log2(n)).cast("int")).drop("alphabet", "body", "counts", "squares", "s1", "s2", "lag", "head")


def thresholds(tested: DataFrame) -> DataFrame:
    """(encoding, octave, top): the least bin still discovered in each stratum."""
    edge = F.pow(F.lit(10.0), -F.col("bin") / 20)
    order = Window.partitionBy("encoding", "octave").orderBy(F.desc("bin"))  # at most 401 bins
    counts = tested.groupBy("encoding", "octave", "bin").agg(F.count("*").alias("m"))
    ranked = counts.withColumn("upto", F.sum("m").over(order)).withColumn("all", F.sum("m").over(Window.partitionBy("encoding", "octave")))
    return ranked.where(edge * F.col("all") <= FDR * F.col("upto")).groupBy("encoding", "octave").agg(F.min("bin").alias("top"))


def with_bin(tested: DataFrame) -> DataFrame:
    """bin: p in twentieths of a decade; its upper edge is what the rule takes p for."""
    return tested.withColumn("bin", F.least(F.lit(400), F.floor(-20 * F.log10(F.greatest(F.col("p"), F.lit(1e-30))))).cast("int"))


def clear_runs(scanned: DataFrame) -> DataFrame:
    """(row_tag, s): runs that overlap no base span of their text.

    Only texts with both are looked at span by span: in order of starts, the furthest end of a base
    span before a run and the nearest start after it tell, without comparing pairs.
    """
    alone = scanned.where(F.size("base") == 0).select("row_tag", F.explode("runs").alias("s"))
    both = scanned.where(F.size("base") > 0)
    spread = lambda c, is_base: both.select("row_tag", F.explode(c).alias("s"), F.lit(is_base).alias("is_base"))
    spans = spread("runs", False).unionAll(spread("base", True)).withColumn("start", F.col("s.start"))
    upto = lambda order: Window.partitionBy("row_tag").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.max(F.when(F.col("is_base"), F.col("s.end"))).over(upto(F.col("start"))), F.min(F.when(F.col("is_base"), F.col("start"))).over(upto(F.desc("start")))
    near = spans.withColumns({"before": before, "after": after}).where("not is_base")
    free = F.coalesce(F.col("before") <= F.col("s.start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("s.end"), F.lit(True))
    return alone.unionAll(near.where(free).select("row_tag", "s"))


def scan(spark: SparkSession, docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind_no, end, kind, hit), sorted.

    Every row is tagged for the way back from its candidates; the candidates are a small written
    table and meet the rows again by that tag.
    """
    scratch = Scratch(spark, "secrets")
    t = F.coalesce(F.col(text), F.lit(""))
    runs = F.filter(places(t, RUN, "random"), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]"))
    rows = docs if keep_text else docs.drop(text)
    kept = [c for c in rows.columns if c not in ("base", "spans")]
    scanned = docs.withColumns({"base": base_spans(t), "runs": runs}).select(*kept, "base", "runs")
    scanned = scratch.write(scanned.withColumn("row_tag", F.monotonically_increasing_id()), "scanned")
    apart = clear_runs(scanned.where(F.size("runs") > 0)).select("row_tag", "s", F.col("s.hit").alias("hit"))
    tested = scratch.write(with_bin(battery(apart)).select("row_tag", "s", "encoding", "octave", "bin"), "tested")
    tops = thresholds(tested)
    found = tested.join(tops, ["encoding", "octave"]).where("bin >= top").groupBy("row_tag").agg(F.collect_list("s").alias("more"))  # a text's own runs
    out = scanned.join(found, "row_tag", "left")
    none = F.array().cast(scanned.schema["base"].dataType)
    return out.select(*kept, "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` and n_chars, where present, counted anew."""
    found = scan(spark, docs, text)
    body = F.coalesce(F.col(text), F.lit(""))

    def cleaned(z: Column) -> Column:
        """A block's stretch of text with its spans replaced; offsets are those of the stretch."""
        stretch = body.substr(z["at"] + 1, z["to"] - z["at"])

        def step(acc: Column, s: Column) -> Column:
            gap = F.when(s["start"] >= acc["at"], F.concat(stretch.substr(acc["at"] - z["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

        return F.aggregate(z["own"], F.struct(z["at"].alias("at"), F.lit("").alias("out")), step)["out"]

    cut = blocks_of(F.col("spans"))
    ends = F.transform(cut, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    at = running(ends, lambda at, e: F.greatest(at, e))
    to = F.zip_with(at, ends, lambda a, e: F.greatest(a, e))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    done = F.array_join(F.transform(F.arrays_zip(cut.alias("own"), at.alias("at"), to.alias("to")), cleaned), "")
    clean = F.when(F.size("spans") == 0, F.col(text)).otherwise(F.concat(done, body.substr(last + 1, F.length(body))))
    out = found.withColumn(text, clean)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length(text).cast(kind)))
    return out.select(*docs.columns)
