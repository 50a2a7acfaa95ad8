"""Operator 7 [native]: secret scans with sliding-window Shannon entropy.

Spans come from SQL functions alone: a pattern's matches and the pieces between them
have lengths whose running sums are the matches' offsets. Long tokens are candidates for the
entropy rule: a window slides over each, counts per character are kept up to date as one
character enters and one leaves, and the sum of c * log2(c) that entropy needs changes by two
terms a step. An allow-list suppresses what is known to be harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds. ``{n,}`` stands for a length test where no shorter match could
#: have hidden a later one; the assignment's value is tested afterwards, as its match is kept whole.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex")
#: Candidates of the entropy rule: a token with nothing of its alphabet on either side.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
WINDOW = 20
#: Least entropy in bits per character, by character class: at most log2(WINDOW) = 4.32 is possible.
LEAST_ENTROPY = {"hex": 3.0, "alnum": 3.6, "mixed": 3.6}
#: Fixed allow-list: identifiers, placeholders and paths that are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?(api[_-]?)?(key|token|secret)|xxxx",
    r"(?i)^(sha1|sha256|sha512|md5)[-_=]",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _with_spans(rows: DataFrame, pattern: str, kind: str, needs: Column, valued: bool = False) -> DataFrame:
    """``rows`` with a column ``__<kind>``: matches of ``pattern`` in ``__t`` as structs of start, end,
    kind, match, value. Running sums are taken in blocks of matches, so that a text
    with very many costs little more than in proportion."""
    t, z, o, block = F.col("__t"), f"__z_{kind}", f"__o_{kind}", 128
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(t, F.lit(pattern), F.lit(1)) if valued else found
    pieces = F.slice(F.split(t, pattern, -1), 1, F.size(found))
    zipped = F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), found.alias("match"), value.alias("value"))
    rows = rows.withColumn(z, F.when(needs, zipped).otherwise(F.expr("array()").cast("array<struct<gap:int,match:string,value:string>>")))
    piece = lambda j: F.slice(z, j * block + 1, block)
    length = lambda x: x["gap"] + F.char_length(x["match"])
    totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int")), lambda j: F.aggregate(piece(j), F.lit(0), lambda s, x: s + length(x)))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    rows = rows.withColumn(o, F.when(F.size(z) > 0, F.slice(starts, 1, F.size(starts) - 1)).otherwise(F.expr("array()").cast("array<int>")))
    none = F.expr("array()").cast("array<struct<start:int,end:int,kind:string,match:string,value:string>>")

    def step(s, x):
        one = F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + length(x)).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), x["value"].alias("value"))
        return F.struct((s["at"] + length(x)).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    spans = F.transform(o, lambda at, j: F.aggregate(piece(j), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"]))
    return rows.withColumn(f"__{kind}", F.flatten(spans)).drop(z, o)


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any ``window`` consecutive characters of ``token``.

    One character leaves the window and one enters at a time; each changes one count and two
    terms of the sum of c * log2(c), whose smallest value gives the largest entropy."""
    code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    before = F.concat(F.array_repeat(F.lit(0), window), F.slice(code, 1, F.size(code) - window))
    event = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    events = F.flatten(F.zip_with(code, before, lambda c, b: F.when(b > 0, F.array(event(b, -1), event(c, 1))).otherwise(F.array(event(c, 1)))))
    bits = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)

    # twelve counts of five bits in each long: a step rewrites six numbers
    call = lambda f, a, b: F.call_function(f, a, b)

    def step(s, x):
        by, part, off = x["by"], F.floor((x["at"] - 1) / 12).cast("int"), F.pmod(x["at"] - 1, F.lit(12)) * 5
        was = call("shiftright", F.get(s["counts"], part), off).bitwiseAND(F.lit(31)).cast("int")
        total = s["sum"] + bits(was + by) - bits(was)
        size = s["size"] + by
        return F.struct(
            F.transform(s["counts"], lambda c, i: F.when(i == part, c + call("shiftleft", F.lit(1).cast("long"), off) * by).otherwise(c)).alias("counts"),
            total.alias("sum"),
            size.alias("size"),
            F.when(size == window, F.least(s["low"], total)).otherwise(s["low"]).alias("low"),
        )

    none = F.array_repeat(F.lit(0).cast("long"), -(-len(_ALPHABET) // 12))
    zero = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("size"), F.lit(float("inf")).alias("low"))
    return F.aggregate(events, zero, step, lambda s: F.log2(F.lit(float(window))) - s["low"] / F.lit(float(window)))


def _before(marks: Column, of: Column) -> Column:
    """For each of the ascending numbers ``of`` how many ``marks`` lie before it (none is equal to one). Marks and numbers are sorted together: a number's place there less its own rank
    counts the marks before it, so n marks and m numbers cost (n + m) log (n + m)."""
    tagged = lambda a, own: F.transform(a, lambda v: F.struct(v.alias("v"), F.lit(own).alias("own")))
    both = F.transform(F.sort_array(F.concat(tagged(marks, 0), tagged(of, 1))), lambda x, i: F.struct(x["own"].alias("own"), i.alias("i")))
    return F.transform(F.filter(both, lambda x: x["own"] == 1), lambda x, k: x["i"] - k)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``spans`` (base) and ``added`` (entropy rule) per row of ``docs``.

    Both are arrays of start, end, kind, match, value, in code points, ends exclusive, by
    start. Added spans are of kind ``entropy`` and overlap no base span; base spans stay even
    where the allow-list knows them. Whole texts are read; null counts as empty; repeated rows and null keys
    give a row each, an empty table none; of equal starts assign comes before access before hex. Other columns, whatever their
    names, are neither read nor returned. One projection: no shuffle, no Python; n log n in a text's matches."""
    t = F.col("__t")
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = _with_spans(rows, ASSIGN, "assign", t.rlike(ASSIGN), valued=True)
    found = _with_spans(found, ACCESS, "access", F.contains(t, F.lit("AKIA")))
    found = _with_spans(found, HEX, "hex", t.rlike(HEX))
    found = _with_spans(found, CANDIDATE, "entropy", t.rlike(CANDIDATE))
    found = found.withColumn("__assign", F.filter("__assign", lambda s: F.char_length(s["value"]) >= MIN_VALUE))
    # by start, then in the order of KINDS: struct order sorts kinds by name, so their rank goes first
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s.alias("s"))
    ordered = F.transform(F.sort_array(F.transform(F.concat("__assign", "__access", "__hex"), rank)), lambda x: x["s"])
    found = found.select("__key", ordered.alias("spans"), "__entropy")

    # Spans that start before a candidate's end, less those that end at its start or before: none overlap it if these are equal.
    ends = _before(F.transform("spans", lambda b: b["start"] * 2), F.transform("__entropy", lambda c: c["end"] * 2 - 1))
    starts = _before(F.transform("spans", lambda b: b["end"] * 2), F.transform("__entropy", lambda c: c["start"] * 2 + 1))
    # zipped, not looked up by place: a column that a lambda names may be computed anew for each element
    free = F.zip_with("__entropy", F.zip_with(ends, starts, lambda a, b: a == b), lambda s, f: F.struct(s.alias("s"), f.alias("free")))
    found = found.withColumn("__entropy", F.when(F.size("spans") > 0, F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"])).otherwise(F.col("__entropy")))

    def secret(s):
        v = s["match"]
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | v.rlike(p)
        least = F.when(v.rlike("^[0-9a-fA-F]+$"), LEAST_ENTROPY["hex"]).when(v.rlike("^[A-Za-z0-9]+$"), LEAST_ENTROPY["alnum"]).otherwise(LEAST_ENTROPY["mixed"])
        return F.when(~allowed & v.rlike("[0-9]") & v.rlike("[A-Za-z]"), window_entropy(v) >= least).otherwise(F.lit(False))

    return found.select(F.col("__key").alias(key), "spans", F.filter("__entropy", secret).alias("added"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a SHA-256 of the base spans and all spans as a string."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    every = F.transform(F.sort_array(F.transform(F.concat("spans", "added"), lambda s: F.struct(s["start"].alias("start"), F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0)).alias("rank"), s.alias("s")))), lambda x: x["s"])
    return found.select(key, *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))
