"""Secret scans: key patterns, and a battery of randomness tests for everything else.

DataFrame functions only. Positions come from the pieces between matches, so they are code points
and no row is ever multiplied.

Base kinds are patterns (``BASE``). The method looks at the other runs of 20 and more characters of the
base64 alphabets, infers the encoding of each (hex, base32, letters, base36, base62, base64) and asks:

- is it unlike text? The likelihood ratio of "uniform over the encoding" against a fixed letter model
  of text bounds the p-value of the text hypothesis (Markov), and falls with length;
- is it random? chi-squared uniformity over the alphabet, the runs test around the alphabet's middle
  and lag-1 serial correlation of the code values, each at a third of ``ALPHA``.

Thousands of long words are tested, so the text hypothesis is rejected under Benjamini-Hochberg control
at rate ``Q``, separately for each length band: one pass counts p-values (in bins, whose upper bound
counts) per band; the at most BANDS x BINS counts reach the driver, which turns them into one
threshold per band. A run is a secret if text is rejected and randomness is not.

Null text counts as empty. Repeated rows and rows without ids get their own equal results; an empty table
has no thresholds and no rows. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import common

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BASE = [(ASSIGN, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]{32,}", 0, 32)]  # pattern, measured group, least length
RUN = "[A-Za-z0-9+/_-]{20,}"
LEAST = 20
BANDS, BINS = 16, 400
ALPHA_Z, ALPHA_CHI = 2.935, 2.713  # normal quantiles of a third of 0.01, two- and one-sided
Q = 0.01
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# Encoding, the runs it fits, its alphabet in code order; the first that fits counts.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"), ("hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("letters", "^[a-z]+$", LOWER), ("letters", "^[A-Z]+$", UPPER), ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER), ("base36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER), ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^.+$", UPPER + LOWER + DIGITS + "-_+/"),
]
# Per mille of letters a to z in English text.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
ELSE = {"upper": 0.03 / 26, "digit": 0.01 / 10, "sign": 0.01 / 4}


def text_model() -> dict[str, float]:
    """log share of every character of a run in ordinary text."""
    model = {c: math.log(0.95 * n / sum(LETTERS)) for c, n in zip(LOWER, LETTERS, strict=True)}
    model |= dict.fromkeys(UPPER, math.log(ELSE["upper"])) | dict.fromkeys(DIGITS, math.log(ELSE["digit"]))
    return model | dict.fromkeys("+/-_", math.log(ELSE["sign"]))


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Structs (start, end, value) of the leftmost matches whose ``group`` has ``least`` characters."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    pieces = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        new = F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("value")))
        out = F.when(F.length(x["part"]) >= least, F.concat(held["out"], new)).otherwise(held["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda held: held["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def tests(run: Column) -> Column:
    """Struct (band, bin, random): length band, -4 log10 of the text p-value's bound, battery passed."""
    n = F.length(run).cast("double")
    model = F.create_map(*[x for c, v in text_model().items() for x in (F.lit(c), F.lit(v))])
    alphabet, size = F.lit(None).cast("string"), F.lit(None).cast("double")
    for _, pattern, symbols in reversed(ENCODINGS):
        fits = run.rlike(pattern)
        alphabet = F.when(fits, F.lit(symbols)).otherwise(alphabet)
        size = F.when(fits, F.lit(float(len(symbols)))).otherwise(size)
    one_case = F.when(run.rlike("[a-z]"), run).otherwise(F.lower(run))  # capitals only: as text, a word in lower case
    ratio = F.aggregate(F.split(one_case, ""), F.lit(0.0), lambda s, c: s - model[c]) - n * F.log(size)
    chars = F.split(run, "")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(run, c)))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    freedom = size - 1
    chi = size / n * squares - n
    cube = (F.pow(chi / freedom, 1 / 3) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    # Code values once, then sums of neighbours.
    values = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    start = F.struct(*[F.lit(0.0).alias(x) for x in ("sum", "square", "product", "high", "turns")], F.lit(-1.0).alias("last"))

    def step(h: Column, v: Column) -> Column:
        first = h["last"] < 0
        turn = ~first & ((h["last"] >= size / 2) != (v >= size / 2))
        return F.struct(
            (h["sum"] + v).alias("sum"), (h["square"] + v * v).alias("square"),
            (h["product"] + F.when(first, 0.0).otherwise(h["last"] * v)).alias("product"),
            (h["high"] + (v >= size / 2).cast("double")).alias("high"),
            (h["turns"] + turn.cast("double")).alias("turns"), v.alias("last"))

    def finish(h: Column) -> Column:
        both = 2 * h["high"] * (n - h["high"])
        mean = both / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(variance > 0, F.abs(h["turns"] + 1 - mean) / F.sqrt(variance)).otherwise(99.0)
        m = h["sum"] / n
        spread = h["square"] - n * m * m
        first = F.element_at(values, 1)
        lagged = h["product"] - m * (2 * h["sum"] - first - h["last"]) + (n - 1) * m * m
        serial = F.when(spread > 0, F.abs(lagged / spread + 1 / n) * F.sqrt(n)).otherwise(99.0)
        return (runs <= ALPHA_Z) & (serial <= ALPHA_Z)

    even = (cube <= ALPHA_CHI) & F.aggregate(values, start, step, finish)
    band = F.least(F.lit(BANDS - 1), F.floor(2 * F.log2(n / LEAST))).cast("int")
    step_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(4 * ratio / math.log(10)))).cast("int")
    return F.struct(band.alias("band"), step_of.alias("bin"), even.alias("random"))


def _as_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted structs (start, kind, end) of the pattern kinds; ``kind`` is a position in KINDS."""
    return F.array_sort(F.concat(*[_as_kind(matches(text, *rule), k) for k, rule in enumerate(BASE)]))


def candidates(text: Column, base: Column) -> Column:
    """Long runs that overlap no base span, with their tests."""
    free = F.filter(matches(text, RUN), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), tests(m["value"]).alias("test")))


def thresholds(docs: DataFrame, text_col: str = "text", q: float = Q) -> dict[int, int]:
    """Lowest rejected bin of every length band with a rejection (Benjamini-Hochberg on binned p-values)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tested = docs.select(text.alias("t")).where(F.col("t").rlike(RUN)).select("t", base_spans(F.col("t")).alias("base"))
    tested = tested.select(F.explode(candidates(F.col("t"), F.col("base"))).alias("c"))
    counts = tested.groupBy("c.test.band", "c.test.bin").count().collect()
    out = {}
    for band in sorted({r["band"] for r in counts}):
        own = {r["bin"]: r["count"] for r in counts if r["band"] == band}
        total, above = sum(own.values()), 0
        for b in range(BINS - 1, -1, -1):
            above += own.get(b, 0)
            if above and 10 ** (-b / 4) <= q * above / total:
                out[band] = b
    return out


def with_spans(docs: DataFrame, text_col: str = "text", q: float = Q) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted arrays of (start, kind, end)."""
    limit = thresholds(docs, text_col, q)
    found = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = common.add_fields(docs, F.struct(base_spans(text).alias("base")), ["base"])
    if limit:
        bound = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
        passed = F.filter(candidates(text, F.col("base")), lambda c: c["test"]["random"] & (c["test"]["bin"] >= bound[c["test"]["band"]]))
        found = _as_kind(passed, KINDS.index("random"))
    return common.add_fields(docs, F.struct(F.array_sort(F.concat("base", found)).alias("spans")), ["spans"])


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(h: Column, s: Column) -> Column:
        more = F.concat(h["out"], F.substring(text, h["at"] + 1, s["start"] - h["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= h["at"], more).otherwise(h["out"]).alias("out"), F.greatest(h["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda h: F.concat(h["out"], F.substring(text, h["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the base digest and all spans."""
    found = with_spans(docs.select(id_col, F.col(text_col).alias("text")), "text", q)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"))


def oracle() -> str:
    """The scan as SQL: matches as rows, the battery as sums over their characters."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    fits = " ".join(f"when regexp_matches(v, {text(p)}) then {{}}" for _, p, _ in ENCODINGS)
    alphabet, size = (f"case {fits.format(*x)} end" for x in (
        [text(a) for _, _, a in ENCODINGS], [f"{len(a)}::double" for _, _, a in ENCODINGS]))
    found = lambda k, pattern, group, least: f"""
m{k} as (select rid, regexp_extract_all(t, {text(pattern)}, 0) as w, regexp_extract_all(t, {text(pattern)}, {group}) as p,
  string_split_regex(t, {text(pattern)}) as g from d where regexp_matches(t, {text(pattern)})),
u{k} as (select rid, unnest(range(1, len(w) + 1)) as i, unnest(w) as w, unnest(p) as p, unnest(g[1:len(w)]) as g from m{k}),
s{k} as (select rid, {k} as kind, e - length(w) as s, e, p as v from (
  select *, sum(length(g) + length(w)) over (partition by rid order by i) as e from u{k}) where length(p) >= {least})"""  # noqa: E731
    rules = [*BASE, (RUN, 0, LEAST)]
    model = ", ".join(f"({text(c)}, {v!r}::double)" for c, v in text_model().items())
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
{",".join(found(k, *rule) for k, rule in enumerate(rules))},
base as (select * from s0 union all select * from s1 union all select * from s2),
free as (select row_number() over () as c, *, length(v)::double as n, {alphabet} as alphabet, {size} as size from s3
  where not exists (select 1 from base where base.rid = s3.rid and base.s < s3.e and s3.s < base.e)),
model as (select * from (values {model}) x(ch, logp)),
chars as (select c, alphabet, size, regexp_matches(v, '[a-z]') as mixed, unnest(range(1, length(v) + 1)) as i, unnest(string_split(v, '')) as ch from free),
likely as (select c, -sum(logp) as gain from chars join model on model.ch = case when mixed then chars.ch else lower(chars.ch) end group by c),
even as (select c, sum(k * k)::double as squares from (select c, ch, count(*) as k from chars group by c, ch) group by c),
coded as (select c, size, i, (instr(alphabet, ch) - 1)::double as v, lag((instr(alphabet, ch) - 1)::double) over (partition by c order by i) as l from chars),
sums as (select c, sum(v) as total, sum(v * v) as square, coalesce(sum(l * v), 0) as product, sum(case when v >= size / 2 then 1 else 0 end)::double as high,
  coalesce(sum(case when (l >= size / 2) <> (v >= size / 2) then 1 else 0 end), 0)::double as turns, arg_min(v, i) as first, arg_max(v, i) as last from coded group by c),
facts as (select free.*, gain - n * ln(size) as ratio, size / n * squares - n as chi, 2 * high * (n - high) / n + 1 as mean, turns, total, square,
    square - n * (total / n) * (total / n) as spread,
    product - total / n * (2 * total - first - last) + (n - 1) * (total / n) * (total / n) as lagged
  from free join likely using (c) join even using (c) join sums using (c)),
tested as (select *, cast(least({BANDS - 1}, floor(2 * log2(n / {LEAST}))) as int) as band,
    cast(greatest(0, least({BINS - 1}, floor(4 * ratio / ln(10)))) as int) as bin,
    (pow(greatest(chi, 0) / (size - 1), 1 / 3::double) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1))) <= {ALPHA_CHI}
    and case when (mean - 1) * (mean - 2) > 0 then abs(turns + 1 - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) else 99 end <= {ALPHA_Z}
    and case when spread > 0 then abs(lagged / spread + 1 / n) * sqrt(n) else 99 end <= {ALPHA_Z} as random from facts),
bins as (select band, bin, count(*) as k from tested group by band, bin),
tails as (select band, bin, sum(k) over (partition by band order by bin desc) as above, sum(k) over (partition by band) as total from bins),
bounds as (select band, min(bin) as bound from tails where pow(10, -bin / 4::double) <= {Q} * above / total group by band),
chosen as (select rid, kind, s, e from base union all
  select rid, 3, s, e from tested join bounds using (band) where random and bin >= bound),
told as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    count(*) filter (kind = 3) as n_random,
    coalesce(string_agg(concat([{", ".join(text(k) for k in KINDS)}][kind + 1], ':', s, ':', e), ',' order by s, kind, e) filter (kind < 3), '') as base,
    string_agg(concat([{", ".join(text(k) for k in KINDS)}][kind + 1], ':', s, ':', e), ',' order by s, kind, e) as spans from chosen group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_random, 0) as n_random from d left join told using (rid)
"""
