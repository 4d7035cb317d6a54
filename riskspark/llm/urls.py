"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule (verdict, host, path) fits its host and every subdomain if the url's path starts with the rule's;
the longest fitting rule decides. Otherwise one automaton over all terms runs through the lower-cased
url; a hit counts if no letter or digit touches it. One strict term blocks, and so do soft terms whose
weights, each term counted once, reach ``SOFT_LIMIT``.

A null url, or one without ``://``, has empty host and path; a null url is allowed. Repeated rows get
equal results, an empty table gives no rows, result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskspark.llm import common

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
STRICT = ["casino", "porn", "xxx", "viagra", "cialis", "escorts", "hentai", "torrents", "warez", "sportsbook"]
SOFT = {  # weight of a soft term; half a point for words that ordinary urls hold too
    "free": 0.5, "win": 0.5, "cheap": 0.5, "sale": 0.5, "deal": 0.5, "deals": 0.5, "download": 0.5, "bonus": 1.0,
    "bet": 1.0, "bets": 1.0, "betting": 1.0, "poker": 1.0, "slots": 1.0, "lottery": 1.0, "jackpot": 1.0, "pills": 1.0,
    "adult": 1.0, "sexy": 1.0, "dating": 1.0, "loans": 1.0, "payday": 1.0, "crypto": 0.5, "crack": 1.0, "keygen": 1.0,
}
SOFT_LIMIT = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = T.StructType([T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_terms", T.IntegerType()), T.StructField("soft_weight", T.DoubleType())])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _counter(strict: list[str], soft: dict[str, float]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            machine.add_word(term, term)
        machine.make_automaton()
        hard = set(strict)
        for column in batches:
            out = []
            for url in column.to_pylist():
                url, found = url or "", set()
                hits = 0
                for last, term in machine.iter(url):
                    first = last - len(term) + 1
                    before, after = url[first - 1:first] if first else "", url[last + 1:last + 2]
                    if not (before.isascii() and before.isalnum() or after.isascii() and after.isalnum()):
                        hits += term in hard
                        if term in soft:
                            found.add(term)
                out.append((hits, len(found), sum(soft[t] for t in found)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield common.struct_array(strict_hits=pa.array(cols[0], pa.int32()), soft_terms=pa.array(cols[1], pa.int32()), soft_weight=pa.array(cols[2], pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, HITS).asNondeterministic()


def judge(pages: DataFrame, url_col: str = "url", rules: list = RULES, strict: list[str] = STRICT, soft: dict = SOFT,
          soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the vocabulary's counts."""
    url = F.col(url_col)
    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"]
    host, path = host_and_path(url)
    rule, verdict = rule_columns(F.col("_h.host"), F.col("_h.path"), rules)
    counted = pages.withColumn("_h", F.struct(host.alias("host"), path.alias("path"), _counter(strict, soft)(lower_ascii(url)).alias("hits")))
    bad = (F.col("_h.hits.strict_hits") > 0) | (F.col("_h.hits.soft_weight") >= soft_limit)
    said = F.coalesce(verdict, F.when(bad, "block").otherwise("allow"))
    result = F.struct(F.col("_h.host").alias("host"), F.col("_h.path").alias("path"), rule.alias("rule"), said.alias("verdict"), "_h.hits.*")
    return common.add_fields(counted, result, names).drop("_h")


def oracle() -> str:
    touch = "(^|[^a-z0-9]){}([^a-z0-9]|$)".format
    strict = " or ".join(f"regexp_matches(u, '{touch(t)}')" for t in STRICT)
    weight = " + ".join(f"case when regexp_matches(u, '{touch(t)}') then {w} else 0 end" for t, w in SOFT.items())
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    rule = " ".join(f"when {f} then '{r}'" for f, r, _ in fits)
    verdict = " ".join(f"when {f} then '{v}'" for f, _, v in fits)
    return f"""
with cut as (
  select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as u,
    case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when ({strict}) or ({weight}) >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict from parts
"""
