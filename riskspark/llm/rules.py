"""Quality rules: repetition limits, and divergence from language references.

Base rules: at least ten words, and at most a fifth of the words in five-word windows that occur twice
or more in the text. The method compares two histograms of a document with references: classes of
characters, and a language's most usual words against all others. The distance is Jensen-Shannon's
(square root of the divergence to base 2); the closest language counts, so a wrong or missing ``lang``
does not reject. References are sums over all documents of each ``lang``, one small array per task
and language before the shuffle. Texts under ``least`` words are too short for a histogram and pass.

Null texts have no words and fail the base; without any document with a language there is no
reference and the method passes all. Repeated rows get equal results; empty tables give no rows;
result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import common

SYMBOLS = b"#*$%&|<>"
CLASS_LIMIT, LEAST = 0.30, 50
WORD_LIMIT = (0.15, 2.0)  # a text of n words may be 0.15 + 2 / sqrt(n) away: short histograms scatter
# Usual words by language, fixed lists.
USUAL = {
    "en": "the of and to in a is that it was for on are with as be at by this from or an have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se il avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
WORDS = sorted({w for words in USUAL.values() for w in words})
PLACE = {w.encode(): i for i, w in enumerate(WORDS)}
CLASSES = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in BASE] + [
    T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])


def _classes() -> np.ndarray:
    """Class of every byte: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 stop, 6 wide, 7 white space."""
    table = np.zeros(256, np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:], table[9:14] = 1, 2, 3, 6, 7
    table[list(SYMBOLS)], table[list(b".,;:?'\"-()")], table[32] = 4, 5, 7
    return table


BYTE_CLASS = _classes()


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) == n:
        return 0
    key = ids[: n - width + 1]
    for k in range(1, width):
        if len(names) >= 4096:  # five names no longer fit 60 bits: ranks of the shorter windows instead
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(names) + ids[k: n - width + 1 + k]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(count[where] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def histograms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Class counts, usual-word counts (the last column: all other words), and the words themselves."""
    data, lengths = common.concat_bytes(texts)
    n, width = len(texts), len(WORDS) + 1
    owner = np.repeat(np.arange(n) * CLASSES, lengths)
    classes = np.bincount(owner + BYTE_CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    split = [t.split() for t in texts]
    usual = np.zeros((n, width), np.int64)
    for i, words in enumerate(split):
        held = np.fromiter((PLACE.get(w, width - 1) for w in map(bytes.lower, words)), np.int64, len(words))
        usual[i] = np.bincount(held, minlength=width)
    return classes, usual, split


def base_counts(text: bytes, words: list[bytes], classes: np.ndarray) -> tuple[int, ...]:
    wide = text.translate(None, bytes(range(128)))
    inner = sum(0x80 <= b < 0xC0 for b in wide) if len(wide) < 64 else int(((np.frombuffer(wide, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text) - int(classes[7]) - inner, int(classes[4]), len(lines) - len(set(lines)), repeated_words(words))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of ``p`` to the histogram ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.clip((part(p) + part(q + 0 * p)) / 2, 0, 1))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word histograms of all documents of each language; languages without a word list are left out."""
    width = CLASSES + len(WORDS) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for part in common.slices(common.byte_texts(batch.column(0))):
                classes, usual, _ = histograms(part)
                both = np.column_stack([classes, usual])
                own = np.array([x or "" for x in langs[at:at + len(part)]])
                at += len(part)
                for lang in set(own.tolist()):
                    total[lang] = total.get(lang, 0) + both[own == lang].sum(axis=0)
        rows = [(lang, i, int(v)) for lang, h in total.items() for i, v in enumerate(h)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["lang", "i", "n"])

    known = docs.where(F.col(lang_col).isin(list(USUAL))).select(text_col, lang_col)
    sums = known.mapInArrow(add, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:  # at most languages x histogram width rows
        out.setdefault(r.lang, np.zeros(width))[r.i] = r.n
    return {lang: (h[:CLASSES], h[CLASSES:]) for lang, h in sorted(out.items()) if h.sum()}


def judge(docs: DataFrame, refs: dict, text_col: str = "text", class_limit: float = CLASS_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT,
          least: int = LEAST) -> DataFrame:
    """``docs`` with the base counts, both distances (six decimals; null where not compared), base_failed and kept."""

    def run(texts: list[bytes]) -> pa.Array:
        classes, usual, split = histograms(texts)
        counts = np.array([base_counts(t, w, c) for t, w, c in zip(texts, split, classes, strict=True)], np.int64).reshape(len(texts), len(BASE))
        near = [np.min([distance(h, r[k]) for r in refs.values()], axis=0) if refs and len(texts) else np.zeros(len(texts))
                for k, h in enumerate((classes, usual))]
        skip = (counts[:, 0] < least) | (not refs)
        return common.struct_array(**{n: counts[:, i] for i, n in enumerate(BASE)},
                                   class_distance=pa.array(np.floor(near[0] * 1e6 + 0.5) / 1e6, mask=skip),
                                   word_distance=pa.array(np.floor(near[1] * 1e6 + 0.5) / 1e6, mask=skip))

    measured = common.add_fields(docs, common.text_udf(run, SCHEMA)(F.col(text_col)), SCHEMA.names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = F.col("class_distance").isNull() | ((F.col("class_distance") <= class_limit) & (F.col("word_distance") <= word_limit[0] + word_limit[1] / F.sqrt("n_words")))
    return common.add_fields(measured, F.struct(failed.alias("base_failed"), (~failed & near).alias("kept")), ["base_failed", "kept"])


def oracle() -> str:
    """The judgement as SQL: words, windows and histogram bins as rows."""
    blank, classes = r"[\x20\x09-\x0D]", {
        "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "stop": r"""[.,;:?''"\-()]""", "white": r"[\x20\x09-\x0D]", "ascii": r"[\x00-\x7F]"}
    rest = lambda p: "[^" + p[1:]
    counted = ", ".join(f"length(regexp_replace(t, '{rest(p)}', '', 'g')) as {n}" for n, p in classes.items())
    langs = ", ".join(f"'{x}'" for x in sorted(USUAL))
    usual = ", ".join(f"('{w}')" for w in WORDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    jsd = lambda name, bins: f"""
{name}_total as (select rid, sum(k)::double as k from {bins} group by rid),
{name}_ref as (select lang, bin, sum(k)::double as k from {bins} join d using (rid) where lang in ({langs}) group by lang, bin),
{name}_ref_total as (select lang, sum(k) as k from {name}_ref group by lang),
{name}_pair as (select x.rid, r.lang, coalesce(x.k, 0) / greatest(x.total, 1) as p, r.k / r.total as q
  from (select b.rid, b.bin, b.k, t.k as total from {bins} b join {name}_total t using (rid)) x
  join (select lang, bin, f.k, g.k as total from {name}_ref f join {name}_ref_total g using (lang) where g.k > 0) r using (bin)),
{name} as (select rid, min(distance) as distance from (
  select rid, lang, sqrt(least(1, greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
    + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as distance from {name}_pair group by rid, lang) group by rid)"""  # noqa: E731
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
cut as (select rid, t, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, strlen(t) as bytes, {counted} from d),
windows as (select rid, unnest(range(1, len(words) - 3)) as i, words from cut where len(words) > 5),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, words[i:i + 4]) as k from windows) where k > 1),
marked as (select rid, count(distinct i + x.step) as n from twice, (select unnest(range(5)) as step) x group by rid),
class_bins as (select rid, unnest(['other', 'lower', 'upper', 'digit', 'symbol', 'stop', 'wide', 'white']) as bin,
  unnest([ascii - lower - upper - digit - symbol - stop - white, lower, upper, digit, symbol, stop, bytes - ascii, white]) as k from cut),
said as (select rid, translate(unnest(words), '{upper}', '{lower}') as word from cut),
usual as (select * from (values {usual}, (' ')) v(bin)),
held as (select rid, case when word in (select bin from usual) then word else ' ' end as bin, count(*) as k from said group by 1, 2),
word_bins as (select d.rid, usual.bin, coalesce(held.k, 0) as k from d cross join usual left join held on held.rid = d.rid and held.bin = usual.bin),
{jsd("near_class", "class_bins")},
{jsd("near_word", "word_bins")},
base as (select cut.rid, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars, symbol as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(marked.n, 0) as n_repeat_words from cut join d using (rid) left join marked using (rid)),
judged as (select base.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  case when n_words >= {LEAST} then floor(near_class.distance * 1e6 + 0.5) / 1e6 end as class_distance,
  case when n_words >= {LEAST} then floor(near_word.distance * 1e6 + 0.5) / 1e6 end as word_distance
  from base left join near_class using (rid) left join near_word using (rid))
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  not base_failed and (class_distance is null or (class_distance <= {CLASS_LIMIT} and word_distance <= {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(n_words))) as kept
from judged
"""
