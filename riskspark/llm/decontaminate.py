"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case, ASCII punctuation removed) fall into hashed terms; document frequencies of all
   documents, summed per task before the shuffle, give the weights.
2. Benchmark items are cut into passages of ``ITEM_WORDS`` words, dealt by hash into blocks of about
   ``BLOCK`` passages. One task per block takes a randomised SVD of its TF-IDF passages: a sketch with
   one power iteration, then the leading ``KEPT`` of the directions, and further ones for passages
   that these do not show.
3. Every window of every document (``2 * STEP`` words, half a window apart) is compared by cosine with all
   passages of a block in its latent space: half windows are summed once, as arrays, and added in pairs. The
   sums are made of entries rounded up to small integers, which never understates a cosine; only windows whose
   rounded cosine suffices are summed exactly. A short passage among rare words, or one that many documents
   share, may have a low cosine though it is there word by word: passages that fit a window are also looked
   for as they are, at every occurrence of their rarest word.
4. A candidate's surroundings are compared word by word: it counts if the longest common subsequence
   within a span of at most one and a half passages covers ``copied`` of the passage, or ``close`` of it while
   the answer (the ``answer`` column, or the item's last sentence) is there too. A passage with fewer than
   ``TELLING`` words that less than a third of the documents hold turns up by chance: it must be there wholly,
   in a span of one and a quarter.

Blocks are read one at a time by the driver and broadcast: their size is bounded by BLOCK, ITEM_WORDS
and KEPT, however large benchmark and corpus are. ``ROUND`` blocks are looked for in one pass; with more blocks
each pass writes what it finds to the shared folder and releases its broadcasts. Documents are never shuffled.

Null and empty texts and items have no words and never match; repeated documents get equal hits;
repeated items hit each; an item's best passage stands for it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskspark import session
from riskspark.llm import common

TERMS = 1 << 17
ITEM_WORDS, ITEM_STEP = 64, 32
STEP = 16  # half a window
BLOCK, KEPT, SHOWN = 256, 0.9, 0.8
TELLING, ROUND = 4, 4
STEP_BYTES = 400_000
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
HIT = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())])


def plain(text: bytes) -> bytes:
    """Lower case, without ASCII punctuation."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(LOWER, PUNCTUATION)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each: no step per word."""
    parts = [plain(t) for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    value = (data.astype(np.uint64) + np.uint64(1)) * POWER[place & (len(POWER) - 1)]
    value *= inside
    h = np.add.reduceat(value, starts)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum([len(x) + 1 for x in parts])
    return h ^ (h >> np.uint64(29)), np.diff(np.searchsorted(starts, ends), prepend=0)


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7) & np.uint64(TERMS - 1)).astype(np.int64)


def answer_of(text: bytes) -> bytes:
    """The last sentence."""
    parts = [p for p in re.split(rb"[.!?\n]+", text) if plain(p).split()]
    return parts[-1] if parts else b""


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each hashed term, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for part in common.slices(common.byte_texts(batch.column(0)), STEP_BYTES):
                hashes, sizes = hashed_words(part)
                held = pa.array(np.repeat(np.arange(len(part)) * TERMS, sizes) + terms_of(hashes)).unique().to_numpy()
                total += np.bincount(held & (TERMS - 1), minlength=TERMS)
                n += len(part)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": np.append(seen, -1), "n": np.append(total[seen], n)})

    rows = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(TERMS + 1, np.int64)
    counts[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return counts[:TERMS], int(counts[TERMS])


def term_weights(frequency: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency, at least 0.3 of a new term's: a passage that very many documents
    share (which makes its words frequent) must still outweigh the rare words around it."""
    top = np.log(n + 2)
    return np.maximum(top - np.log(frequency + 1), 0.3 * top).astype(np.float32)


def latent_block(passages: list[np.ndarray], weight: np.ndarray, kept: float = KEPT, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, directions [term, k], unit passages [passage, k]) of one block by randomised SVD."""
    hashed = [terms_of(p) for p in passages]
    terms = np.unique(np.concatenate(hashed))
    a = np.zeros((len(passages), len(terms)))
    for i, ids in enumerate(hashed):
        np.add.at(a[i], np.searchsorted(terms, ids), weight[ids])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    rank = min(len(passages), len(terms), max(1, int(np.ceil(kept * len(passages)))))
    wide = min(rank + 8, len(passages), len(terms))
    sketch = a @ np.random.default_rng(seed).normal(size=(len(terms), wide))
    sketch = a @ (a.T @ np.linalg.qr(sketch)[0])
    q = np.linalg.qr(sketch)[0]
    directions = np.linalg.svd(q.T @ a, full_matrices=False)[2][:rank].T
    # A passage that the leading directions hardly show adds its own remainder as a direction.
    hidden = a - (a @ directions) @ directions.T
    hidden = hidden[np.linalg.norm(hidden, axis=1) > 1 - SHOWN]
    if len(hidden):
        _, size, more = np.linalg.svd(hidden, full_matrices=False)
        directions = np.linalg.qr(np.column_stack([directions, more[size > 1e-6].T]))[0]
    items = a @ directions
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    return terms, directions.astype(np.float32), items.astype(np.float32)


def blocks(benchmark: DataFrame, weight: np.ndarray, frequency: np.ndarray, n: int, answer_col: str | None = None) -> DataFrame:
    """One pickled block per row: item ids, words and answers of its passages, its terms, and what each
    term adds to the latent product with each passage (weight times directions times latent passages);
    which passages must be there wholly; and the place of the rarest word of those that fit a window, else -1."""
    spark = benchmark.sparkSession
    shared, shared_usual, shared_rank = (spark.sparkContext.broadcast(x) for x in (weight, frequency > n / 3, frequency))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            answers = common.byte_texts(batch.column(2))
            for item, text, answer in zip(batch.column(0).to_pylist(), common.byte_texts(batch.column(1)), answers, strict=True):
                words = hashed_words([text])[0]
                close = hashed_words([answer if plain(answer).split() else answer_of(text)])[0].tobytes()
                for k in range(0, max(1, len(words) - ITEM_STEP), ITEM_STEP):
                    part = words[k:k + ITEM_WORDS]
                    if len(part):
                        out.append((item, k, part.tobytes(), close))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["item_id", "k", "passage", "answer"])

    def fit(group: pa.Table) -> pa.Table:
        passages, answers = ([np.frombuffer(p, np.uint64) for p in group.column(c).to_pylist()] for c in ("passage", "answer"))
        terms, directions, items = latent_block(passages, shared.value)
        product = np.vstack([(directions @ items.T) * shared.value[terms][:, None], np.zeros((1, len(items)), np.float32)])
        wholly = [int((~shared_usual.value[terms_of(p)]).sum()) < TELLING for p in passages]
        rarest = [int(shared_rank.value[terms_of(p)].argmin()) if len(p) <= 2 * STEP else -1 for p in passages]
        held = (group.column("item_id").to_pylist(), [p.tolist() for p in passages], [x.tolist() for x in answers], terms, product, wholly, rarest)
        return pa.table({"block": [pickle.dumps(held)]})

    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    parts = session.cut_lineage(benchmark.select(F.col("item_id").cast("long"), F.col("text"), answer.alias("answer"))
                                .mapInArrow(cut, "item_id long, k long, passage binary, answer binary"))
    count = max(1, -(-parts.count() // BLOCK))
    dealt = parts.withColumn("b", F.pmod(F.xxhash64("item_id", "k", "passage"), F.lit(count)))
    return session.cut_lineage(dealt.groupBy("b").applyInArrow(fit, "block binary"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine step per word of ``b``."""
    place: dict = {}
    for i, word in enumerate(a):
        place[word] = place.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for word in b:
        hit = open_ & place.get(word, 0)
        if hit:
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def spread_length(passage: list, region: list, span: int) -> int:
    """Longest common subsequence of the passage and a stretch of at most ``span`` words of the region."""
    best = common_length(passage, region)
    if len(region) <= span:
        return best
    most, best, held = best, 0, set(passage)
    for i, word in enumerate(region):
        if word in held:
            best = max(best, common_length(passage, region[i:i + span]))
            if best == most:
                break
    return best


def rounded_up(product: np.ndarray) -> tuple[np.ndarray, float]:
    """The product in small integers that are never below it, and their unit."""
    unit = max(float(np.abs(product).max()), 1e-9) / 500
    return np.ceil(product / unit).astype(np.int16), unit


def window_norms(ids: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Norms of windows in which repeated terms count in full."""
    at = start[:, None] + np.arange(2 * STEP)
    inside = at < end[:, None]
    term = np.where(inside, ids[np.minimum(at, len(ids) - 1)], -1)
    times = (term[:, :, None] == term[:, None, :]).sum(axis=2)
    return np.sqrt((np.where(inside, weight[term].astype(np.float64) ** 2, 0) * times).sum(axis=1))


def find(texts: list[bytes], weight: np.ndarray, block: tuple, row: np.ndarray, rough: tuple[np.ndarray, float], cosine: float, copied: float,
         close: float) -> list[list[tuple]]:
    """Hits of every text against one block; ``row`` is a term's row of the product, ``rough`` the product rounded up."""
    items, passages, answers, _, product, wholly, rarest = block
    hits: list[dict] = [{} for _ in texts]
    words, sizes = hashed_words(texts)
    if not len(words):
        return [[] for _ in texts]
    ids, ends = terms_of(words), np.cumsum(sizes)

    def keep(d: int, i: int, near: float, lcs: float, answer: float) -> None:
        new, old = (items[i], min(1.0, near), lcs, answer), hits[d].get(items[i])
        if old is None or (lcs, new[1]) > (old[2], old[1]):
            hits[d][items[i]] = new

    halves = -(-sizes // STEP)
    doc = np.repeat(np.arange(len(texts)), halves)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)
    start = (ends - sizes)[doc] + nth * STEP
    left, none = ends[doc] - start, len(product) - 1  # the last row of the product is zero
    place = np.append(row[ids], np.full(STEP, none))
    small, unit = rough
    score, taken = np.zeros((len(doc), small.shape[1]), np.int16), np.empty((len(doc), small.shape[1]), np.int16)
    for k in range(STEP):
        np.take(small, np.where(k < left, place[start + k], none), axis=0, out=taken, mode="clip")
        score += taken
    norm = np.add.reduceat(weight[ids].astype(np.float64) ** 2, start)
    more = np.flatnonzero(np.append(doc[1:] == doc[:-1], False))  # a half with a successor: windows of two halves
    score[more], norm[more] = score[more] + score[more + 1], norm[more] + norm[more + 1]
    top = score.max(axis=1) * unit / cosine  # the norm up to which a window can reach the cosine
    able = np.flatnonzero(top >= np.sqrt(norm))
    exact = np.concatenate([window_norms(ids, weight, start[part], ends[doc[part]]) for part in np.array_split(able, 1 + len(able) // 1024)])
    for h, size in zip(able[top[able] >= exact].tolist(), exact[top[able] >= exact].tolist(), strict=True):
        d, a = doc[h], start[h]
        end = min(a + 2 * STEP, ends[d])
        near = product[place[a:end]].sum(axis=0) / size
        for i in np.flatnonzero(near >= cosine):
            passage, wanted, n = passages[i], answers[i], len(passages[i])
            region = words[max(ends[d] - sizes[d], a - n):min(ends[d], end + n)].tolist()
            if sum(map(set(region).__contains__, passage)) < close * n:
                continue  # the common subsequence has no other words
            lcs = spread_length(passage, region, n + n // (4 if wholly[i] else 2)) / n
            if lcs < close or (wholly[i] and lcs < 1):
                continue
            answer = common_length(wanted, region) / len(wanted) if wanted else 0.0
            if lcs >= copied or answer >= copied:
                keep(d, i, float(near[i]), lcs, answer)
    heads = {}
    for i, at in enumerate(rarest):
        if at >= 0:
            heads.setdefault(passages[i][at], []).append(i)
    if heads:
        names = np.array(sorted(heads), np.uint64)
        found = np.minimum(np.searchsorted(names, words), len(names) - 1)
        spots = np.flatnonzero(names[found] == words)
        order = spots[np.argsort(found[spots], kind="stable")]
        edges = np.searchsorted(found[order], np.arange(len(names) + 1))
        whose = np.repeat(np.arange(len(texts)), sizes)
        for k, name in enumerate(names.tolist()):
            at = order[edges[k]:edges[k + 1]]
            for i in heads[name]:
                n, first = len(passages[i]), at - rarest[i]
                first = first[(first >= 0) & (first + n <= len(words))]
                first = first[whose[first] == whose[first + n - 1]]
                passage = np.array(passages[i], np.uint64)
                for q in range(n):  # those that agree so far
                    first = first[words[first + q] == passage[q]]
                for d in np.unique(whose[first]).tolist():
                    wanted, mine = answers[i], words[ends[d] - sizes[d]:ends[d]].tolist()
                    keep(d, i, 0.0, 1.0, common_length(wanted, mine) / len(wanted) if wanted else 0.0)
    return [[h[k] for k in sorted(h, key=lambda x: (x is None, x))] for h in hits]


def _finder(shared, shared_weight, cosine: float, copied: float, close: float):
    """The Arrow UDF that finds the hits of one broadcast block."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block, weights = pickle.loads(shared.value), shared_weight.value
        row = np.full(TERMS, len(block[3]), np.int64)
        row[block[3]] = np.arange(len(block[3]))
        rough = rounded_up(block[4])
        for column in batches:
            found = [h for part in common.slices(common.byte_texts(column), STEP_BYTES)
                     for h in find(part, weights, block, row, rough, cosine, copied, close)]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            cols = list(zip(*(x for h in found for x in h), strict=True)) or [(), (), (), ()]
            yield pa.ListArray.from_arrays(pa.array(offsets), common.struct_array(
                item_id=pa.array(cols[0], pa.int64()), cosine=pa.array(cols[1], pa.float64()),
                lcs=pa.array(cols[2], pa.float64()), answer=pa.array(cols[3], pa.float64())))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(HIT)).asNondeterministic()


def rounds(docs: DataFrame, benchmark: DataFrame, cosine: float, copied: float, close: float, text_col: str, answer_col: str | None) -> Iterator[tuple[Column, bool]]:
    """(hits of the next ``ROUND`` blocks as one array column over ``text_col``, whether more follow).

    The blocks' broadcasts are released when the next round is asked for."""
    spark: SparkSession = docs.sparkSession
    frequency, n = document_frequency(docs, text_col)
    weight = term_weights(frequency, n)
    shared_weight = spark.sparkContext.broadcast(weight)
    fitted = blocks(benchmark, weight, frequency, n, answer_col)
    left = fitted.count()
    held: list = []
    for packed in fitted.toLocalIterator():
        held.append(spark.sparkContext.broadcast(bytes(packed.block)))
        left -= 1
        if len(held) == ROUND or not left:
            hits = F.concat(*[_finder(b, shared_weight, cosine, copied, close)(F.col(text_col)) for b in held])
            yield hits, left > 0
            if left:
                for b in held:
                    b.unpersist()
                held = []


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", cosine: float = 0.38, copied: float = 0.8, close: float = 0.6,
                 text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document and benchmark item found in it (its best passage): ``id_col``, item_id, cosine, lcs, answer.

    With a benchmark of several rounds, documents of equal id count as one.
    """
    spark, found, many = docs.sparkSession, None, False
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for hits, more in rounds(rows, benchmark, cosine, copied, close, "text", answer_col):
        ranked = F.array_sort(F.transform("hits", lambda h: F.struct(h.item_id.alias("item_id"), (-h.lcs).alias("a"), (-h.cosine).alias("b"), h.alias("h"))))
        best = F.filter("ranked", lambda h, i: (i == 0) | ~h.item_id.eqNullSafe(F.try_element_at("ranked", i).item_id))  # an item's passages lie in several blocks
        part = rows.select("id", hits.alias("hits")).select("id", ranked.alias("ranked")).select("id", F.explode(best).alias("r")).select("id", "r.h.*")
        many = many or more
        if many:
            path = session.work_path(spark, "hits")
            part.write.parquet(path)
            part = spark.read.parquet(path)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = rows.schema["id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *HIT.fields]))
    if many:
        best = F.max_by(F.struct("cosine", "lcs", "answer"), F.struct("lcs", "cosine")).alias("h")
        found = found.groupBy("id", "item_id").agg(best).select("id", "item_id", "h.*")
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.38, copied: float = 0.8, close: float = 0.6, text_col: str = "text",
          answer_col: str | None = None) -> DataFrame:
    """Documents without a hit, with their columns."""
    spark = docs.sparkSession
    for hits, more in rounds(docs.select(text_col), benchmark, cosine, copied, close, text_col, answer_col):
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col))
        docs = row.withColumn("_found", hits).where(F.size("_found") == 0).select("_row.*")
        if more:
            path = session.work_path(spark, "clean")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
