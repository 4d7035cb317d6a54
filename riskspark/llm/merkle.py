"""A Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

1. Every row becomes a leaf digest where it is read; only digests, keys and positions are shuffled.
2. Leaves are range partitioned by group and key and numbered from the counts per partition, so a group
   that holds a third of all rows is spread like any other. Every ``arity`` neighbours of a level become their
   parent's digest, until a group has one node, its subroot. One shuffle climbs ``RISE`` levels: it brings
   together the ``arity ** RISE`` neighbours below a node, a fixed number whatever the group's size.
   Subroots in the order of their groups are the leaves of one more such tree: the root.
3. Every node holds the sibling digests on its way to the node ``RISE`` levels above. A self-join on the
   ancestor doubles the distance that every node sees, and its siblings' array continues with its
   ancestor's, until every leaf reaches the root: as many joins as the logarithm of the tree's height. Nodes
   that no longer are an ancestor of that distance leave the table. The ancestors' side is counted in every
   round and broadcast below ``small_bytes``; above it has so many keys that a shuffle is even.

Every climb and round is a checkpoint; nothing but counts and the root comes to the driver.

Null fields have their own mark, so null and empty differ; a null group is one group and comes first;
null keys come first in their group. Repeated rows are leaves of their own, next to each other (ties are
ordered by digest), and each row of the input gives one row. A lone leaf is its group's subroot, a
lone subroot the root, and its proof is empty. Empty tables give no rows. Other input columns, whatever
their names, are left out unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskspark import session
from riskspark.operators import distsort

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEVEL = 56  # bits of a node's name below its climb
TOP = 64  # the subroots' tree counts its climbs from here
RISE = 4  # levels of one climb
SMALL_BYTES = 16_000_000


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) over the fields in order: ``-`` for null, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    spelled = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*spelled).cast("binary"), 256))


def proof_digest(siblings: Column) -> Column:
    """SHA-256 (hex) over all sibling digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda x: hex_text(F.substring(x, 2, 1 << 30))), "").cast("binary"), 256)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root (hex) that a leaf and a proof give."""
    def step(digest: Column, level: Column) -> Column:
        before = 64 * F.substring(level, 1, 1).cast("string").cast("int")
        others = hex_text(F.substring(level, 2, 1 << 30))
        return F.sha2(F.concat(F.left(others, before), digest, F.substr(others, before + 1)).cast("binary"), 256)

    return F.aggregate(siblings, hex_text(leaf), step)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's position in ``order`` (nulls first), from 0."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return distsort.file_row_number(session.cut_lineage(placed), name)


def grow(nodes: DataFrame, most: int, first: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Edges per climb, and the last node of every tree.

    ``nodes`` has base (where a tree starts), m (nodes of the tree's level), j (position among them), id,
    digest and row (what a leaf carries, else null); ``most`` is the largest m, ``first`` the first climb.
    Edges have id, anc, row and siblings: per level one array entry, the count of left siblings, then all digests.
    """
    edges, ends, climb, wide = [], [], 0, arity**RISE
    while most > 1:
        ends.append(nodes.where("m = 1"))
        climb += 1
        runs = nodes.where("m > 1").groupBy("base", "m", F.expr(f"j div {wide}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("j", "id", "digest", "row"))).alias("kids"))
        runs = runs.withColumns({"m0": F.col("m"), "d0": F.transform("kids", lambda k: k.digest)})
        for q in range(1, RISE + 1):  # a tree that has one node left stays as it is
            below = f"d{q - 1}"
            starts = F.sequence(F.lit(0), F.expr(f"(size({below}) - 1) div {arity}"))
            parents = F.transform(starts, lambda i: F.unhex(F.sha2(F.array_join(F.transform(  # noqa: B023
                F.slice(below, i * arity + 1, arity), hex_text), "").cast("binary"), 256)))  # noqa: B023
            runs = runs.withColumn(f"d{q}", F.when(F.col(f"m{q - 1}") > 1, parents).otherwise(F.col(below)))
            runs = runs.withColumn(f"m{q}", F.expr(f"(m{q - 1} + {arity - 1}) div {arity}"))
        runs = session.cut_lineage(runs.select(
            "base", "up", (F.lit((first + climb) << LEVEL) + F.col("base") + F.col("up")).alias("id"), "kids",
            *[f"m{q}" for q in range(RISE + 1)], *[f"d{q}" for q in range(RISE + 1)]))
        kid = runs.select("*", F.posexplode("kids").alias("k", "kid"))
        edges.append(kid.select("kid.id", F.col("id").alias("anc"), "kid.row", F.array_compact(F.array(
            *[F.when(F.col(f"m{q}") > 1, _siblings(f"d{q}", F.expr(f"k div {arity**q}"), arity)) for q in range(RISE)])).alias("siblings")))
        nodes = runs.select("base", F.col(f"m{RISE}").alias("m"), F.col("up").alias("j"), "id", F.get(f"d{RISE}", F.lit(0)).alias("digest"),
                            F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
        most = -(-most // wide)
    ends.append(nodes)
    last = ends[0]
    for more in ends[1:]:
        last = last.unionByName(more)
    return edges, session.cut_lineage(last)


def _siblings(level: str, at: Column, arity: int) -> Column:
    """The count of left siblings of the node at ``at`` of a level, then the siblings' digests."""
    place = F.pmod(at, F.lit(arity))
    run = F.slice(level, (at - place + 1).cast("int"), arity)
    others = F.filter(run, lambda x, i: i != place)
    return F.aggregate(others, place.cast("string").cast("binary"), lambda out, x: F.concat(out, x))


def jump(edges: list[DataFrame], small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(row, siblings) of every leaf, its siblings up to the root; ``edges`` are all climbs, lowest first."""
    now = edges[0]
    for more in edges[1:]:
        now = now.unionByName(more)
    now, seen = session.cut_lineage(now), 1
    while True:
        last = 2 * seen >= len(edges)
        if seen >= len(edges):
            return now.where("row is not null").select("row", "siblings")
        above = now.where(F.col("id") >= F.lit(min(seen, TOP) << LEVEL)).select(
            F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("siblings").alias("more"))
        if above.count() * (80 + 100 * RISE * seen) <= small_bytes:
            above = F.broadcast(above)
        wanted = now.where(F.col("row").isNotNull() | (F.lit(not last) & (F.col("id") >= F.lit(min(2 * seen, TOP) << LEVEL))))
        now = wanted.join(above, "anc", "left").select(
            "id", F.coalesce("next", "anc").alias("anc"), "row",
            F.concat("siblings", F.coalesce("more", F.array().cast(T.ArrayType(T.BinaryType())))).alias("siblings"))
        now, seen = now if last else session.cut_lineage(now), 2 * seen


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "source", key: str = "doc_id", arity: int = 3,
             keep: dict[str, Column] | None = None, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``key``, leaf, subroot, root (binary), siblings (its proof), and ``keep``.

    ``siblings`` has one entry per level up to the root: the count of left siblings as a digit, then
    the siblings' digests, left to right. ``keep`` are columns computed from ``docs`` and carried along.
    """
    fields, keep = fields or FIELDS, keep or {}
    leaves = docs.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                         F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in keep.items()]).alias("kept"))
    leaves = numbered(session.cut_lineage(leaves), ["g", "k", "digest"], "id")
    trees = session.broadcast_if_small(leaves.groupBy("g").agg(F.min("id").alias("base"), F.count("*").alias("m")))
    most, groups = trees.agg(F.max("m"), F.count("*")).first()
    spot = lambda df: df.select("base", "m", "j", "id", "digest", "row")
    nodes = spot(distsort.join_null_safe(leaves, trees, ["g"]).withColumns({
        "j": F.col("id") - F.col("base"), "row": F.struct("k", "digest", "base", "kept")}))
    lower, subroots = grow(nodes, most or 0, 0, arity)
    tops = numbered(subroots.drop("j", "m"), ["base"], "j").withColumns({"tree": F.col("base"), "base": F.lit(0).cast("long"),
                                                                      "m": F.lit(groups).cast("long")})
    upper, root = grow(spot(tops), groups, TOP, arity)
    if lower or upper:
        proofs = jump(lower + upper, small_bytes)
    else:  # one leaf at most
        proofs = nodes.select("row", F.array().cast(T.ArrayType(T.BinaryType())).alias("siblings"))
    first = root.first()
    named = session.broadcast_if_small(subroots.select(F.col("base").alias("tree"), F.col("digest").alias("subroot")))
    return proofs.join(named, F.col("row.base") == F.col("tree")).select(
        F.col("row.k").alias(key), F.col("row.digest").alias("leaf"), "subroot",
        F.lit(bytes(first.digest) if first else b"").alias("root"), "siblings", *[F.col("row.kept")[n].alias(n) for n in keep])


def audit(docs: DataFrame, changed: dict[str, Column], where: Column, **options) -> DataFrame:
    """Proofs checked against changed data, all digests as hex text: key, leaf, subroot, root and proof_sha256 of the
    unchanged data; folded_root from the leaf as it is after ``changed`` fields are replaced ``where`` that
    holds (null: not); verified where it is the root."""
    fields = options.get("fields") or FIELDS
    new = leaf_digest([changed.get(f, F.col(f)) for f in fields])
    found = manifest(docs, keep={"changed": F.when(where, new)}, **options)
    found = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("siblings")))
    names = ["leaf", "subroot", "root"]
    return found.select(options.get("key", "doc_id"), *[hex_text(F.col(n)).alias(n) for n in names],
                        proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == hex_text(F.col("root"))).alias("verified"))


ORACLE = """
with recursive rows as (
  select doc_id, source, lang, n_chars, text,
         list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
           lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, (crc & 1) * 3988292384) end) as crc
  from documents),
spelled as (
  select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
         replace(text, chr(10), '') as flat from rows),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when xor(crc, 4294967295) % 2 = 0 then sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) end as changed,
         row_number() over (partition by source order by doc_id) - 1 as j, count(*) over (partition by source) as m from spelled),
inner_nodes(source, lvl, j, m, h) as (
  select source, 0, j, m, leaf from leaves
  union all
  select source, lvl + 1, j // 3, any_value((m + 2) // 3), sha256(string_agg(h, '' order by j))
  from inner_nodes where m > 1 group by source, lvl, j // 3),
subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as j, count(*) over () as m from inner_nodes where m = 1),
top_nodes(lvl, j, m, h) as (
  select 0, j, m, subroot from subroots
  union all
  select lvl + 1, j // 3, any_value((m + 2) // 3), sha256(string_agg(h, '' order by j)) from top_nodes where m > 1 group by lvl, j // 3),
inner_steps as (
  select a.source, a.lvl, a.j, a.m, coalesce(string_agg(b.h, '' order by b.j) filter (where b.j < a.j), '') as l,
         coalesce(string_agg(b.h, '' order by b.j) filter (where b.j > a.j), '') as r
  from inner_nodes a join inner_nodes b on a.source is not distinct from b.source and a.lvl = b.lvl and a.j // 3 = b.j // 3
  where a.m > 1 group by all),
top_steps as (
  select a.lvl, a.j, coalesce(string_agg(b.h, '' order by b.j) filter (where b.j < a.j), '') as l,
         coalesce(string_agg(b.h, '' order by b.j) filter (where b.j > a.j), '') as r
  from top_nodes a join top_nodes b on a.lvl = b.lvl and a.j // 3 = b.j // 3 where a.m > 1 group by all),
up(doc_id, source, lvl, j, proof, h) as (
  select doc_id, source, 0, j, '', coalesce(changed, leaf) from leaves
  union all
  select u.doc_id, u.source, u.lvl + 1, u.j // 3, u.proof || s.l || s.r, sha256(s.l || u.h || s.r)
  from up u join inner_steps s on u.source is not distinct from s.source and u.lvl = s.lvl and u.j = s.j),
at_subroot as (
  select u.*, s.subroot, s.j as place from up u join subroots s on u.source is not distinct from s.source
  qualify row_number() over (partition by u.doc_id order by u.lvl desc) = 1),
over(doc_id, lvl, j, proof, h) as (
  select doc_id, 0, place, proof, h from at_subroot
  union all
  select o.doc_id, o.lvl + 1, o.j // 3, o.proof || s.l || s.r, sha256(s.l || o.h || s.r)
  from over o join top_steps s on o.lvl = s.lvl and o.j = s.j),
done as (select * from over qualify row_number() over (partition by doc_id order by lvl desc) = 1)
select l.doc_id, l.leaf, a.subroot, t.h as root, sha256(d.proof) as proof_sha256, d.h as folded_root, d.h = t.h as verified
from leaves l join at_subroot a using (doc_id) join done d using (doc_id) cross join (select h from top_nodes where m = 1) t
"""
