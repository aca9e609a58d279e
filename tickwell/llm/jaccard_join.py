"""N-gram Jaccard join: an exact metric-space join of shingle sets under Jaccard distance.

Two documents link when ``100 * |A & B| >= percent * |A | B|``, i.e. when their Jaccard
distance is at most eps = 1 - percent / 100. The distance is a metric, so pivots, Voronoi
regions and triangle-inequality windows give an exact join. Texts are special in one way:
nearly all pairs lie at distance 1, where document pivots alone separate nothing. The join
therefore runs in three steps, each exact:

1. *Classes and meeting places.* Equal sets become one class. A class x linked with y misses
   at most n // 4 (for 75 %) of x's shingles, so the n // 4 + 1 rarest shingles of x, in one
   order that holds for all, must include one of y's; likewise for y. Classes that share such
   a shingle, and whose sizes and places in the order still allow the link, meet there. A
   class whose rarest shingles are its own alone links with nothing and stops here.
2. *Pivots and regions.* The smallest class at a meeting place is its pivot, and a pivot's
   region is every class that meets it somewhere; so a linked pair always shares a region.
   Distances to the pivot are a join of sets. A member within eps is linked with the pivot.
   The rest of the region is cut by distance into rings as wide as eps: by the triangle
   inequality a link stays in a ring or crosses to the next one, and the innermost ring
   needs no pairs of its own, as all its members link with the pivot. A large region is
   dealt out in pairs of blocks, of which one task holds two.
3. *Recursion.* Inside a block or pair of blocks, further pivots make Voronoi cells; a set is
   replicated into every cell whose pivot is at most 2 eps farther than its nearest one; cells
   are joined recursively, and by counting common shingles once they are small or their windows
   no longer halve the number of pairs.

Links are used for connected components, so a block returns a spanning forest of its links;
copies are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.llm.components import connected_components
from tickwell.llm.shingles import WIDTH, mix64, shingle_sets, text_buffers
from tickwell.llm.work import free_name, small, stored, table

PERCENT = 75
#: Share of the hash range whose shingles are looked up for their rarity: somewhat over the quarter that a prefix needs.
POOL = 0.30
#: Bounds of a block of a region: members (a count matrix of two blocks is 16 MB) and shingles of all members (2 MB).
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 1 << 18
_LEAF = 64
_COLUMNS = 4096
#: A step of a row-by-row count costs as much as so many of a product.
_DENSE = 150


def set_key(own: np.ndarray) -> int:
    """64-bit hash of a set of shingle hashes."""
    total = mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(total + mix64(np.array([len(own)], np.uint64))).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _shingled(batches: Iterator[pa.RecordBatch], width: int, percent: int, pool: float, whole: bool) -> Iterator[pa.RecordBatch]:
    top = np.uint64(int(pool * 2**64))
    for batch in small(batches):
        ids, n, keys, kept = batch.column(0), [], [], []
        for own in shingle_sets(*text_buffers(batch.column(1)), width):
            n.append(len(own))
            keys.append(set_key(own) if len(own) else None)
            kept.append(own.copy() if whole else own[: max(int(np.searchsorted(own, top)), len(own) - -(-len(own) * percent // 100) + 1)].copy() if len(own) else own)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.int64()), _lists(kept)], ["doc_id", "n", "key", "shingles"])


def shingled(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, pool: float, whole: bool = False) -> DataFrame:
    """doc_id, n (distinct shingles), key (of the set; null if empty), shingles (all if ``whole``, else the pool: those of the lowest hashes, a prefix's worth at least)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_shingled, width=width, percent=percent, pool=pool, whole=whole), "doc_id long, n long, key long, shingles array<long>"
    )


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, key, shared): the regions of the pivots, from the pools of all classes; shared: at how many places they meet."""
    by_token = Window.partitionBy("token")
    rows = sets.where("key IS NOT NULL").select("key", "n", F.size("shingles").alias("pool"), F.explode("shingles").alias("token"))
    rows = rows.withColumn("before", F.lag("key").over(by_token.orderBy("key"))).withColumns({"lo": F.min("key").over(by_token), "hi": F.max("key").over(by_token), "df": F.count(F.lit(1)).over(by_token)})
    rows = rows.where("lo <> hi AND (before IS NULL OR before <> key)").select("key", "n", "pool", "token", "df")

    # The prefix: shingles that no other class has come first, then the rarest.
    by_key = Window.partitionBy("key")
    rows = rows.withColumns({"rank": F.row_number().over(by_key.orderBy("df", "token")), "shared": F.count(F.lit(1)).over(by_key)})
    most_missed = F.expr(f"n - ((n * {percent} + 99) div 100)")
    alone = F.col("pool") - F.col("shared")
    # A pool of no more than a prefix may reach above the cut, where a partner holds shingles outside its own pool: there no shingle counts as missed.
    rest = F.when(F.col("pool") <= most_missed + 1, F.col("n")).otherwise(F.col("n") - alone - F.col("rank") + 1)
    rows = rows.where(F.col("rank") + alone <= most_missed + 1).select("key", "n", "token", rest.alias("rest"))

    # At most min(rest) shingles are common to two sets that meet here first; a link needs percent / (100 + percent) of both sizes.
    p, q = percent, 100 + percent
    index = F.when(q * F.col("rest") >= 2 * p * F.col("n"), F.col("n"))  # could link with a set as large as itself
    rows = rows.withColumns({"least": F.min(index).over(by_token), "most": F.max(index).over(by_token)})
    rows = rows.where(index.isNotNull() | ((q * F.col("rest") >= p * (F.col("n") + F.col("least"))) & (100 * F.col("most") >= p * F.col("n"))))
    rows = rows.withColumn("pivot", F.min("key").over(by_token)).where("pivot <> key")
    return rows.groupBy("pivot", "key").agg(F.count(F.lit(1)).alias("shared"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections: by products of dense slices, or row by row where sets have few of the shingles."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    rows, column = rows[keep], new[column[keep]]
    columns = int(new[-1]) + 1 if len(new) else 0
    total = np.zeros((m, m), np.float32)
    if _DENSE * len(column) < m * columns:
        begin = np.searchsorted(rows, np.arange(m + 1))
        some = np.flatnonzero(np.diff(begin))
        for i in some:
            mine = np.zeros(columns, np.float32)
            mine[column[begin[i] : begin[i + 1]]] = 1
            total[i, some] = np.add.reduceat(mine[column], begin[some])
        return total.astype(np.int64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for a in range(0, columns, _COLUMNS):
        i, j = np.searchsorted(column, [a, a + _COLUMNS])
        dense = np.zeros((m, _COLUMNS), np.float32)
        dense[rows[i:j], column[i:j] - a] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label, len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def voronoi_links(sets: list[np.ndarray], percent: int, members: np.ndarray | None = None, forest: bool = False) -> list[tuple[int, int]]:
    """All linked pairs (positions) of ``sets``, by recursive Voronoi cells with windows; a pair may come more than once.

    With ``forest``, each small cell gives every member with the first of its component there, instead of all pairs.
    """
    members = np.arange(len(sets)) if members is None else members
    eps = 1 - percent / 100
    if len(members) > _LEAF:
        pivots = members[np.linspace(0, len(members) - 1, 8).astype(int)]
        size = np.array([len(sets[i]) for i in members])
        flat, begin = np.concatenate([sets[i] for i in members]), np.concatenate(([0], np.cumsum(size)[:-1]))
        far = np.empty((len(members), len(pivots)))
        for c, p in enumerate(pivots):
            common = np.add.reduceat(np.isin(flat, sets[p]), begin, dtype=np.int64)
            far[:, c] = 1 - common / (size + len(sets[p]) - common)
        window = far <= far.min(axis=1)[:, None] + 2 * eps + 1e-9
        if (window.sum(axis=0) ** 2).sum() <= 0.5 * len(members) ** 2:  # all pairs in the cells are far fewer than all pairs here
            return [x for c in range(len(pivots)) for x in voronoi_links(sets, percent, members[window[:, c]], forest)]
    if len(members) < 2:
        return []
    own = [sets[i] for i in members]
    common = common_counts(own)
    size = np.array([len(s) for s in own])
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if forest:
        first = spanning(linked)
        a = np.flatnonzero(first != np.arange(len(first)))
        b = first[a]
    else:
        a, b = np.nonzero(np.triu(linked, 1))
    return list(zip(members[a].tolist(), members[b].tolist(), strict=True))


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    keys = block["key"].to_numpy()
    column = block["shingles"].combine_chunks()
    at = np.asarray(column.offsets)
    flat = np.asarray(column.flatten()).view(np.uint64)
    sets = [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, j in voronoi_links(sets, percent, forest=True):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            found.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def region_links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes that make the same components as all links do.

    ``regions``: (pivot, key); ``sets``: (key, n, shingles).
    """
    pivots = sets.select(F.col("key").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles"))
    pivots = pivots.join(stored(regions.select("pivot").distinct(), "pivots"), "pivot", "left_semi")
    common = F.size(F.array_intersect("shingles", "pivot_shingles")).cast("long")
    members = regions.select("pivot", "key").join(sets, "key").join(pivots, "pivot").select("pivot", "key", "n", "shingles", common.alias("common"), (F.col("n") + F.col("pivot_n") - common).alias("joint"))
    rings = 100 // (100 - percent)
    inner = int(100 % (100 - percent) == 0)  # whether all of the innermost ring lies within eps
    members = stored(members.select("pivot", "key", "n", "shingles", (100 * F.col("common") >= percent * F.col("joint")).alias("linked"), F.expr(f"({rings} * (joint - common)) div joint").cast("int").alias("ring")), "members")

    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"), F.max("ring").alias("last"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.where(f"members > 1 AND last >= {inner}").select("pivot", blocks.alias("blocks"))
    dealt = members.join(sizes, "pivot").withColumn("cell", F.when(F.col("blocks") == 1, 0).otherwise(F.col("ring") * F.col("blocks") + F.pmod(F.xxhash64("key"), "blocks")).cast("int"))
    near_rings = F.expr(f"filter(array(ring - 1, ring, ring + 1), x -> x BETWEEN 0 AND {rings} AND x + ring >= {inner})")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.flatten(F.transform(near_rings, lambda r: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (r * F.col("blocks") + b).cast("int")))))
    dealt = dealt.withColumn("other", F.explode(others)).select("pivot", F.least("cell", "other").alias("c"), F.greatest("cell", "other").alias("d"), "key", "shingles")

    def joined(block: pa.Table) -> pa.Table:
        return _block_links(block, percent)

    inside = dealt.groupBy("pivot", "c", "d").applyInArrow(joined, "a long, b long")
    return members.where("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b")).unionByName(inside)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, pool: float = POOL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest id reachable over links.

    Null and empty texts, and texts of white space, have no shingles and link with nothing; their
    component is their own id. A text of one to ``width - 1`` words has one shingle and links
    with equal texts. Repeated rows come back once each. A null id stays null and never names a
    component that has another id. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = stored(shingled(docs, "doc_id", "text", width, percent, pool), "sets")
    regions = stored(meetings(sets, percent), "regions")

    # One row for each class: its key and its smallest id, null if it has none.
    classes = stored(sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "classes")
    needed = stored(regions.select("key").unionByName(regions.select(F.col("pivot").alias("key"))).groupBy("key").agg(F.lit(True).alias("needed")), "needed")
    readers = classes.where("doc_id IS NOT NULL").join(needed, "key", "left_semi").select("doc_id")
    unnamed = classes.where("doc_id IS NULL").join(needed, "key", "left_semi").limit(1).count()
    some = docs.join(readers, "doc_id", "left_semi")
    some = some.unionByName(docs.where("doc_id IS NULL")) if unnamed else some
    whole = stored(shingled(some, "doc_id", "text", width, percent, pool, whole=True).where("key IS NOT NULL").select("key", "n", "shingles"), "whole")
    if whole.count() != whole.select("key").distinct().count():  # an id that stands for several texts
        whole = stored(whole.dropDuplicates(["key"]), "whole")
    links = stored(region_links(regions, whole, percent), "pairs")

    # Joins on a root or a key have written tables on both sides, so that Spark can split a large component or class.
    roots = connected_components(links, "a", "b").withColumnRenamed("vertex", "key")
    first = stored(roots.join(classes, "key").groupBy("root").agg(F.min("doc_id").alias("first")), "firsts")
    names = stored(roots.join(first, "root").select("key", "first").join(classes, "key", "right").select("key", F.coalesce("first", "doc_id").alias("name")), "names")
    return sets.join(names, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """One row of ``docs`` for each group of linked documents, that of the smallest id, with all its columns.

    Rows that repeat an id and its text count as one; rows without an id stay, as no group can be named after them.
    """
    groups = stored(jaccard_components(docs, doc_id, text, **options), "groups")
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("head"), F.count(F.lit(1)).alias("rows"))
    # What goes is the smaller side, and a written table has a known size: Spark broadcasts it only where it is small.
    gone_id, text_hash = free_name(docs, "gone"), free_name(docs, "text_hash")
    gone = stored(ids.where("NOT head").select(F.col("doc_id").alias(gone_id)), "gone")
    kept = docs.join(gone, F.col(doc_id) == F.col(gone_id), "left_anti")
    if ids.where("head AND rows > 1").limit(1).count():
        named = kept.where(F.col(doc_id).isNotNull()).withColumn(text_hash, F.xxhash64(F.col(text))).dropDuplicates([doc_id, text_hash]).drop(text_hash)
        return named.unionByName(kept.where(F.col(doc_id).isNull()))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
