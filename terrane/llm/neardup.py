"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Each set is embedded into ``COORDINATES`` minwise tokens. A tree
recursively branches the sets: at every node two coordinates are chosen, and the node's sets go to one child for each
value of either coordinate. Two sets of similarity J share a child with probability 1 - (1-J)^2 and, because
2 J > 1, keep sharing nodes at any depth with a positive probability (0.9375 at J = 0.8; the fixed point of
q = (1 - J + J q)^2 is the chance to lose the pair). Four independent trees lose a pair at exactly 0.8 with
probability below 0.0625^4 = 1.6e-5, and rapidly less above; ``TREES`` sets the recall.

The root and the first levels always hold too much, so three levels are taken at once; below that

* every node links its members to its smallest one (a star, linear in the node);
* small nodes in which more than one component is left are compared exhaustively: pair by pair up to ``TINY_NODE``
  members, and up to ``SMALL_NODE`` (and ``SMALL_NODE_SHINGLES``) in one task by a product of membership matrices, which
  returns no more links than span the node;
* larger ones with more than one component branch again, to ``MAX_DEPTH`` levels. What is left then is compared across
  components by an exact prefix filter: of two sets that are similar enough, the rarest shingles of either (all but
  the share that they must have in common) hold a common one, so members meet by their rare shingles and never all
  with all.

Before that, each member of such a node is bounded by the number of its shingles that stand in any other member of
one: no pair has more in common than the smaller of the two bounds. In a group of loose copies most pairs are ruled
out by these two numbers, and members that can't link to anything leave their nodes.

Every link is confirmed on the full sets (100 * intersection >= 80 * union). Only components matter to the result, so
pairs that are already connected aren't confirmed again, which keeps large groups of near copies linear.

Scale and skew: equal sets collapse to one class by a 128-bit fingerprint first, so thousands of exact copies cost one
row. Node statistics are partial aggregates; rows meet their node's by a broadcast if the nodes are fewer than a checked
bound, which leaves the rows where they are, and by a join that Spark can split otherwise. Sets are
recomputed from the texts of documents that have a candidate only. The embedding, candidates, links and labels are
tables in the shared folder.

Defined cases: a null, empty or wordless text has no shingles and stays alone; fewer words than a shingle make one
shingle of the whole text; very long texts are taken whole, one at a time; rows that share a doc_id count as one
document with all their links; repeated rows each get their row; rows without a doc_id belong to the class of an equal
set (if that has an id) but link nothing; of a group the smallest doc_id is kept, which leaves no ties; ``kept`` is
never null; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .scratch import fresh, materialise, only_columns, small

SHINGLE = 5
SIMILARITY_PERCENT = 80
TREES = 4
LEVELS = 3
COORDINATES = 64
SMALL_NODE = 4096
SMALL_NODE_SHINGLES = 4_000_000
TINY_NODE = 16
MAX_DEPTH = 10
BROADCAST_ROWS = 500_000

_PER_TREE = 2 + 4 + 8
_draw = np.random.default_rng(7)
_A = (_draw.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_B = _draw.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[None, :]
_FACTORS = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row."""
    words, at = W.fingerprints(column, W.SPACED)
    n = np.diff(at)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        rolled += words[i : len(words) - k + 1 + i] * _FACTORS[i]
    rolled = W.mix(rolled)
    for row, first in zip(n.tolist(), at[:-1].tolist(), strict=True):
        if row >= k:
            yield np.unique(rolled[first : first + row - k + 1])
        elif row:
            yield W.mix((words[first : first + row] * _FACTORS[:row]).sum(keepdims=True) + _FACTORS[k + 1 : k + 2] * np.uint64(row))
        else:
            yield np.zeros(0, np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: for each coordinate the least value of a random affine map."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=least)
    return least


def _embedder(k: int):
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 1):
            n, prints, signatures = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(minwise(s).view(np.int32) if len(s) else None)
            flat = np.concatenate([s for s in signatures if s is not None] or [np.zeros(0, np.int32)])
            offsets = np.cumsum([0] + [0 if s is None else COORDINATES for s in signatures], dtype=np.int32)
            signature = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), signature], names=["doc_id", "n_shingles", "print", "signature"])

    return embed


def embed(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    narrow = only_columns(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_embedder(k), "doc_id long, n_shingles long, print binary, signature array<int>")


def _sets_of(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.pieces(batches, 1):
            all_sets = list(shingle_sets(part.column(1), k))
            flat = np.concatenate(all_sets).view(np.int64)
            offsets = np.cumsum([0] + [len(s) for s in all_sets], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "members"])

    return sets


def leaf_keys(trees: int) -> Column:
    """The nodes three levels down: one for each tree and choice of coordinates on the way."""
    sig = lambda i: F.get("signature", F.lit(i))
    keys = []
    for t in range(trees):
        base = t * _PER_TREE
        for leaf in range(8):
            first, second = leaf >> 2, leaf >> 1
            path = [base + first, base + 2 + second, base + 6 + leaf]
            keys.append(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t * 8 + leaf), *[sig(i % COORDINATES) for i in path]).alias("node")))
    return F.array(*keys)


def child_keys(depth: int) -> Column:
    """A node's children one level further down; each node draws its two coordinates by hash, none of its tree's own."""
    keys = []
    for choice in range(2):
        drawn = F.pmod(F.xxhash64("node", F.lit(depth), F.lit(choice), F.lit("coordinate")), F.lit(COORDINATES - _PER_TREE)).cast("int")
        coordinate = (F.col("tree") * _PER_TREE + _PER_TREE + drawn) % COORDINATES
        keys.append(F.struct("tree", F.xxhash64("node", F.lit(depth), F.lit(choice), F.get("signature", coordinate)).alias("node")))
    return F.array(*keys)


def _node_links(percent: int):
    def links(node: pd.DataFrame) -> pd.DataFrame:
        """Compare all members of a node; links that span what they connect, between different labels only."""
        sets, ids, labels = node["members"].tolist(), node["id"].tolist(), node["label"].tolist()
        n = np.array([len(s) for s in sets])
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = df[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            i, j = np.searchsorted(column, [lo, lo + 2048])
            block = np.zeros((len(sets), 2048), np.float32)
            block[row[i:j], column[i:j] - lo] = 1
            both += block @ block.T
        root = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in range(len(sets) - 1):
            hit = both[i, i + 1 :] * 100 >= (n[i] + n[i + 1 :] - both[i, i + 1 :]) * percent
            for j in (np.flatnonzero(hit) + i + 1).tolist():
                x, y = find(labels[i]), find(labels[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def near(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if small(table, BROADCAST_ROWS) else table


class _Join:
    def __init__(self, docs: DataFrame, classes: DataFrame, doc_id: str, text: str, k: int, percent: int, shared: DataFrame | None) -> None:
        """``shared``: the ids that several classes have, None without any."""
        self.docs, self.classes, self.doc_id, self.text, self.k, self.percent, self.shared = docs, classes, doc_id, text, k, percent, shared
        self.spark = docs.sparkSession
        self.bounds = classes.select("id", "n", F.col("n").alias("shared"))
        self.labels: DataFrame | None = None
        self.links: list[DataFrame] = []

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("members").alias("in_a"))
        right = sets.select(F.col("id").alias("b"), F.col("members").alias("in_b"))
        both = F.size(F.array_intersect("in_a", "in_b"))
        hit = both * 100 >= (F.size("in_a") + F.size("in_b") - both) * self.percent
        return pairs.join(left, "a").join(right, "b").where(hit).select("a", "b")

    def sets(self, grouped: DataFrame) -> DataFrame:
        ids = materialise(grouped.select("id").distinct(), "candidates")
        narrow = only_columns(self.docs, self.doc_id, self.text).select(F.col(self.doc_id).cast("long").alias("id"), F.col(self.text).alias("text"))
        chosen = narrow.join(F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids, "id", "left_semi")
        sets = chosen.mapInArrow(_sets_of(self.k), "id long, members array<long>")
        return materialise(sets if self.shared is None else sets.distinct(), "sets")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that may be similar enough by their sizes and by what each shares with any other candidate."""
        a, b = self.bounds.toDF("a", "n_a", "shared_a"), self.bounds.toDF("b", "n_b", "shared_b")
        return pairs.join(a, "a").join(b, "b").where(self.may_link()).select("a", "b")

    def may_link(self) -> Column:
        most = F.least("shared_a", "shared_b", "n_a", "n_b")
        return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * self.percent

    def bound(self, sets: DataFrame, mixed: DataFrame) -> None:
        """For the members of mixed nodes, count the shingles that stand in another member of a mixed node.

        No two of them have more in common than either's count, which rules most pairs out without their sets. Ids of
        several sets keep the sets' sizes as their bound.
        """
        ids = mixed.select("id").distinct()
        shingles = sets.join(ids, "id", "left_semi").select("id", F.explode("members").alias("shingle"))
        lonely = shingles.groupBy("shingle").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1")
        lonely = lonely.groupBy("id").agg(F.count("*").alias("lonely"))
        if self.shared is not None:
            lonely = lonely.join(self.shared, "id", "left_anti")
        counted = self.classes.select("id", "n").join(ids, "id", "left_semi").join(lonely, "id", "left")
        self.bounds = materialise(counted.select("id", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("shared")), "bounds")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs that aren't connected yet."""
        if self.labels is None:
            return pairs
        a, b = self.labels.toDF("a", "label_a"), self.labels.toDF("b", "label_b")
        joined = pairs.join(a, "a", "left").join(b, "b", "left")
        return joined.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")

    def link(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Confirm pairs and take the links into the components."""
        self.take(self.confirmed(pairs, sets))

    def take(self, links: DataFrame) -> None:
        found = materialise(links, "links")
        if found.isEmpty():
            return
        self.links.append(found)
        union = self.links[0]
        for more in self.links[1:]:
            union = union.unionAll(more)
        self.labels = connected_components(union)

    def grouped(self, rows: DataFrame) -> DataFrame:
        """The members of nodes that hold more than one: node, tree, id, m members, a the least of them."""
        nodes = materialise(rows.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("a")).where("m > 1"), "nodes")
        return materialise(rows.join(near(nodes), "node"), "grouped")

    def stars(self, grouped: DataFrame) -> DataFrame:
        return grouped.where("id <> a").select("a", F.col("id").alias("b")).distinct()

    def run(self, trees: int) -> DataFrame | None:
        grouped = self.grouped(self.classes.select("id", F.inline(leaf_keys(trees))))
        pairs = materialise(self.possible(self.stars(grouped)), "pairs")
        if pairs.isEmpty():
            return None
        sets = self.sets(grouped)
        tried = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
        self.link(tried, sets)
        mixed = self.mixed_nodes(grouped)
        self.bound(sets, mixed)
        left = materialise(self.possible(self.apart(pairs.join(tried, ["a", "b"], "left_anti"))), "pairs")
        if not left.isEmpty():
            self.link(left, sets)
            tried = tried.unionAll(left)
        small_node = (F.col("m") <= SMALL_NODE) & (F.col("shingles") <= SMALL_NODE_SHINGLES)
        for depth in range(LEVELS, MAX_DEPTH + 1):
            # Nodes of two stay: others may have left, so that their pair needn't have been a star's.
            mixed = self.mixed_nodes(mixed)
            if mixed.isEmpty():
                break
            last = depth == MAX_DEPTH
            by_pairs = F.lit(True) if last else F.col("m") <= TINY_NODE
            found = self.sharing(mixed.select("id", "label").distinct(), sets) if last else self.across(mixed.where(by_pairs))
            left = materialise(found.join(tried, ["a", "b"], "left_anti"), "pairs")
            members = mixed.where(~by_pairs & small_node).select("node", "id", "label").join(sets, "id")
            inside = members.groupBy("node").applyInPandas(_node_links(self.percent), "a long, b long").distinct()
            self.take(self.confirmed(left, sets).unionAll(inside))
            if last:
                break
            large = mixed.where(~by_pairs & ~small_node).select("node", "tree", "id").join(self.classes.select("id", "signature"), "id")
            mixed = self.grouped(large.select("id", F.inline(child_keys(depth))).distinct())
            if mixed.isEmpty():
                break
            tried = tried.unionAll(left)
            pairs = materialise(self.possible(self.apart(self.stars(mixed))).join(tried, ["a", "b"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                self.link(pairs, sets)
                tried = tried.unionAll(pairs)
        return self.labels

    def mixed_nodes(self, grouped: DataFrame) -> DataFrame:
        """Members that may link to any other, of nodes that hold more than one component of them: node, tree, id, label, m, shingles."""
        can = self.bounds.groupBy("id").agg(F.min("n").alias("fewest"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.max(F.col("shared") / F.col("n")).alias("part"))
        can = can.where(F.col("part") * 100 >= self.percent - 1e-6).drop("part")
        members = grouped.select("node", "tree", "id").join(can, "id")
        if self.labels is None:
            members = members.withColumn("label", F.col("id"))
        else:
            members = members.join(self.labels.toDF("id", "known"), "id", "left").withColumn("label", F.coalesce("known", "id")).drop("known")
        members = materialise(members.select("node", "tree", "id", "label", "fewest", "n", "shared"), "members")
        # The other set has as many shingles as the node's smallest at least, which leaves less to share.
        least = members.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("fewest").alias("least")).where("lo < hi").select("node", "least")
        union = F.col("n") + F.greatest("least", "shared") - F.col("shared")
        fits = F.col("shared") * 100 >= union * self.percent
        members = members.join(near(materialise(least, "least")), "node")
        if self.shared is not None:
            # An id of several sets stays: its columns speak of different ones.
            members = members.join(near(self.shared.withColumn("several", F.lit(True))), "id", "left")
            fits = fits | F.col("several").isNotNull()
        members = materialise(members.where(fits).select("node", "tree", "id", "label", "n"), "members")
        mixed = members.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        mixed = materialise(mixed.select("node", "m", "shingles"), "nodes")
        return materialise(members.select("node", "tree", "id", "label").join(near(mixed), "node"), "mixed")

    def sharing(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of ``(id, label)`` in different components that share one of their rare shingles and may be similar enough.

        Of a set of n shingles, ordered by how many members hold each, the first n - ceil(percent n) + 1 are looked at:
        a set with so much in common with it holds one of these among its own first.
        """
        one = sets.join(members.select("id"), "id", "left_semi").select("id", F.monotonically_increasing_id().alias("part"), "members")
        one = materialise(one.withColumn("size", F.size("members").cast("long")), "left")
        shingles = one.select("id", "part", "size", F.explode("members").alias("shingle"))
        often = shingles.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
        known = shingles.join(often, "shingle")
        # Shingles that stand nowhere else come first in the order and join nothing.
        order = F.col("size") - F.count("*").over(Wd.partitionBy("id", "part")) + F.row_number().over(Wd.partitionBy("id", "part").orderBy("often", "shingle"))
        first = F.col("size") - F.ceil(F.col("size") * self.percent / 100 - 1e-9) + 1
        rare = known.withColumn("order", order).where(F.col("order") <= first)
        rare = materialise(rare.select("id", "size", "shingle").join(members, "id"), "rare")
        a, b = (rare.select("shingle", *[F.col(c).alias(f"{c}_{d}") for c in ("label", "size")], F.col("id").alias(d)) for d in "ab")
        fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * self.percent
        return self.possible(a.join(b, "shingle").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & fits).select("a", "b").distinct())

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs of one node that are in different components and may be similar enough."""
        m = members.select("node", "id", "label").join(self.bounds, "id")
        a, b = (m.select("node", *[F.col(c).alias(f"{c}_{d}") for c in ("label", "n", "shared")], F.col("id").alias(d)) for d in "ab")
        return a.join(b, "node").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & self.may_link()).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = SIMILARITY_PERCENT, trees: int = TREES) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    rows = materialise(embed(docs, doc_id, text, k), "embedded")
    classes = rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    with_id = classes.where("id is not null")
    # Classes that share an id are one document; each keeps its own place in the trees.
    repeated = materialise(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    shared, same_document = None, None
    if not repeated.isEmpty():
        several = with_id.groupBy("id").count().where("count > 1").select("id")
        shared = materialise(several, "shared")
        again = rows.where("print is not null").join(near(repeated), "doc_id").select("doc_id", "print").distinct().join(with_id.select("print", "id"), "print")
        same_document = materialise(again.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"), "links")
    join = _Join(docs, with_id, doc_id, text, k, percent, shared)
    if same_document is not None and not same_document.isEmpty():
        join.links.append(same_document)
    labels = join.run(trees)
    if labels is None and join.links:
        labels = connected_components(join.links[0])
    if labels is None:
        labels = rows.sparkSession.createDataFrame([], "id long, label long")
    members = classes.join(labels, "id", "left").where("copies > 1 or label is not null").select("print", F.coalesce("label", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "print").join(members, "print", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id.

    Of that document's rows one stays for each different text, the first of the rows as JSON. Of rows without a doc_id
    those stay that copy no other row's text, one for each text.
    """
    found = materialise(near_duplicates(docs, doc_id, text, **more), "found")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest, rank = fresh(docs, "digest", "rank")
    content = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)

    def once(rows: DataFrame, *by: str) -> DataFrame:
        order = Wd.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(F.to_json(F.struct(*columns)))
        return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)

    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.where(F.col(f"`{doc_id}`").isNotNull())
    kept = named.join(near(materialise(gone, "gone")), doc_id, "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(doc_id))
    twice = materialise(twice, "repeated")
    if not twice.isEmpty():
        again = once(kept.join(near(twice), doc_id, "left_semi").withColumn(digest, content), doc_id, digest).drop(digest)
        kept = kept.join(near(twice), doc_id, "left_anti").unionByName(again)
    if not found.where("doc_id is null").isEmpty():
        alone = once(docs.where(F.col(f"`{doc_id}`").isNull()).withColumn(digest, content), digest)
        kept = kept.unionByName(alone.join(named.select(content.alias(digest)), digest, "left_anti").drop(digest))
    return kept.select(*columns)


def oracle_sql(k: int) -> str:
    """The same rows by a self-join on shingles, for small tables."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({fold}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {k - 1}) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= {SIMILARITY_PERCENT} * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, b AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other),
least AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
"""
