"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, exact shingle sets decide.

Every text has TREES labels of LABEL levels, one MinHash value a level. A tree is a prefix trie of its labels: the
entries of all trees are sorted by (tree, label), and neighbours in that order show how long a prefix they share. A text
starts from its full labels and shortens the prefix, level by level, until partners at the threshold are found with
probability TARGET. How short that is hangs on the text: the Jaccard index of a set of n shingles takes few values from
the threshold on, and the fewer shingles, the higher the least of them. Pairs meet at the deeper of their two stops.

What shares a prefix is a group. Groups of the same members are one, groups within others go. Each group is compared
exactly, in blocks, so that no pair is ever a row; a pair that several groups share counts in the first of them. Only
verified links are joined to classes. Texts of equal shingle sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import cut, hot_join
from inkgrid.llm.components import components
from inkgrid.llm.words import U, Words, blank_table, mixed, slices, splitmix

THRESHOLD = 0.8
TREES, LABEL = 24, 8
TARGET = 0.9999
#: Sets of more shingles stop where a pair at the threshold itself is found.
SMALL = 200
#: Texts, and bytes of shingle sets, of a group that one task compares with as many others.
BLOCK_TEXTS, BLOCK_BYTES = 256, 8 << 20
#: Columns of the shingle-by-text table that are multiplied at once; shingles of fewer texts than RARE are counted pair by pair.
STRIP, RARE = 4096, 6
WIDTH = 2 * LABEL


def least_similarity(n: int) -> float:
    """The least Jaccard index, THRESHOLD or more, that a set of n elements can have with another set; 1 if there is none."""
    limit, best = Fraction(THRESHOLD).limit_denominator(1000), Fraction(1)
    for gone in range(n):
        most = (n - gone) / limit - n  # elements that the other set may have beyond the common ones
        if most < 0:
            break
        if gone or most >= 1:
            best = min(best, Fraction(n - gone, n + int(most)))
    return float(best)


def stop_depth(n: int) -> int:
    """The longest prefix by which a text of n shingles finds any partner with probability TARGET at least."""
    least, depth = THRESHOLD if n > SMALL else least_similarity(n), LABEL
    while depth > 1 and 1 - (1 - least**depth) ** TREES < TARGET:
        depth -= 1
    return depth


SIGNED = "id binary, doc_id bigint, node binary, n int, stop int, labels binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, doc_id, text): digest of the shingle set (none for a text without words), its size, stop and labels."""
    turn, shift = splitmix(TREES * LABEL, 21) | U(1), splitmix(TREES * LABEL, 22)
    stops = np.array([stop_depth(n) for n in range(SMALL + 2)])
    names, kinds = [f.split()[0] for f in SIGNED.split(", ")], (pa.binary(), pa.int32(), pa.int32(), pa.binary())
    for batch in slices(batches, 2):
        words = Words(batch.column(2), blank_table())
        shingles, counts, _ = words.shingles()
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        levels = np.zeros((len(full), TREES * LABEL), ">u2")
        for k in range(TREES * LABEL if len(full) else 0):
            with np.errstate(over="ignore"):
                levels[:, k] = mixed(np.minimum.reduceat((shingles ^ shift[k]) * turn[k], starts)) >> U(48)
        sets = [np.unique(s) for s in np.split(shingles, starts[1:])] if len(full) else []
        sizes = np.array([len(s) for s in sets], np.int64)
        found = (
            [blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            sizes,
            stops[np.minimum(sizes, SMALL + 1)] if len(full) else sizes,
            [row.tobytes() for row in levels],
        )
        columns = []
        for values, kind in zip(found, kinds):
            column = np.full(len(counts), None, object)
            column[full] = np.array([*values, None], object)[:-1]
            columns.append(pa.array(column, kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)


MEMBERS = "node binary, gid bigint, n int"


def shared_prefixes(tree: np.ndarray, label: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, group) by depth, from the full label up, of sorted entries that share a prefix at the depth they have to meet at.

    A depth is asked by the entries that stop there; with them meet all that stop there or above. The first and the last run
    of equal prefixes may go on outside and are kept whatever they hold.
    """
    same = np.cumprod((label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(1) if len(tree) else np.zeros(0, int)
    for depth in range(LABEL, int(stop.min(initial=LABEL)) - 1, -1):
        run = np.cumsum(np.r_[False, same < depth])[: len(tree)]
        taking = stop <= depth
        size, asked = np.bincount(run, taking), np.bincount(run, stop == depth)
        wanted = (size > 1) & (asked > 0)
        wanted[[0, -1]] = True
        rows = np.flatnonzero(wanted[run] & taking)
        group = mixed(tree[rows].astype(U) * U(LABEL + 1) + U(depth))
        with np.errstate(over="ignore"):
            for level in range(depth):
                group = mixed(group * U(0x9E3779B97F4A7C15) + label[rows, level].astype(U))
        yield rows, group


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries (tree, label, node, n, stop) sorted by tree and label: the groups of each node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, n, stop = (batch.column(k).to_numpy() for k in (0, 3, 4))
        label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, LABEL)
        for rows, group in shared_prefixes(tree, label, stop):
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows)), pa.array(group.view(np.int64)), pa.array(n[rows], pa.int32())], names=["node", "gid", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column becomes the sorted distinct shingles, packed."""
    for batch in slices(batches, 1):
        words = Words(batch.column(1), blank_table())
        shingles, counts, _ = words.shingles()
        packed = [np.unique(s).tobytes() for s in np.split(shingles, np.cumsum(counts)[:-1])]
        columns = [c if k != 1 else pa.array(packed, pa.binary()) for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "weight", "groups"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets has in common: products of strips of the incidence table."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(values)])
    # Counts in floats are exact below 2^24, which a set has to reach first.
    kind = np.float32 if max(map(len, sets), default=0) < 1 << 24 else np.float64
    total = np.zeros((n, n), kind)
    rare = RARE if n > 64 else 1
    for k in range(2, rare + 1):
        if (size == k).any():
            held = owner[first[size == k][:, None] + np.arange(k)]
            cells = np.concatenate([held[:, i] * n + held[:, j] for i in range(k) for j in range(k) if i != j])
            total += np.bincount(cells, minlength=n * n).reshape(n, n)
    keep = np.repeat(size > rare, size)
    owner, column = owner[keep], (np.cumsum(size > rare) - 1).repeat(size)[keep]
    for at in range(0, int((size > rare).sum()), STRIP):
        a, b = np.searchsorted(column, [at, at + STRIP])
        strip = np.zeros((n, int(column[b - 1]) + 1 - at), kind)
        strip[owner[a:b], column[a:b] - at] = 1
        total += strip @ strip.T
    return total


def _compare(gid: int, nodes: list[bytes], blocks: list[int], groups: list[np.ndarray], weights: list[int], sets: list[np.ndarray]) -> list[tuple[bytes, bytes, int, bool]]:
    """(node, least node that it is linked to here, texts linked to it here for the first time, whether it is elsewhere too)."""
    size = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    linked = common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-3
    np.fill_diagonal(linked, False)
    at = np.array(blocks)
    if (at != at[0]).any():
        linked &= at[:, None] != at[None, :]
    earlier = [g[g < gid] for g in groups]
    fresh = linked & (common_counts(earlier) == 0) if sum(len(g) > 0 for g in earlier) > 1 else linked
    counts = fresh @ np.array(weights, np.int64)
    out, seen = [], np.zeros(len(nodes), bool)
    for k in np.flatnonzero(linked.any(1)):
        if seen[k]:
            continue
        group, wave = {int(k)}, [int(k)]
        while wave:
            reached = set(np.flatnonzero(linked[wave].any(0)).tolist()) - group
            group |= reached
            wave = list(reached)
        members = sorted(group)
        seen[members] = True
        root, split = min(nodes[m] for m in members), any(len(groups[m]) > 1 for m in members)
        out += [(nodes[m], root, int(counts[m]), split) for m in members]
    return out


LINKS = "node binary, root binary, links bigint, split boolean"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, gid, node, block, blocks, groups, weight, shingles) come sorted by cell; each cell is compared when it is complete."""
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[2]: r for r in rows}.values())
        found = []
        if len(rows) > 1:
            _, gids, nodes, at, blocks, groups, weights, sets = zip(*rows)
            found = _compare(gids[0], nodes, at, [np.array(g, np.int64) for g in groups], weights, [np.frombuffer(s, U) for s in sets])
            found = [(*r[:3], r[3] or blocks[0] > 1) for r in found]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 4, kinds)], names=[f.split()[0] for f in LINKS.split(", ")])

    cell, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != cell and rows:
                yield made(rows)
                rows = []
            cell = row[0]
            rows.append(row)
    if rows:
        yield made(rows)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) with `id`, the digest of the text: equal texts are one class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("id", F.unhex(F.md5("text")))


def groups_of(nodes: DataFrame) -> DataFrame:
    """node, groups (gid and blocks of each): the groups that must be compared; for nodes (node, n, stop, labels)."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    entries = nodes.select("node", "n", "stop", "labels", tree).select("tree", F.substring("labels", F.col("tree") * WIDTH + 1, F.lit(WIDTH)).alias("label"), "node", "n", "stop")
    # Sorted by node too, so that a label that very many texts share is dealt over several ranges.
    ordered = entries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    members = cut(ordered.mapInArrow(_tries, MEMBERS))
    total = members.count()
    who = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    groups = members.groupBy("gid").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), who(1).alias("x"), who(2).alias("y")).filter("size > 1")
    groups = groups.groupBy("size", "shingles", "x", "y").agg(F.min("gid").alias("gid"))
    held = cut(hot_join(members.select("node", "gid"), groups.select("gid", "size", "shingles", F.col("size").alias("rows")), "gid", "rows", total))
    # A group within another one lies within the least of its members' largest groups, or else is kept: no pair of groups is a row.
    top = held.groupBy("node").agg(F.max(F.struct("size", "gid")).alias("top"))
    inside = held.join(top, "node").groupBy("gid").agg(F.first("size").alias("size"), F.min("top").alias("top")).filter("top.size > size")
    inside = cut(inside.select("gid", "size", F.col("top.gid").alias("other"), F.col("size").alias("rows")))
    asked = hot_join(held.select("node", "gid"), inside, "gid", "rows", total).join(held.select("node", F.col("gid").alias("other")), ["node", "other"], "left_semi")
    within = asked.groupBy("gid").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n = size").select("gid")
    left = cut(held.groupBy("gid").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")).join(within, "gid", "left_anti"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    sized = left.select("gid", blocks.alias("blocks"), F.col("size").alias("rows"))
    return hot_join(held.select("node", "gid"), sized, "gid", "rows", total).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("gid", "blocks"))).alias("groups"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, linked): classes has id, first_doc, n_copies, node, weight for every distinct text; linked has node, root, links.

    A node is a shingle set, null for texts without words; weight tells how many different texts have it; links counts the
    texts of other nodes that are linked to it.
    """
    rows = _identified(docs)
    signed = rows.select("id", "doc_id", "text").mapInArrow(_sign, SIGNED)
    any_ = [F.any_value(c).alias(c) for c in ("node", "n", "stop", "labels")]
    classes = cut(signed.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_copies"), *any_))
    nodes = classes.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "first_doc")).alias("first"), F.count("*").alias("weight"), *any_[1:])
    nodes = cut(nodes)
    groups = groups_of(nodes.select("node", "n", "stop", "labels"))
    wanted = nodes.select("node", "first.id", F.xxhash64("first.first_doc").alias("doc"), "weight").join(groups, "node")
    texts = rows.withColumn("doc", F.xxhash64("doc_id")).join(wanted, ["id", "doc"]).select("node", "text", "weight", "groups")
    sets = texts.mapInArrow(_sets, "node binary, shingles binary, weight bigint, groups array<struct<gid:bigint,blocks:int>>")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), n).cast("int")
    cells = sets.select("node", "shingles", "weight", F.col("groups.gid").alias("groups"), F.explode("groups").alias("g"))
    cells = cells.select("node", "shingles", "weight", "groups", "g.*", block(F.col("g.blocks")).alias("block"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("gid", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    cells = cells.select(cell, "gid", "node", "block", "blocks", "groups", "weight", "shingles")
    found = cut(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, LINKS))
    # What stands in one cell only is settled there; links from several cells are joined to classes.
    parts = found.filter("split")
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    linked = found.filter("not split").select("node", "root", "links").unionByName(counts.join(roots, "node").select("node", "root", "links"))
    return classes.drop("n", "stop", "labels").join(nodes.select("node", "weight"), "node", "left"), linked


def _known(docs: DataFrame) -> DataFrame:
    """id, first_doc, n_copies, n_links, root of every distinct text; root is the same for all texts of a class."""
    classes, linked = links(docs)
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return classes.join(linked, "node", "left").select("id", "first_doc", "n_copies", n_links.alias("n_links"), F.coalesce("root", "node", "id").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, first_copy for every row of `docs`.

    Similarity is the Jaccard index of the sets of five-word shingles (words stand between white space; a text of fewer
    words has one shingle, all of them). class_id is the least doc_id of all texts that chains of links of THRESHOLD or
    more join; n_links counts the *different texts* that are linked to the row's text, so that copies are not expanded
    into pairs; n_copies counts the rows with the same text, first_copy is their least doc_id. Null texts count as empty;
    texts without words have no links, though equal ones are copies. Rows that repeat a doc_id are rows of their own;
    null ids come out only where a class has no other id. An empty table gives no rows; other columns are ignored.
    """
    known = cut(_known(docs))
    total = known.agg(F.count("*"), F.sum("n_copies")).first()
    firsts = known.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.count("*").alias("rows"))
    known = hot_join(known, firsts, "root", "rows", total[0]).select("id", "class_id", "n_links", "n_copies", F.col("first_doc").alias("first_copy"), F.col("n_copies").alias("rows"))
    return hot_join(_identified(docs).select("doc_id", "id"), known, "id", "rows", total[1] or 0).select("doc_id", "class_id", "n_links", "n_copies", "first_copy")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, that stand for their class: the least doc_id (null only if there is no other), once.

    Where several rows have the same doc_id and text, the one whose columns come first as JSON stays, so that reruns agree.
    Null and empty texts are one class. An empty table gives no rows.
    """
    best = _known(docs).groupBy("root").agg(F.min(F.struct(F.col("first_doc").isNull().alias("no"), F.col("first_doc").alias("doc"), F.col("id").alias("id"))).alias("b"))
    kept = best.select("b.id", F.xxhash64("b.doc").alias("doc"))
    # The caller's columns are one column here, so that no name of theirs can clash.
    own: Column = F.struct(*docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(own.alias("row"), F.unhex(F.md5(text)).alias("id"), F.xxhash64("doc_id").alias("doc"))
    repeated = marked.groupBy("id", "doc").count().filter("count > 1").limit(1).count()
    out = marked.join(kept, ["id", "doc"], "left_semi")
    if repeated:
        out = out.groupBy("id", "doc").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select("row.*")
