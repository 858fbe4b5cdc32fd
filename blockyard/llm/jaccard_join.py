"""N-gram Jaccard join by chosen paths.

Every document is the set of its five-word shingles; equal sets collapse to one node first, so copies never meet in
pairs. A run samples one token of a set at each level as the smallest under that level's hash order, so two sets
choose the same token with a chance equal to their similarity. Nodes with the same path share a bucket: small buckets
are compared at once, larger ones split on the next sampled token. ``runs_for`` gives the runs that reach the target
recall. A bucket that is large after all levels is dense: it is thinned in blocks, where nodes whose sampled tokens
nearly agree with a leader's are tied to that leader and leave, until what stays is small.

Buckets are compared on the sampled tokens alone; the groups they connect are then verified on whole sets, and links are
counted exactly. Small groups compare all pairs. In a large group every node is first compared with one centre c: the
symmetric difference d is a metric, so d(x, c) + d(y, c) decides most pairs without comparing x and y, and a histogram of
distances counts them. Only pairs it leaves open are compared, in tiles, one row per node and tile, never a row per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .scratch import fresh, small_batches, store

DEPTH = 3


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, even where all levels are used."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _sketches(docs: DataFrame, runs: int, depth: int, shingle: int) -> DataFrame:
    """Per row: doc_id, node (128-bit digest of the set; null for an empty set), n, sig (sampled tokens, 16 bits each), paths."""
    k = runs * depth

    def sketch(batches):
        a, b = tn.odd(k, 11)[:, None], tn.odd(k, 13)[:, None]
        for batch in tn.slices(batches):
            buf, offs = tn.utf8(batch.column("text"))
            _, _, rows, hashes = tn.words(buf, offs)
            nodes, sizes, sigs, paths = [], [], [], []
            for s in tn.shingle_sets(hashes, rows, batch.num_rows, shingle):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), sigs.append(None), paths.append(None)
                    continue
                nodes.append(np.array([tn.mix(s + np.uint64(17)).sum(dtype=np.uint64), np.bitwise_xor.reduce(tn.mix(s ^ np.uint64(23)))]).tobytes())
                low = np.full((k, 1), ~np.uint64(0))
                for at in range(0, len(s), 1024):
                    low = np.minimum(low, ((s[None, at : at + 1024] ^ b) * a).min(1, keepdims=True))
                low = low[:, 0]
                sigs.append((tn.mix(low) >> np.uint64(48)).astype(np.uint16).tobytes())
                steps = tn.mix(low.reshape(runs, depth) + np.arange(runs, dtype=np.uint64)[:, None])
                for d in range(1, depth):
                    steps[:, d] = tn.mix(steps[:, d] + steps[:, d - 1] * np.uint64(3))
                paths.append(steps.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "digest", "node", "n", "sig", "paths"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(sketch, "doc_id long, digest long, node binary, n int, sig binary, paths array<long>")


def _buckets(nodes: DataFrame, runs: int, depth: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(path, node) of the buckets to compare, and (path, size, node) of those that are large after all levels."""
    out, left = None, nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "paths")
    for d in range(depth):
        keyed = left.select("node", "run", "paths", F.element_at("paths", F.col("run") * depth + d + 1).alias("path"))
        sizes = keyed.groupBy("path").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("size > 1")
        # Runs fill many buckets with the same nodes: one of those is enough. Large ones go on to split.
        large = F.when((F.col("size") > small) & F.lit(d < depth - 1), F.col("path"))
        sizes = sizes.groupBy("size", "who", large.alias("split")).agg(F.min("path").alias("path")).select("path", "size")
        met = store(keyed.select("node", "run", "path").join(sizes, "path"), f"paths{d}")
        rest, met = met.filter(F.col("size") > small), met.filter(F.col("size") <= small).select("path", "node")
        left = rest.select("node", "run").join(nodes.select("node", "paths"), "node")
        out = met if out is None else out.union(met)
    return out, rest.select("path", "size", "node")


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the links (x, y)."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _alike(sig: np.ndarray, left: np.ndarray, right: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (from left, from right) that agree in ``need`` sampled tokens or more, and in how many."""
    xs, ys, ns = [], [], []
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        both = (sig[part][:, None] == sig[right][None]).sum(2)
        x, y = np.nonzero(both >= need)
        xs.append(part[x]), ys.append(right[y]), ns.append(both[x, y])
    return tuple(np.concatenate([[], *v]).astype(int) for v in (xs, ys, ns))


def _signs(table: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint16) for x in table.column("sig").to_pylist()])


def _stars(table: pa.Table, label: np.ndarray) -> list[pa.Array]:
    """Every node that is not its own label, and the node of its label."""
    node, low = table.column("node"), np.flatnonzero(label != np.arange(table.num_rows))
    return [node.take(pa.array(low)).combine_chunks(), node.take(pa.array(label[low])).combine_chunks()]


def _compared(rows: DataFrame, least: float, *, tiled: bool = False) -> DataFrame:
    """Edges (a, b) that connect nodes of a bucket whose sampled tokens agree in at least the share ``least``."""

    def compare(table: pa.Table) -> pa.Table:
        sig = _signs(table)
        left = right = np.arange(len(sig))
        if tiled and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            side = table.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y, _ = _alike(sig, left, right, math.ceil(least * sig.shape[1]))
        return pa.table(_stars(table, _labels(len(sig), x, y)), ["a", "b"])

    return rows.groupBy("path", *(["i", "j"] if tiled else [])).applyInArrow(compare, "a binary, b binary")


def _leaders(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of n points stays, if each staying point removes the later ones it is tied to by (x, y)."""
    stays = np.ones(n, bool)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    cut = np.searchsorted(x, np.arange(n + 1))
    for i in range(n):
        if stays[i]:
            own = y[cut[i] : cut[i + 1]]
            stays[own[own > i]] = False
    return stays


def _thinned(rows: DataFrame, least: float, tight: float, block: int, turn: int) -> DataFrame:
    """Rows (path, node, sig) that stay in their bucket, and edges (a, b), after each block of a bucket was compared.

    What leaves agrees with a leader in the share ``tight``. A text linked to one that left is then about as near to the
    leader, and meets it later at ``least``, which is lower than the threshold by more than the steps lose.
    """
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / block)).cast("int"))

    def thin(table: pa.Table) -> pa.Table:
        sig = _signs(table)
        every = np.arange(len(sig))
        x, y, n = _alike(sig, every, every, math.ceil(least * sig.shape[1]))
        a, b = _stars(table, _labels(len(sig), x, y))
        near = n >= math.ceil(tight * sig.shape[1])
        stay = pa.array(np.flatnonzero(_leaders(len(sig), x[near], y[near])))
        kept = [table.column(c).take(stay).combine_chunks() for c in ("path", "node", "sig")]
        none = lambda k, t: pa.nulls(k, t)
        k, e = len(stay), len(a)
        parts = [[*kept, none(k, pa.binary()), none(k, pa.binary())], [none(e, pa.int64()), none(e, pa.binary()), none(e, pa.binary()), a, b]]
        return pa.concat_tables([pa.table(p, ["path", "node", "sig", "a", "b"]) for p in parts])

    return dealt.groupBy("path", "block").applyInArrow(thin, "path long, node binary, sig binary, a binary, b binary")


def _candidates(nodes: DataFrame, runs: int, depth: int, small: int, least: float, tight: float, block: int) -> DataFrame:
    """Edges (a, b) that connect nodes whose sampled tokens agree in at least the share ``least``."""
    signs = nodes.select("node", "sig")
    few, dense = _buckets(nodes, runs, depth, small)
    edges = [store(_compared(few.join(signs, "node"), least), "edges")]
    rows, turn = store(dense.join(signs, "node"), "dense"), 0
    left = rows.count()
    while left:
        met = store(_thinned(rows, least, tight, block, turn), "thinned")
        edges.append(met.filter("a is not null").select("a", "b"))
        stay = met.filter("path is not null").select("path", "node", "sig")
        sizes = store(stay.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        sized = stay.join(sizes, "path")
        # A bucket of one block has been compared as a whole.
        edges.append(_compared(sized.filter((F.col("size") <= block)), least))
        rows = store(sized.filter(F.col("size") > block), "dense")
        before, left, turn = left, rows.count(), turn + 1
        if left > 0.7 * before:  # loose: nothing leaves, so all blocks of a bucket meet
            edges.append(_compared(_tiles(rows, "size", block), least, tiled=True))
            break
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _tiles(rows: DataFrame, size: str, tile: int) -> DataFrame:
    """Adds (i, j, side): a group of more than ``tile`` rows becomes blocks, and each pair of blocks a task's work."""
    nb = F.ceil(F.col(size) / tile).cast("int")
    block = F.pmod(F.xxhash64("node"), nb).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "other")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at, minlength=len(token)) > 1
    new = np.cumsum(often) - 1
    use = often[at]
    who, at = who[use], new[at[use]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.round().astype(np.int64)


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which of left is linked to which of right."""
    (num, den), n = threshold, np.array([len(s) for s in sets])
    return _intersections(sets, left, right) * (den + num) >= num * (n[left][:, None] + n[right][None])


LINKS = "node binary, links long, root binary"


def _small_groups(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, links, root): links counts the documents of other nodes of the group at the threshold or above."""

    def compare(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        every, node = np.arange(len(own)), table.column("node")
        linked = _linked(own, every, every, threshold)
        np.fill_diagonal(linked, False)
        links = linked @ table.column("copies").to_numpy()
        label, keep = _labels(len(own), *np.nonzero(linked)), np.flatnonzero(links)
        return pa.table([node.take(pa.array(keep)), pa.array(links[keep]), node.take(pa.array(label[keep]))], ["node", "links", "root"])

    return sets.groupBy("comp").applyInArrow(compare, LINKS)


def _bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table, broadcast where its rows are proven few."""
    return F.broadcast(df) if df.count() <= most else df


def _slack(sets: DataFrame, threshold: tuple[int, int], centre_of: int = 15) -> DataFrame:
    """The rows of large groups with slack: two nodes of a group are surely linked if their slacks add up to 0 or more.

    A pair is linked where (den + num) d(x, y) <= (den - num)(|x| + |y|). With d(x, y) <= d(x, c) + d(y, c) that follows
    from slack(x) + slack(y) >= 0, slack(x) = (den - num)|x| - (den + num) d(x, c), for any set c: here the tokens of
    most of a few nodes of the group, chosen by digest.
    """
    num, den = threshold
    by = Window.partitionBy("comp").orderBy("node")
    few = sets.select("comp", "node", "tokens").withColumn("at", F.row_number().over(by)).filter(F.col("at") <= centre_of)

    def centre(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        token, n = np.unique(np.concatenate(own), return_counts=True)
        return pa.table([table.column("comp").slice(0, 1), pa.array([token[2 * n > len(own)].tobytes()], pa.binary())], ["comp", "centre"])

    centres = _bounded(store(few.drop("at", "node").groupBy("comp").applyInArrow(centre, "comp binary, centre binary"), "centres"), 1000)

    def slack(batches):
        for batch in batches:
            out = []
            for x, c in zip(batch.column("tokens").to_pylist(), batch.column("centre").to_pylist()):
                own, mid = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64)
                both = len(np.intersect1d(own, mid, assume_unique=True))
                out.append((den - num) * len(own) - (den + num) * (len(own) + len(mid) - 2 * both))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "node", "copies", "tokens")), pa.array(out, pa.int64())], ["comp", "node", "copies", "tokens", "slack"])

    return sets.join(centres, "comp").mapInArrow(slack, "comp binary, node binary, copies long, tokens binary, slack long")


def _large_groups(sets: DataFrame, threshold: tuple[int, int], tile: int) -> DataFrame:
    """As ``_small_groups``, for groups of any size: sure pairs are counted by slack, the others compared in tiles."""
    rows = store(_slack(sets, threshold), "slack")
    # How many documents have a slack of -s or more, for every slack s of a group: sums over distinct values.
    held = rows.groupBy("comp", "slack").agg(F.sum("copies").alias("copies"), F.max("node").alias("node"))
    held = store(held, "slacks")
    points = held.select("comp", F.col("slack").alias("at"), "copies", F.lit(None).cast("long").alias("slack"))
    points = points.unionByName(held.select("comp", (-F.col("slack")).alias("at"), F.lit(0).cast("long").alias("copies"), "slack"))
    above = Window.partitionBy("comp").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sure = points.withColumn("sure", F.sum("copies").over(above)).filter("slack is not null").select("comp", "slack", "sure")
    ends = held.groupBy("comp").agg(F.max("slack").alias("most"), F.min("slack").alias("least"), F.max_by("node", "slack").alias("hub"))
    told = _bounded(store(sure.join(ends, "comp"), "sure"))
    rows = rows.join(told, ["comp", "slack"])
    # A node is no link of its own.
    own = F.when(F.col("slack") >= 0, F.col("copies")).otherwise(0)
    hub = F.when((F.col("slack") + F.col("most") >= 0) & (F.col("node") != F.col("hub")), F.col("hub")).otherwise(F.col("node"))
    certain = rows.select("node", (F.col("sure") - own).alias("links"), hub.alias("root")).filter("links > 0")
    # Open pairs have slacks that add up to less than 0, so one of the two is below 0: far nodes meet all that may be open.
    open_ = rows.withColumn("far", F.col("slack") < 0).filter("slack < -least")
    counts = open_.groupBy("comp").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far"))
    open_ = open_.select("comp", "node", "copies", "tokens", "slack", "far").join(_bounded(store(counts.filter("n_far > 0"), "open")), "comp")
    blocks = lambda c: F.ceil(F.col(c) / tile).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    columns = ["comp", "node", "copies", "tokens", "slack", "far", "i", "j", "side"]
    left = open_.filter("far").withColumns({"i": place("n_far"), "j": each("n"), "side": F.lit(0)}).select(*columns)
    right = open_.withColumns({"j": place("n"), "i": each("n_far"), "side": F.lit(1)}).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        slack, copies, side = (table.column(c).to_numpy() for c in ("slack", "copies", "side"))
        far, node = table.column("far").to_numpy(), table.column("node")
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return pa.table([pa.nulls(0, pa.binary()), pa.array([], pa.int64()), pa.nulls(0, pa.binary())], ["node", "links", "root"])
        codes = node.combine_chunks().dictionary_encode().indices.to_numpy()
        linked = _linked(own, a, b, threshold) & (slack[a][:, None] + slack[b][None] < 0) & (codes[a][:, None] != codes[b][None])
        links = np.zeros(len(own), np.int64)
        links[a] = linked @ copies[b]
        links[b] = np.where(far[b], 0, linked.T @ copies[a])  # two far nodes meet once on either side
        x, y = np.nonzero(linked)
        label = _labels(len(own), a[x], b[y])
        keep = np.flatnonzero((links > 0) | (label != np.arange(len(own))))
        return pa.table([node.take(pa.array(keep)), pa.array(links[keep]), node.take(pa.array(label[keep]))], ["node", "links", "root"])

    return certain.unionByName(left.unionByName(right).groupBy("comp", "i", "j").applyInArrow(compare, LINKS))


def _classes(
    docs: DataFrame, threshold: tuple[int, int] = (4, 5), shingle: int = 5, recall: float = 0.9999, small: int = 128, tile: int = 256, slack: float = 0.25, tight: float = 0.95, block: int = 1024, most_broadcast: int = 1_000_000
) -> DataFrame:
    """The rows of ``jaccard_join`` with digest (xxhash64 of the text) and class, which names the class even where ids don't; null without shingles."""
    num, den = threshold
    runs = runs_for(num / den, recall)
    small_batches(docs.sparkSession)
    sketched = store(_sketches(docs, runs, DEPTH, shingle), "sketches")
    nodes = store(
        sketched.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("one"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("paths").alias("paths"), F.min("doc_id").alias("rep")),
        "nodes",
    )
    edges = _candidates(nodes, runs, DEPTH, small, num / den - slack, tight, block)
    comp = store(components(edges).withColumnRenamed("root", "comp"), "groups")
    sizes = comp.groupBy("comp").agg(F.count("*").alias("members"))
    active = store(nodes.select("node", "one.*", "copies").withColumnRenamed("doc_id", "rep").join(comp, "node").join(sizes, "comp"), "active")

    def sets(batches):
        for batch in tn.slices(batches):
            buf, offs = tn.utf8(batch.column("text"))
            _, _, rows, hashes = tn.words(buf, offs)
            own = [s.tobytes() for s in tn.shingle_sets(hashes, rows, batch.num_rows, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("comp", "members", "node", "copies")] + [pa.array(own, pa.binary())], ["comp", "members", "node", "copies", "tokens"])

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).alias("d")
    met = F.expr("d.digest = a.digest and d.doc_id <=> a.rep")
    # Texts stay where they are if what is asked of them is proven small.
    asked = F.broadcast(active) if active.count() <= most_broadcast else active
    texts = own.join(asked.alias("a"), met).select("comp", "members", "node", "copies", "text").dropDuplicates(["node"])
    filled = store(texts.mapInArrow(sets, "comp binary, members long, node binary, copies long, tokens binary"), "sets")
    found = store(_small_groups(filled.filter(F.col("members") <= tile), threshold).unionByName(_large_groups(filled.filter(F.col("members") > tile), threshold, tile)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = roots.join(nodes.select("node", "rep"), "node")
    names = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = nodes.select("node", "rep", "copies").join(roots, "node", "left").join(names, "root", "left").join(links, "node", "left")
    classes = classes.select("node", F.coalesce("root", "node").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return sketched.select("doc_id", "digest", "node", F.col("n").cast("long").alias("n_shingles")).join(classes, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "n_shingles", "digest", "class"
    )


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, n_shingles.

    class_id is the smallest doc_id of the documents connected by links of similarity ``threshold`` (a fraction) or
    above; n_links counts all other rows linked to this one, equal sets included; n_copies the other rows with the same
    set. ``slack``: candidates may fall this far below the threshold on the sampled tokens. Null or blank text has no
    shingles and links to nothing: class_id is its own doc_id. Texts under five words are one shingle. Repeated rows
    each appear and count as copies; a null doc_id stays null and is ignored for class_id unless its class has no other.
    Columns beyond doc_id and text are ignored.
    ``options`` are threshold, shingle, recall, small, tile, slack, tight, block and most_broadcast.
    """
    return _classes(docs, **options).drop("digest", "class")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: that of the smallest doc_id, then of the smallest digest of its text; rows without shingles stay.

    A null doc_id comes after all ids, so a class without ids keeps a row, too. Of rows with equal doc_id and text the
    one with the smallest columns stays. Other rows of a doc_id are no part of this: they stay or go with their class.
    """
    held = store(_classes(docs, **options).filter("class is not null").groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n")), "classes")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = held.groupBy("class").agg(F.min(key).alias("first"))
    # What goes, and what stays but is repeated; a row that is neither stays as it is.
    touched = held.join(first, "class").withColumn("again", key == F.col("first")).filter("n > 1 or not again")
    own, digest, stays = fresh(docs, "_id", "_digest", "_again")
    touched = store(touched.select(F.col("doc_id").alias(own), F.col("digest").alias(digest), F.col("again").alias(stays)), "touched")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(digest))
    plain = docs.join(touched, same, "left_anti")
    again = docs.join(touched.filter(F.col(stays)), same, "left_semi")
    one = again.groupBy("doc_id", F.xxhash64("text").alias(digest)).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return plain.unionByName(one)
