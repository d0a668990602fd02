"""Near-duplicate embeddings by NN-descent, with an exact way for what its lists can't hold or its audit doubts.

Equal vectors are one vertex with a number. A graph gives each vertex its nearest neighbours of
the same label. It starts from vectors that lie next to each other on several random orders (signs
of random projections) and is refined by joining the neighbours of each vertex with one another,
until a round adds hardly any link. A list all of whose entries are links is saturated and is
enlarged. Edges at or over the threshold are links, and what they connect is closed: the vertices
of each component are compared with one another, so that a component has all links inside it.

The audit compares saturated vertices and some others of each label with the whole label. A label
passes if no link of these is missing and they had enough links to tell, or were all there are; all
vertices of the other labels are compared with one another. So no round is the last by number
alone, and each row says what the audit found and whether its label was compared in full.

Comparisons are made by pairs of blocks of a bounded size, each in a task that gets the two
blocks by a shuffle. What a task gives back grows with its vertices and not with the links: the
number of links of each vertex, and edges that join what is linked, a spanning forest of what the
task has seen. Pairs are looked for in single precision, with a margin for its error, and decided
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestone.llm.common import connected_components, looked_up, stage

THRESHOLD = 0.93
#: Neighbours in a list, and in one that is saturated.
NEIGHBOURS, WIDE = 8, 32
#: Random orders of the start and signs of each; vectors of a window on an order and its step; members of a vertex that are joined at once.
ORDERS, SIGNS, WINDOW, STRIDE, JOINED = 6, 24, 256, 192, 64
#: Rounds after which what isn't settled is compared in full.
ROUNDS = 8
#: Audited vertices of a label, expected, and links that they must have had to speak for the others.
AUDITED, EVIDENCE = 2048, 200
SEED = 20240229
#: Numbers in the vectors of one block, about.
VALUES = 1 << 21
#: Vectors of two blocks that are compared at once.
TILE = (512, 4096)


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, zero or empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision. Scaled first, so that no square overflows or vanishes."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.offsets.to_numpy()
    rows = np.split(values[ends[0] : ends[-1]], ends[1:-1] - ends[0])
    if len({len(r) for r in rows}) == 1:
        table = np.stack(rows)
        table = table / np.abs(table).max(axis=1, keepdims=True)
        return list(table / np.sqrt((table * table).sum(axis=1, keepdims=True)))
    out = [r / np.abs(r).max() for r in rows]
    return [r / np.sqrt((r * r).sum()) for r in out]


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal rows."""
    if not len(columns[0]):
        return
    change = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    yield from zip(cuts, cuts[1:], strict=False)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, grp, v) once for each order, with their code there."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = _unit(batch.column("v")) if batch.num_rows else []
        codes, sizes = np.zeros((len(vectors), ORDERS), dtype=np.int64), np.array([len(v) for v in vectors])
        for size in set(sizes.tolist()):
            if size not in planes:
                planes[size] = np.random.default_rng(SEED + size).standard_normal((size, ORDERS * SIGNS))
            at = np.flatnonzero(sizes == size)
            signs = np.stack([vectors[k] for k in at]) @ planes[size] > 0
            # Gray code: neighbours in the order differ in few signs
            bits = np.logical_xor.accumulate(signs.reshape(len(at), ORDERS, SIGNS), axis=2)
            codes[at] = bits @ (1 << np.arange(SIGNS)[::-1])
        for k in range(ORDERS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, k, np.int32)), batch.column("grp"), pa.array(codes[:, k]), batch.column("node"), batch.column("v")],
                names=["k", "grp", "code", "node", "v"],
            )


def _edges(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["src", "dst", "sim"])


def _best(nodes: np.ndarray, vectors: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, sim) of the nearest rows of each row of a block."""
    table = np.stack(vectors)
    sims = table @ table.T
    sims[nodes[:, None] == nodes[None, :]] = -2
    keep = min(keep, len(nodes) - 1)
    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    return np.repeat(nodes, keep), nodes[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel()


def _first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each against those in the same windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order, grp, node = batch.column("k").to_numpy(), batch.column("grp").to_numpy(zero_copy_only=False), batch.column("node").to_numpy()
        vectors, out = _unit(batch.column("v")), []
        for a, b in _runs(order, grp):
            for s in range(a, b, STRIDE):
                e = min(b, s + WINDOW)
                if e - s > 1:
                    out.append(_best(node[s:e], vectors[s:e], NEIGHBOURS))
                if e == b:
                    break
        found = _edges(out)
        yield found.filter(pa.array(found.column("sim").to_numpy() > -2))


def _neighbours_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mid, node, least, v) sorted by mid: pairs among the neighbours of mid that improve a list."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mid, node, least = (batch.column(c).to_numpy() for c in ("mid", "node", "least"))
        vectors, out = _unit(batch.column("v")), []
        for a, b in _runs(mid):
            for s in range(a, b, JOINED):
                e = min(b, s + JOINED)
                if e - s > 1:
                    src, dst, sim = _best(node[s:e], vectors[s:e], NEIGHBOURS)
                    better = sim > np.repeat(least[s:e], len(src) // (e - s))
                    out.append((src[better], dst[better], sim[better]))
        yield _edges(out)


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """node, near: its best (sim, dst), least: the similarity that a better one has to pass, full: whether it is saturated.

    A list of NEIGHBOURS links goes on to WIDE. Each node comes with as many edges as it was met.
    """
    every = F.sort_array(F.collect_set(F.struct("sim", "dst")), asc=False)
    sorted_ = edges.groupBy(F.col("src").alias("node")).agg(every.alias("every"))
    wide = (F.size("every") >= NEIGHBOURS) & (F.try_element_at("every", F.lit(NEIGHBOURS))["sim"] >= threshold)
    room = F.when(wide, F.lit(WIDE)).otherwise(F.lit(NEIGHBOURS))
    cut = sorted_.select("node", F.slice("every", F.lit(1), room).alias("near"), room.alias("room"))
    last = F.element_at("near", F.lit(-1))["sim"]
    return cut.select("node", "near", F.when(F.size("near") < F.col("room"), F.lit(-2.0)).otherwise(last).alias("least"), ((F.size("near") >= WIDE) & (last >= threshold)).alias("full"))


def _arcs(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("node").alias("src"), F.inline("near")).select("src", "dst", "sim")


def refined(vertices: DataFrame, lists: DataFrame, threshold: float, turn: int) -> DataFrame:
    """The lists after one join of neighbours with neighbours."""
    arcs = _arcs(lists)
    both = arcs.select(F.col("src").alias("mid"), F.col("dst").alias("node")).union(arcs.select(F.col("dst").alias("mid"), F.col("src").alias("node"))).distinct()
    members = both.join(vertices.select("node", "v").join(lists.select("node", "least"), "node"), "node")
    # sorted runs instead of groups: a vertex near to very many is dealt over tasks and blocks, others in each round
    dealt = members.withColumn("salt", F.xxhash64("node", F.lit(turn))).repartitionByRange("mid", "salt").sortWithinPartitions("mid", "salt")
    better = dealt.select("mid", "node", "least", "v").mapInArrow(_neighbours_joined, "src long, dst long, sim double")
    return stage(_lists(arcs.union(better), threshold), "lists")


def neighbour_graph(vertices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, near (sim, dst; best first), least, full for vertices (node, grp, v) with neighbours in grp."""
    rows = vertices.select("node", "grp", "v").mapInArrow(_ordered, "k int, grp string, code long, node long, v " + vertices.schema["v"].dataType.simpleString())
    rows = rows.repartitionByRange("k", "grp", "code", "node").sortWithinPartitions("k", "grp", "code", "node")
    lists, before = stage(_lists(rows.mapInArrow(_first_edges, "src long, dst long, sim double"), threshold), "lists"), -1
    for turn in range(ROUNDS):
        links = lists.agg(F.sum(F.size(F.filter("near", lambda n: n["sim"] >= threshold)))).first()[0] or 0
        if links <= 1.01 * before:  # the audit sees to the rest
            break
        lists, before = refined(vertices, lists, threshold, turn), links
    return lists


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, numbers and unit vectors of a block."""
    batch = table.combine_chunks().to_batches()[0]
    return batch.column("node").to_numpy(), batch.column("n").to_numpy(), np.stack(_unit(batch.column("v")))


def _joined(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """root, the smallest place of each place's set, after the sets of the roots in pairs are united."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while k in up:
            if up[k] in up:
                up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    to = np.arange(len(root))
    for k in up:
        to[k] = top(k)
    return to[root]


class _Group:
    """The vertices of a block, and what has been found of them."""

    def __init__(self, node: np.ndarray, n: np.ndarray, table: np.ndarray):
        self.node, self.n, self.table, self.single = node, n, table, table.astype(np.float32)
        self.root, self.links = np.arange(len(node)), np.zeros(len(node), np.int64)

    def meet(self, node: np.ndarray, n: np.ndarray, table: np.ndarray, later: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the vertices (node, n, table), and places of an edge of each that has links: (links, from, to).

        later: whether they are another block; those of the block itself meet what has a smaller node.
        """
        links, tied, margin = np.zeros(len(node), np.int64), np.full(len(node), -1), max(1e-3, 2e-7 * table.shape[1])
        single = table.astype(np.float32)
        for c in range(0, len(self.node), TILE[1]):
            cols = slice(c, c + TILE[1])
            for r in range(0, len(node), TILE[0]):
                maybe = (single[r : r + TILE[0]] @ self.single[cols].T >= threshold - margin).any(axis=1)
                rows = r + np.flatnonzero(maybe)
                if not len(rows):
                    continue
                hit = table[rows] @ self.table[cols].T >= threshold
                if not later:
                    hit &= node[rows][:, None] > self.node[cols][None, :]
                links[rows] += hit @ self.n[cols]
                self.links[cols] += hit.T @ n[rows]
                some = hit.any(axis=1)
                rows, hit = rows[some], hit[some]
                if not len(rows):
                    continue
                roots = self.root[cols]
                low = np.where(hit, roots[None, :], len(self.root)).min(axis=1)
                split = np.where(hit, roots[None, :], -1).max(axis=1) > low
                old = tied[rows] >= 0
                pairs = [np.stack([tied[rows][old], low[old]], axis=1)]
                tied[rows] = low
                if split.any():
                    a, b = np.nonzero(hit[split])
                    pairs.append(np.stack([low[split][a], roots[b]], axis=1))
                pairs = np.concatenate(pairs)
                pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                if len(pairs):
                    # an edge to a place stays right when its root moves
                    self.root = _joined(self.root, self.root[pairs])
        at = np.flatnonzero(tied >= 0)
        return links, at, tied[at]


def _found(src: list[np.ndarray], dst: list[np.ndarray | None], links: list[np.ndarray | None]) -> pa.RecordBatch:
    def column(parts: list, others: list) -> pa.Array:
        return pa.concat_arrays([pa.nulls(len(o), pa.int64()) if p is None else pa.array(p, pa.int64()) for p, o in zip(parts, others, strict=True)])

    return pa.RecordBatch.from_arrays([column(src, src), column(dst, src), column(links, src)], names=["src", "dst", "links"])


def compared(vertices: DataFrame, threshold: float, values: int = VALUES) -> DataFrame:
    """(src, null, links) and (src, dst, null) for vertices (node, grp, n, v, hot): links to be summed, and edges that join what is linked.

    Each pair of a grp with a hot vertex is compared once: a hot vertex gets all of its links, any
    other those to hot ones. The hot vertices of a grp are dealt over blocks of some values
    numbers, the others over blocks that follow; a block of hot ones meets itself and all that follow.
    """

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("src", "dst", "links")})
        group, (node, n, table) = _Group(*_block(left)), _block(right)
        links, at, to = group.meet(node, n, table, left.column("block")[0] != right.column("block")[0], threshold)
        some, own, moved = np.flatnonzero(links), np.flatnonzero(group.links), np.flatnonzero(group.root != np.arange(len(group.root)))
        src = [node[some], node[at], group.node[own], group.node[moved]]
        return pa.Table.from_batches([_found(src, [None, group.node[to], None, group.node[group.root[moved]]], [links[some], None, group.links[own], None])])

    numbers = [F.sum(F.when(F.col("hot") == hot, F.size("v")).otherwise(0)) for hot in (True, False)]
    sizes = vertices.groupBy("grp").agg(*[F.ceil(n / values).alias(c) for n, c in zip(numbers, ("hot_blocks", "cold_blocks"), strict=True)]).filter("hot_blocks > 0")
    known = looked_up(vertices, stage(sizes, "sizes"), "grp", "node")
    block = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.col("hot_blocks"))).otherwise(F.col("hot_blocks") + F.try_mod(F.xxhash64("node").bitwiseAND(F.lit((1 << 62) - 1)), F.col("cold_blocks")))
    placed = stage(known.withColumn("block", block), "placed")
    last, zero = F.col("hot_blocks") + F.col("cold_blocks") - 1, F.lit(0).cast("long")
    left = placed.filter("hot").select("grp", "block", F.col("block").alias("a"), F.explode(F.sequence("block", last)).alias("b"), "node", "n", "v")
    right = placed.select("grp", "block", F.explode(F.sequence(zero, F.least("block", F.col("hot_blocks") - 1))).alias("a"), F.col("block").alias("b"), "node", "n", "v")
    left, right = (side.toDF(*side.columns) for side in (left, right))  # cogroup takes columns of one origin for the same
    return left.groupBy("grp", "a", "b").cogroup(right.groupBy("grp", "a", "b")).applyInArrow(met, "src long, dst long, links long")


def _counts(found: DataFrame, name: str) -> DataFrame:
    return found.filter("links IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias(name))


def audited(vertices: DataFrame, lists: DataFrame, threshold: float, values: int, sample: int, evidence: int) -> tuple[DataFrame, DataFrame]:
    """(grp, recall, passed) of each label, and (src, dst, null) and (src, null, links) of the closed components."""
    arcs = _arcs(lists).filter(F.col("sim") >= threshold).select("src", "dst")
    inside = connected_components(arcs).join(vertices, "node").select("node", F.col("root").cast("string").alias("grp"), "n", "v", F.lit(True).alias("hot"))
    closed = stage(compared(inside, threshold, values), "closed")
    sizes = stage(vertices.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    share = F.lit(float(1 << 30) * sample) / F.col("size")
    picked = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < share
    full = lists.filter("full").select("node", F.lit(True).alias("full"))
    hot = F.coalesce("full", F.lit(False)) | picked
    marked = stage(looked_up(vertices, sizes, "grp", "node").join(full, "node", "left").select("node", "grp", "n", "v", hot.alias("hot")), "marked")
    true, known = _counts(compared(marked, threshold, values), "links"), _counts(closed, "have")
    judged = marked.select("node", "grp", "hot").join(true, "node", "left").join(known, "node", "left")
    links, have = F.coalesce("links", F.lit(0)), F.coalesce("have", F.lit(0))
    said = judged.groupBy("grp").agg(
        F.sum(F.when(F.col("hot"), links).otherwise(0)).alias("of"), F.sum(F.when(F.col("hot"), F.least(links, have)).otherwise(0)).alias("have"), F.count_if(~F.col("hot")).alias("unseen")
    )
    recall = F.when(F.col("of") > 0, F.col("have") / F.col("of")).otherwise(F.lit(1.0))
    audit = said.select("grp", recall.alias("recall"), ((F.col("have") == F.col("of")) & ((F.col("unseen") == 0) | (F.col("of") >= evidence))).alias("passed"))
    return stage(audit, "audit"), closed


def embedding_links(
    embeddings: DataFrame, threshold: float = THRESHOLD, values: int = VALUES, sample: int = AUDITED, evidence: int = EVIDENCE
) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall, compared_all of every row of embeddings (vec_id, embedding, label).

    Vectors link at a cosine of threshold or more if their labels are equal and not null and
    their lengths are equal; components are read in their own precision. Null, empty or zero vectors and those with null or non-finite
    components link with nothing: n_links 0, a component of their own, kept. Equal vectors link;
    rows repeated as a whole are vectors of their own with the same id. Other columns are
    ignored, an empty table gives an empty result.

    audit_recall is the share of the audited links of the row's label that the graph had (1 where
    there were none, null for rows that can't link); compared_all says that the label didn't pass and was compared in full.
    """
    kind = embeddings.schema["embedding"].dataType
    precise = "array<float>" if getattr(kind, "elementType", None) == FloatType() else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(precise).alias("v"), F.col("label").cast("string").alias("label"))
    good = rows.filter(F.col("label").isNotNull() & usable(F.col("v")))
    vertices = stage(
        good.groupBy("label", "v")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp"), "label", "v", "vec_id", "n"),
        "vertices",
    )
    plain = vertices.select("node", "grp", "n", "v")
    audit, closed = audited(plain, neighbour_graph(plain, threshold), threshold, values, sample, evidence)
    graded = looked_up(vertices, audit, "grp", "node").select("grp", "node", "label", "v", "vec_id", "n", "recall", "passed")
    again = compared(graded.filter("not passed").select("node", "grp", "n", "v", F.lit(True).alias("hot")), threshold, values)
    good_nodes = graded.filter("passed").select("node")
    found = stage(closed.join(good_nodes.withColumnRenamed("node", "src"), "src", "left_semi").union(again), "found")
    edges, counts = found.filter("dst IS NOT NULL").select("src", "dst"), _counts(found, "links")
    roots = connected_components(edges)
    named = stage(roots.join(vertices.select("node", "vec_id"), "node").groupBy("root").agg(F.min("vec_id").alias("component_id")), "named")
    linked = looked_up(roots, named, "root", "node").join(counts, "node").select("node", "component_id", "links")
    whole = stage(
        graded.join(linked, "node", "left").select(
            "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "recall", (~F.col("passed")).alias("again")
        ),
        "linked",
    )
    out = rows.join(whole, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("recall").alias("audit_recall"), F.coalesce("again", F.lit(False)).alias("compared_all"),
    )
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audit_recall", "compared_all")
