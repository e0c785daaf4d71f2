"""Near-duplicate embeddings by search in a robust-pruned flat graph.

Centres fitted to a bounded sample part the vectors into shards that overlap:
each vector belongs to its ``OVERLAP`` nearest centres. A shard of more than
``SPLIT_ROWS`` vectors is parted again by centres of its own, fitted to its own
bounded sample, each vector going to one centre less than it has shards; so
shards keep their size up to ``MAX_CENTRES`` squared of them. Centres within the
link cosine of one another are one centre, so that no dense group is cut by
centres of its own. In every shard each
vector gets its robust-pruned neighbours (a candidate is dropped if a chosen
neighbour is nearer to it by a factor), and every vector is made reachable
from the shard's medoid. The adjacency lists of a vector's shards are united
into one flat graph. Every vector is then searched for in its shards: a greedy
beam search from medoids over the graph, which expands further as long as it
meets vectors in range. What it finds is verified in double precision.

Exact copies are one vector with a count. A shard of more than ``PART_ROWS``
vectors is dealt into parts, and every pair of its parts is searched in a task
of its own; so a dense group of any size is neither collected nor capped, and
no pairs are emitted: a task returns link counts and a spanning forest. A pair
that shares several shards counts in the first of them. A search walks the
part of the united graph whose vectors lie in its shard; neighbours beyond it
are met in the other shards of the vector.

Recall is audited: for at most ``AUDIT`` vectors chosen by hash, and as many of
those with few links, links are counted against all vectors by brute force,
and the lower mean of the two counts. Below ``RECALL`` the search is repeated
with twice the overlap; where that is all shards and still isn't enough, all
vectors of a length are one shard, whose parts are compared exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components have no links and are components of their own; vectors link with
those of their own length only; rows with one vector but different ids are
links of each other, and so are rows that repeat both; different vectors that
repeat an id are separate; a row with a null id keeps it, counts as a link and
gives no component its id (that of null ids alone is null); other columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, slices, small, table
from .graph import components

#: Cosine that links; vectors, and their bytes, that centres are fitted to; centres at most; vectors of a shard on average, and of a part at most.
LINK, SAMPLE, SAMPLE_BYTES, MAX_CENTRES, SHARD_ROWS, PART_ROWS = 0.95, 20_000, 40_000_000, 4096, 768, 1024
#: Vectors of a shard beyond which it is parted again, and of them in a task that does so; bits of a shard's number at each level.
SPLIT_ROWS, SPLIT_TASK, BITS = 6144, 8192, 20
#: Nearest centres of a vector; neighbours of a vector in a shard, and candidates for them; pruning factor; beam of the greedy search; medoids it starts from.
OVERLAP, DEGREE, CANDIDATES, FACTOR, BEAM, STARTS = 3, 16, 48, 1.2, 12, 4
#: How far below the link cosine the range search still expands; audited vectors; links of those that have few; recall asked for.
SLACK, AUDIT, FEW_LINKS, RECALL, SEED = 0.05, 256, 32, 0.95, 5


def unit_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, unit): unit vectors as packed doubles; null where a vector can't be linked."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            packed = []
            for v in batch.column(1).to_pylist():
                x = None
                if v and None not in v:
                    a = np.array(v, np.float64)
                    a = a / top if np.isfinite(a).all() and (top := np.abs(a).max()) > 0 else None
                    x = None if a is None else (a / np.sqrt(a @ a)).tobytes()
                packed.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "unit"])

    return rows.mapInArrow(run, "id long, unit binary")


def matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def by_length(packed: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    places = defaultdict(list)
    for i, p in enumerate(packed):
        places[len(p)].append(i)
    return [(some, matrix([packed[i] for i in some])) for _, some in sorted(places.items())]


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from randomly drawn vectors."""
    draw = np.random.default_rng(SEED)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(b @ centres.T).argmax(axis=1) for b in np.array_split(x, max(1, len(x) // 2048))])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], starts, axis=0)
        centres = centres.copy()
        centres[near[order][starts]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return apart(centres)


def apart(centres: np.ndarray, link: float = LINK) -> np.ndarray:
    """The centres without those within ``link`` of one before them."""
    left = np.ones(len(centres), bool)
    for i in range(len(centres)):
        if left[i]:
            left[i + 1 :] &= centres[i + 1 :] @ centres[i] < link
    return centres[left]


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The numbers of each row's ``k`` nearest centres, ascending."""
    like = x @ centres.T
    k = min(k, like.shape[1])
    return np.sort(np.argpartition(-like, k - 1, axis=1)[:, :k], axis=1)


def prune(x: np.ndarray, degree: int = DEGREE, factor: float = FACTOR) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row, reachable from the medoid throughout.

    All rows choose at a time, among their ``CANDIDATES`` nearest: the nearest
    one left, after which those that are nearer to it by ``factor`` than to
    the row go.
    """
    n = len(x)
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(gaps, np.inf)
    k = min(CANDIDATES, n - 1)
    near: list[list[int]] = [[] for _ in range(n)]
    if k > 0:
        pool = np.argpartition(gaps, k - 1, axis=1)[:, :k]
        left = np.take_along_axis(gaps, pool, 1)
        order = np.argsort(left, axis=1, kind="stable")
        pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(left, order, 1)
        left = own.copy()
        rows = np.arange(n)
        for _ in range(degree):
            pick = left[rows].argmin(axis=1)
            some = np.isfinite(left[rows, pick])
            rows, pick = rows[some], pick[some]
            if not len(rows):
                break
            chosen = pool[rows, pick]
            for r, p in zip(rows.tolist(), chosen.tolist(), strict=True):
                near[r].append(p)
            gone = factor * gaps[chosen[:, None], pool[rows]] <= own[rows]
            gone[np.arange(len(rows)), pick] = True
            left[rows] = np.where(gone, np.inf, left[rows])
    np.fill_diagonal(gaps, 0.0)
    both = [set(a) for a in near]
    for r, a in enumerate(near):  # both ways, as far as the other side has room
        for p in a:
            if len(both[p]) < 2 * degree:
                both[p].add(r)
    # Vectors that can't be reached from the medoid hang on the nearest that can.
    start = int((x @ x.sum(axis=0)).argmax()) if n else 0
    reached = np.zeros(n, bool)
    reached[start : start + 1] = True
    todo = [start] if n else []
    while True:
        while todo:
            for p in both[todo.pop()]:
                if not reached[p]:
                    reached[p] = True
                    todo.append(p)
        out = np.flatnonzero(~reached)
        if not len(out):
            return [np.array(sorted(b), np.int64) for b in both]
        inside = np.flatnonzero(reached)
        gap = gaps[np.ix_(out, inside)]
        at = np.unravel_index(gap.argmin(), gap.shape)
        a, b = int(inside[at[1]]), int(out[at[0]])
        both[a].add(b)
        both[b].add(a)
        reached[b] = True
        todo = [b]


def search(queries: np.ndarray, x: np.ndarray, graph: list[np.ndarray], link: float = LINK) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows in range that a range-expanding greedy search meets.

    All queries advance together. Each holds the ``BEAM`` best rows it has met;
    in a step it expands the best one that isn't expanded yet, and all rows
    that it met in the last step within ``SLACK`` of the range. A query ends
    when nothing is left to expand. The work of a step follows the rows that
    are met in it.
    """
    q, n = len(queries), len(x)
    if not q or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(map(len, graph))
    table_ = np.full((n, max(width, 1)), -1, np.int64)
    for i, a in enumerate(graph):
        table_[i, : len(a)] = a
    seen, opened, place_of = np.zeros(q * n, bool), np.zeros(q * n, bool), np.zeros(q * n, np.int32)
    value, held = np.full((q, BEAM), -2.0), np.full((q, BEAM), -1)
    found: list[np.ndarray] = []

    def meet(flat: np.ndarray) -> np.ndarray:
        """Take new (query, row) pairs in, ascending by query, and return those near the range."""
        a, b = flat // n, flat % n
        like = np.concatenate([np.einsum("ij,ij->i", queries[u], x[v]) for u, v in zip(np.array_split(a, 1 + len(a) // 65_536), np.array_split(b, 1 + len(b) // 65_536), strict=True)])
        seen[flat] = True
        found.append(flat[like >= link])
        better = np.flatnonzero(like > value.min(axis=1)[a])  # the others don't come among the best
        order = better[np.lexsort((-like[better], a[better]))]
        who, best = a[order], like[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        some = place < BEAM
        rows = who[np.flatnonzero(np.diff(who, prepend=-1))]
        at = np.searchsorted(rows, who[some])
        new, new_held = np.full((len(rows), BEAM), -2.0), np.full((len(rows), BEAM), -1)
        new[at, place[some]], new_held[at, place[some]] = best[some], b[order][some]
        both, both_held = np.concatenate([value[rows], new], 1), np.concatenate([held[rows], new_held], 1)
        pick = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM]
        value[rows], held[rows] = np.take_along_axis(both, pick, 1), np.take_along_axis(both_held, pick, 1)
        return flat[like >= link - SLACK]

    starts = [int((x @ x.sum(axis=0)).argmax())]
    far = x @ x[starts[0]]
    for _ in range(min(STARTS, n) - 1):  # further medoids: each the row least like those before
        starts.append(int(far.argmin()))
        far = np.maximum(far, x @ x[starts[-1]])
    active = np.arange(q)
    near = meet((active[:, None] * n + np.unique(starts)).ravel())
    while len(active):
        mine = held[active]
        shut = np.where((mine >= 0) & ~opened[active[:, None] * n + mine], value[active], -2.0)
        best = shut.argmax(axis=1)
        go = shut[np.arange(len(active)), best] > -2.0
        pairs = np.unique(np.concatenate([active[go] * n + mine[go, best[go]], near]))
        pairs = pairs[~opened[pairs]]
        opened[pairs] = True
        active = pairs // n
        who, row = np.repeat(active, table_.shape[1]), table_[pairs % n].ravel()
        active = active[np.flatnonzero(np.diff(active, prepend=-1))]
        flat = (who * n + row)[row >= 0]
        flat = flat[~seen[flat]]
        number = np.arange(len(flat), dtype=np.int32)
        place_of[flat] = number
        flat = flat[place_of[flat] == number]  # each pair once
        near = meet(flat) if len(flat) else flat
    pairs = np.sort(np.concatenate(found))
    return pairs // n, pairs % n


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component under edges (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def assign(reps: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(rep, mult, unit, shards): each vector's nearest centres of its length, ascending by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            for some, x in by_length(batch.column(2).to_pylist()):
                length, centre = x.shape[1], centres.get(x.shape[1])
                # A length without centres is one shard.
                near = np.zeros((len(x), 1), np.int64) if centre is None else nearest(x, centre, overlap)
                rows = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((near + (length << BITS)).tolist(), pa.list_(pa.int64()))], names=["rep", "mult", "unit", "shards"])

    return reps.select("rep", "mult", "unit").mapInArrow(run, "rep long, mult long, unit binary, shards array<long>")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """(shard, size), materialised."""
    return cut(placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("size")))


def refine(placed: DataFrame, sizes: DataFrame, overlap: int) -> DataFrame:
    """``placed``, where a shard of more than ``SPLIT_ROWS`` vectors gives way to shards around centres of its own.

    Those are fitted to a bounded sample of the shard, a shard a task, and stay
    on the executors; a vector has ``overlap`` - 1 of them, or all there are. A
    shard without two centres that are apart stays whole.
    """
    large = sizes.filter(F.col("size") > SPLIT_ROWS)
    if large.isEmpty():
        return placed
    inner = max(1, overlap - 1)
    # At most MAX_CENTRES shards a length.
    member = placed.select("rep", "unit", F.explode("shards").alias("shard")).join(small(large), "shard")
    most = F.least(F.lit(SAMPLE), F.greatest(F.lit(1), F.lit(SAMPLE_BYTES) / F.octet_length("unit")))
    drawn = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 30)) < most / F.col("size") * F.lit(1 << 30)

    def fit(shard: pa.Table) -> pa.Table:
        x = matrix(sorted(shard["unit"].to_pylist()))
        centres = fit_centres(x, min(MAX_CENTRES, -(-shard["size"][0].as_py() * inner // SHARD_ROWS)))
        some = slice(0, int(len(centres) > 1))
        return pa.table({"shard": pa.array([shard["shard"][0].as_py()][some], pa.int64()), "centres": pa.array([centres.tobytes()][some], pa.binary()), "size": pa.array([shard["size"][0].as_py()][some], pa.int64())})

    split = cut(member.filter(drawn).select("shard", "unit", "size").groupBy("shard").applyInArrow(fit, "shard long, centres binary, size long"))
    split = split.withColumn("tasks", F.ceil(F.col("size") / SPLIT_TASK).cast("int"))
    dealt = member.drop("size").join(small(split.drop("centres", "size")), "shard").withColumn("task", F.pmod(F.xxhash64("rep", F.lit(SEED + 1)), F.col("tasks")).cast("int"))
    each = split.select("shard", "centres", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))

    def place(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "within": pa.array([], pa.list_(pa.int64()))})
        x = matrix(rows["unit"].to_pylist())
        centres = np.frombuffer(own["centres"][0].as_py(), np.float64).reshape(-1, x.shape[1])
        near = nearest(x, centres, inner) + (rows["shard"][0].as_py() << BITS)
        return pa.table({"rep": rows["rep"], "shard": rows["shard"], "within": pa.array(near.tolist(), pa.list_(pa.int64()))})

    both = dealt.select("shard", "task", "rep", "unit").groupBy("shard", "task").cogroup(each.groupBy("shard", "task"))
    within = both.applyInArrow(place, "rep long, shard long, within array<long>").groupBy("rep")
    # At most as many lists as a vector has shards.
    within = within.agg(F.collect_list("shard").alias("split"), F.flatten(F.collect_list("within")).alias("within"))
    shards = F.when(F.col("split").isNull(), F.col("shards")).otherwise(F.array_sort(F.concat(F.array_except("shards", "split"), "within")))
    return cut(placed.join(within, "rep", "left").select("rep", "mult", "unit", shards.alias("shards")))


def link_up(reps: DataFrame, centres: dict[int, np.ndarray], overlap: int, link: float, exact: bool = False) -> DataFrame:
    """(u, v, n): n more links of u, or (v given) an edge of the forest.

    With ``exact`` all vectors of two parts are compared.
    """
    first = assign(reps, {} if exact else centres, overlap)
    sizes = shard_sizes(first)
    placed = first if exact else refine(first, sizes, overlap)
    if placed is not first:
        sizes = shard_sizes(placed)
    deals = sizes.select("shard", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("deal"))
    member = placed.withColumn("shard", F.explode("shards")).join(small(deals), "shard")
    member = cut(member.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("deal")).cast("int")))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("rep")
        ids = shard["rep"].to_numpy()
        near = prune(matrix(shard["unit"].to_pylist()))
        return pa.table({"rep": pa.array(ids), "near": pa.array([ids[a].tolist() for a in near], pa.list_(pa.int64()))})

    lists = member.select("shard", "part", "rep", "unit").groupBy("shard", "part").applyInArrow(build, "rep long, near array<long>")
    # The union of as many lists of bounded length as a vector has shards.
    flat = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    dealt = member.join(flat, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    dealt = dealt.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))

    def find(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        part, here = group["part"].to_numpy(), group["shard"][0].as_py()
        ids, mult = group["rep"].to_numpy(), group["mult"].to_numpy()
        x, own = matrix(group["unit"].to_pylist()), group["shards"].to_pylist()
        shards = np.full((len(own), max(map(len, own))), -1)
        for k, some in enumerate(own):
            shards[k, : len(some)] = some
        lists = group["near"].combine_chunks()
        owner, near = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        found = [np.zeros((0, 2), np.int64)]
        for a, b in {(i, j), (j, i)}:
            asked, held = np.flatnonzero(part == a), np.flatnonzero(part == b)
            if not len(asked) or not len(held):  # a part without vectors
                continue
            at = np.minimum(np.searchsorted(ids[held], near), len(held) - 1)  # ids ascend
            inside = (part[owner] == b) & (ids[held][at] == near)
            graph = np.split(at[inside], np.searchsorted(owner[inside], held)[1:])
            u, v = np.nonzero(x[asked] @ x[held].T >= link) if exact else search(x[asked], x[held], graph, link)
            found.append(np.stack([asked[u], held[v]], 1))
        pairs = np.concatenate(found)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        u, v = pairs[:, 0], pairs[:, 1]
        # The first shard that both belong to counts the pair.
        both = (shards[u][:, :, None] == shards[v][:, None, :]).any(axis=2) & (shards[u] >= 0)
        common = np.where(both, shards[u], np.iinfo(np.int64).max)
        mine = common.min(axis=1, initial=np.iinfo(np.int64).max) == here
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, u[mine], mult[v[mine]])
        np.add.at(n, v[mine], mult[u[mine]])
        root = _roots(len(ids), u, v)
        some, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table(
            {
                "u": pa.array(np.concatenate([ids[some], ids[tied]])),
                "v": pa.array([None] * len(some) + ids[root[tied]].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([n[some], np.zeros(len(tied), np.int64)])),
            }
        )

    return cut(dealt.select("shard", "i", "j", "part", "rep", "mult", "unit", "shards", "near").groupBy("shard", "i", "j").applyInArrow(find, "u long, v long, n long"))


def audit(reps: DataFrame, counted: DataFrame, link: float, most: int = AUDIT) -> float:
    """The share of links found, as the mean over audited vectors that have any.

    The lower of two means: over vectors chosen by hash alone, and over those
    with few links, which large groups don't outweigh.
    """
    chosen = lambda some: [r["rep"] for r in some.orderBy(F.xxhash64("rep"), "rep").limit(most).select("rep").collect()]
    sets = [set(chosen(reps)), set(chosen(counted.filter(F.col("n") <= FEW_LINKS)))]
    asked = reps.filter(F.col("rep").isin(*set().union(*sets))).select("rep", "unit").orderBy("rep").collect()
    if not asked:
        return 1.0
    ids, groups = np.array([r["rep"] for r in asked]), by_length([bytes(r["unit"]) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in slices(batches, 2048):
            rep, mult = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for some, x in by_length(batch.column(2).to_pylist()):
                for mine, y in groups:
                    if x.shape[1] == y.shape[1]:
                        near = y @ x.T >= link
                        total[mine] += ((near & (rep[some][None, :] != ids[mine][:, None])) * mult[some][None, :]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rep", "n"])

    true = reps.select("rep", "mult", "unit").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("true")).filter(F.col("true") > 0)
    rows = true.join(counted, "rep", "left").select("rep", (F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("share")).collect()
    means = [np.mean(found) for some in sets if (found := [r["share"] for r in rows if r["rep"] in some])]
    return float(min(means, default=1.0))


def centres_of(sample: DataFrame, n: int, overlap: int) -> dict[int, np.ndarray]:
    """Centres of each length of a bounded sample, fitted in one task; their number follows that of all ``n`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = sorted(x for batch in batches for x in batch.column(0).to_pylist())
        found = {}
        for some, x in by_length(packed):
            share = n * len(some) / len(packed)
            found[x.shape[1]] = fit_centres(x, min(MAX_CENTRES, max(1, -(-int(share * overlap) // SHARD_ROWS))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["centres"])

    return pickle.loads(sample.select("unit").repartition(1).mapInArrow(run, "centres binary").first()["centres"])


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", link: float = LINK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector."""
    units = cut(unit_vectors(df, id_column, vector))
    reps = cut(units.filter("unit IS NOT NULL").groupBy("unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult")))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    n, width = reps.agg(F.count(F.lit(1)), F.max(F.octet_length("unit"))).first()
    if n:
        # The sample: about SAMPLE vectors by hash, or as many as may reach SAMPLE_BYTES.
        most = min(SAMPLE, max(1, SAMPLE_BYTES // width))
        draw = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
        sample, exact = reps.filter(draw | (F.lit(n) <= most)), False
        while True:
            centres = centres_of(sample, n, overlap)
            k = max(map(len, centres.values()), default=1)
            found = link_up(reps, centres, overlap, link, exact)
            counted = cut(found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n")))
            recall = audit(reps, counted, link)
            logging.getLogger(__name__).info("recall %.4f with %d of %d shards a vector", recall, overlap, k)
            if recall >= RECALL or exact:
                break
            exact, overlap = overlap >= k, 2 * overlap
        joined = small(cut(components(found.filter("v IS NOT NULL"), "u", "v")))
        reps = reps.join(small(counted), "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
        links = (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")
        reps = cut(reps.select("unit", "root", "mult", "least", links))
        least = cut(reps.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
        reps = cut(join_hot(reps, least, "root", "members").select("unit", "n_links", "component_id", "mult"))
        linked = join_hot(units.filter("unit IS NOT NULL"), reps, "unit", "mult")
    else:
        linked = units.limit(0).select("*", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    alone = units.filter("unit IS NULL").select("*", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").union(alone.select("id", "n_links", "component_id")).withColumnRenamed("id", id_column)
    return out.withColumn("n_links", F.col("n_links").cast("long")).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links and component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: For tables of some thousand vectors: the links are those of all pairs.
SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    usable AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LINK}),
    reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT w, root FROM reach JOIN link ON u = id),
    part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
    deg AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN part ON id = vec_id LEFT JOIN deg ON u = vec_id"""
