"""Problem 3: the k most similar vectors of every vector, by balanced posting lists.

The index is fitted on a sample: balanced clustering splits it until every cluster stands for about `list_size`
vectors, so lists keep their length and their number grows with the table. The clusters' centres are joined into a
graph that a worker holds in memory. Every vector is then indexed: it goes to the list of its nearest centre and,
near a boundary, also to the next ones. Every vector also asks: the centres near it are searched in the graph, and
the lists within a ratio of the nearest distance are read. That ratio, and the number of lists it takes, are not
constants: they are fitted to the recall asked for, by brute force of a bounded sample of queries against all rows.

Lists lie in the order of the clustering, so neighbouring lists form groups and a vector is sent once to each group
it has to do with, not once to each list. A group with very many rows is cut into blocks of bounded size, each pair
of blocks its own task group. Exact copies (one direction) are searched once and expanded afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import Workspace, rows_of, spread

LIST_SIZE = 1024  # vectors a list should stand for
PER_CENTRE = 16  # vectors the index is fitted on, for each list
SAMPLE_LIMIT = 1 << 20  # ... and in all, at most (256 MB): beyond 64 million vectors a list is fitted on fewer, down to 4
LEAST_SAMPLE = 4096
ASKED = 4096  # queries the reading rule is fitted on
DEGREE = 20  # neighbours of a centre in the graph
COPIES = 4  # lists a boundary vector is put into, at most
CLOSURE = 1.10  # ... those whose centre is within this ratio of the nearest one's distance
GROUP = 8  # neighbouring lists searched in one place
BLOCK = 32_768  # rows of a block
SLACK = 3  # candidates kept beyond k while similarities are in single precision


def usable_vectors(df: DataFrame, dimensions: int = 64) -> DataFrame:
    """(token, vec array<double>): of each token the row of the highest graph_version, if it holds a vector.

    Usable are an array of `dimensions` finite numbers, not all zero, in a row whose `dimensions` says so. A null
    token is left out, a null graph_version is the lowest, repeated rows count once.
    """
    v = F.from_json("vector_json", "array<double>")
    fine = (F.col("dimensions") == dimensions) & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.where(F.col("token").isNotNull()).select("token", "graph_version", "dimensions", v.alias("v"))
    rows = rows.select("token", F.struct("graph_version", F.when(fine, F.col("v")).alias("v")).alias("row"))
    return rows.groupBy("token").agg(F.max("row").alias("row")).where(F.col("row.v").isNotNull()).select("token", F.col("row.v").alias("vec"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _rows(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _directions(df: DataFrame, d: int) -> DataFrame:
    """(token, direction, vec): unit vectors, and a 64-bit name of the direction that exact copies share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("vec"), d)
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
            names = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "big", signed=True) for r in np.round(m, 9) + 0.0]
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(names, pa.int64()), _rows(m.astype(np.float32))], names=["token", "direction", "vec"])

    return df.mapInArrow(work, "token string, direction bigint, vec array<float>")


# ------------------------------------------------------------------------------------------------- index
def balanced_centres(x: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Centres of clusters of at most `leaf` rows (more only where rows are equal), split top down."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        m = x[rows]
        k = min(16, -(-len(rows) // leaf))
        if k < 2 or np.ptp(m, axis=0).max() < 1e-9:
            c = m.mean(axis=0)
            out.append(c / max(np.linalg.norm(c), 1e-12))
            continue
        c = m[rng.choice(len(m), k, replace=False)]
        for _ in range(8):
            near = np.argmax(m @ c.T, axis=1)
            for j in range(k):
                own = m[near == j]
                c[j] = own.mean(axis=0) if len(own) else m[rng.integers(len(m))]
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        parts = [rows[near == j] for j in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal directions only: cut in halves
            parts = np.array_split(rows, 2)
        todo += parts
    return np.array(out)


class CentreGraph:
    """Centres and a graph over them: each is joined to near ones that are not nearer to each other, both ways."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.c = centres.astype(np.float32)
        n = len(centres)
        rng = np.random.default_rng(seed)
        pool = min(n - 1, 3 * degree)
        links = np.full((n, min(n, 2 * degree)), -1, dtype=np.int32)
        for i in range(0, n if pool > 0 else 0, 512):
            s = self.c[i : i + 512] @ self.c.T
            here = np.arange(len(s))
            s[here, here + i] = -2
            near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
            sims = np.take_along_axis(s, near, axis=1)
            order = np.argsort(-sims, axis=1)
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            among = np.matmul(self.c[near], self.c[near].transpose(0, 2, 1))
            kept = np.zeros(near.shape, dtype=bool)
            for j in range(pool):  # kept unless it is nearer to a kept one than to the centre; a few nearest stay anyway
                kept[:, j] = (kept.sum(axis=1) < degree) & ((j < 6) | ~(kept & (among[:, :, j] > sims[:, j : j + 1])).any(axis=1))
            r, j = np.nonzero(kept)
            links[i + r, np.cumsum(kept, axis=1)[r, j] - 1] = near[r, j]
        free = (links >= 0).sum(axis=1)
        for a, b in zip(*(x.tolist() for x in np.nonzero(links[:, :degree] >= 0))) if pool > 0 else ():  # and back
            other = links[a, b]
            if free[other] < links.shape[1] and a not in links[other]:
                links[other, free[other]] = a
                free[other] += 1
        self.links = links
        self.entries = rng.choice(n, min(n, max(64, 32 * int(n**0.5))), replace=False)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the `beam` nearest centres of each query, nearest first; id -1: none."""
        q = q.astype(np.float32)
        n = len(self.c)
        if n <= 2 * beam:
            s = q @ self.c.T
            ids = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            return ids, np.take_along_axis(s, ids, axis=1)
        s = q @ self.c[self.entries].T
        first = np.argsort(-s, axis=1)[:, : min(max(4, beam // 2), s.shape[1])]
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -2.0, dtype=np.float32)
        ids[:, : first.shape[1]] = self.entries[first]
        sims[:, : first.shape[1]] = np.take_along_axis(s, first, axis=1)
        seen = np.zeros((len(q), beam), dtype=bool)
        live = np.arange(len(q))
        for _ in range(4 * beam):
            open_ = np.where(seen[live] | (ids[live] < 0), -3.0, sims[live])
            pick = open_.argmax(axis=1)
            go = open_[np.arange(len(live)), pick] > -2.5
            live, pick = live[go], pick[go]
            if not len(live):
                break
            seen[live, pick] = True
            nb = self.links[ids[live, pick]]
            known = (nb < 0) | (nb[:, :, None] == ids[live][:, None, :]).any(axis=2)
            ns = np.matmul(self.c[nb], q[live][:, :, None])[:, :, 0]
            ns[known] = -2.0
            nb = np.where(known, -1, nb)
            all_ids = np.concatenate([ids[live], nb], axis=1)
            all_sims = np.concatenate([sims[live], ns], axis=1)
            all_seen = np.concatenate([seen[live], np.zeros_like(known)], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], seen[live] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_seen))
        return ids, sims

    def near(self, q: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, chosen): of each query at most `most` centres, those within `ratio` of the nearest one's distance."""
        ids, sims = self.search(q, min(len(self.c), max(16, 2 * most)))
        twice = np.zeros_like(ids, dtype=bool)
        order = np.argsort(ids, axis=1, kind="stable")
        s = np.take_along_axis(ids, order, axis=1)
        np.put_along_axis(twice, order, np.concatenate([np.zeros((len(s), 1), dtype=bool), s[:, 1:] == s[:, :-1]], axis=1), axis=1)
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims))
        there = (ids >= 0) & ~twice
        return ids, there & (away <= ratio * away[:, :1] + 1e-6) & (np.cumsum(there, axis=1) <= most)


def _some(ids: np.ndarray, which: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(which.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[which], pa.int32()))


def _near_lists(rows: DataFrame, graph, most: int, ratio: float, d: int, name: str) -> DataFrame:
    """rows(direction, token, vec, ...) with a column of the lists whose centres are near; graph None: list 0."""
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    at = rows.columns.index("vec")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(at), d)
            for i in range(0, len(m), 2048):
                part = m[i : i + 2048]
                if graph is None:
                    ids = np.zeros((len(part), 1), dtype=np.int64)
                    got = _some(ids, ids == 0)
                else:
                    got = _some(*graph.value.near(part, most, ratio))
                yield pa.RecordBatch.from_arrays([*b.slice(i, len(part)).columns, got], names=[*b.schema.names, name])

    return spread(rows).mapInArrow(work, f"{fields}, {name} array<int>")


# ------------------------------------------------------------------------------------------- reading rule
def _truly_nearest(lists: DataFrame, queries: pa.Table, k: int, d: int) -> list:
    """Rows (q, sim, put) of the k truly nearest of each of the queries: one pass over all rows, k a query come back."""
    names = queries.column("direction").to_numpy()
    shared = lists.sparkSession.sparkContext.broadcast((names, _matrix(queries.column("vec").combine_chunks(), d)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best, at = np.full((len(q), k), -2.0, dtype=np.float32), np.full((len(q), k), -1, dtype=np.int64)
        puts: list = []  # of the rows that were among the best when they came
        for b in batches:
            m, ids, put = _matrix(b.column("vec"), d), b.column("direction").to_numpy(), b.column("put")
            for i in range(0, len(m), 2048):
                s = q @ m[i : i + 2048].T
                s[names[:, None] == ids[None, i : i + 2048]] = -2.0
                n = min(k, s.shape[1])
                c = np.argpartition(-s, n - 1, axis=1)[:, :n]
                sims = np.take_along_axis(s, c, axis=1)
                used, code = np.unique(np.where(sims > best[:, -1:], c, -1), return_inverse=True)
                code = np.where(used[code.reshape(c.shape)] < 0, -1, code.reshape(c.shape) + len(puts))
                puts += [None if u < 0 else put[i + int(u)] for u in used]
                both, codes = np.concatenate([best, np.where(code < 0, -2.0, sims)], axis=1), np.concatenate([at, code], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best, at = np.take_along_axis(both, order, axis=1).astype(np.float32), np.take_along_axis(codes, order, axis=1)
        there = [(int(n), float(s), puts[c].as_py()) for n, row, codes in zip(names, best, at) for s, c in zip(row, codes) if c >= 0]
        cols = list(zip(*there)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["q", "sim", "put"])

    top = lists.select("direction", "vec", "put").mapInArrow(work, "q bigint, sim double, put array<int>")
    return top.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim")))).where(F.col("r") <= k).collect()


def _reading_rule(graph: CentreGraph, lists: DataFrame, n: int, k: int, least: float, recall: float, asked: int, d: int) -> tuple[int, float]:
    """(most, ratio): how many lists a query reads, and within which ratio, so that `recall` of the true neighbours of
    the sampled queries lie in a list it reads. Neighbours below `least` do not count unless there are hardly others."""
    queries = lists.where(F.pmod(F.xxhash64("direction", F.lit(11)), F.lit(max(1, n // asked))) == 0).select("direction", "vec").limit(2 * asked).toArrow()
    row = {int(x): i for i, x in enumerate(queries.column("direction").to_numpy())}
    hits = _truly_nearest(lists, queries, k, d)
    close = [h for h in hits if h.sim >= least]
    hits = close if len(close) >= 30 else hits
    if not hits:
        return len(graph.c), 1e9
    q = _matrix(queries.column("vec").combine_chunks(), d)
    ratios, places = [], []
    by_query: dict[int, list] = {}
    for h in hits:
        by_query.setdefault(row[h.q], []).append(h.put)
    for i, puts in by_query.items():
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (graph.c @ q[i])))
        for put in puts:
            mine = away[np.array(put)].min()
            ratios.append(mine / max(float(away.min()), 1e-6))
            places.append(int((away < mine).sum()) + 1)
    part = 1.0 - (1.0 - recall) / 2  # what the two rules may lose together
    most = int(np.quantile(places, part, method="higher"))
    return most + 2 + most // 4, float(np.quantile(ratios, part, method="higher")) * 1.01  # with a margin for the sample


# ------------------------------------------------------------------------------------------------ search
def _in_group(t: pa.Table, lists: str, group: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of all lists of the group that the rows name, in order of the list."""
    col = t.column(lists).combine_chunks()
    ids = np.asarray(col.flatten())
    rows = np.repeat(np.arange(len(col)), np.diff(np.asarray(col.offsets)))
    here = ids // size == group
    rows, ids = rows[here], ids[here]
    order = np.argsort(ids, kind="stable")
    return rows[order], ids[order]


def _search_block(k: int, least: float, d: int, size: int):
    """Searches one block of queries in one block of a group. Candidates are chosen in single precision, then scored in double."""
    keep_n = k + SLACK

    def best_of(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keep_n best of each row r, each candidate c once."""
        o = np.lexsort((c, r))
        r, c, s = r[o], c[o], s[o]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        r, c, s = r[new], c[new], s[new]
        o = np.lexsort((c, -s, r))
        r, c, s = r[o], c[o], s[o]
        first = np.searchsorted(r, r, side="left")
        ok = np.arange(len(r)) - first < keep_n
        return r[ok], c[ok], s[ok]

    def work(key, items: pa.Table, queries: pa.Table) -> pa.Table:
        found_q, found_x, found_s = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
        q = iq = x = ix = None
        if items.num_rows and queries.num_rows:
            items = items.sort_by("token")  # ties go to the smaller token
            x, ix = _matrix(items.column("vec").combine_chunks(), d), items.column("direction").to_numpy()
            q, iq = _matrix(queries.column("q_vec").combine_chunks(), d), queries.column("q_direction").to_numpy()
            xr, xl = _in_group(items, "put", key[0].as_py(), size)
            qr, ql = _in_group(queries, "q_ask", key[0].as_py(), size)
            floor = np.full(len(q), least - 1e-5 if least > -1.0 else -1.5, dtype=np.float32)
            for one in np.intersect1d(xl, ql):
                mine = xr[np.searchsorted(xl, one, side="left") : np.searchsorted(xl, one, side="right")]
                ask = qr[np.searchsorted(ql, one, side="left") : np.searchsorted(ql, one, side="right")]
                part, names = x[mine], ix[mine]
                by_name = np.argsort(names)
                got_r, got_c, got_s = [], [], []
                for i in range(0, len(ask), 1024):
                    rows = ask[i : i + 1024]
                    s = q[rows] @ part.T
                    at = by_name[np.minimum(np.searchsorted(names, iq[rows], sorter=by_name), len(names) - 1)]
                    own = names[at] == iq[rows]
                    s[np.flatnonzero(own), at[own]] = -2.0
                    edge = floor[rows]
                    if s.shape[1] > keep_n:
                        hot = (s > edge[:, None]).sum(axis=1) > keep_n
                        if hot.any():
                            edge = edge.copy()
                            edge[hot] = np.partition(s[hot], s.shape[1] - keep_n, axis=1)[:, s.shape[1] - keep_n]
                    r, c = np.nonzero(s >= edge[:, None])
                    got_r.append(rows[r])
                    got_c.append(mine[c])
                    got_s.append(s[r, c])
                r, c, s = best_of(np.concatenate([found_q, *got_r]), np.concatenate([found_x, *got_c]), np.concatenate([found_s, *got_s]))
                found_q, found_x, found_s = r, c, s
                full = np.bincount(r, minlength=len(q)) >= keep_n
                last = np.full(len(q), np.inf, dtype=np.float32)
                np.minimum.at(last, r, s)
                floor[full] = np.maximum(floor[full], last[full])
        if not len(found_q):
            return pa.table({"q": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "o": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
        sim = np.einsum("ij,ij->i", q[found_q].astype(np.float64), x[found_x].astype(np.float64))
        ok = sim >= least
        return pa.table({"q": pa.array(iq[found_q][ok], pa.int64()), "other": pa.array(ix[found_x][ok], pa.int64()), "o": items.column("token").take(pa.array(found_x[ok])).combine_chunks().cast(pa.string()), "sim": pa.array(sim[ok], pa.float64())})

    return work


def _blocked(rows: DataFrame, sizes: DataFrame, own: str, block: int) -> DataFrame:
    """Each row of (grp, ...) in a block of its own side, once for every block of the other side.

    sizes: (grp, items, queries), one row for each group of lists, a number bounded by the centres.
    """
    other = "queries" if own == "items" else "items"
    n = lambda side: F.greatest(F.lit(1), F.ceil(F.col(side) / block)).cast("int")
    mine = F.pmod(F.hash("direction", F.lit(3)), n(own))
    j = rows.join(F.broadcast(sizes), "grp").select(*rows.columns, mine.alias("mine"), F.explode(F.sequence(F.lit(0), n(other) - 1)).alias("theirs"))
    a, b = ("mine", "theirs") if own == "items" else ("theirs", "mine")
    return j.select("grp", F.col(a).alias("ib"), F.col(b).alias("qb"), *[c for c in rows.columns if c != "grp"])


def nearest(
    vectors: DataFrame,
    k: int = 5,
    least: float = -1.0,
    dimensions: int = 64,
    recall: float = 0.95,
    exact: bool = False,
    list_size: int = LIST_SIZE,
    sample_limit: int = SAMPLE_LIMIT,
    asked: int = ASKED,
    copies: int = COPIES,
    closure: float = CLOSURE,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """(token, other, sim, rank): for every token its k most similar others with a cosine of `least` or more.

    recall: the share of true neighbours that must be found, by which the lists to read are chosen (fitted on about
    `asked` queries against all rows). exact: one list, every block against every block, nothing is missed and the
    work is quadratic. Ties of similarity go to the smaller token. Copies of one direction are each other's nearest
    at 1.0. An empty or one-row table gives no rows. `least` is applied inside the blocks; since the k best of at
    least `least` are the k best cut off at `least`, nothing is lost by it.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "nearest")
    named = ws.save(_directions(vectors.select("token", "vec"), dimensions), "directions")
    members = named.select("direction", "token")
    by_token = W.partitionBy("direction").orderBy("token")
    heads = members.withColumn("place", F.row_number().over(by_token)).where(F.col("place") <= k + 1)
    heads = ws.save(heads, "heads")
    # one row per direction: the row of its least token
    singles = named.join(heads.where("place = 1").select("direction", "token"), ["direction", "token"], "left_semi").dropDuplicates(["direction"]).select("direction", "token", "vec")
    singles = ws.save(singles, "singles")
    n = rows_of(singles)
    if n < 1:
        return members.limit(0).select("token", F.col("token").alias("other"), F.lit(1.0).alias("sim"), F.lit(1).alias("rank"))
    centres, graph, most, ratio = -(-n // list_size), None, 1, 1.0
    if centres > 1 and not exact:
        want = min(sample_limit, max(LEAST_SAMPLE, PER_CENTRE * centres))
        every = max(1, n // want)
        fit = singles.where(F.pmod(F.xxhash64("direction"), F.lit(every)) == 0).select("vec").limit(2 * want).toArrow()
        x = _matrix(fit.column("vec").combine_chunks(), dimensions)
        graph = spark.sparkContext.broadcast(CentreGraph(balanced_centres(x, max(4, list_size // every))))
    lists = ws.save(_near_lists(singles, graph, copies, closure, dimensions, "put"), "lists")
    ws.drop(singles)
    if graph is not None:
        most, ratio = _reading_rule(graph.value, lists, n, k, least, recall, asked, dimensions)
    found = ws.save(_near_lists(lists, graph, most, ratio, dimensions, "ask"), "asked")
    ws.drop(lists)
    groups = lambda c: F.explode(F.array_distinct(F.transform(c, lambda x: F.floor(x / group).cast("int"))))
    sizes = found.select(groups("put").alias("grp"), F.lit(1).alias("i"), F.lit(0).alias("q")).unionAll(found.select(groups("ask"), F.lit(0), F.lit(1)))
    sizes = ws.save(sizes.groupBy("grp").agg(F.sum("i").alias("items"), F.sum("q").alias("queries")), "sizes")
    items = _blocked(found.select(groups("put").alias("grp"), "direction", "token", "vec", "put"), sizes, "items", block)
    queries = _blocked(found.select(groups("ask").alias("grp"), "direction", "vec", "ask"), sizes, "queries", block).toDF("q_grp", "q_ib", "q_qb", "q_direction", "q_vec", "q_ask")
    hits = items.groupBy("grp", "ib", "qb").cogroup(queries.groupBy("q_grp", "q_ib", "q_qb")).applyInArrow(_search_block(k, least, dimensions, group), "q bigint, other bigint, o string, sim double")
    best = hits.groupBy("q", "other", "o").agg(F.max("sim").alias("sim"))
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "o"))).where(F.col("r") <= k).select("q", "other", "sim")
    best = ws.save(best, "best")
    ws.drop(found)
    twins = members.join(heads.select("direction", F.col("token").alias("other")), "direction").where("token <> other").select("token", "other", F.lit(1.0).alias("sim"))
    to_token = best.join(members.withColumnRenamed("direction", "q"), "q").join(heads.where(F.col("place") <= k).select(F.col("direction").alias("other"), F.col("token").alias("o")), "other")
    all_ = to_token.select("token", F.col("o").alias("other"), F.least("sim", F.lit(1.0)).alias("sim")).unionByName(twins)
    ranked = all_.withColumn("rank", F.row_number().over(W.partitionBy("token").orderBy(F.desc("sim"), "other")))
    return ranked.where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, recall: float = 0.999, **options) -> DataFrame:
    """(token_a, token_b), token_a < token_b: one is among the k nearest of the other, with a cosine of least or more."""
    near = nearest(vectors, k, least, recall=recall, **options)
    return near.select(F.least("token", "other").alias("token_a"), F.greatest("token", "other").alias("token_b")).distinct()
