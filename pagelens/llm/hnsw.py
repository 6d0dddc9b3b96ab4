"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of one length make up shards; each shard gets a graph of its own, and every vector asks every shard of its length. A
search keeps a beam of the nearest vectors met so far. Every task audits its searches: for sampled vectors of the shard a
probe is made whose cosine to the vector is just the threshold, the hardest link there is, and must find it; and sampled
queries must find what a full scan of the shard finds, themselves left out. The beam is widened until both lose almost
nothing; past the widest beam the shard is scanned. A query whose beam is full of linked vectors is widened by itself, so
that a large group of copies is found whole. Cosines are taken again in double precision, and components follow from the links.

A task's memory is bounded by bytes, whatever the number, length and likeness of the vectors: shards and parts of queries have
a size, graphs cross the network in pieces, vectors are held once as they are given and made unit vectors in blocks, and links
are counted and joined a block at a time.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stars, with_facts

#: Links of a vector on the lowest level, twice as many as on the others, and the beam while building.
LINKS, BUILD_BEAM = 12, 48
#: Beams of the searches, in turn, and what audited queries must find at least.
BEAMS, RECALL = (24, 48, 96, 192), 0.995
#: Queries of a task that are compared with a full scan, and probes of it.
AUDITED, PROBES = 64, 400
#: Vectors of a shard at most, and their bytes in double precision; shards of the vectors of one length, unless these are few.
SHARD_VECTORS, SHARD_BYTES, SHARDS, FEW_VECTORS = 200_000, 64 << 20, 6, 500
#: Bytes of the queries of a task in double precision, at least and at most, and their number at most; within these, parts that
#: the queries are dealt over.
PART_BYTES, PART_VECTORS, PARTS = (2 << 20, 64 << 20), 200_000, 4
#: Bytes of the vectors that are gathered, made unit vectors or compared at once, of the places that a walk has met, and of a
#: piece of a graph that crosses the network as one row.
BLOCK_BYTES, SEEN_BYTES, PIECE_BYTES = 16 << 20, 48 << 20, 4 << 20
#: Partitions for each graph or part, so that few share one.
SPREAD = 4


#: The graph's cosines are in single precision.
SLACK = 1e-5


class Graph:
    """A navigable small-world graph over unit vectors; vectors are added and asked for in batches."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 6)
        self.out = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.top, self.entry = -1, -1
        at, size = 0, 1
        while at < n:
            self._add(np.arange(at, min(n, at + size)), links, beam)
            at, size = at + size, min(512, max(32, at))

    def _add(self, new: np.ndarray, links: int, beam: int) -> None:
        """Link a batch: candidates are what a search finds, and the batch's other members."""
        q = self.v[new]
        near = np.full((len(new), 1), self.entry, np.int64)
        within = q @ q.T
        np.fill_diagonal(within, -2)
        for k in range(max(self.top, int(self.level[new].max())), -1, -1):
            on = self.level[new] >= k
            found = sims = None
            if self.entry >= 0 and k <= self.top:
                found, sims = self._walk(q, near, beam if on.any() else 1, k)
                near = found[:, : max(1, min(4, found.shape[1]))]
            if not on.any():
                continue
            rows = np.flatnonzero(on)
            peers = np.where(on[None, :], within[rows], -2)
            best = np.argsort(-peers, axis=1)[:, : min(beam, len(new))]
            ids, sim = new[best], np.take_along_axis(peers, best, 1)
            ids = np.where(sim > -2, ids, -1)
            if found is not None:
                ids, sim = np.concatenate([found[rows], ids], 1), np.concatenate([sims[rows], sim], 1)
            self._link(new[rows], ids, sim, k)
        high = new[np.argmax(self.level[new])]
        if self.level[high] > self.top:
            self.top, self.entry = int(self.level[high]), int(high)

    def _pick(self, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates of each row that are nearer to the row than to one picked before; the nearest of
        the rest fill up."""
        step = max(1, BLOCK_BYTES // (12 * most * (self.v.shape[1] + 3 * most)))
        if len(ids) > step:
            return np.concatenate([self._pick(ids[a : a + step], sim[a : a + step], most) for a in range(0, len(ids), step)])
        sim = np.where(ids >= 0, sim, -3.0)
        order = np.argsort(-sim, axis=1)[:, : 3 * most]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        v = self.v[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            covered = (np.where(kept, between[:, c], -3.0) > sim[:, c, None]).any(1)
            kept[:, c] = (ids[:, c] >= 0) & ~covered & (kept.sum(1) < most)
        rank = np.argsort(~kept * 2 + (ids < 0), axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
        return out

    def _link(self, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> None:
        table = self.out[k]
        table[rows] = self._pick(ids, sim, table.shape[1])
        back = np.repeat(rows, table.shape[1]).astype(np.int32)
        to = table[rows].ravel()
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        who, first, many = np.unique(to, return_index=True, return_counts=True)
        # by how many link to them, so that one that the whole batch links to makes few rows wide
        by = np.argsort(many, kind="stable")
        who, first, many = who[by], first[by], many[by]
        a = b = 0
        while b < len(who):
            a, b = b, min(len(who), b + 2048)
            while b - a > 1 and (b - a) * (table.shape[1] + int(many[b - 1])) * self.v.shape[1] * 4 > BLOCK_BYTES:
                b = a + (b - a + 1) // 2
            w, f, m = who[a:b], first[a:b], many[a:b]
            width = int(m.max())
            more = np.full((len(w), width), -1, np.int32)
            inside = np.arange(width) < m[:, None]
            more[inside] = back[(f[:, None] + np.arange(width))[inside]]
            every = np.concatenate([table[w], more], 1)
            every = np.sort(every, axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            s = np.einsum("rcd,rd->rc", self.v[np.maximum(every, 0)], self.v[w])
            table[w] = self._pick(every, s, table.shape[1])

    def _walk(self, q: np.ndarray, start: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one level: ids and similarities, nearest first; -1 fills up."""
        table, n = self.out[k], len(self.v)
        ids_out, sims_out = [], []
        step = max(16, min(1024, SEEN_BYTES // max(1, n), BLOCK_BYTES // (8 * table.shape[1] * self.v.shape[1])))
        for a in range(0, len(q), step):
            qq, ss = q[a : a + step], start[a : a + step]
            m = len(qq)
            seen = np.zeros((m, n + 1), bool)
            ids = np.full((m, max(beam, ss.shape[1])), -1, np.int64)
            ids[:, : ss.shape[1]] = ss
            np.put_along_axis(seen, np.where(ids < 0, n, ids), True, 1)
            sim = np.where(ids >= 0, np.einsum("rcd,rd->rc", self.v[np.maximum(ids, 0)], qq), -3.0).astype(np.float32)
            done = ids < 0
            live = np.arange(m)
            while len(live):
                rest = np.where(done[live], -4.0, sim[live])
                width = min(2, rest.shape[1])
                pick = np.argpartition(-rest, width - 1, axis=1)[:, :width]
                ok = np.take_along_axis(rest, pick, 1) > -3.5
                go = ok.any(1)
                live, pick, ok = live[go], pick[go], ok[go]
                if not len(live):
                    break
                np.put_along_axis(d := done[live], pick, True, 1)
                done[live] = d
                from_ = np.where(ok, np.take_along_axis(ids[live], pick, 1), -1)
                near = np.where(from_[:, :, None] >= 0, table[np.maximum(from_, 0)], -1).reshape(len(live), -1).astype(np.int64)
                near[seen[live[:, None], np.where(near < 0, n, near)]] = -1
                near.sort(axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
                seen[live[:, None], np.where(near < 0, n, near)] = True
                s = np.einsum("rcd,rd->rc", self.v[np.maximum(near, 0)], qq[live])
                s = np.where(near >= 0, s, -3.0)
                all_ids, all_s = np.concatenate([ids[live], near], 1), np.concatenate([sim[live], s], 1)
                all_d = np.concatenate([done[live], near < 0], 1)
                keep = np.argpartition(-all_s, beam - 1, axis=1)[:, : ids.shape[1]] if all_s.shape[1] > ids.shape[1] else np.tile(np.arange(all_s.shape[1]), (len(live), 1))
                ids[live], sim[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_s, all_d))
            order = np.argsort(-sim, axis=1)[:, :beam]
            ids_out.append(np.take_along_axis(ids, order, 1))
            sims_out.append(np.take_along_axis(sim, order, 1))
        return np.concatenate(ids_out), np.concatenate(sims_out)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        near = np.full((len(q), 1), self.entry, np.int64)
        for k in range(self.top, 0, -1):
            near, _ = self._walk(q, near, 4, k)
        return self._walk(q, near, beam, 0)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, level=self.level, top=self.top, entry=self.entry, **{f"out{k}": x[self.level >= k] for k, x in enumerate(self.out)})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes, vectors: np.ndarray) -> Graph:
        """The graph that :meth:`dump` wrote, over the same vectors."""
        z, g = np.load(io.BytesIO(raw)), cls.__new__(cls)
        g.v, g.level, g.top, g.entry = vectors.astype(np.float32), z["level"], int(z["top"]), int(z["entry"])
        g.out = []
        for k in range(sum(x.startswith("out") for x in z.files)):
            links = z[f"out{k}"]  # of the vectors that this level has
            g.out.append(np.full((len(g.level), links.shape[1]), -1, np.int32))
            g.out[k][g.level >= k] = links
        return g


def unit(vectors: list) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square over- or underflows."""
    v = np.array(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Units:
    """Vectors as they are given, which become unit vectors, the same as by :func:`unit`, only where they are asked for."""

    def __init__(self, given: np.ndarray):
        self.given, self.shape = given, given.shape

    def __len__(self) -> int:
        return len(self.given)

    def __getitem__(self, at) -> np.ndarray:
        return unit(self.given[at])

    def astype(self, kind: type) -> np.ndarray:
        out = np.empty(self.shape, kind)
        for part in _blocks(len(self), 8 * self.shape[1]):
            out[part] = self[part]
        return out


def _blocks(n: int, row_bytes: int) -> Iterator[slice]:
    """Slices of ``n`` rows, each of about BLOCK_BYTES."""
    step = max(1, BLOCK_BYTES // max(1, row_bytes))
    return (slice(a, min(n, a + step)) for a in range(0, n, step))


def _probes(held: np.ndarray | Units, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places of sampled vectors, and for each a vector whose cosine to it is just over ``least``."""
    at = rng.permutation(len(held))[:PROBES]
    if held.shape[1] < 2:
        return at, held[at]
    side = rng.normal(size=(len(at), held.shape[1]))
    side -= (side * held[at]).sum(1, keepdims=True) * held[at]
    c = min(1.0, least + 1e-4)
    return at, unit(c * held[at] + np.sqrt(1 - c * c) * unit(side))


def audited(graph: Graph, held: np.ndarray | Units, q: np.ndarray | Units, least: float, own: np.ndarray, seed: int = 11) -> dict:
    """The audit of the last beam that was asked: ``beam`` (0 where the shard is to be scanned for all), ``probes`` and
    ``probes_found``, ``links`` that the sampled queries have and ``links_found``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    at, probe = _probes(held, least, rng)
    audit = rng.permutation(len(q))[:AUDITED]
    asked = q[audit]
    true = np.zeros((len(audit), len(held)), bool)
    for part in _blocks(len(held), 8 * max(held.shape[1], len(audit))):
        true[:, part] = asked @ held[part].T >= least
    true[own[audit] >= 0, own[audit][own[audit] >= 0]] = False
    told = {"beam": 0, "probes": len(at), "probes_found": len(at), "links": int(true.sum()), "links_found": int(true.sum())}
    for beam in BEAMS:
        if beam >= len(held):
            break
        # a probe counts as found too where its beam is full of linked vectors: such a query is widened
        ids, sim = graph.search(probe, beam)
        hit = (ids == at[:, None]).any(1) | ((sim >= least - SLACK) & (ids >= 0)).all(1)
        ids, sim = graph.search(asked, beam)
        near = (sim >= least - SLACK) & (ids >= 0)
        whole = near.all(1)
        found = np.zeros_like(true)
        r, c = np.nonzero(near)
        found[r, ids[r, c]] = True
        lost = (true & ~found & ~whole[:, None]).sum()
        if hit.sum() >= RECALL * len(hit) and lost <= (1 - RECALL) * true.sum():
            return told | {"beam": beam, "probes_found": int(hit.sum()), "links_found": int(true.sum() - lost)}
    return told  # no beam passes


def _met(graph: Graph, held: np.ndarray | Units, q: np.ndarray, least: float, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block of queries that are linked in single precision: by beams from ``first`` on, and what is left by a scan."""
    todo = np.arange(len(q))
    for beam in BEAMS:
        if not first or not first <= beam < len(held) or not len(todo):
            continue
        ids, sim = graph.search(q[todo], beam)
        near = (sim >= least - SLACK) & (ids >= 0)
        full = near.all(1)
        r, c = np.nonzero(near & ~full[:, None])
        yield todo[r], ids[r, c]
        todo = todo[full]
    if not len(todo):
        return
    for part in _blocks(len(held), 8 * held.shape[1]):
        beside = held[part]
        for some in _blocks(len(todo), 8 * len(beside)):
            r, c = np.nonzero(q[todo[some]] @ beside.T >= least - SLACK)
            yield todo[some][r], c + part.start


def links(graph: Graph, held: np.ndarray | Units, q: np.ndarray | Units, least: float, own: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, held) with cosine >= least, taken in double precision, a block of them at a time. ``beam`` is what
    :func:`audited` says; ``own`` says which of the held each query is itself, -1 for none: that pair is left out."""
    for block in _blocks(len(q), 8 * max(q.shape[1], 4 * BEAMS[-1])):
        asked = q[block]
        for rows, cols in _met(graph, held, asked, least, beam):
            for part in _blocks(len(rows), 8 * q.shape[1]):
                r, c = rows[part], cols[part]
                sure = (np.einsum("rd,rd->r", asked[r], held[c]) >= least) & (own[block][r] != c)
                if sure.any():
                    yield block.start + r[sure], c[sure]


def linked(graph: Graph, held: np.ndarray, q: np.ndarray, least: float, own: np.ndarray | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray, dict]:
    """All pairs of :func:`links`, and the audit."""
    own = np.full(len(q), -1) if own is None else own
    told = audited(graph, held, q, least, own, seed)
    rows, cols = zip((np.zeros(0, int), np.zeros(0, int)), *links(graph, held, q, least, own, told["beam"]))
    return np.concatenate(rows), np.concatenate(cols), told


AUDIT = "beam int, probes long, probes_found long, links long, links_found long"


_GRAPH = pa.schema([("d", pa.int32()), ("shard", pa.int32()), ("parts", pa.int32()), ("k", pa.int32()), ("pieces", pa.int32()), ("piece", pa.binary())])
_FOUND = pa.schema([*((c, pa.int64()) for c in "abn"), *((c, pa.int32()) for c in ("d", "shard", "part", "beam")), *((c, pa.int64()) for c in ("probes", "probes_found", "links", "links_found"))])


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Groups of rows in batches sorted by ``keys``; what is left of a group is passed over."""

    def cuts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            columns = np.array([_numbers(batch, c) for c in keys])
            ends = [*(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip([0, *ends], ends):
                if a < b:
                    yield tuple(columns[:, a].tolist()), batch.slice(a, b - a)

    for key, of in itertools.groupby(cuts(), lambda x: x[0]):
        yield key, (run for _, run in of)


def _numbers(run: pa.RecordBatch, name: str) -> np.ndarray:
    return run.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _vectors(run: pa.RecordBatch, dtype: type) -> np.ndarray:
    return run.column("v").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(run.num_rows, -1) if run.num_rows else np.zeros((0, 1), dtype)


def _packed(graph: bytes, reps: np.ndarray, many: np.ndarray, held: np.ndarray) -> list[bytes]:
    """A shard as pieces; the first tells how many vectors there are."""
    out = [len(reps).to_bytes(8, "little")]
    for part in (memoryview(x).cast("B") for x in (reps, many, held, graph)):
        out += [bytes(part[a : a + PIECE_BYTES]) for a in range(0, len(part), PIECE_BYTES)]
    return out


def _unpacked(pieces: list[bytes], d: int, dtype: type) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`_packed` was given; the pieces are used up."""
    n = int.from_bytes(pieces.pop(0), "little")

    def take(size: int) -> bytearray:
        out = bytearray(size)
        at = 0
        while at < size:
            piece = pieces.pop(0)
            out[at : at + len(piece)] = piece
            at += len(piece)
        return out

    reps, many, held = np.frombuffer(take(8 * n), np.int64), np.frombuffer(take(8 * n), np.int64), np.frombuffer(take(n * d * np.dtype(dtype).itemsize), dtype)
    return b"".join(pieces), reps, many, held.reshape(n, d)


def _answers(key: tuple, pieces: list[bytes], rep: np.ndarray, asking: np.ndarray, dtype: type, least: float) -> Iterator[pa.RecordBatch]:
    """What one part of the queries finds in one shard."""
    raw, reps, many, given = _unpacked(pieces, key[0], dtype)
    pieces.clear()
    held, q = Units(given), Units(asking)
    graph = Graph.load(raw, held)
    del raw
    place = np.minimum(np.searchsorted(reps, rep), len(reps) - 1)
    own = np.where(reps[place] == rep, place, -1)
    told = dict(zip(("d", "shard", "part"), key)) | audited(graph, held, q, least, own)

    def batch(**columns: np.ndarray) -> pa.RecordBatch:
        size = len(columns["n"])
        every = columns | {c: np.full(size, told[c]) for c in ("d", "shard", "part", "beam")}
        return pa.RecordBatch.from_arrays([pa.array(every[f.name], f.type) if f.name in every else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)

    yield pa.RecordBatch.from_pylist([told], _FOUND)
    n = np.zeros(len(rep), np.int64)
    # one edge of each that joins two groups is enough for the components
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r, c in links(graph, held, q, least, own, told["beam"]):
        n += np.bincount(r, many[c], minlength=len(rep)).astype(np.int64)
        edges = []
        for x, y in zip(rep[r].tolist(), reps[c].tolist()):
            if (i := find(x)) != (j := find(y)):
                up[i] = j
                edges.append((x, y))
        if edges:
            a, b = np.array(edges, np.int64).T
            yield batch(a=a, b=b, n=np.zeros(len(a), np.int64))
    some = n > 0
    yield batch(a=rep[some], b=rep[some], n=n[some])


def _search(df: DataFrame, least: float, id_col: str, vector_col: str, shards: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, one vector a row id, different vectors with their number, and what the tasks found: links of a vector
    ``(a, a, n)``, edges ``(a, b, 0)`` that join what a task linked, and a row of its audit without ``a``."""
    given = df.select(vector_col).schema[0].dataType
    kind, dtype = ("float", np.float32) if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else ("double", np.float64)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    named = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # rows that have equal vectors come together by what they hold, so a very common vector is one group with a partial count
    named = cut(named.withColumn("fine", fine).withColumn("h", F.xxhash64("v")))
    classes = cut(named.where("fine").groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("v")))
    # vectors of one length have shards and query parts of their own, as many as their number asks for
    asked_bytes = F.col("m") * F.col("d") * F.lit(8.0)
    most = F.greatest(F.col("m") / F.lit(float(SHARD_VECTORS)), asked_bytes / F.lit(float(SHARD_BYTES)))
    own_shards = F.lit(shards) if shards else F.when(F.col("m") <= FEW_VECTORS, 1).otherwise(F.greatest(F.lit(SHARDS), F.ceil(most).cast("int")))
    sizes = classes.groupBy("d").agg(F.count("*").alias("m")).withColumn("shards", own_shards)
    part_bytes = F.least(F.greatest(asked_bytes / PARTS, F.lit(float(PART_BYTES[0]))), F.lit(float(PART_BYTES[1])))
    sizes = cut(sizes.withColumn("parts", F.ceil(F.greatest(asked_bytes / part_bytes, F.col("m") / F.lit(float(PART_VECTORS)))).cast("int")))
    count, graph_tasks, ask_tasks = sizes.agg(*[F.coalesce(F.sum(F.expr(c)), F.lit(0)) for c in ("m", "shards", "shards * parts")]).first()
    sized = with_facts(classes, sizes, "d", "m", count)
    put = cut(sized.select("rep", "copies", "v", "d", "shards", "parts", F.pmod(F.xxhash64("rep", F.lit(1)), "shards").cast("int").alias("shard"), F.pmod(F.xxhash64("rep", F.lit(2)), "parts").cast("int").alias("part")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (d, shard), runs in _runs(batches, "d", "shard"):
            reps, many, held = [], [], []
            for run in runs:
                parts = run.column("parts")[0].as_py()
                reps.append(_numbers(run, "rep"))
                many.append(_numbers(run, "copies"))
                held.append(_vectors(run, dtype))
            reps, many, held = np.concatenate(reps), np.concatenate(many), np.concatenate(held)
            whole = _packed(Graph(Units(held)).dump(), reps, many, held)
            for k, piece in enumerate(whole):
                yield pa.RecordBatch.from_pylist([{"d": d, "shard": shard, "parts": parts, "k": k, "pieces": len(whole), "piece": piece}], _GRAPH)

    by_shard = put.select("d", "shard", "parts", "rep", "copies", "v").repartition(max(1, SPREAD * graph_tasks), "d", "shard").sortWithinPartitions("d", "shard", "rep")
    graphs = cut(by_shard.mapInArrow(build, "d int, shard int, parts int, k int, pieces int, piece binary"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = put.select("d", upto("shards").alias("shard"), "part", F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("pieces"), F.lit(None).cast("binary").alias("piece"), "rep", "v")
    shown = graphs.select("d", "shard", upto("parts").alias("part"), "k", "pieces", "piece", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(f"array<{kind}>").alias("v"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, runs in _runs(batches, "d", "shard", "part"):
            pieces, reps, asking = [], [], []
            for run in runs:
                queries = run.column("k").null_count
                pieces += run.column("piece").slice(0, run.num_rows - queries).to_pylist()
                reps.append(_numbers(run.slice(run.num_rows - queries), "rep"))
                asking.append(_vectors(run.slice(run.num_rows - queries), dtype))
            if pieces and sum(map(len, reps)):
                yield from _answers(key, pieces, np.concatenate(reps), np.concatenate([x for x in asking if len(x)]), dtype, least)

    # the pieces of a task's graph come before its queries
    keys, tasks = ("d", "shard", "part"), max(1, SPREAD * ask_tasks)
    both = shown.unionByName(asked).repartition(tasks, *keys).sortWithinPartitions(*keys, F.col("k").asc_nulls_last(), "rep")
    found = cut(both.mapInArrow(ask, f"a long, b long, n long, d int, shard int, part int, {AUDIT}"))
    return rows, named, classes, found


def recall_audit(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """What the searches of :func:`near_duplicates` missed: one row per length, shard and part of the queries, with the beam
    that passed (0: the shard was scanned), the probes and links audited, and how many of them it found."""
    return _search(df, least, id_col, vector_col, shards)[3].where("a is null").drop("a", "b", "n")


def near_duplicates(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """Vectors linked by cosine of at least ``least``; a tie at ``least`` links.

    Returns ``(vec_id, n_links, component_id, kept)``, one row per id: other vectors linked directly, the smallest id that
    links reach (itself included), and whether that is the vector itself. Vectors that are null, empty, zero, or hold null
    or non-finite components are linked with nothing; those of different lengths have no cosine. Rows of one id count once, by
    the first of its vectors; a row with a null id keeps null as component and counts for no one. An empty table gives
    no rows; other columns are left out. Equal vectors are one in the graphs, with their number.
    """
    rows, named, classes, found = _search(df, least, id_col, vector_col, shards)
    tops = stars(found.where("a <> b").select("a", "b"))
    links = found.where("a is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    told = classes.join(links.hint("merge"), "rep", "left").join(tops.hint("merge"), F.col("rep") == F.col("node"), "left")
    told = cut(told.select("h", "v", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    of = with_facts(named.where("fine").select("vec_id", "h", "v"), told, ["h", "v"], "copies", named.count()).select("vec_id", "n_links", "component_id")
    out = of.unionByName(named.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_links(vectors: np.ndarray, least: float = 0.95) -> Iterator[tuple[int, int]]:
    """All linked pairs, for tests."""
    u = unit(vectors)
    for a, b in zip(*np.nonzero(u @ u.T >= least)):
        if a != b:
            yield int(a), int(b)
