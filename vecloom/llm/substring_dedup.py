"""Incremental substring deduplication over a log-structured fingerprint index.

The index is a bucketed table.  A run is a set of immutable rows (bucket, sorted window hashes, check codes), of at most
`ROW_WINDOWS` windows each; runs are only ever added, or merged.  Compaction is tiered: `fan` runs of one level become
one run of the next, so a window is rewritten once per level, and levels grow with the logarithm of the batches.
What the index consists of is a small state table of numbered versions, written last: what a lost driver left half done
is not in it, and another session opens the index by its folder.  A new batch is hashed, shuffled once by hash range and
merge-joined with the runs, which are read where they lie: the table is bucketed like the shuffle, so history is not
moved.  A match counts only if the 64-bit fingerprint and an independently computed check code agree.

Rows travel as packed blobs (about ten bytes a window).  Within a map task only the smallest document of a window goes
to the merge; the others are already known to repeat, so a window that a third of all documents share reaches its
bucket once per few megabytes of text, not once per document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import fs_delete, partitions, ship, shuffles_dropped, written

COMBINE_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20
ROW_WINDOWS = 4 << 20
_PACK = "bucket int, part int, owners binary, owner_parts binary, owner binary, hashes binary, checks binary"
_OUT = "bucket int, part int, docs binary, hashes binary, checks binary, kind string"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _planes(h: np.ndarray) -> bytes:
    """Sorted 64-bit numbers byte plane by byte plane: the high planes of sorted numbers compress to nearly nothing."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of each hash: ascending in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def partition_keys(n: int) -> np.ndarray:
    """keys[i] is the smallest non-negative int that hash partitioning over n partitions puts into partition i.

    Spark hashes an int with Murmur3 (seed 42); numbered by these keys, n buckets fill n partitions evenly.
    """
    keys, start = np.full(n, -1, dtype=np.int32), 0
    while (keys < 0).any():
        x = np.arange(start, start + 16 * n + 64, dtype=np.uint32)
        start += len(x)
        turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        k = turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        found, first = np.unique(part, return_index=True)
        fresh = keys[found] < 0
        keys[found[fresh]] = x[first[fresh]].astype(np.int32)
    return keys


def _windows(words: T.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check code, position of the first word) of every window that lies in one text."""
    wh = words.hashes()
    h = T.gram_hashes(wh, width)
    keep = np.flatnonzero(words.doc[: len(h)] == words.doc[width - 1 :]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[keep], (T.second_hashes(wh, width)[keep] >> np.uint64(48)).astype(np.uint16), keep


def _fingerprinter(width: int, buckets: int, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            parts = np.asarray(batch.column(1))
            hs, cs, ds, held, lo0, hi0 = [], [], [], 0, 0, 0
            for lo, hi, data, offs in T.chunks(batch, "text", CHUNK_BYTES):
                w = T.Words(data, offs)
                h, c, at = _windows(w, width)
                hs.append(h)
                cs.append(c)
                ds.append((w.doc[at] + (lo - lo0)).astype(np.uint32))
                held, hi0 = held + len(data), hi
                if held >= COMBINE_BYTES or hi == batch.num_rows:
                    yield from pack(np.concatenate(hs), np.concatenate(cs), np.concatenate(ds), ids[lo0:hi0], parts[lo0:hi0])
                    hs, cs, ds, held, lo0 = [], [], [], 0, hi0

    def pack(h, c, d, ids, parts) -> Iterator[pa.RecordBatch]:
        if not len(h):
            return
        order = np.argsort(ids[d], kind="stable")
        order = order[np.argsort(h[order], kind="stable")]  # by hash, then by doc_id
        h, c, d = h[order], c[order], d[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])  # the same window twice in one text
        h, c, d = h[~again], c[~again], d[~again]
        group = np.ones(len(h), dtype=bool)
        group[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(group, np.arange(len(h)), 0))
        repeat = ids[d] > ids[d[first]]
        rows = []
        if repeat.any():
            rd, rh = d[repeat], h[repeat]
            rp = parts[rd]
            for p in np.unique(rp):
                m = rp == p
                rows.append((int(keys[p]), int(p), ids[rd[m]].astype("<i8").tobytes(), None, None, _planes(rh[m]), None))
        h, c, d = h[~repeat], c[~repeat], d[~repeat]
        edge = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            s = slice(edge[b], edge[b + 1])
            own, local = np.unique(d[s], return_inverse=True)
            kind = np.uint16 if len(own) <= 65536 else np.uint32
            rows.append((int(keys[b]), -1, ids[own].astype("<i8").tobytes(), parts[own].astype("<i4").tobytes(), local.astype(kind).tobytes(), _planes(h[s]), c[s].tobytes()))
        names = ["bucket", "part", "owners", "owner_parts", "owner", "hashes", "checks"]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

    return run


def _merge(new: pa.Table, old: pa.Table) -> pa.Table:
    """Merge-join of one bucket: which (document, window) pairs repeat an earlier document, and the windows new here."""
    cols = {k: new.column(k).to_pylist() for k in ("bucket", "part", "owners", "owner_parts", "owner", "hashes", "checks")}
    out: list[tuple] = []
    hs, cs, ids, ps = [], [], [], []
    for b, part, owners, owner_parts, owner, hashes, checks in zip(*cols.values(), strict=True):
        if part >= 0:
            out.append((b, part, owners, hashes, None, "repeat"))
            continue
        own = np.frombuffer(owners, dtype="<i8")
        local = np.frombuffer(owner, dtype=np.uint16 if len(own) <= 65536 else np.uint32)
        hs.append(_unplanes(hashes))
        cs.append(np.frombuffer(checks, dtype=np.uint16))
        ids.append(own[local])
        ps.append(np.frombuffer(owner_parts, dtype="<i4")[local])
    if hs:
        bucket = cols["bucket"][0]
        h, c, d, p = (np.concatenate(x) for x in (hs, cs, ids, ps))
        order = np.lexsort((d, c, h))
        h, c, d, p = h[order], c[order], d[order], p[order]
        group = np.ones(len(h), dtype=bool)
        group[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(group)
        known = np.zeros(len(at), dtype=bool)
        for hashes, checks in zip(old.column("hashes").to_pylist(), old.column("checks").to_pylist(), strict=True):
            oh, oc = _unplanes(hashes), np.frombuffer(checks, dtype=np.uint16)
            lo, hi = np.searchsorted(oh, h[at], side="left"), np.searchsorted(oh, h[at], side="right")
            for step in range(int((hi - lo).max()) if len(lo) else 0):  # equal fingerprints, different check codes
                x = np.flatnonzero(lo + step < hi)
                known[x] |= oc[lo[x] + step] == c[at[x]]
        rank = np.cumsum(group) - 1
        repeat = known[rank] | (d > d[at][rank])
        rd, rh, rp = d[repeat], h[repeat], p[repeat]
        order = np.argsort(rp, kind="stable")
        rd, rh, rp = rd[order], rh[order], rp[order]
        for s in np.split(np.arange(len(rp)), np.flatnonzero(np.diff(rp)) + 1) if len(rp) else []:
            out.append((bucket, int(rp[s[0]]), rd[s].tobytes(), _planes(rh[s]), None, "repeat"))
        fresh = at[~known]
        out += _run(bucket, h[fresh], c[fresh])
    return _table(out)


def _run(bucket: int, h: np.ndarray, c: np.ndarray) -> list[tuple]:
    """Rows of a run: consecutive stretches of the sorted windows of a bucket."""
    return [(bucket, -1, None, _planes(h[i : i + ROW_WINDOWS]), c[i : i + ROW_WINDOWS].tobytes(), "run") for i in range(0, len(h), ROW_WINDOWS)]


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of _OUT, in batches of bounded size: one Arrow array holds 2 GB at most."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary()), ("kind", pa.string())])
    batches, held, size = [], [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + len(r[2] or b"")
        if size > 1 << 28:
            batches.append(held)
            held, size = [], 0
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([r[i] for r in b], type=t) for i, t in enumerate(schema.types)], schema=schema) for b in (*batches, held)], schema)


def _union(runs: pa.Table) -> pa.Table:
    """The rows of one bucket of several runs as one sorted run."""
    h = np.concatenate([_unplanes(x) for x in runs.column("hashes").to_pylist()])
    c = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in runs.column("checks").to_pylist()])
    order = np.lexsort((c, h))
    return _table(_run(runs.column("bucket")[0].as_py(), h[order], c[order]))


def part_numbers(ids: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(id), parts) as Spark computes it (XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).view(np.int64) % parts).astype(np.int64)


def _doubler(buckets: int, keys: np.ndarray):
    """Rows of an index of half as many buckets: runs cut where buckets are, marks dealt to the parts of their documents."""

    def halves(r: dict) -> Iterator[tuple]:
        h = _unplanes(r["hashes"])
        if r["kind"] == "run":
            checks = np.frombuffer(r["checks"], dtype=np.uint16)
            edge = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)):
                s = slice(edge[b], edge[b + 1])
                yield int(keys[b]), -1, None, _planes(h[s]), checks[s].tobytes()
        else:
            docs = np.frombuffer(r["docs"], dtype="<i8")
            parts = part_numbers(docs, buckets)
            for p in np.unique(parts):
                m = parts == p
                yield int(keys[p]), int(p), docs[m].tobytes(), _planes(h[m]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # a row may hold millions of windows
                (r,) = batch.slice(i, 1).to_pylist()
                rows = [(*x, r["step"], r["kind"]) for x in halves(r)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], type=t) for c, t in enumerate(kinds)], names=["bucket", "part", "docs", "hashes", "checks", "step", "kind"])

    return run


def due(levels: list[int], fan: int) -> list[int]:
    """Numbers of the runs to merge next, of runs with these levels: the `fan` oldest of the lowest level that has so many."""
    for level in sorted(set(levels)):
        same = [i for i, x in enumerate(levels) if x == level]
        if len(same) >= fan:
            return same[:fan]
    return []


def _cutter(width: int):
    """Second pass: texts of one part after the repeated windows of that part."""

    def finish(ids, batch, marked: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offs in T.chunks(batch, "text", CHUNK_BYTES):
            w = T.Words(data, offs)
            drop = np.zeros(len(w), dtype=bool)
            mine = {i: marked[ids[lo + i]] for i in range(hi - lo) if ids[lo + i] in marked}
            if mine:
                h, _, at = _windows(w, width)
                edge = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
                for i, known in mine.items():
                    hit = at[edge[i] : edge[i + 1]][np.isin(h[edge[i] : edge[i + 1]], known)]
                    if len(hit):
                        delta = np.zeros(w.per_doc[i] + 1, dtype=np.int32)
                        np.add.at(delta, hit - w.first[i], 1)
                        np.add.at(delta, np.minimum(hit - w.first[i] + width, w.per_doc[i]), -1)
                        drop[w.first[i] : w.first[i + 1]] = np.cumsum(delta[:-1]) > 0
            raw = data.tobytes()
            removed, shas = np.zeros(hi - lo, dtype=np.int64), []
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                gone = drop[a:b]
                removed[i] = gone.sum()
                kept = b" ".join(raw[offs[i] : offs[i + 1]].translate(_SPACES).split()) if not removed[i] else b" ".join([raw[s:e] for s, e in zip(w.start[a:b][~gone].tolist(), w.end[a:b][~gone].tolist(), strict=True)])
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], type=pa.int64()), pa.array(w.per_doc), pa.array(removed), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, hashes, marked = None, [], [], {}
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            for s in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if parts[s[0]] != part:
                    part, docs, hashes, marked = parts[s[0]], [], [], {}
                rows = batch.slice(s[0], len(s))
                marks = rows.filter(pa.compute.equal(rows.column("ord"), 0))
                for d, h in zip(marks.column("docs").to_pylist(), marks.column("hashes").to_pylist(), strict=True):
                    docs.append(np.frombuffer(d, dtype="<i8"))
                    hashes.append(_unplanes(h))
                texts = rows.filter(pa.compute.equal(rows.column("ord"), 1))
                if texts.num_rows:
                    if docs:
                        d, h = np.concatenate(docs), np.concatenate(hashes)
                        order = np.argsort(d, kind="stable")
                        d, h = d[order], h[order]
                        edge = np.concatenate(([0], np.flatnonzero(np.diff(d)) + 1, [len(d)]))
                        marked = {int(d[a]): h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)}
                        docs, hashes = [], []
                    yield from finish(texts.column("doc_id").to_pylist(), texts, marked)

    return run


_SPACES = bytes(0x20 if T.SEPARATOR[i] else i for i in range(256))


class FingerprintIndex:
    """Window hashes of all documents ingested so far, as immutable sorted runs of a bucketed table.

    A task holds one bucket of a batch and of the history, about ten bytes a window; `buckets` sets how many there are.
    """

    def __init__(self, spark: SparkSession, width: int = 13, fan: int = 4, buckets: int | None = None):
        ship(spark)
        self.spark, self.width, self.fan = spark, width, fan
        self.buckets = buckets or partitions(spark)
        self.keys = partition_keys(self.buckets)
        self.name = f"vecloom_fingerprints_{uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []  # step, level
        self.repeats: list[str] = []
        self.highest: int | None = None
        self.version = -1

    @property
    def folder(self) -> str:
        """Where the table lies: what open() takes."""
        return self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").head()[1]

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan: int = 4) -> FingerprintIndex:
        """The index that an earlier session left in a folder."""
        states = spark.read.parquet(f"{folder}_state")
        r = states.orderBy(F.desc("version")).head()
        index = cls(spark, r["width"], fan, r["buckets"])
        index.name = folder.rstrip("/").rsplit("/", 1)[1]
        index.runs = [(x["step"], x["level"]) for x in r["runs"]]
        index.repeats, index.highest, index.version = list(r["repeats"]), r["highest"], r["version"]
        if not spark.catalog.tableExists(index.name):
            spark.sql(f"CREATE TABLE {index.name} (bucket int, part int, docs binary, hashes binary, checks binary, step string, kind string) USING parquet PARTITIONED BY (step, kind) CLUSTERED BY (bucket) INTO {index.buckets} BUCKETS LOCATION '{folder}'")
            spark.sql(f"MSCK REPAIR TABLE {index.name}")
        return index

    def _rows(self, steps: list[str], kind: str) -> DataFrame:
        if not self.runs and not self.repeats:
            return self.spark.createDataFrame([], "bucket int, part int, docs binary, hashes binary, checks binary")
        t = self.spark.table(self.name).where(F.col("step").isin(steps) & (F.col("kind") == kind))
        return t.select("bucket", "part", "docs", "hashes", "checks")

    def _append(self, df: DataFrame) -> str:
        step = f"s{uuid.uuid4().hex}"  # a step that a lost driver left behind is never written again
        with shuffles_dropped(self.spark):
            df.withColumn("step", F.lit(step)).write.partitionBy("step", "kind").bucketBy(self.buckets, "bucket").option("compression", "zstd").mode("append").saveAsTable(self.name)
        return step

    def _commit(self) -> None:
        self.version += 1
        row = (self.version, self.width, self.buckets, self.highest, self.runs, self.repeats)
        state = self.spark.createDataFrame([row], "version long, width int, buckets int, highest long, runs array<struct<step:string,level:int>>, repeats array<string>")
        state.coalesce(1).write.mode("append").parquet(f"{self.folder}_state")

    def ingest(self, docs: DataFrame) -> None:
        """Marks the repeated windows of docs(doc_id, text) and adds a run.

        Every doc_id must be greater than all those ingested before: "earlier" means a smaller doc_id.
        """
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
        if low is None:
            return
        if self.highest is not None and low <= self.highest:
            raise ValueError(f"doc_id {low} is not greater than {self.highest}, which is already in the index")
        rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), self.part_of("doc_id").alias("part"), F.col("text").cast("string").alias("text"))
        new = rows.mapInArrow(_fingerprinter(self.width, self.buckets, self.keys), _PACK)
        old = self._rows([s for s, _ in self.runs], "run").select("bucket", "hashes", "checks")
        step = self._append(new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(lambda a, b: _merge(a, b) if a.num_rows else _NOTHING, _OUT))
        self.runs.append((step, 0))
        self.repeats.append(step)
        self.highest = high
        self._commit()
        self.compact()

    def compact(self) -> None:
        """Merges runs of one level until no level has `fan` of them; buckets lie together, so nothing is shuffled."""
        while old := due([level for _, level in self.runs], self.fan):
            gone = [self.runs[i] for i in old]
            step = self._append(self._rows([s for s, _ in gone], "run").groupBy("bucket").applyInArrow(_union, _OUT))
            self.runs = [r for r in self.runs if r not in gone]
            self.runs.insert(old[0], (step, gone[0][1] + 1))
            self._commit()
            for s, _ in gone:  # after the commit: a lost driver leaves files, but no state that lacks them
                fs_delete(self.spark, f"{self.folder}/step={s}/kind=run")
            self.spark.catalog.refreshTable(self.name)

    def double(self) -> None:
        """Twice as many buckets, each half of one that was there: for an index whose buckets outgrow a task.

        Buckets are hash ranges, so every task splits what it reads and nothing is shuffled or hashed again but the
        documents of marks.  The index moves to a new folder; the old one counts until the new one's state is written.
        """
        wide = FingerprintIndex(self.spark, self.width, self.fan, 2 * self.buckets)
        if self.runs or self.repeats:
            t = self.spark.table(self.name)
            live = (F.col("kind") == "run") & F.col("step").isin([s for s, _ in self.runs]) | (F.col("kind") == "repeat") & F.col("step").isin(self.repeats)
            rows = t.where(live).select("bucket", "part", "docs", "hashes", "checks", "step", "kind")
            rows = rows.mapInArrow(_doubler(wide.buckets, wide.keys), _OUT.replace("kind string", "step string, kind string"))
            with shuffles_dropped(self.spark):
                rows.write.partitionBy("step", "kind").bucketBy(wide.buckets, "bucket").option("compression", "zstd").saveAsTable(wide.name)
            wide.runs, wide.repeats, wide.highest, wide.version = self.runs, self.repeats, self.highest, self.version
            wide._commit()
            self.drop()
        self.__dict__.update(wide.__dict__)

    def drop(self) -> None:
        """Deletes the index.  What cut() returned is lazy and reads it, so first write that."""
        if self.spark.catalog.tableExists(self.name):
            folder = self.folder
            self.spark.sql(f"DROP TABLE {self.name}")
            fs_delete(self.spark, folder)
            fs_delete(self.spark, f"{folder}_state")
        self.runs, self.repeats, self.highest = [], [], None

    def part_of(self, column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.buckets)).cast("int")

    def marks(self) -> DataFrame:
        """(part, docs, hashes): packed pairs of document and repeated window of all ingested batches."""
        return self._rows(self.repeats, "repeat").select("part", "docs", "hashes")

    def cut(self, docs: DataFrame) -> DataFrame:
        """The digest of docs without the words that repeated windows cover."""
        texts = docs.select(self.part_of("doc_id").alias("part"), F.lit(1).alias("ord"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("hashes"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        marks = self.marks().select("part", F.lit(0).alias("ord"), "docs", "hashes", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
        rows = marks.unionByName(texts).repartitionById(self.buckets, F.col("part")).sortWithinPartitions("part", "ord")
        return rows.mapInArrow(_cutter(self.width), RESULT)


_NOTHING = _table([])


def substring_dedup(docs: DataFrame, width: int = 13, generations: int = 3, fan: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text, ...).

    The documents enter a fresh FingerprintIndex in `generations` batches of ascending doc_id.  The result is written;
    the index is dropped.

    Defined cases: null text has no words.  A null doc_id has no place in the order: the row is returned whole and
    others are not compared with it.  Rows that repeat a doc_id do not count as earlier than each other, and a window
    marked in one of them is cut from all of them.  Texts of fewer than `width` words are returned whole.
    Other columns of docs are ignored, whatever their names.
    """
    index = FingerprintIndex(docs.sparkSession, width, fan)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    steps = [i / generations for i in range(1, generations)]
    borders = sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), 1000)).head()[0] or [])) if steps else []
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.ingest(part)
    out = written(index.cut(docs), "substring-dedup")
    index.drop()
    return out
