"""Deterministic sharded WARC archives.

Pages are put in order of page id, cut into shards at fixed places, and written by one task per shard: each
record its own gzip member, headers and digests made anew, a new file where the compressed size
passes ``roll_bytes``. The cuts follow from exact running sums of bytes over ids, and within an id over ``CUTS`` classes of
payload and url, so that an id of many rows, or none, goes to many shards. Equal input gives equal files
whatever the partitioning. Rows equal in id, payload and url share a shard. A file is written under a temporary name of its attempt and renamed when
complete; the manifest, written by Spark's own committer, names the files of the attempts that
counted. A repeated or speculative attempt therefore ends in the same files with the same bytes.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is a response and
the others revisit it. Payloads are compared by SHA-1 and length.

Nulls and edge cases: a null html is an empty payload, a null url is left out of the header, a null page id
sorts first and is never chosen while its group has another. Rows of one page id and equal payload are all
responses where that id is chosen. Control characters in a url are percent-encoded. An empty table gives an
empty manifest and no archive. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.llm.common import shuffle_partitions
from pitsignal.session import land, scratch_dir

LEAST_BYTES = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
CUTS = 4096
#: Shards at most. Above SHARD_BYTES times this (2 TB) shards hold more bytes, so that the driver's table of starts and what each task gets
#: of it stay below 1 MB. Files are rolled by their own size all the same.
MOST_SHARDS = 1 << 16
LEAST_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

MANIFEST = "file string, shard long, part long, records long, bytes long, sha256 string"


def shard_starts(pages: DataFrame, key: str, cut: Column, size: Column, target: int, most: int = MOST_SHARDS) -> list[tuple[int, int]]:
    """Places (key, cut) at which shards after the first begin, so that a shard holds about ``target`` bytes, or as many as ``most``
    shards need to hold all.

    Bytes are summed per place, and running sums are taken over ranges of places, each from the sum of the ranges before it. A
    place belongs to the shard in which its first byte falls. The driver gets a row per range, as many as there are shuffle
    partitions, and a row per shard, ``most`` at most. A null key counts as the smallest.
    """
    spark = pages.sparkSession
    places = pages.select(F.coalesce(F.col(key), F.lit(LEAST_ID)).alias("k"), cut.cast("int").alias("cut"), size.cast("bigint").alias("n"))
    places = places.groupBy("k", "cut").agg(F.sum("n").alias("n"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy()
            after = upto + np.cumsum(n)
            upto = int(after[-1])
            parts = pa.array(np.full(len(n), part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [parts, batch.column(0), batch.column(1), pa.array(after - n), pa.array(after)], names=["part", "k", "cut", "before", "after"]
            )

    ranges = places.repartitionByRange(shuffle_partitions(spark), "k", "cut").sortWithinPartitions("k", "cut")
    summed = land(ranges.mapInArrow(work, "part int, k long, cut int, before long, after long"), "places")
    sums = sorted((r["part"], r["n"]) for r in summed.groupBy("part").agg(F.max("after").alias("n")).collect())
    if not sums:
        return []
    offsets = np.cumsum([0, *[n for _, n in sums]])
    table = spark.createDataFrame([(p, int(o)) for (p, _), o in zip(sums, offsets[:-1], strict=True)], "part int, offset long")
    target = max(int(target), -(-int(offsets[-1]) // most))
    shard = F.expr(f"(before + offset) div {target}").alias("shard")
    first = summed.join(F.broadcast(table), "part").groupBy(shard).agg(F.min(F.struct("k", "cut")).alias("place"))
    return sorted((r["place"]["k"], r["place"]["cut"]) for r in first.collect())[1:]


def shard_bounds(pages: DataFrame, key: str, size: Column, target: int) -> list[int]:
    """Keys at which shards after the first begin, no key in two shards."""
    return [k for k, _ in shard_starts(pages, key, F.lit(0), size, target)]


def shard_numbers(starts: list[tuple[int, int]]):
    """The shard of each place, from arrays of keys and cuts."""
    keys = np.array([k for k, _ in starts], dtype=np.int64)
    cuts = np.array([c for _, c in starts], dtype=np.int64)
    distinct, rank = np.unique(keys, return_inverse=True)
    edges = rank * CUTS + cuts

    def of(k: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at = np.searchsorted(distinct, k)
        known = np.append(distinct, 0)[at] == k
        known &= at < len(distinct)
        return np.searchsorted(edges, at * CUTS + np.where(known, cut, -1), side="right")

    return of


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its ``size`` and ``digest``, and the ``cut`` of payload and url."""
    rows = pages.select(
        F.col("page_id").cast("bigint"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    return rows.withColumn("cut", F.pmod(F.xxhash64("digest", "url"), F.lit(CUTS)).cast("int"))


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``cut``, ``digest`` and ``refers_to`` of the records that are not responses; no payloads."""
    large = payloads(pages).filter(F.col("size") >= least_bytes).select("page_id", "cut", "digest", "size")
    # Counted in each task before the shuffle, so a payload with many copies is a few rows.
    chosen = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    joined = large.join(chosen.filter("n > 1"), ["digest", "size"])
    apart = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.filter(apart).select("page_id", "cut", "digest", "refers_to").distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url, payload, size, digest, refers_to) -> bytes:
    """One record. A revisit has the headers of its payload, not the payload."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id(refers_to, digest)))
        fields.append(("X-Refers-To-Page", str(refers_to)))
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def file_system(path: str):
    """The file system of a path and the path inside it; for use inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Roller:
    """Writes the files of a shard and yields a manifest row for each."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int):
        self.system, self.folder = file_system(folder)
        self.shard, self.attempt, self.roll_bytes, self.part, self.out = shard, attempt, roll_bytes, 0, None

    def _name(self) -> str:
        return f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"

    def write(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.folder}/_{self._name()}.{self.attempt}"
            self.out = self.system.open_output_stream(self.temporary)
            self.records = self.size = 0
            self.sum = hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sum.update(member)
        self.records += 1
        self.size += len(member)
        if self.size >= self.roll_bytes:
            yield self._commit()

    def _commit(self) -> tuple:
        self.out.close()
        self.system.move(self.temporary, f"{self.folder}/{self._name()}")
        row = (self._name(), self.shard, self.part, self.records, self.size, self.sum.hexdigest())
        self.out, self.part = None, self.part + 1
        return row

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            yield self._commit()


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                   least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives and their manifest below ``folder``; gives the manifest back."""
    spark = pages.sparkSession
    starts = shard_starts(payloads(pages), "page_id", F.col("cut"), F.col("size") + 500, shard_bytes)
    numbers = shard_numbers(starts)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, cuts: pa.Array) -> pa.Array:
        k = ids.fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
        return pa.array(numbers(k, cuts.to_numpy(zero_copy_only=False)).astype(np.int32))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}"
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        roller, done, decided = None, [], (None, None, None)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(7)), strict=True):
                shard, page_id, digest, refers_to, url, payload, size = (v.as_py() for v in row)
                if payload is None:  # a decision, which comes before the records it is about
                    decided = (page_id, digest, refers_to)
                    continue
                if roller is None or roller.shard != shard:
                    done += roller.close() if roller else ()
                    roller = Roller(folder, shard, attempt, roll_bytes)
                target = decided[2] if decided[:2] == (page_id, digest) else None
                done += roller.write(record(page_id, url, payload, size, digest, target))
        done += roller.close() if roller else ()
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "shard", "part", "records", "bytes", "sha256"])

    # Payloads travel once, to their shard. Decisions are small rows of the same shuffle, sorted to the front.
    decisions = revisits(pages, least_bytes).select(
        "page_id", "cut", "digest", "refers_to", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("bigint").alias("size"),
    )
    full = payloads(pages).select("page_id", "cut", "digest", F.lit(None).cast("bigint").alias("refers_to"), "url", "payload", "size")
    rows = decisions.unionByName(full).withColumn("shard", shard_of("page_id", "cut"))
    rows = rows.select("shard", "page_id", "digest", "refers_to", "url", "payload", "size", "cut")
    placed = rows.repartitionById(len(starts) + 1, F.col("shard"))
    ordered = placed.sortWithinPartitions("shard", "page_id", "cut", "digest", F.col("payload").isNotNull(), "url")
    ordered.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zlib

    plain, held = zlib.decompressobj(wbits=31), []
    while block := stream.read(1 << 20):
        while block:
            held.append(plain.decompress(block))
            block = plain.unused_data
            if plain.eof:
                yield b"".join(held)
                plain, held = zlib.decompressobj(wbits=31), []
            else:
                break


def parsed(data: bytes) -> tuple:
    """Page id, payload length and digest, record type and referred page of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return (None if page is None else int(page), size, digest, fields["WARC-Type"], None if refers is None else int(refers))


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
                     T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
                     T.StructField("refers_to", T.LongType())])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the files that the manifest names; digests are verified."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{inner}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parsed(data))
                        if len(rows) == 4096:
                            yield _found(rows)
                            rows = []
                if rows:
                    yield _found(rows)

    files = manifest.select("file").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(work, READ)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=READ.names)


def archive_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "warc")
