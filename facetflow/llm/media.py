"""Media columns, stored as content-defined chunks.

Each text's bytes, padded with spaces to a positive multiple of 192, are the 8-bit samples of a mono WAV file, the stored
form. A gear hash rolls over its bytes and cuts it where the hash's top bits are zero, between a least and a greatest size. A
chunk is known by its SHA-256 digest and is stored once: chunks that occur once stay in their media row, chunks that occur
again go to a table of chunks, deduplicated by a join-ready grouping on the digest. Which digests occur again is
first asked of a bitmap of fixed size (see common.repeat_filter), so the bulk of unique chunks never moves; a false alarm
costs a row in the chunk table and nothing else.

Reading back: media rows list their chunks in order; those that are not inline are joined from the chunk table, once
for each distinct media; the whole is held against the SHA-256 of the stored form before any feature is computed.

Defined cases: null text counts as empty (192 spaces); equal texts give equal values; repeated rows and null ids are rows
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetflow.llm.common import in_filter, materialize, repeat_filter, shared_path, spread, texts

UNIT = 192
RATE = 8000
LEAST, BITS, MOST = 512, 11, 8192

#: A number for each byte value, by rule: its xxHash32 with seed 9.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 9) for b in range(256)], dtype=np.uint32)


def payload(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def wav(samples: bytes) -> bytes:
    """A mono WAV file of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples(media: bytes) -> bytes:
    """The samples of a WAV file as :func:`wav` makes it; other chunks in it are stepped over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(data: bytes) -> str:
    """Mean, root mean square, crossings of the middle, and a spectrum of eight bands over the mean of 192-sample frames."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    power = np.abs(np.fft.rfft(x.reshape(-1, UNIT).mean(0)))[1:97].reshape(8, 12).mean(1)
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};cross={crossings};bands=" + ",".join(f"{p:.3f}" for p in power)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: the sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(batch: list[bytes]) -> list[list[int]]:
    """For each media the ends of its chunks."""
    sizes = [len(m) for m in batch]
    hashes = gear(np.frombuffer(b"".join(batch), dtype=np.uint8))
    # no cut comes before LEAST bytes of a media, so the 32 bytes of a hash never reach into the one before
    marks = np.flatnonzero(hashes >> np.uint32(32 - BITS) == 0) + 1
    base = np.cumsum([0, *sizes])
    lo = np.searchsorted(marks, base[:-1], "right")
    hi = np.searchsorted(marks, base[1:], "left")
    out = []
    for k, size in enumerate(sizes):
        ends, last = [], 0
        for end in (marks[lo[k] : hi[k]] - base[k]).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while size - last > MOST:
            last += MOST
            ends.append(last)
        if size > last:
            ends.append(size)
        out.append(ends)
    return out


def chunked(xs: list[str], mb: int = 8):
    """For lists of texts of some MB each: (text bytes, media, ends of its chunks, their digests) of each text."""
    at = 0
    while at < len(xs):
        some, size = [], 0
        while at < len(xs) and size < mb << 20:
            some.append(xs[at].encode())
            size += len(some[-1])
            at += 1
        media = [wav(payload(d)) for d in some]
        yield [(d, m, ends, [hashlib.sha256(m[a:b]).digest() for a, b in zip([0, *ends], ends)]) for d, m, ends in zip(some, media, cuts(media))]


def short(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a long."""
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<i8")


_MEDIA = "id string, n_bytes long, media_bytes long, media_sha256 binary, digests binary, ends array<int>, is_shared array<boolean>, inline binary, any_shared boolean"
_CHUNKS = "digest binary, data binary"


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the media of all rows under ``path``: folder media, with columns id, n_bytes, ..., and folder chunks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    only = rows.select("text")

    def digests(batches):
        for _, xs in texts(batches):
            for part in chunked(xs):
                yield pd.DataFrame({"d": short([d for *_, ds in part for d in ds])})

    repeated = spark.sparkContext.broadcast(repeat_filter(only.mapInPandas(digests, "d long"), "d"))

    def media(batches):
        for pdf, xs in texts(batches):
            at = 0
            for part in chunked(xs):
                out = []
                for data, m, ends, ds in part:
                    shared = in_filter(repeated.value, short(ds))
                    inline = b"".join(m[a:b] for a, b, s in zip([0, *ends], ends, shared) if not s)
                    out.append((len(data), len(m), hashlib.sha256(m).digest(), b"".join(ds), ends, shared.tolist(), inline, bool(shared.any())))
                made = pd.DataFrame(out, columns=["n_bytes", "media_bytes", "media_sha256", "digests", "ends", "is_shared", "inline", "any_shared"])
                made.insert(0, "id", pdf["id"].iloc[at : at + len(part)].reset_index(drop=True))
                at += len(part)
                yield made

    def chunks(batches):
        seen: set[bytes] = set()
        for _, xs in texts(batches):
            for part in chunked(xs):
                out = []
                for _, m, ends, ds in part:
                    for a, b, d, s in zip([0, *ends], ends, ds, in_filter(repeated.value, short(ds))):
                        if s and d not in seen:
                            if len(seen) > 100_000:  # only spares repeats; the grouping below is what deduplicates
                                seen.clear()
                            seen.add(d)
                            out.append((d, m[a:b]))
                yield pd.DataFrame(out, columns=["digest", "data"])

    rows.mapInPandas(media, _MEDIA).write.partitionBy("any_shared").option("compression", "zstd").parquet(f"{path}/media")
    only.mapInPandas(chunks, _CHUNKS).groupBy("digest").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    repeated.destroy()


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _assembled(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    fetched = pdf["fetched"] if "fetched" in pdf else [()] * len(pdf)
    for sha, ends, is_shared, inline, others in zip(pdf["media_sha256"], pdf["ends"], pdf["is_shared"], pdf["inline"], fetched):
        others, at, parts = {r["n"]: r["data"] for r in others}, 0, []
        for n, (a, b, s) in enumerate(zip([0, *ends], ends, is_shared)):
            if s:
                parts.append(bytes(others[n]))
            else:
                parts.append(inline[at : at + b - a])
                at += b - a
        media = b"".join(parts)
        if hashlib.sha256(media).digest() != sha:
            raise ValueError(f"stored media {bytes(sha).hex()} differs from what was written")
        data = samples(media)
        out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), bytes(sha).hex(), feature(data)))
    return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(spark, path: str) -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from a store."""
    media, chunks = spark.read.schema(_MEDIA).parquet(f"{path}/media"), spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    own = media.where("not any_shared").select("id", "n_bytes", "media_sha256", "ends", "is_shared", "inline")
    kind = T.StructType([own.schema["id"], own.schema["n_bytes"], *T.StructType.fromDDL(_READ).fields])

    def whole(batches):
        for pdf in batches:
            yield pd.concat([pdf[["id", "n_bytes"]].reset_index(drop=True), _assembled(pdf)], axis=1)

    def distinct(batches):
        for pdf in batches:
            yield _assembled(pdf)

    rest = media.where("any_shared")
    once = rest.select("media_sha256", "digests", "ends", "is_shared", "inline").groupBy("media_sha256").agg(*(F.first(c).alias(c) for c in ("digests", "ends", "is_shared", "inline")))
    asked = F.transform(F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda n: F.get("is_shared", n)), lambda n: F.struct(n.alias("n"), F.substring(F.col("digests"), n * 32 + 1, F.lit(32)).alias("digest")))
    wanted = once.select("media_sha256", F.explode(asked).alias("c")).select("media_sha256", "c.n", "c.digest")
    wanted = materialize(wanted, "wanted-chunks")  # digests and places only
    fetched = spread(wanted, chunks, ["digest"], F.col("media_sha256")).groupBy("media_sha256").agg(F.collect_list(F.struct("n", "data")).alias("fetched"))
    made = once.join(fetched, "media_sha256").select("media_sha256", "ends", "is_shared", "inline", "fetched").mapInPandas(distinct, _READ)
    back = spread(rest.select("id", "n_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256")), made, ["media_sha256"], F.col("id"))
    return own.mapInPandas(whole, kind).unionByName(back)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store the media of all rows and read them back; one row per row of ``docs``."""
    path = path or shared_path(docs.sparkSession, "media")
    store(docs, path, id_col, text_col)
    return read_back(docs.sparkSession, path).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", "doc_id")
