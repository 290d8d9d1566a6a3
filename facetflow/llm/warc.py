"""WARC archives: one record per page, and reading by verification of the chain of record boundaries.

Writing. Pages of equal payload (the html in UTF-8) are one response, that with the smallest id, and revisits that refer to
it. Which digests occur again is first asked of a bitmap of fixed size (see common.repeat_filter); only those
digests are joined, the others are unique and their pages stay where they are. A record is a row of text that ends with two line ends,
so Spark's text writer makes valid archives, with its commit protocol.

Reading. The magic of a record can also stand inside a payload. Tasks find each place that reads like a record's start and
emit it as a candidate with the offset where, by its Content-Length, its successor starts. Within a file, pointer
jumping from offset 0 then marks what can be reached; only those candidates are records. A file of the writer holds at
most ``per_file`` records, which bounds a file's candidates.

Defined cases: null html is an empty payload; null urls are written as urn:null; a null page id ranks last and is the id
of its own record alone; line ends in urls are percent-encoded; rows that repeat an id and a payload are all responses where that id is the
smallest, else all revisits; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetflow.llm.common import in_filter, materialize, repeat_filter, shared_path, spread

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def record(page_id, url: str | None, html: str, digest: str, refers_to: int | None) -> str:
    """A record without its two closing line ends. refers_to: a page id for a revisit, else None."""
    again = refers_to is not None
    body = HTTP if again else HTTP + html
    where = "urn:null" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <{uri(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {where}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{uri(refers_to)}>", f"WARC-Profile: {PROFILE}"] if again else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body.encode())}",
    ]
    return "\r\n".join(head) + END + body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0, per_file: int = 2000) -> None:
    """Write WARC files under ``path``. Payloads of fewer than ``smallest`` bytes are always responses."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    digests = rows.where(F.octet_length("html") >= smallest).select("page_id", "sha", F.xxhash64("sha").alias("d"))
    repeated = spark.sparkContext.broadcast(repeat_filter(digests, "d"))

    def may_repeat(batches):
        for pdf in batches:
            yield pdf[in_filter(repeated.value, pdf["d"].to_numpy())]

    again = digests.withColumn("page_id", F.col("page_id").cast("string"))
    again = again.mapInPandas(may_repeat, again.schema).withColumn("page_id", F.col("page_id").cast("long"))
    # ids of pages with a repeated payload, and the id of the response; null ids last
    again = materialize(again, "repeated-payloads")  # short: ids and digests of payloads that may repeat
    first = again.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = spread(again, first, ["sha"], F.col("page_id")).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).select("page_id", "sha", F.col("first").alias("refers_to")).distinct()

    def lone(batches):
        for pdf in batches:
            out = pdf[~in_filter(repeated.value, pdf["d"].to_numpy())]
            yield pd.DataFrame({"value": pd.Series([record(p, u, h, b32(bytes.fromhex(s)), None) for p, u, h, s in zip(_ids(out["page_id"]), out["url"], out["html"], out["sha"])], dtype=object)})

    def told(batches):
        for out in batches:
            yield pd.DataFrame({"value": pd.Series([record(p, u, h, b32(bytes.fromhex(s)), r) for p, u, h, s, r in zip(_ids(out["page_id"]), out["url"], out["html"], out["sha"], _ids(out["refers_to"]))], dtype=object)})

    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))  # a pandas column of longs with nulls would lose digits
    keyed = rows.withColumn("d", F.when(F.octet_length("html") >= smallest, F.xxhash64("sha")))
    small = keyed.where("d is null").withColumn("refers_to", F.lit(None).cast("string")).drop("d")
    keyed = keyed.where("d is not null")
    shared = keyed.mapInPandas(may_repeat, keyed.schema).alias("k").join(refers.select(F.col("page_id").cast("string").alias("page_id"), "sha", F.col("refers_to").cast("string").alias("refers_to")).alias("r"), F.col("k.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("k.sha") == F.col("r.sha")), "left").select("k.page_id", "url", "html", "k.sha", "refers_to")
    lines = keyed.mapInPandas(lone, "value string").unionByName(shared.unionByName(small).mapInPandas(told, "value string"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _ids(s: pd.Series) -> list:
    return [None if x is None or x != x else int(x) for x in s.tolist()]


def candidates(content: bytes) -> list[tuple]:
    """(offset, successor, type, id, refers_to, stated digest, payload bytes, payload digest) of each record-like place."""
    out = []
    for m in _START.finditer(content):
        stop = content.find(b"\r\n\r\n", m.end() - 2)
        if stop < 0:
            continue
        fields = {k.lower(): v for k, v in _FIELD.findall(content[m.end() : stop + 2])}
        size = fields.get(b"content-length", b"")
        if not size.isdigit():
            continue
        begin, end = stop + 4, stop + 4 + int(size)
        if content[end : end + 4] != b"\r\n\r\n":
            continue
        block = content[begin:end]
        _, _, payload = block.partition(b"\r\n\r\n")
        text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
        out.append((m.start(), end + 4, text.get(b"warc-type", ""), text.get(b"warc-record-id", ""), text.get(b"warc-refers-to"), text.get(b"warc-payload-digest", "").removeprefix("sha1:"), len(payload), b32(hashlib.sha1(payload).digest())))
    return out


def reachable(offset: np.ndarray, successor: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates lie on the chain from ``start``, by pointer jumping: each round doubles the jump."""
    n = len(offset)
    order = np.argsort(offset)
    place = np.searchsorted(offset[order], successor)
    hit = (place < n) & (offset[order][np.minimum(place, n - 1)] == successor)
    jump = np.where(hit, order[np.minimum(place, n - 1)], n)  # n: the end, its own successor
    jump = np.append(jump, n)
    marked = np.append(offset == start, False)
    while True:
        new = marked.copy()
        new[jump[marked]] = True
        new[n] = False
        if (new == marked).all() and (jump == jump[jump]).all():
            return marked[:n]
        marked, jump = new, jump[jump]


_CANDIDATE = "file string, offset long, successor long, type string, record_id string, refers_to string, stated string, payload_bytes long, payload_digest string, size long"


def read_archives(spark, path: str) -> DataFrame:
    """Rows (page_id, type, refers_to, stated, payload_bytes, payload_digest), one per record of the archives at ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def emit(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                got = pd.DataFrame(candidates(content), columns=["offset", "successor", "type", "record_id", "refers_to", "stated", "payload_bytes", "payload_digest"])
                got.insert(0, "file", name)
                yield got.assign(size=len(content))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = reachable(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())
        if not (pdf["successor"].to_numpy()[keep] == pdf["size"].iloc[0]).any():
            raise ValueError(f"{pdf['file'].iloc[0]}: its records do not lead to its end")
        return pdf[keep]

    schema = T.StructType.fromDDL(_CANDIDATE)
    records = files.mapInPandas(emit, schema).groupBy("file").applyInPandas(verify, schema)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    return records.select(F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"), "type", F.when(F.col("refers_to").isNotNull(), F.when(number("refers_to") != "", number("refers_to").cast("long"))).alias("refers_to"), "stated", "payload_bytes", "payload_digest")


def round_trip(pages: DataFrame, path: str | None = None, smallest: int = 0, **columns: str) -> DataFrame:
    """Write the pages as archives and read them back: rows (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A response's length and digest are those of the payload read back, and must be what its header states; a revisit
    has no payload of its own and takes both from the response that it refers to.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, smallest=smallest, **columns)
    records = materialize(read_archives(spark, path), "warc-records")
    own = records.where("type = 'response'")
    bad = F.when(F.col("stated") != F.col("payload_digest"), F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    out = own.select("page_id", "payload_bytes", F.coalesce(bad, F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    source = own.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("stated"))
    # one response may have a large share of all revisits
    again = spread(records.where("type = 'revisit' and refers_to is not null").select("page_id", "type", "refers_to", "stated"), source.dropDuplicates(["refers_to", "stated"]), ["refers_to", "stated"], F.col("page_id"))
    return out.unionByName(again.select("page_id", F.col("b").alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))
