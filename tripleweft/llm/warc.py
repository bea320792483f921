"""WARC archives with an index written first and byte-range reads through it.

Writing deals the pages to tasks, each of which appends gzipped records to
archive files of its own and returns an index row per record: path, offset,
length, URL and digest. Reading goes through the index alone: the selected
rows are sorted by file and offset, neighbouring ranges are coalesced, and
each coalesced range is one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import slices
from tripleweft.llm.runtime import materialize, open_store, prepare, scratch_path

REVISIT_BYTES = 1000  # smaller payloads are always stored
FILE_BYTES = 128 << 20  # an archive is closed at the next record beyond this size
RANGE_BYTES = 8 << 20  # most bytes of one coalesced read, but for a larger record
GAP_BYTES = 64 << 10  # unselected bytes that are read through rather than skipped
TASK_BYTES = 64 << 20  # archive bytes that a reading task is meant to get
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "path string, offset bigint, length bigint, url string, payload_digest string, payload_bytes bigint, "
    "record_type string, page_id {id}, refers_to {id}"
)


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """`page_id, url, html, payload_bytes, payload_digest, record_type, refers_to`.

    Of equal payloads of at least `least` bytes the one with the largest
    page_id is the response, the others revisit it. The payload of a null html
    is empty. Rows that repeat the largest page_id are each a response; a null
    page_id is smaller than any other.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", "url", "html", F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body).alias("payload_digest")
    )
    # the side that is summed per digest has no page; as in `semi_join`, the hash beside
    # the keys gives both sides an exchange, so that a payload with many pages is split
    keys = ["payload_digest", "payload_bytes"]
    rows = rows.withColumn("_hash", F.xxhash64(*keys))
    repeated = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy(*keys)
        .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(*keys, "_largest", F.xxhash64(*keys).alias("_hash"))
    )
    revisit = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return rows.join(repeated, [*keys, "_hash"], "left").select(
        "page_id", "url", "html", *reversed(keys),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_largest")).alias("refers_to"),
    )


def _record(row: dict) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, which tells the payload's length."""
    body = b"" if row["record_type"] == "revisit" else (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{row["page_id"]}')}>",
        f"WARC-Target-URI: {' '.join((row['url'] or '').split())}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{row["refers_to"]}')}>"]
    head += [f"Content-Length: {len(http) + len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + http + body + b"\r\n\r\n", 1, mtime=0)


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of `page_id, url, html` below `folder`; returns the index.

    Files are named by task attempt and count only through the index, which is
    written last, so lost or repeated attempts do no harm. Null urls are empty,
    empty tables give an empty index, other columns are ignored.
    """
    prepare(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    columns = ["url", "payload_digest", "payload_bytes", "record_type", "page_id", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for part in slices(batches, "html"):
            paths, offsets, lengths = [], [], []
            for row in part.to_pylist():
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _record(row)
                out.write(data)
                paths.append(name)
                offsets.append(offset)
                lengths.append(len(data))
                offset += len(data)
            found = [pa.array(paths), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(found + [part.column(c) for c in columns], ["path", "offset", "length", *columns])
        if out is not None:
            out.close()

    return materialize(plan_records(pages, least).mapInArrow(run, INDEX.format(id=kind)), "warc-index")


def _ranges(rows: Iterator[tuple[str, int, int, object]]) -> Iterator[tuple[str, int, int, list]]:
    """Coalesced `path, start, end, rows` of rows sorted by path and offset."""
    path, start, end, held = None, 0, 0, []
    for row in rows:
        if held and (row[0] != path or row[1] - end > GAP_BYTES or row[1] + row[2] - start > RANGE_BYTES):
            yield path, start, end, held
            held = []
        if not held:
            path, start, end = row[0], row[1], row[1]
        held.append(row)
        end = max(end, row[1] + row[2])
    if held:
        yield path, start, end, held


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(data, zlib.MAX_WBITS | 16)
    head, _, rest = raw.partition(b"\r\n\r\n")
    http, _, _ = rest.partition(b"\r\n\r\n")

    def fields(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)

    warc = fields(head)
    return warc, fields(http), rest[len(http) + 4 : int(warc["Content-Length"])]


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the rows of `index`, read back from `folder`.

    `page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to`. Length and digest of a stored payload are taken from its bytes,
    those of a revisit from the record's heads. `refers_to` is the index's.
    Stretches of archives are dealt to tasks by the bytes to be read, not by
    the far smaller index; a record longer than a stretch is read whole.
    """
    prepare(index.sparkSession)
    kind = dict(index.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)

        def rows() -> Iterator[tuple]:
            for part in batches:
                yield from zip(*[part.column(c).to_pylist() for c in ("path", "offset", "length", "page_id", "refers_to")], strict=True)

        opened, file = None, None
        for path, start, end, held in _ranges(rows()):
            if path != opened:
                opened, file = path, store.open_input_file(f"{root}/{path}")
            file.seek(start)
            data = memoryview(file.read(end - start))
            out = []
            for _, offset, length, page_id, refers_to in held:
                warc, http, payload = parse_record(data[offset - start : offset - start + length])
                stored = warc["WARC-Type"] == "response"
                out.append({
                    "page_id": page_id,
                    "url": warc["WARC-Target-URI"],
                    "payload": payload if with_payload and stored else None,
                    "payload_bytes": len(payload) if stored else int(http["Content-Length"]),
                    "payload_digest": hashlib.sha1(payload).hexdigest() if stored else warc["WARC-Payload-Digest"].removeprefix("sha1:"),
                    "record_type": warc["WARC-Type"],
                    "refers_to": refers_to,
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    id_type = index.select("page_id").limit(0).toArrow().schema.field("page_id").type
    schema = pa.schema([("page_id", id_type), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", id_type)])
    fields = f"page_id {kind}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}"
    total = index.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(1, -(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, total // RANGE_BYTES))
    stretch = F.floor(F.col("offset") / (TASK_BYTES // 4))
    sorted_index = index.repartition(n_tasks, "path", stretch).sortWithinPartitions("path", "offset")
    return sorted_index.select("path", "offset", "length", "page_id", "refers_to").mapInArrow(run, fields)


def warc_report(pages: DataFrame) -> DataFrame:
    """Every page's record, written as WARC and read back through the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    records = read_records(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
