"""WARC archives and their capture index, built by an external merge.

Writing: every task packs its pages into gzip members of WARC files in the shared folder and
returns a capture run, sorted by URL key, timestamp and page. A file is named after its task
attempt and counts only if its name is in the stored run, so lost or repeated attempts leave
nothing behind but unused files.

Merging: runs are dealt by ranges of the sort key, and each range merges its slices of all runs
with a loser tree. Ranges are ordered, so the numbered ranges together are one globally sorted
capture history. A URL captured very often is split among ranges by its timestamps.

Reading: records are fetched by file and offset and parsed back into payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import new_path, stored

MIN_REVISIT_BYTES = 1000
#: An archive file is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Rows of a merge range.
RANGE_ROWS = 200_000
EPOCH = "2024-01-01T00:00:00Z"
RUN_SCHEMA = "urlkey string, ts string, page_id long, url string, file string, offset long, length long, record_type string, run string, seq long"
INDEX_SCHEMA = RUN_SCHEMA + ", shard int, place long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sortable URL key: host reversed by its dots, without www and a default port, then the path and sorted query."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    turned = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        turned += f":{port}"
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{turned}){(parts.path or '/').lower()}" + (f"?{query}" if query else "")


def record_id(page_id: int | None, digest_hex: str, revisit: bool) -> str:
    """The id of a page's record; a revisit finds that of the response by its page and the payload they share. Rows
    that repeat a page and a payload are one capture and share an id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest_hex} {"revisit" if revisit else "response"}')}>"


def info_bytes(file: str) -> bytes:
    """The record that opens every archive."""
    block = b"software: marginalia\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>", f"WARC-Date: {EPOCH}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_bytes(url: str, ts: str, page_id: int | None, payload: bytes, digest_hex: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest_hex, revisit)}",
        f"WARC-Date: {ts}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest_hex, False)}", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record back to its fields; ``payload`` is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    revisit = fields["warc-type"] == "revisit"
    if not revisit and len(payload) != size:
        raise ValueError("a payload is cut short")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    refers = fields.get("x-refers-to-page")
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "url": fields["warc-target-uri"], "ts": fields["warc-date"], "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None, "payload": None if revisit else payload,
    }


def duplicate_heads(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(__digest, __head): for each payload of at least ``min_bytes`` that several pages hold, the largest page_id."""
    sized = pages.where(F.col("__bytes") >= min_bytes)
    heads = sized.groupBy("__digest").agg(F.max("page_id").alias("__head"), F.count("*").alias("__n"))
    return heads.where("__n > 1 AND __head IS NOT NULL").select("__digest", "__head")


def _write_runs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        rows: list[tuple] = []
        sink, number, at = None, 0, 0
        for batch in batches:
            for page_id, url, ts, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or at >= FILE_BYTES:
                    if sink is not None:
                        sink.close()
                    file, at, number = f"{name}-{number:04d}.warc.gz", 0, number + 1
                    sink = files.open_output_stream(f"{base}/{file}", compression=None)
                    info = gzip_member(info_bytes(file))
                    sink.write(info)
                    at = len(info)
                member = gzip_member(record_bytes(url or "", ts, page_id, payload or b"", digest, refers))
                sink.write(member)
                rows.append((url_key(url), ts, page_id, url, file, at, len(member), "response" if refers is None else "revisit"))
                at += len(member)
        if sink is not None:
            sink.close()
        rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[4], r[5]))
        for start in range(0, len(rows), 20_000):
            part = rows[start : start + 20_000]
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()),
                 pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64()), pa.array(columns[7], pa.string()), pa.array([name] * len(part), pa.string()), pa.array(range(start, start + len(part)), pa.int64())],
                names=[f.split()[0] for f in RUN_SCHEMA.split(", ")],
            )

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html); returns the stored runs.

    Of equal payloads of at least ``min_bytes`` that with the largest page_id is written whole,
    the others as revisits of it. Rows that share the largest id are all written whole. Rows
    without an id are revisits if a row with an id has their payload. Null pages have an empty
    payload, null URLs an empty one; texts of any length are written whole. Records are dated by
    ``EPOCH`` and their id in seconds. Other columns are not used.
    """
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", F.octet_length(payload).alias("__bytes"), F.sha1(payload).alias("__digest"))
    heads = stored(duplicate_heads(sized, min_bytes), "payload-heads")
    revisits = (
        sized.where(F.col("__bytes") >= min_bytes).join(heads, "__digest").where("page_id IS NULL OR page_id <> __head")
        .select(F.coalesce("page_id", F.lit(-1)).alias("__page"), F.when(F.col("page_id").isNull(), F.col("__digest")).otherwise("").alias("__bare"), F.col("__digest").alias("__of"), "__head").distinct()
    )
    digest = F.sha1(payload)
    keyed = pages.select("page_id", "url", payload.alias("html"), F.coalesce("page_id", F.lit(-1)).alias("__page"), F.when(F.col("page_id").isNull(), digest).otherwise("").alias("__bare"), digest.alias("__of"))
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ready = keyed.join(revisits, ["__page", "__bare", "__of"], "left").select("page_id", "url", ts.alias("ts"), F.encode("html", "UTF-8").alias("payload"), F.col("__of").alias("digest"), F.col("__head").alias("refers"))
    return stored(ready.mapInArrow(_write_runs(folder), RUN_SCHEMA), "capture-runs")


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, the top the winner, so
    the next item costs one match a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.n = max(1, len(runs))
        self.at = [0] * len(runs)
        self.losers = [-1] * self.n
        winners = [-1] * (2 * self.n)
        for i in range(len(runs)):
            winners[self.n + i] = i
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winners[1] if self.n > 1 else (0 if runs else -1)

    def _first(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.top >= 0 and self.at[self.top] < len(self.runs[self.top]):
            run = self.top
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            winner, node = run, (self.n + run) // 2
            while node:
                if self._first(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.top = winner


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).to_pandas()
    rows["page_id"] = rows["page_id"].astype("Int64")
    keys = list(zip(rows["urlkey"], rows["ts"], rows["page_id"].fillna(-1), rows["file"], rows["offset"], range(len(rows))))
    runs: dict[str, list[tuple]] = {}
    for run, seq, key in sorted(zip(rows["run"], rows["seq"], keys), key=lambda x: x[:2]):  # slices arrive in blocks, each in its run's order
        runs.setdefault(run, []).append(key)
    order = [key[-1] for key in LoserTree(list(runs.values()))]
    shard = TaskContext.get().partitionId()
    out = rows.iloc[order].assign(shard=shard, place=range(len(order)))
    out["shard"] = out["shard"].astype("int32")
    out["place"] = out["place"].astype("int64")
    yield from pa.Table.from_pandas(out, preserve_index=False).combine_chunks().to_batches(max_chunksize=20_000)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The global capture index: the runs' rows with ``shard`` and ``place``, which order them."""
    n = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "urlkey", "ts", "page_id", "file", "offset")
    return stored(dealt.mapInArrow(_merge_range, INDEX_SCHEMA), "capture-index")


def _read_records(folder: str, with_payload: bool):
    names = ["page_id", "url", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = []
                for file, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, files.open_input_file(f"{base}/{file}")
                    source.seek(offset)
                    found.append(parse_record(zlib.decompress(source.read(length), 31)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names=names)
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of an index, read back by file and offset. Each file is read in order by one task for each of its parts."""
    kinds = "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    part = F.floor(F.col("offset") / (64 << 20))
    dealt = index.select("file", "offset", "length").repartition(F.col("file"), part).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read_records(folder, with_payload), kinds)


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages``, merge the capture runs and read every capture back, one row each: page_id, url, ts, payload_bytes,
    payload_digest, record_type, refers_to.

    Nulls, empty and long texts, ties and repeated rows: see write_archives. Null URLs come back empty. An empty table gives no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    runs = write_archives(pages, folder, min_bytes)
    return read_archives(merge_runs(runs), folder)
