"""WARC archives of pages, and the external merge of their capture indexes.

Tasks write archives of gzip members, one for each record, into the shared folder; a payload that a later page holds
too is written there only, as the response, and the others revisit it. Reading an archive back gives one run of
captures, sorted by url key and timestamp. Runs are merged k at a time through a loser tree, straight from their
files. Each round cuts the keys into ranges, finer as the runs grow, and merges each range of a group of runs in a
task of its own, so that no task has more of a run than of a round before; the last round gives the capture histories
in global order.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, slices, small_side, utf8, written

#: Payloads under this size are never revisits. Bytes of an archive, from which a new one begins.
MIN_REVISIT, ARCHIVE_BYTES = 1000, 16 << 20
#: Runs of one merge, rows that a run gives at once, one key of so many that is kept to cut ranges.
FAN_IN, RUN_ROWS, SAMPLE = 64, 512, 256
#: Captures that a range of a merge has in the mean, and ranges at most (a power of two); beyond, ranges grow.
RANGE_ROWS, MAX_RANGES = 8192, 4096
#: Captures have no time of their own; page n is taken n seconds after this.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lodestone:page:"
_FIELDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path there."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    head = {
        "WARC-Type": "response" if revisits is None else "revisit",
        "WARC-Record-ID": f"<{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": f"{EPOCH + timedelta(seconds=(page_id or 0) % 10**10):%Y-%m-%dT%H:%M:%SZ}",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if revisits is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_URN}{revisits}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the rest, in lower case."""
    if not url:
        return "-"
    scheme, mark, rest = url.partition("://")
    rest = rest if mark else scheme
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")).lower()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        made, size, out, name = [], 0, None, ""
        for batch in slices(batches, "html"):
            ids, urls, back = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for page, url, html, to in zip(ids, urls, utf8(batch.column("html")), back, strict=True):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0  # a task that runs again writes files of its own
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    made.append(name)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                size += out.write(packer.compress(record(page, url, html, to)) + packer.flush())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages and gives the archives' names; only files of tasks that ended well are named.

    Of equal payloads of MIN_REVISIT bytes or more, that of the largest page_id is the response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select(F.col("digest").alias("shared"), "last")
    shared = written(shared, "shared-payloads")  # a table of its own, so that Spark can split a frequent digest where it can't be broadcast
    linked = rows.join(small_side(shared), rows["digest"] == F.col("shared"), "left").select("page_id", "url", "html", F.when(F.col("last") != F.coalesce("page_id", F.col("last") - 1), F.col("last")).alias("refers_to"))
    return written(linked.mapInArrow(_write(folder), "archive string"), "archives")


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(view[at : at + (1 << 20)])
        used = min(1 << 20, len(data) - at)
        parts = [out]
        while not unpack.eof:
            more = view[at + used : at + used + (1 << 20)]
            if not len(more):
                raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(more))
            used += len(more)
        yield at, b"".join(parts)
        at += used - len(unpack.unused_data)


def captures(data: bytes, archive: str) -> list[dict]:
    """An index entry for each record of an archive, in the order of their keys."""
    out = []
    for offset, raw in members(data):
        head, http, payload = parse(raw)
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
        if head["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"{archive} at {offset}: the payload is not that of its digest")
        number = lambda name: int(x) if (x := head.get(name, "").strip("<>").removeprefix(_URN)) else None
        page = number("WARC-Record-ID")
        stamp = head["WARC-Date"].translate(str.maketrans("", "", "-:TZ"))
        out.append({
            "key": f"{url_key(head.get('WARC-Target-URI'))} {stamp} {'' if page is None else f'{page:+021d}'} {archive} {offset:012d}", "page_id": page,
            "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": digest.hex(), "record_type": head["WARC-Type"], "refers_to": number("WARC-Refers-To"), "archive": archive, "offset": offset,
        })
    return sorted(out, key=lambda r: r["key"])


class Run:
    """Writes rows in ascending order of key to a file of its own, with a name that no other task writes."""

    def __init__(self, folder: str):
        self.fs, root = store(folder)
        self.fs.create_dir(root, recursive=True)
        self.name, self.rows = f"{uuid.uuid4().hex}.parquet", []
        self.out = pq.ParquetWriter(f"{root}/{self.name}", _FIELDS, filesystem=self.fs, compression="zstd")

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= RUN_ROWS:
            self.flush()

    def flush(self) -> None:
        self.out.write_table(pa.Table.from_pylist(self.rows, _FIELDS))
        self.rows = []

    def close(self) -> str:
        self.flush()
        self.out.close()
        return self.name


#: A row for every SAMPLE captures of a run: its file, the place and key of the first of them, and how many they are.
_SAMPLES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("key", pa.string()), ("n", pa.int64())])
_SAMPLES_DDL = "file string, at long, key string, n long"
_PIECE = pa.schema([("run", pa.int64()), ("piece", pa.int64()), ("file", pa.string())])
_PIECE_DDL = "run long, piece long, file string"


def _index(archives: str, runs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(archives)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as data:
                    rows = captures(data.read(), name)
                out = Run(runs)
                for row in rows:
                    out.add(row)
                file = out.close()
                yield pa.RecordBatch.from_pylist([{"file": file, "at": i, "key": rows[i]["key"], "n": min(SAMPLE, len(rows) - i)} for i in range(0, len(rows), SAMPLE)], _SAMPLES)

    return run


def read_run(fs: pa.fs.FileSystem, path: str, low: str | None, high: str | None) -> Iterator[dict]:
    """The rows of a run with low <= key < high, a few at a time; row groups outside are skipped."""
    with fs.open_input_file(path) as data:
        file = pq.ParquetFile(data)
        for g in range(file.num_row_groups):
            ends = file.metadata.row_group(g).column(0).statistics
            if ends is not None and ends.has_min_max and (low is not None and ends.max < low or high is not None and ends.min >= high):
                continue
            rows = file.read_row_group(g)
            if low is not None:
                rows = rows.filter(pc.greater_equal(rows["key"], low))
            if high is not None:
                rows = rows.filter(pc.less(rows["key"], high))
            yield from rows.to_pylist()


def loser_tree(runs: list[Iterator[dict]]) -> Iterator[dict]:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path to the root."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a]["key"], a) < (heads[b]["key"], b)

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield heads[top]
        heads[top] = next(runs[top], None)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _merged(folder: str, lows: list[str | None], last: bool):
    """Merges the runs of each row (run, piece, files) within the piece's range: to a file, or in the last round to captures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            for number, piece, files in zip(*(batch.column(c).to_pylist() for c in ("run", "piece", "files")), strict=True):
                rows = loser_tree([read_run(fs, f"{root}/{f}", lows[piece], lows[piece + 1] if piece + 1 < len(lows) else None) for f in files])
                if last:
                    for first, held in enumerate(iter(lambda: list(islice(rows, RUN_ROWS)), [])):  # noqa: B023 - used up at once
                        yield pa.RecordBatch.from_pylist([r | {"part": piece, "at": first * RUN_ROWS + i} for i, r in enumerate(held)], _HISTORY)
                else:
                    out = Run(folder)
                    for row in rows:
                        out.add(row)
                    yield pa.RecordBatch.from_pylist([{"run": number, "piece": piece, "file": out.close()}], _PIECE)

    return run


_HISTORY = pa.schema([*_FIELDS, ("part", pa.int64()), ("at", pa.int64())])
_HISTORY_DDL = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, part long, at long"


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> tuple[str, DataFrame]:
    """Reads each archive to a sorted run; gives the runs' folder and the samples of their keys (file, at, key, n)."""
    runs = scratch(spark, "capture-runs")
    each = archives.repartition(max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism)))
    return runs, written(each.mapInArrow(_index(folder, runs), _SAMPLES_DDL), "run-samples")


def _bits(rows: int) -> int:
    """Ranges, as a power of two, in which so many rows are merged."""
    return (min(MAX_RANGES, max(1, -(-rows // RANGE_ROWS))) - 1).bit_length()


def _lows(samples: DataFrame, bits: int) -> list[str | None]:
    """Where each of 2^bits ranges begins; empty ranges begin where the last one does."""
    parts = samples.select("key").repartitionByRange(1 << bits, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low"))
    found = sorted(r[0] for r in parts.select("low").collect())[1:] if bits else []  # one for each part
    want = (1 << bits) - 1
    cuts = found if len(found) <= want else [found[(i + 1) * (len(found) + 1) // (want + 1) - 1] for i in range(want)]
    return [None, *cuts, *[cuts[-1] if cuts else None] * (want - len(cuts))]


def _dealt(pieces: DataFrame, finer: int) -> DataFrame:
    """(run, piece, files): the files of FAN_IN runs in each range, the ranges of pieces (run, piece, file) cut into 2^finer."""
    each = pieces.select(F.floor(F.col("run") / FAN_IN).alias("run"), F.explode(F.sequence(F.shiftleft("piece", finer), F.shiftleft(F.col("piece") + 1, finer) - 1)).alias("piece"), "file")
    return each.groupBy("run", "piece").agg(F.sort_array(F.collect_list("file")).alias("files"))


def capture_histories(spark: SparkSession, folder: str, samples: DataFrame) -> DataFrame:
    """All captures in the order of part and at: by url key, then timestamp, then page, archive and place there.

    samples: of the runs in the folder. The driver sees where ranges begin, never rows or names of runs. More than
    FAN_IN runs are merged in rounds. Captures of equal keys can't be: keys end with archive and place. Without runs
    there is no row.
    """
    firsts = samples.where("at = 0").select("file").rdd.map(lambda r: r[0]).zipWithIndex()
    pieces = written(spark.createDataFrame(firsts, "file string, run long").select("run", F.lit(0).cast("long").alias("piece"), "file"), "runs")
    n, total = pieces.count(), samples.agg(F.sum("n")).first()[0] or 0
    bits, now = _bits(total), 0
    lows = _lows(samples, bits)
    tasks = lambda df: max(1, min(df.count(), 4 * spark.sparkContext.defaultParallelism))
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        to = min(bits, max(now, _bits(total // n)))
        dealt = written(_dealt(pieces, to - now), "merge-groups")
        pieces = written(dealt.repartition(tasks(dealt)).mapInArrow(_merged(folder, lows[:: 1 << bits - to], False), _PIECE_DDL), "runs")
        now = to
    dealt = written(_dealt(pieces, bits - now), "merge-groups")
    return dealt.repartitionByRange(tasks(dealt), "piece").sortWithinPartitions("piece").mapInArrow(_merged(folder, lows, True), _HISTORY_DDL)


def archived(pages: DataFrame) -> DataFrame:
    """The capture histories of pages after a round trip through archives.

    A null html is an empty payload, a null url has the key -, a row without page_id is a response or revisits one
    with a page_id. Repeated rows are archived as often as they stand there. An empty table gives none.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "archives")
    runs_folder, samples = read_archives(spark, folder, write_archives(pages, folder))
    return capture_histories(spark, runs_folder, samples)


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, in the order of histories."""
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
