"""WARC archives with a two-level capture index.

Pages are sorted by their reversed-host URL key (com,example)/path) and then by page id; each task writes one archive
of gzip members and one index of its captures: lines in blocks that are compressed on their own. A directory with the
first key and the place of each block stays sparse, one row per shard holding it, so a search is a binary search over
shards, one over a shard's blocks, one range read of a block, one binary search in it, and one range read per record.

Of records with equal payloads of `least` bytes or more, that with the smallest page id is a response, and the others
revisit it; smaller ones are all responses. A page's html crosses the network once: what is a revisit is found from
digests alone, and meets its page in the sort.

Files of a task carry its attempt in their names, and only those of attempts that succeeded are in the directory.

Defined results: a null html is an empty payload; a null or odd url is its own key; a null page id passes, and refers
to the smallest id with its payload if there is one, else it is a response; rows that repeat a page id with the same
payload are all responses if that id is the smallest; an empty table gives archives without records. Only the named
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import dropped, new_path, table, written

LEAST = 100
#: Captures in a block of the index.
BLOCK = 256
#: Keys of a search that go to a shard in one row.
KEYS = 4096
DATE = "1970-01-01T00:00:00Z"
SHARD = "warc string, cdx string, first string, last string, blocks array<struct<key:string,offset:bigint,length:bigint,captures:int>>"
RECORD = "key string, page_id bigint, url string, record_type string, refers_to bigint, digest string, full_bytes bigint, payload binary"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of http://www.example.com:80/path?query#part; else the text itself, lower-cased."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, parts, 1))
    path = F.regexp_extract(text, parts, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.translate(F.when(host == "", F.lower(text)).otherwise(key), " \t\r\n", "++++")


def member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record; that of a revisit has the response's headers, with the length of the payload, and no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What `record` wrote."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    full = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    target = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": target if target is None else target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "full_bytes": full,
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
    }


def file_system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) to archives in a folder that all executors share; returns the directory, one row per shard."""
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), url_key(F.col("url")).alias("key"), F.sha2(payload, 256).alias("digest"))
    narrow = written(rows.filter(F.octet_length("html") >= least).select("page_id", "key", "digest"), "digests")
    many = written(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n"), "firsts")
    marks = written(narrow.join(many, "digest").filter("page_id is null or page_id <> refers_to").select("page_id", "key", "digest", "refers_to"), "revisits")
    both = rows.select("key", "page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("bigint").alias("refers_to"), "url", "html").union(
        marks.select("key", "page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    dealt = both.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", "page_id", "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = file_system(folder)
        name = f"{path}/{task.partitionId():06d}-{task.taskAttemptId()}"
        known: dict[tuple[int | None, str], int] = {}
        at, lines, blocks, cdx_at, last, group = 0, [], [], 0, "", None
        warc = cdx = None

        def close_block() -> None:
            nonlocal cdx_at
            data = member("\n".join(lines).encode("utf-8", "surrogatepass"))
            cdx.write(data)
            blocks.append({"key": lines[0].split(" ", 1)[0], "offset": cdx_at, "length": len(data), "captures": len(lines)})
            cdx_at += len(data)
            lines.clear()

        for batch in batches:
            for key, page_id, kind, digest, refers_to, url, html in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if warc is None:
                    fs.create_dir(path, recursive=True)
                    warc, cdx = fs.open_output_stream(f"{name}.warc.gz", compression=None), fs.open_output_stream(f"{name}.cdx.gz", compression=None)
                if group != (key, page_id):
                    group = (key, page_id)
                    known.clear()
                if kind == 0:
                    known[page_id, digest] = refers_to
                    continue
                first = known.get((page_id, digest))
                data = member(record(page_id, url, digest, html.encode("utf-8", "surrogatepass"), first))
                warc.write(data)
                lines.append(f"{key} {at} {len(data)}")
                at, last = at + len(data), key
                if len(lines) == BLOCK:
                    close_block()
        if warc is not None:
            if lines:
                close_block()
            warc.close()
            cdx.close()
        if blocks:
            yield pa.RecordBatch.from_pylist([{"warc": f"{name}.warc.gz", "cdx": f"{name}.cdx.gz", "first": blocks[0]["key"], "last": last, "blocks": blocks}], schema=directory_schema())

    directory = written(dealt.mapInArrow(write, SHARD), "directory")
    dropped(narrow, many, marks)
    return directory


def directory_schema() -> pa.Schema:
    block = pa.struct([("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("captures", pa.int32())])
    return pa.schema([("warc", pa.string()), ("cdx", pa.string()), ("first", pa.string()), ("last", pa.string()), ("blocks", pa.list_(block))])


def record_schema() -> pa.Schema:
    return pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("full_bytes", pa.int64()), ("payload", pa.binary())])


class Reader:
    """Range reads of the files of a folder, the last ones kept open."""

    def __init__(self, folder: str):
        self.fs, _ = file_system(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = self.fs.open_input_file(path)
        return self.open[path].read_at(length, offset)

    def captures(self, cdx: str, offset: int, length: int) -> list[tuple[str, int, int]]:
        lines = zlib.decompress(self.read(cdx, offset, length), 31).decode("utf-8", "surrogatepass").split("\n")
        return [(k, int(a), int(n)) for k, a, n in (x.split(" ") for x in lines)]

    def record(self, warc: str, key: str, offset: int, length: int) -> dict:
        return {"key": key, **parse(zlib.decompress(self.read(warc, offset, length), 31))}


def in_batches(rows: Iterator[dict], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=record_schema())
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=record_schema())


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record: the index's blocks are dealt out, and each is read with its records by ranges."""
    partitions = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = directory.select("warc", "cdx", F.explode("blocks").alias("b")).select("warc", "cdx", "b.offset", "b.length").repartition(partitions, "cdx", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for b in batch.to_pylist():
                yield from in_batches(reader.record(b["warc"], *c) for c in reader.captures(b["cdx"], b["offset"], b["length"]))

    return blocks.mapInArrow(read, RECORD)


def search(directory: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of the given URLs, as read_archives gives them. The first and last keys of shards, one of each task
    that wrote, are sent to all executors; the directory of a shard goes to the tasks that search it, once for up to KEYS
    keys in order, which find the block that they share decompressed."""
    spark = directory.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = spark.sparkContext.broadcast(sorted(tuple(r) for r in directory.select("first", "last", "cdx").collect()))

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [x[0] for x in ends.value]
        lasts = [x[1] for x in ends.value]
        for batch in batches:
            keys, places = [], []
            for key in batch.column(0).to_pylist():
                # shards are ranges in order; those from the first that ends at the key or later, to the last that begins at it or earlier
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    keys.append(key)
                    places.append(ends.value[i][2])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.string())], ["key", "cdx"])

    def in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = batch.column("key"), batch.column("cdx").to_pylist()
            cuts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]] + [len(places)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for c in range(a, b, KEYS):
                    held = keys.slice(c, min(KEYS, b - c))
                    yield pa.RecordBatch.from_arrays([pa.array([places[a]]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], ["cdx", "keys"])

    wanted = urls.select(url_key(F.col(url_col)).alias("key")).distinct().mapInArrow(shards_of, "key string, cdx string")
    dealt = wanted.repartitionByRange(partitions, "cdx", "key").sortWithinPartitions("cdx", "key").mapInArrow(in_rows, "cdx string, keys array<string>")
    joined = dealt.join(directory.select("cdx", "warc", "blocks"), "cdx").select("keys", "cdx", "warc", "blocks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)

        def rows(batch: pa.RecordBatch) -> Iterator[dict]:
            for x in batch.to_pylist():
                firsts, at, lines = [b["key"] for b in x["blocks"]], None, []
                for key in x["keys"]:
                    for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                        if i != at:
                            at, lines = i, reader.captures(x["cdx"], x["blocks"][i]["offset"], x["blocks"][i]["length"])
                        for c in lines[bisect.bisect_left(lines, (key,)) :]:
                            if c[0] != key:
                                break
                            yield reader.record(x["warc"], *c)

        for batch in batches:
            yield from in_batches(rows(batch))

    return joined.mapInArrow(find, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as its record in the archives says, found by a search for the page's URL key; a response's size and digest
    are those of the payload read."""
    folder, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    records = search(write_archives(pages.select("page_id", "url", "html"), folder), folder, pages.select("url"))
    response = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {LEAST}"""
