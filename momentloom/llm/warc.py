"""WARC archives with a two-level capture index.

Captures are written as gzipped WARC records by the tasks that hold them. Their index lines,
sorted by reversed-host key, are cut into compressed blocks; a sparse directory keeps the first
key of each block. A lookup bisects the directory, reads one block, bisects its lines, and then
reads just the record's byte range.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.session import shared_dir

#: Payloads shorter than this are always stored in full.
LEAST_REVISIT = 100
#: Index lines per compressed block; bytes after which a task begins another archive file.
BLOCK_LINES = 2000
ARCHIVE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query: ``org,example)/a``.

    A null URL has the key ``)``; scheme, ``www.``-free host case and fragment don't matter.
    """
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # a malformed address is its own key
        return ")" + re.sub(r"\s", "%20", url or "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path if url else "")
    return re.sub(r"\s", "%20", key)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def target_uri(url: str) -> str:
    """A URL as a header may hold it: what is not ASCII, and white space, is escaped."""
    return quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")


def _header(kind: str, block: bytes, content: str, *more: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}", *more,
            f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _info(name: str) -> bytes:
    """The record an archive begins with."""
    fields = "software: momentloom\r\nformat: WARC File Format 1.1\r\n".encode()
    return _header("warcinfo", fields, "application/warc-fields", f"WARC-Filename: {name}")


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None = None) -> bytes:
    """A record that any reader of WARC takes. What the format has no place for, the page's number
    and a URL that its header can't hold as it is, stands in fields of our own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    more = [f"WARC-Target-URI: {target_uri(url)}"] if url else []
    if url is not None and (not url or target_uri(url) != url):
        more.append(f"X-Page-URL: {json.dumps(url)}")
    more.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        more.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page: {first}"]
        more += [f"WARC-Refers-To-Target-URI: {target_uri(first_url)}"] if first_url else []
    return _header(kind, block, "application/http; msgtype=response", *more)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _parse(member: bytes) -> dict:
    """Fields of one gzipped record; a response's digest is computed anew and compared."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page, url = fields.get("X-Page-ID"), fields.get("WARC-Target-URI")
    url = json.loads(fields["X-Page-URL"]) if "X-Page-URL" in fields else url
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page} does not hold what its header says")
    refers = fields.get("X-Refers-To-Page")
    return {"page_id": int(page) if page else None, "url": url, "payload": payload if kind == "response" else None,
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": int(refers) if refers else None}


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (null: empty), digest, and the page a revisit refers to with its URL.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response. Only
    digests are grouped (combined before the shuffle); the join back is left to Spark, which
    splits a digest that a third of the pages share. Repeated rows of one page_id all count as
    that page, and pages with a null page_id are never referred to.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    shared = (rows.filter(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("_first"), F.min_by("url", "page_id").alias("_url"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    joined = rows.join(shared.select("digest", "_first", "_url"), "digest", "left")
    revisit = (F.col("page_id") != F.col("_first")) | F.col("page_id").isNull()
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("_first")).alias("refers_to"), F.when(revisit, F.col("_url")).alias("refers_url"))


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write the records of ``plan_records`` below ``path``; returns their captures: key,
    page_id, file, offset, length. A file's name is new for each try of a task, so what a lost
    try left behind is never referred to."""
    def write(batches):
        import pyarrow as pa

        store, base = _store(path)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                lines = []
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "refers_url")]
                htmls = batch.column("html").cast(pa.large_binary())
                for i, (page, url, digest, first, first_url) in enumerate(zip(*columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        about = _gzip(_info(name))
                        out.write(about)
                        at = len(about)
                    member = _gzip(_record("response" if first is None else "revisit", page, url, htmls[i].as_py(), digest, first, first_url))
                    out.write(member)
                    lines.append((url_key(url), page, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "page_id", "file", "offset", "length"), x)) for x in lines], schema=schema)
        finally:
            if out is not None:
                out.close()

    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    return records.mapInArrow(write, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """Sort the captures by key and write their lines in compressed blocks below ``path``.

    Returns the sparse directory: first and last key, file, offset and length of each block.
    The sort is by (key, page_id, file, offset), so a host or URL with very many captures is
    spread over tasks.
    """
    def write(batches):
        import pyarrow as pa

        store, base = _store(path)
        name, at, lines, rows, out = f"{uuid.uuid4().hex}.cdx", 0, [], [], None

        def flush():
            nonlocal at, lines, out
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            packed = _gzip("\n".join(lines).encode())
            out.write(packed)
            rows.append({"first_key": lines[0].split(" ", 1)[0], "last_key": lines[-1].split(" ", 1)[0],
                         "file": name, "offset": at, "length": len(packed)})
            at, lines = at + len(packed), []

        try:
            for batch in batches:
                for key, page, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                    lines.append(f"{key} {'-' if page is None else page} {file} {offset} {length}")
                    if len(lines) >= BLOCK_LINES:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    order = [F.col(c) for c in ("key", "page_id", "file", "offset")]
    return (captures.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(write, "first_key string, last_key string, file string, offset long, length long"))


def lookup(keys: DataFrame, directory: DataFrame, path: str, fanout: int = 1024) -> DataFrame:
    """Captures (key, page_id, file, offset, length) of each distinct key of ``keys``.

    The directory is bisected through a fixed number of fences: a sample of its first keys
    (at most ``fanout``, so it may be sent to every task) cuts the key space into ranges. The
    entries of a range are read into a list that its keys, streamed after them, bisect; then
    every block named is read once for all its keys. Keys without captures give no row.
    """
    fences = _fences(directory, fanout)

    @F.pandas_udf("int")
    def range_of(first):
        return first.map(lambda k: bisect_right(fences, k)).astype("int32")

    entries = (directory.select(range_of("first_key").alias("_from"), range_of("last_key").alias("_to"), F.col("first_key").alias("key"),
                                "last_key", "file", "offset", "length")
               .select(F.explode(F.sequence("_from", "_to")).alias("_range"), "key", "last_key", "file", "offset", "length"))
    wanted = keys.select(F.coalesce("key", F.lit(")")).alias("key")).distinct()
    asked = wanted.select(range_of("key").alias("_range"), "key", *[F.lit(None).cast(t).alias(c) for c, t in
                          (("last_key", "string"), ("file", "string"), ("offset", "long"), ("length", "long"))])
    meeting = (entries.unionByName(asked).repartition("_range")
               .sortWithinPartitions("_range", F.col("last_key").isNull(), "key", "last_key", "file", "offset"))

    def pick(batches):
        """Entries of a range come first, then its keys: each key bisects the entries. These are
        sorted by first and last key, so blocks of one key alone stand before the block in which
        it ends, whatever files they are in, and last keys never fall."""
        import pyarrow as pa

        at, firsts, held = None, [], []
        for batch in batches:
            rows = []
            for place, key, last, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if place != at:
                    at, firsts, held = place, [], []
                if last is not None:
                    firsts.append(key)
                    held.append((last, file, offset, length))
                    continue
                j = bisect_right(firsts, key) - 1
                while j >= 0 and held[j][0] >= key:  # a crowded key may fill several blocks
                    rows.append((key, *held[j][1:]))
                    j -= 1
            yield pa.RecordBatch.from_pylist([dict(zip(visit.names, r)) for r in rows], schema=visit)

    import pyarrow as pa

    visit = pa.schema([("key", pa.string()), ("block_file", pa.string()), ("block_at", pa.int64()), ("block_length", pa.int64())])
    visits = meeting.mapInArrow(pick, "key string, block_file string, block_at long, block_length long")

    def read(batches):
        import pyarrow as pa

        store, base = _store(path)
        held, lines, names = None, [], []
        for batch in batches:
            rows = []
            for key, file, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (file, at):
                    with store.open_input_file(f"{base}/{file}") as f:
                        lines = zlib.decompress(f.read_at(length, at), 31).decode().split("\n")
                    held, names = (file, at), [x.split(" ", 1)[0] for x in lines]
                for line in lines[bisect_left(names, key):bisect_right(names, key)]:
                    _, page, target, offset, size = line.split(" ")
                    rows.append({"key": key, "page_id": None if page == "-" else int(page), "file": target, "offset": int(offset), "length": int(size)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return (visits.repartition("block_file", "block_at").sortWithinPartitions("block_file", "block_at", "key")
            .mapInArrow(read, "key string, page_id long, file string, offset long, length long"))


def _fences(directory: DataFrame, fanout: int) -> list[str]:
    """At most ``fanout`` keys that cut the directory into ranges of about equal size."""
    picked = (directory.select("first_key", F.xxhash64("file", "offset").alias("_o")).orderBy("_o").limit(fanout))
    return sorted({r["first_key"] for r in picked.collect()})


def read_records(captures: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """Read the byte range of each capture and parse it: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and with ``payload`` the bytes (null for revisits).

    Captures are sorted by place, so a task reads its archives front to back.
    """
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    kinds |= {"payload": "binary"} if payload else {}

    def read(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c, types[k]) for c, k in kinds.items()])
        store, base = _store(path)
        name, source = None, None
        try:
            for batch in batches:
                rows = []
                for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, store.open_input_file(f"{base}/{file}")
                    rows.append(_parse(source.read_at(length, offset)))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if source is not None:
                source.close()

    share = F.floor(F.col("offset") / F.lit(8 << 20))  # a large archive is read by several tasks
    return (captures.repartition(F.col("file"), share).sortWithinPartitions("file", "offset")
            .mapInArrow(read, ", ".join(f"{c} {k}" for c, k in kinds.items())))


def archive_pages(pages: DataFrame) -> tuple[DataFrame, str, str]:
    """Write ``pages`` (page_id, url, html) as archives and index them.

    Returns the block directory and the folders of archives and index. A null html is an
    empty payload; null URLs and page_ids are kept; an empty table gives an empty directory.
    """
    from momentloom.session import stage

    spark = pages.sparkSession
    archives, index = _uri(shared_dir(spark, "warc")), _uri(shared_dir(spark, "cdx"))
    captures = stage(write_archives(plan_records(pages), archives), "captures")
    return stage(build_index(captures, index), "directory"), archives, index


def _uri(path: str) -> str:
    return path if re.match(r"\w+:", path) else f"file://{path}"


def key_of(url: Column) -> Column:
    """``url_key`` as a column."""
    @F.pandas_udf("string")
    def keys(urls):
        return urls.map(url_key)

    return keys(url)
