"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is a frame of
its own.  The reader loads the dictionary from the leading frame, decodes one frame at a time, and validates
headers, lengths and digests; revisits are held against the response that they name.

Records are WARC/1.1: a response's block is an HTTP message with the payload as its body, a revisit's the headers of
that message alone, whose Content-Length is the payload's.  Archives travel as binary rows, so that any store that
Spark writes will do; export_archives makes files of them, and read_files reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, ship
from lodestone.llm.components import HOT_KEYS, HOT_ROWS

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Payload bytes after which the writer closes an archive; bounds memory on both sides.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
#: Payloads that a writer task keeps back to train its archive's dictionary, and bytes of each.
TRAIN_PAYLOADS, TRAIN_BYTES = 200, 4096
EMPTY_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the reader gives the decoder at first; what follows a frame in a chunk is read again.
CHUNK = 1 << 12


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block; raises ValueError where the record breaks the format."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in fields:
            raise ValueError(f"bad header: {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", *(("warc-target-uri", "content-type") if fields.get("warc-type") in ("response", "revisit") else ())):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("bad content-length")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length doesn't match content-length")
    return fields, rest[:size]


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def http_message(block: bytes) -> tuple[int, bytes]:
    """(Content-Length, body) of a block that holds an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    sizes = [x.split(b":", 1)[1].strip() for x in lines[1:] if x.lower().startswith(b"content-length:")]
    if not gap or not lines[0].startswith(b"HTTP/1.") or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("the block isn't an HTTP message with a length")
    return int(sizes[0]), body


def target_uri(url: str | None, page) -> str:
    """The url with what may not stand in a header line or a URI percent-encoded; without a url, a name for the page."""
    if not url:
        return f"urn:page:{'' if page is None else page}"
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    options = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=3, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + b"".join(options.compress(r) for r in records)


def read_archive(archive: bytes):
    """Yields each record's raw bytes; one frame per record."""
    view = memoryview(archive)
    at, dictionary = 0, b""
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        dictionary = bytes(view[8 : 8 + size])
        if len(dictionary) != size:
            raise ValueError("the dictionary's frame is cut short")
        if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("neither a Zstandard nor a skippable frame")
        # Chunks grow with the frame, so what is copied stays in proportion to it, not to the archive.
        frame, parts, chunk = reader.decompressobj(), [], CHUNK
        while not frame.eof:
            if at >= len(view):
                raise ValueError("a frame is cut short")
            parts.append(frame.decompress(view[at : at + chunk]))
            at += min(chunk, len(view) - at) - len(frame.unused_data)
            chunk *= 2
        yield b"".join(parts)


def plan_records(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page, url, payload (null: empty) and keeper: of rows with equal payloads the one with the largest key.

    Only digests and keys are grouped (partial maxima before the shuffle), never payloads.  Payloads that very many
    rows share are met by broadcast, and their rows are dealt out by key, so no task gets them all.  A null key is
    never the keeper unless all are null.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    target = F.col(url) if url in pages.columns else F.lit(None)
    rows = pages.select(F.col(key).alias("page"), target.cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    keepers = materialize(rows.groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")), "warc-keepers")
    bound = max(HOT_ROWS, (keepers.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot, cool = keepers.where(F.col("n") > bound), keepers.where(F.col("n") <= bound)
    rows = rows.join(F.broadcast(hot.select("digest", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("is_hot"))), "digest", "left")
    spread = F.when(F.col("is_hot"), F.concat(F.lit("hot-"), F.xxhash64("page", "url").cast("string"))).otherwise(F.col("digest"))
    rows = rows.withColumn("place", spread).join(cool.select(F.col("digest").alias("place"), "keeper"), "place", "left")
    return rows.select("page", "url", "payload", F.when(F.col("is_hot"), F.col("hot_keeper")).otherwise(F.col("keeper")).alias("keeper"))


def write_pages(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Archives (archive binary, n_records int) with one record per row: response, or revisit of the keeper's.

    A revisit carries the digest and the length of the payload but not the payload.  Rows that repeat a key and
    payload are all responses if that key is the keeper.  Rows with a null key have records of an empty page name.
    A url that is null, or the lack of such a column, leaves the page's name as the target.
    """
    ship(pages.sparkSession)

    def run(batches):
        dictionary, kept, held, size = None, [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                page, target, body, keeper = (batch.column(c)[at].as_py() for c in ("page", "url", "payload", "keeper"))
                if dictionary is None:
                    kept.append(body[:TRAIN_BYTES])
                    if len(kept) == TRAIN_PAYLOADS:
                        dictionary = trained(kept)
                revisit = keeper is not None and page != keeper
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", EMPTY_DATE)]
                fields += [("WARC-Target-URI", target_uri(target, page)), ("WARC-Payload-Digest", f"sha1:{payload_digest(body)}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{keeper}>"), ("WARC-Refers-To-Date", EMPTY_DATE), ("WARC-Profile", REVISIT_PROFILE)]
                held.append(build_record(fields, http_head(len(body)) + (b"" if revisit else body)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    dictionary = trained(kept) if dictionary is None else dictionary
                    yield _row(held, dictionary)
                    held, size = [], 0
        if held:
            yield _row(held, trained(kept) if dictionary is None else dictionary)

    def _row(held, dictionary):
        return pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.binary()), pa.array([len(held)], pa.int32())], ["archive", "n_records"])

    return plan_records(pages, payload, key, url).mapInArrow(run, "archive binary, n_records int")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file NAME.warc.zst of folder, a URI that the executors can write; (file, n_records, n_bytes).

    Written by the tasks that hold the archives.  A name is the archive's digest, so a task that runs again writes
    the same file again.
    """
    ship(archives.sparkSession)

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for archive in batch.column("archive"):
                data = archive.as_py()
                names.append(f"{hashlib.sha256(data).hexdigest()[:32]}.warc.zst")
                sizes.append(len(data))
                with store.open_output_stream(f"{root}/{names[-1]}", compression=None) as out:  # not packed once more for its name
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("n_records"), pa.array(sizes, pa.int64())], ["file", "n_records", "n_bytes"])

    return archives.select("archive", "n_records").mapInArrow(run, "file string, n_records int, n_bytes long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """read_records() of the .warc.zst files of a folder."""
    return read_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.col("content").alias("archive")))


def read_records(archives: DataFrame) -> DataFrame:
    """Per record: record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes and payload (null for revisits)."""
    ship(archives.sparkSession)
    names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for archive in batch.column("archive"):
                rows, size = [], 0
                for raw in read_archive(archive.as_py()):
                    fields, block = parse_record(raw)
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    length, body = http_message(block)
                    if kind == "response" and (digest != payload_digest(body) or length != len(body)):
                        raise ValueError("a payload doesn't match its digest or length")
                    if kind == "revisit" and (body or fields.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in fields):
                        raise ValueError("a revisit with a body, of another profile or of nothing")
                    rows.append((kind, fields["warc-record-id"], fields["warc-target-uri"], fields.get("warc-refers-to"), digest, length, None if kind == "revisit" else body))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    def _rows(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return archives.mapInArrow(run, "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def check_revisits(records: DataFrame) -> None:
    """Raises ValueError where revisits of a payload name another record than its response, or have another length.

    One row for each digest, from partial aggregates; a count comes back.
    """
    of = lambda kind, c: F.when(F.col("record_type") == kind, F.col(c))
    one = records.groupBy("payload_digest").agg(
        F.min(of("response", "record_id")).alias("r"), F.min(of("revisit", "refers_to")).alias("low"), F.max(of("revisit", "refers_to")).alias("high"),
        F.min("payload_bytes").alias("short"), F.max("payload_bytes").alias("long"), F.max(of("response", "record_id")).alias("last"),
    )
    wrong = one.where("low is not null and (r is null or low <> high or low <> r or r <> last or short <> long)").count()
    if wrong:
        raise ValueError(f"revisits of {wrong} payloads don't match a response")


def round_trip(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Write the archives to the shared folder, read every record back and hold revisits against responses; without payloads."""
    records = materialize(read_records(materialize(write_pages(pages, payload, key, url), "warc")).drop("payload"), "warc-records")
    check_revisits(records)
    return records


def record_key(column: str) -> F.Column:
    return F.regexp_extract(column, "^<urn:page:(.*)>$", 1)
