"""Attachments: a directory of metadata, and a literal byte search over their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.sources.scratch import cut

#: Formats that are searched as text, bytes in a chunk, and limits beyond which no partial answer is given.
TEXT_FORMATS = ("txt", "md", "log", "csv", "json", "xml", "yaml", "yml", "html", "htm", "sql", "ini", "conf", "toml")
CHUNK_BYTES, AROUND = 8192, 80
MAX_FILES, MAX_BYTES, MAX_HITS = 256, 256 << 20, 1000


class GrepError(ValueError):
    pass


#: The columns of the directory, with their types.
DIRECTORY = (
    ("attachment_id", "string"), ("user_id", "bigint"), ("workspace_id", "bigint"), ("session_id", "string"), ("turn_id", "string"), ("turn_seq", "bigint"), ("filename", "string"), ("file_type", "string"),
    ("media_type", "string"), ("purpose", "string"), ("origin", "string"), ("byte_len", "bigint"), ("sha256", "string"), ("created_ms", "bigint"), ("searchable", "boolean"), ("search_mode", "string"),
)


def directory(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sixteen columns for each file: what files has of them, else null; bytes and digests are those of the chunks.

    Files whose type is text are searchable, as literal bytes.
    """
    body = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    joined = F.aggregate(body, F.lit(b""), lambda a, c: F.concat(a, c["data"]))
    sizes = chunks.groupBy("attachment_id").agg(F.sum(F.octet_length("data")).alias("held_bytes"), F.sha2(joined, 256).alias("held_sha256"), F.max("format").alias("held_format"), F.max("session_id").alias("held_session"))
    rows = files.join(sizes, "attachment_id", "left")
    known = {c.lower(): c for c in files.columns}
    kind = F.coalesce(*[F.col(known[c]) for c in ("file_type", "format") if c in known], F.col("held_format"))
    text = F.coalesce(F.lower(kind).isin(*TEXT_FORMATS), F.lit(False))
    made = {"file_type": kind, "byte_len": F.coalesce("held_bytes", F.lit(0)), "sha256": F.col("held_sha256"), "searchable": text, "search_mode": F.when(text, "literal")}
    made["session_id"] = F.coalesce(*[F.col(known[c]) for c in ("session_id",) if c in known], F.col("held_session"))
    return rows.select(*[(made.get(n, F.col(known[n]) if n in known else F.lit(None))).cast(t).alias(n) for n, t in DIRECTORY])


def matches(bodies: DataFrame, pattern: str, key: str, body: str = "body") -> DataFrame:
    """key, match_no, line_number (from 1), byte_offset (from 0), snippet: every place where pattern's bytes stand, overlaps not counted.

    Each body is split at the pattern, and offsets are running sums of the parts before a match: the work is in
    proportion to the body, however many matches it has.
    """
    if not pattern:
        raise GrepError("the pattern is empty")
    size, lines = len(pattern.encode()), pattern.count("\n")
    rows = cut(bodies.where(F.contains(F.col(body), F.lit(pattern))).select(F.col(key), F.col(body).alias("body"), F.monotonically_increasing_id().alias("row_no")), "grep")
    parts = rows.select("row_no", F.posexplode(F.split(F.col("body"), F.lit(_quoted(pattern)), -1)).alias("match_no", "part"), F.octet_length("body").alias("whole"))
    breaks = F.char_length("part") - F.char_length(F.replace("part", F.lit("\n"), F.lit("")))
    parts = parts.select("row_no", "match_no", "whole", F.octet_length("part").cast("long").alias("b"), breaks.cast("long").alias("l"))
    before = W.partitionBy("row_no").orderBy("match_no")
    places = parts.select("row_no", "match_no", "whole", (F.sum("b").over(before) + F.col("match_no") * size).alias("byte_offset"), (F.sum("l").over(before) + F.col("match_no") * lines + 1).alias("line_number"))
    places = places.where(F.col("byte_offset") < F.col("whole")).drop("whole")  # the last part has no match behind it
    out = places.join(rows, "row_no")
    low = F.greatest(F.col("byte_offset") - AROUND, F.lit(0))
    high = F.least(F.col("byte_offset") + size + AROUND, F.octet_length("body"))
    shown = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("body", "UTF-8"), (low + 1).cast("int"), (high - low).cast("int")).cast("string")), "^\ufffd+|\ufffd+$", "")
    return out.select(key, "match_no", "line_number", "byte_offset", shown.alias("snippet"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def grep(chunks: DataFrame, pattern: str, session: str | None = None, attachment: str | None = None, files: DataFrame | None = None, snapshot: int = 0) -> DataFrame:
    """chunks(attachment_id, session_id, format, ordinal, data): matches of one snapshot, or an error beyond the limits.

    The directory's columns (from files, or from the chunks alone), then match_no, line_number, byte_offset, snippet
    and scan_snapshot.
    """
    if not 1 <= len(pattern.encode()) <= 512 or "\0" in pattern:
        raise GrepError("a pattern has 1 to 512 bytes and no NUL")
    chosen = chunks.where(F.lower("format").isin(*TEXT_FORMATS))
    if session is not None:
        chosen = chosen.where(F.col("session_id") == session)
    if attachment is not None:
        chosen = chosen.where(F.col("attachment_id") == attachment)
    size = chosen.agg(F.count_distinct("attachment_id").alias("files"), F.sum(F.octet_length("data")).alias("bytes")).first()
    if size["files"] > MAX_FILES or (size["bytes"] or 0) > MAX_BYTES:
        raise GrepError("too many files or bytes for one search")
    bodies = chosen.groupBy("attachment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "data"))), lambda c: F.decode(c["data"], "UTF-8")), "").alias("body"))
    found = matches(bodies, pattern, "attachment_id")
    if found.limit(MAX_HITS + 1).count() > MAX_HITS:
        raise GrepError(f"more than {MAX_HITS} hits")
    of = directory(files if files is not None else chosen.select("attachment_id").distinct(), chosen)
    return of.join(found, "attachment_id").withColumn("scan_snapshot", F.lit(snapshot).cast("bigint"))
