"""WARC archives: writing, and reading verified by the chain of record boundaries.

Records are written by Spark's text sink, a record a row: a WARC record of UTF-8 payload is text that ends in two
line breaks, which is the sink's line separator. So output is committed like any other, and archives are uncompressed
and can be cut anywhere.

Reading trusts no magic alone. A task takes one range of bytes of an archive, reports every place where a record
could begin (version line, and a header block with a content length), and the place where its successor would. A
payload may hold such text, too. Within its range the task jumps pointers (each place's successor is replaced by the
successor's successor until all have left the range), so every candidate is known by the place where its chain
leaves. Across ranges the same jumping goes on as a join on (archive, place): places reachable from the file's start
by 1, 2, 4 .. ranges, which ends after the logarithm of an archive's ranges. A last pass over the ranges walks from
the reachable entry of each and emits its records; what is not on the chain is payload. A chain that ends elsewhere
than at the file's end raises an error.

Of records with equal payloads of at least `least` bytes, that with the smallest id is the response, the others are
revisits without a block, which name it. Digests and ids alone are shuffled to find the revisits, and these are written
from them. A bitmap of the revisits' (digest, id) tells what is surely a response, which goes from the scan to the sink; a
second one, of the responses whose bit the first has set by chance, tells what is surely a revisit. Only rows that both
bitmaps hold are joined with their payload. Bitmaps have 16 bits a row and at most MOST_BITS; past that more rows are
joined, with the same result. Cases: null payload counts as empty; repeated rows of the smallest id are
all responses; a null id takes part as the largest; an empty table gives an archive set without records; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch, keep

PAGE_BITS = 1 << 15  # of one row of a bitmap, as Spark's bitmap functions have it
MOST_BITS = 1 << 30  # 128 MiB
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"  # archives made from a table have no capture time
LEAST = 100
RANGE = 4 << 20
HEADER = 1 << 16  # bytes read at first for a header block; longer ones are read on
SCHEMES = {"s3a": "s3", "s3n": "s3"}  # Hadoop's names of what pyarrow calls otherwise
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def keys_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest (binary), bytes per row."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("bytes", F.octet_length("payload").cast("long"))


def revisits_of(keys: DataFrame, least: int) -> DataFrame:
    """keys' rows that revisit another record, and refers_to, that record's id."""
    # digests that occur once need no response; a hot one combines in the map tasks
    firsts = keys.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return keys.join(firsts.hint("merge"), "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to")))  # left side splits where a digest is hot


def bits_for(rows: int) -> int:
    """Size of a bitmap of so many rows: a power of two, 16 bits a row, MOST_BITS at most."""
    return min(MOST_BITS, max(PAGE_BITS, 1 << (16 * rows - 1).bit_length()))


def bitmap(rows: DataFrame, bits: int) -> DataFrame:
    """page, map: the set bits of the rows' (digest, id), in at most bits / PAGE_BITS rows of 4 KiB."""
    return _placed(rows, bits).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("map"))


def _placed(rows: DataFrame, bits: int) -> DataFrame:
    place = F.pmod(F.xxhash64("digest", "id"), F.lit(bits))
    return rows.withColumn("page", F.floor(place / PAGE_BITS).cast("long")).withColumn("bit", F.pmod(place, F.lit(PAGE_BITS)))


def _marked(rows: DataFrame, bitmap_: DataFrame, bits: int, name: str) -> DataFrame:
    """rows and whether their bit is set. The bitmap has at most MOST_BITS / 8 bytes, so it may be broadcast."""
    at = F.conv(F.hex(F.substring(F.col("map"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.expr("getbit(coalesce(byte, 0), cast(bit % 8 as int))") == 1, F.lit(False))
    joined = _placed(rows, bits).join(F.broadcast(bitmap_), "page", "left").withColumn("byte", at)
    return joined.withColumn(name, set_).drop("page", "bit", "map", "byte")


def record(row_type: Column) -> Column:
    """The text of one record without its end."""
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace("url", "[\\r\\n]", " ")
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", row_type),
        line("WARC-Record-ID", F.concat(F.lit("<"), uri(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("X-Payload-Length", F.col("bytes").cast("string")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), uri(F.col("refers_to")), F.lit(">"))))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, per_file: int = 5000) -> None:
    """Archives of at most per_file records in the folder path."""
    scratch = Scratch(pages.sparkSession)
    whole = keys_of(pages, id_col, url_col, payload_col)
    keys = scratch.put("keys", whole.drop("payload"))
    back = scratch.put("revisits", revisits_of(keys, least))
    n = back.count()
    if n:
        who = back.select("digest", "id").distinct()
        one = bits_for(n)
        first = scratch.put("bitmap1", bitmap(back, one))
        taken = _marked(keys.select("digest", "id"), first, one, "hit").filter("hit")
        taken = scratch.put("taken", _without(taken, who).select("digest", "id"))
        two = bits_for(taken.count())
        second = scratch.put("bitmap2", bitmap(taken, two))
        marked = _marked(_marked(whole, first, one, "hit"), second, two, "doubt")
        sure = marked.filter("not hit")
        whole = sure.unionByName(_without(marked.filter("hit and doubt"), who)).select("id", "url", "payload", "digest", "bytes")
    text = lambda digest: F.lower(F.hex(digest))
    rows = whole.withColumn("digest", text("digest")).withColumn("refers_to", F.lit(None).cast("long")).select(record(F.lit("response")).alias("value"))
    if n:
        again = back.withColumn("digest", text("digest")).withColumn("payload", F.lit(""))
        rows = rows.unionByName(again.select(record(F.lit("revisit")).alias("value")))
    rows.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)
    scratch.drop()


def _without(rows: DataFrame, who: DataFrame) -> DataFrame:
    """rows whose (digest, id) is not in who."""
    other = who.select(F.col("digest").alias("_d"), F.col("id").alias("_k")).hint("merge")
    return rows.join(other, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_k")), "left_anti")


def _open(uri: str) -> pa.NativeFile:
    scheme, _, rest = uri.partition(":")
    system, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return system.open_input_file(path)


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """(start of the block, its length) of a record whose version line begins at `at`."""
    end = data.find(END, at)
    if end < 0:
        return None
    found = _LENGTH.findall(data, at, end)
    return (end + len(END), int(found[0])) if len(found) == 1 else None


def candidates(data: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, successor) of each possible record that begins in data[start:stop], both relative to data."""
    at, place, after = data.find(MAGIC, start), [], []
    end, lengths = -1, []
    while 0 <= at < stop:
        if end < at:  # version lines before one end share it
            end = data.find(END, at)
            if end < 0:
                break
            lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data, at, end)]
        if lengths and lengths[-1][0] >= at and (len(lengths) == 1 or lengths[-2][0] < at):
            place.append(at)
            after.append(end + len(END) + lengths[-1][1] + len(END))
        at = data.find(MAGIC, at + 1)
    return np.array(place, np.int64), np.array(after, np.int64)


def jump(place: np.ndarray, after: np.ndarray, stop: int) -> np.ndarray:
    """Where the chain from each place first reaches stop or beyond; -1 where it breaks. place is ascending."""
    if not len(place):
        return after
    to = after.copy()
    while True:
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        inside = (to >= 0) & (to < stop)
        if not inside.any():
            return to
        to = np.where(inside, np.where(place[at] == to, to[at], -1), to)


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """uri, size, start: row per range of every archive; only names and sizes are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("size")).filter("size > 0")
    return files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))))


def entries(ranges: DataFrame, size: int) -> DataFrame:
    """uri, size, at, after, exit: row per candidate; exit is where its chain leaves its range."""
    schema = pa.schema([("uri", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("after", pa.int64()), ("exit", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri, total, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(uri) as f:
                    data = f.read_at(min(size + HEADER + len(MAGIC), total - start), start)
                    stop = min(size, total - start)
                    last = data.rfind(MAGIC, 0, stop + len(MAGIC) - 1)
                    while last >= 0 and data.find(END, last) < 0 and len(data) < total - start:
                        data += f.read_at(min(len(data), total - start - len(data)), start + len(data))
                place, after = candidates(data, 0, stop)
                out = jump(place, after, stop)
                ok = out >= 0
                n = int(ok.sum())
                yield pa.record_batch([pa.array([uri] * n, pa.string()), pa.array([total] * n, pa.int64()), pa.array(place[ok] + start), pa.array(after[ok] + start), pa.array(out[ok] + start)], schema=schema)

    return ranges.select("uri", "size", "start").mapInArrow(run, "uri string, size long, at long, after long, exit long")


def reachable(candidate: DataFrame, scratch: Scratch) -> DataFrame:
    """uri, at: the first record of the chain in each range, from the file's start on."""
    heads = candidate.filter("at = 0").select("uri", "at", "size")
    steps = candidate.select("uri", "at", "exit")
    # only places that some chain enters a range by can be jumped from
    entered = candidate.select("uri", F.col("exit").alias("at")).unionByName(heads.select("uri", "at")).distinct()
    steps = scratch.put("steps0", steps.join(entered, ["uri", "at"], "left_semi"))
    found = scratch.put("found0", heads)
    turn = 0
    while True:
        onward = found.join(steps, ["uri", "at"]).select("uri", F.col("exit").alias("at"), "size")
        more = found.unionByName(onward).distinct()
        turn += 1
        now = scratch.put(f"found{turn}", more)
        if now.count() == found.count():
            break
        found = now
        twice = steps.join(steps.select("uri", F.col("at").alias("exit"), F.col("exit").alias("far")), ["uri", "exit"], "left").select("uri", "at", F.coalesce("far", "exit").alias("exit"))
        steps = scratch.put(f"steps{turn}", twice)
    return now


def read(spark: SparkSession, path: str, size: int = RANGE, with_payload: bool = True, tasks: int = 20_000) -> DataFrame:
    """Records on the chain of every archive under path: uri, at, id, url, record_type, payload_digest (as the
    header names it), payload_bytes (of the block; of the header for a revisit), refers_to, block_digest (SHA-256 of
    the block read), and payload (binary; null for a revisit). A task reads its ranges one after another; there are `tasks`
    at most."""
    scratch = Scratch(spark)
    ranges = scratch.put("ranges", _ranges(spark, path, size))
    found = reachable(scratch.put("entries", entries(ranges, size)), scratch)
    ends = found.groupBy("uri").agg(F.max("at").alias("last"), F.max("size").alias("size")).filter("last <> size").count()
    starts = found.select("uri").distinct().count()
    if ends or starts != ranges.select("uri").distinct().count():
        raise ValueError(f"broken record chain in an archive under {path}")
    walk = keep(found.filter("at < size").select("uri", "size", "at").repartition(max(1, min(tasks, ranges.count())), "uri", "at"))
    scratch.drop()
    names = ["uri", "at", "id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "block_digest", *["payload"] * with_payload]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    field = re.compile(rb"(?m)^([\w-]+):[ \t]*(.*?)\r?$")

    def page(value: bytes | None) -> int | None:
        tail = (value or b"").strip(b"<>").rpartition(b":")[2]
        return int(tail) if re.fullmatch(rb"-?\d+", tail) else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri, total, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stop = min((first // size + 1) * size, total)
                rows: list[tuple] = []
                with _open(uri) as f:
                    base, data = first, f.read_at(min(size, total - first), first)
                    at = first
                    while at < stop:
                        head = _header(data, at - base) if data.startswith(MAGIC, at - base) else None
                        while head is None or head[0] + head[1] > len(data):
                            if base == at and len(data) == total - at:
                                raise ValueError(f"broken record in {uri} at {at}")
                            want = (2 * len(data) if base == at else HEADER) if head is None else head[0] - (at - base) + head[1]
                            base, data = at, f.read_at(min(max(want, size), total - at), at)
                            head = _header(data, 0)
                        lo, n = head
                        fields = {k.lower(): v for k, v in field.findall(data, at - base, lo)}
                        block = data[lo : lo + n]
                        kind = fields[b"warc-type"].decode()
                        rows.append((uri, at, page(fields.get(b"warc-record-id")), fields.get(b"warc-target-uri", b"").decode(), kind, fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), n if kind == "response" else int(fields.get(b"x-payload-length", 0)), page(fields.get(b"warc-refers-to")), hashlib.sha256(block).hexdigest(), *[None if kind == "revisit" else block] * with_payload))
                        at = base + lo + n + len(END)
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "uri string, at long, id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, block_digest string" + ", payload binary" * with_payload
    return walk.mapInArrow(run, schema)
