"""Deterministic sharded WARC archives: write, commit, read back.

Records are dealt to shards by ranges of page_id whose bounds follow from the ids
and payload sizes alone, sorted, and written as one gzip member each. A file is
rolled when its compressed size reaches ``roll_bytes``. Every file is written
under a temporary name and renamed when whole; a shard's manifest is renamed
into place after its files, and the archive's manifest, which holds the totals of
all shards' manifests, at last. Names,
headers, dates and digests depend on the rows only, so a task that runs again
writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Shards of an archive, at most; larger archives get larger shards.
MOST_SHARDS = 1 << 20
#: Parts of the ids' range, and of each part that is too large for a shard.
BINS = 256
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
EMPTY = {"files": 0, "shards": 0, "records": 0, "bytes": 0, "folded": 0}
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}:{payload_digest}')}>"


def _open(uri: str):
    """(file system, path) of a location that Python workers can write to."""
    from pyarrow import fs

    if "://" not in uri:
        uri = re.sub(r"^file:", "", uri)
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename."""
    system, path = _open(uri)
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.tmp-{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, path)


def record(page_id: int, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, payload_digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(body)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to) per distinct page and payload.

    Of equal payloads of at least ``least`` bytes the largest page_id is the
    response (refers_to null). Payloads themselves aren't shuffled, and digests
    are counted before the shuffle, so a payload that most pages share is no
    hot spot.
    """

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "payload_digest": [digest(x or b"") for x in pdf["html"]], "n": [len(x or b"") for x in pdf["html"]]})

    rows = pages.select("page_id", F.col("html").cast("binary").alias("html")).mapInPandas(told, "page_id long, payload_digest string, n long")
    rows = materialize(rows.distinct(), "digests")
    last = rows.filter(F.col("n") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    # Stored first, so that Spark can split the rows of a payload that most pages share.
    last = materialize(last, "copied")
    refers = F.when(F.col("page_id") != F.col("last"), F.col("last"))
    return rows.join(last, "payload_digest", "left").select("page_id", "payload_digest", "n", refers.alias("refers_to"))


def shard_starts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First page_id of each shard, for ``sizes`` (page_id, n).

    The range of ids is cut into parts; parts of more than a shard's bytes are cut
    again, so neither dense nor far ids make a shard large (one id may). A few sums
    for each shard come to the driver.
    """
    spark = sizes.sparkSession
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    bits = max(0, (high - low + 1).bit_length() - BINS.bit_length() + 1)
    leaves: list[tuple[int, int]] = []
    rows = sizes.withColumn("part", F.lit(None).cast("long"))
    while True:
        part = F.shiftleft(F.shiftright("page_id", bits), bits)
        rows = rows.select("page_id", "n", part.alias("part"))
        sums = [(r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()]
        heavy = [(p,) for p, n in sums if n > shard_bytes and bits]
        leaves += [x for x in sums if not (x[1] > shard_bytes and bits)]
        if not heavy:
            break
        rows = rows.join(F.broadcast(spark.createDataFrame(heavy, "part long")), "part")  # fewer parts than shards
        bits = max(0, bits - BINS.bit_length() + 1)
    starts, held = [], shard_bytes
    for start, n in sorted(leaves):
        if held + n > shard_bytes:
            starts.append(start)
            held = 0
        held += n
    return np.array(starts, dtype=np.int64)


def write(pages: DataFrame, path: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) under ``path``; returns the manifests' rows.

    html null counts as empty; a row with null page_id is left out, as no record
    can name it. Exact repeats of a row make one record each; all but the first
    revisit it.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html").filter(F.col("page_id").isNotNull())
    role = materialize(roles(pages, least), "roles")
    total = role.agg(F.sum("n")).first()[0]
    if total is None:
        _open(path)[0].create_dir(_open(path)[1], recursive=True)
        _put(f"{path}/manifest.json", json.dumps(EMPTY).encode())
        return spark.createDataFrame([], MANIFEST)
    starts = shard_starts(role.select("page_id", "n"), max(shard_bytes, -(-total // MOST_SHARDS)))
    known = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known.value, ids.to_numpy(np.int64), "right") - 1)

    both = role.select("page_id", F.lit(0).alias("part"), "payload_digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    both = both.unionByName(pages.select("page_id", F.lit(1).alias("part"), "url", "html"), allowMissingColumns=True)
    dealt = both.withColumn("shard", shard_of("page_id"))
    dealt = dealt.repartitionByRange(len(starts), "shard").sortWithinPartitions("shard", "page_id", "part", "url", "html")
    system, folder = _open(path)
    system.create_dir(folder, recursive=True)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, page, told, seen = None, None, {}, set()
        out, size, records, files, done = [], 0, 0, [], []

        def roll() -> None:
            nonlocal out, size, records
            if records:
                data = b"".join(out)
                name = f"part-{shard:06d}-{len(files):04d}.warc.gz"
                _put(f"{path}/{name}", data)
                files.append({"shard": shard, "file": name, "records": records, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            out, size, records = [], 0, 0

        def close() -> None:
            nonlocal files
            if shard is not None:
                roll()
                _put(f"{path}/part-{shard:06d}.json", json.dumps({"files": files}).encode())
                done.extend(files)
            files = []

        for pdf in batches:
            for k, p, part, d, refers, url, html in pdf[["shard", "page_id", "part", "payload_digest", "refers_to", "url", "html"]].itertuples(index=False):
                if k != shard:
                    close()
                    shard = k
                if p != page:
                    page, told, seen = p, {}, set()
                if part == 0:
                    told[d] = None if pd.isna(refers) else int(refers)
                    continue
                payload = html.encode() if isinstance(html, str) else b""
                d = digest(payload)
                to = page if told[d] is None and d in seen and len(payload) >= least else told[d]
                seen.add(d)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(p, url if isinstance(url, str) else None, payload, d, to)) + packer.flush()
                out.append(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    roll()
        close()
        if done:
            yield pd.DataFrame(done)

    files = materialize(dealt.mapInPandas(store, MANIFEST), "manifest")
    _put(f"{path}/manifest.json", json.dumps(_totals(files)).encode())
    return files


def _totals(files: DataFrame) -> dict:
    """What an archive's manifest says; the files' sums are folded, so that none is listed on the driver."""
    folded = F.expr("bit_xor(xxhash64(file, sha256, records))")
    row = files.agg(F.count("*").alias("files"), F.countDistinct("shard").alias("shards"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), folded.alias("folded")).first()
    return row.asDict() if row["files"] else EMPTY


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members; the file is walked by offset."""
    at = 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = data[at : at + (1 << 14)]
            if not piece:
                raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive, checked against the manifest and their digests.

    A revisit's payload_bytes and payload_digest are those of the payload it
    refers to; its payload is null.
    """
    system, folder = _open(path)
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        told = json.loads(f.read())
    if not told["files"]:
        return spark.createDataFrame([], ROWS)
    listed = spark.read.schema(f"files array<struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>>").option("pathGlobFilter", "part-*.json").json(path)
    listed = listed.select(F.explode("files").alias("f")).select("f.*")
    if _totals(listed) != told:
        raise ValueError("the shards' manifests differ from the archive's")

    def sums(shard: str) -> dict[str, str]:
        system, folder = _open(path)
        with system.open_input_stream(f"{folder}/{shard}.json") as f:
            return {x["file"]: x["sha256"] for x in json.loads(f.read())["files"]}

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                if hashlib.sha256(content).hexdigest() != sums(name.rpartition("-")[0]).get(name):
                    raise ValueError(f"{name} differs from its manifest")
                rows = []
                for headers, block in parse(bytes(content)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f"sha1:{digest(block)}" != headers["WARC-Block-Digest"] or kind == "response" and digest(payload) != said:
                        raise ValueError(f"a digest differs in {name}")
                    refers = headers.get("X-Refers-To-Page")
                    rows.append((int(headers["X-Page-Id"]), int(headers["X-Payload-Length"]), said, kind, None if refers is None else int(refers), headers.get("WARC-Target-URI"), payload.decode() if kind == "response" else None))
                    if len(rows) >= 256:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        out["refers_to"] = out["refers_to"].astype("Int64")
        return out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files.select("file").count() != told["files"]:
        raise ValueError("files are missing")
    return files.mapInPandas(unpack, ROWS)
