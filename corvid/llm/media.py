"""ISO base media containers in a binary column: write one, walk its nested boxes, decode its sample tables.

``probe`` never touches the payload: it reads the boxes around it and gives the codec, the duration and where each keyframe's
bytes lie. ``read_samples`` follows the same tables to give the payload back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import saved, slices, utf8

#: Bytes in a sample (an access unit of 8-bit units), samples in a chunk, samples from one keyframe to the next, units a second.
UNIT, CHUNK_SAMPLES, KEY_EVERY, RATE = 64, 64, 16, 8000
#: Boxes within boxes that are followed; a file that nests deeper is malformed.
DEEPEST = 64
#: Boxes that hold other boxes.
PARENTS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"])
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, unit: int = UNIT, chunk_samples: int = CHUNK_SAMPLES, key_every: int = KEY_EVERY, rate: int = RATE) -> bytes:
    """A file whose one track holds the payload, a multiple of ``unit`` bytes, as unsigned 8-bit units (codec 'raw ')."""
    n = len(payload) // unit
    ticks = n * unit
    first = -(-n // chunk_samples)
    rest = n - (first - 1) * chunk_samples
    runs = [(1, chunk_samples, 1)] * (first > 1) + [(first, rest, 1)]
    if len(runs) == 2 and rest == chunk_samples:
        runs.pop()
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    keys = range(1, n + 1, key_every)

    def moov(offsets: list[int], wide: bool) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, ticks, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0"), minf)
        trak = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), IDENTITY, bytes(8), version=1, flags=3), mdia)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQIH", 0, 0, rate, ticks, 0x10000, 0x100), bytes(10), IDENTITY, bytes(24), struct.pack(">I", 2), version=1), trak)

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    wide = len(payload) > 0xF0000000
    base = len(head) + len(moov([0] * first, wide)) + (16 if wide else 8)
    return head + moov([base + i * chunk_samples * unit for i in range(first)], wide) + box(b"mdat", payload)


class Malformed(ValueError):
    pass


def walk(data, start: int = 0, end: int | None = None):
    """(path, body start, body end) of every box, parents before children. A size of 0 runs to the end, 1 has 64 bits.

    The boxes that are still open are kept in a list of at most DEEPEST, so no nesting can exhaust the interpreter's stack.
    """
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(start, len(data) if end is None else end, ())]
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if kind == b"uuid":
            body += 16
        if stop < body or stop > end:
            raise Malformed(f"box {kind!r} does not fit")
        yield (*path, kind), body, stop
        open_.append((stop, end, path))
        if kind in PARENTS:
            if len(path) + 1 >= DEEPEST:
                raise Malformed("boxes are nested too deep")
            open_.append((body, stop, (*path, kind)))


def _table(data, at: tuple[int, int], form: str, skip: int = 4) -> list[tuple]:
    start, end = at
    (n,) = struct.unpack_from(">I", data, start + skip)
    step = struct.calcsize(">" + form)
    if start + skip + 4 + n * step > end:
        raise Malformed("a sample table is cut off")
    return list(struct.iter_unpack(">" + form, data[start + skip + 4 : start + skip + 4 + n * step]))


def tracks(data) -> list[dict]:
    """Each track's codec, timescale, duration in ticks, and its samples' byte runs and keyframes, from the tables alone."""
    found: list[dict] = []
    for path, start, end in walk(data):
        if path == (b"moof", b"traf"):
            raise Malformed("samples in movie fragments are not read")
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak") and found:
            found[-1].setdefault(path[-1], (start, end))
    out = []
    for boxes in found:
        if not {b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz"} <= boxes.keys() or not {b"stco", b"co64"} & boxes.keys():
            raise Malformed("a track has no sample tables")
        at = boxes[b"mdhd"][0]
        rate, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        (codec,) = struct.unpack_from(">4s", data, boxes[b"stsd"][0] + 12)
        at, end = boxes[b"stsz"]
        each, n = struct.unpack_from(">II", data, at + 4)
        if not each and at + 12 + 4 * n > end:
            raise Malformed("a sample table is cut off")
        sizes = None if each else struct.unpack_from(f">{n}I", data, at + 12)
        chunks = [x for (x,) in (_table(data, boxes[b"stco"], "I") if b"stco" in boxes else _table(data, boxes[b"co64"], "Q"))]
        per = _table(data, boxes[b"stsc"], "III")
        keys = [k for (k,) in _table(data, boxes[b"stss"], "I")] if b"stss" in boxes else None
        places: list[tuple[int, int]] = []  # offset, first sample
        runs: list[tuple[int, int]] = []
        sample = 0
        for i, (first, count, _) in enumerate(per):
            last = per[i + 1][0] if i + 1 < len(per) else len(chunks) + 1
            for chunk in range(first, last):
                count_here = min(count, n - sample)
                if chunk > len(chunks) or count_here <= 0:
                    break
                size = each * count_here if each else sum(sizes[sample : sample + count_here])
                places.append((chunks[chunk - 1], sample))
                runs.append((chunks[chunk - 1], size))
                sample += count_here
        if sample != n or any(o + s > len(data) for o, s in runs):
            raise Malformed("the tables point outside the file")
        wanted = range(1, n + 1) if keys is None else keys
        ranges, p = [], 0
        for k in wanted:
            if not 1 <= k <= n:
                raise Malformed("a keyframe has no sample")
            while p + 1 < len(places) and places[p + 1][1] < k:
                p += 1
            offset, first = places[p]
            offset += each * (k - 1 - first) if each else sum(sizes[first : k - 1])
            ranges.append((offset, each or sizes[k - 1]))
        out.append({"codec": codec.decode("latin-1"), "handler": bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1"), "timescale": rate, "ticks": ticks, "n_samples": n, "runs": runs, "keyframes": ranges})
    return out


def read_samples(data, track: dict) -> bytes:
    return b"".join(bytes(data[o : o + s]) for o, s in track["runs"])


TRACK = "codec string, handler string, duration_s double, n_samples bigint, keyframes array<struct<offset:bigint,length:bigint>>"
PROBED = f"{TRACK}, tracks array<struct<{TRACK.replace(' bigint', ':bigint').replace(' string', ':string').replace(' double', ':double').replace(' array', ':array').replace(', ', ',')}>>, error string"


def probe(media: Column | str) -> Column:
    """A struct of codec, duration, samples and keyframe byte ranges of the first track, and the same of all tracks in order.

    Null gives nulls. A broken file, one without a track, one nested too deep and one whose samples are in movie fragments give
    their error, and the job goes on.
    """
    return F.pandas_udf(_probe, PROBED)(media)


def _probe(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        if data is None:
            rows.append((None,) * 7)
            continue
        try:
            found = [(t["codec"], t["handler"], t["ticks"] / t["timescale"] if t["timescale"] else None, t["n_samples"], [{"offset": o, "length": s} for o, s in t["keyframes"]]) for t in tracks(data)]
            if not found:
                raise Malformed("no track")
            names = ("codec", "handler", "duration_s", "n_samples", "keyframes")
            rows.append((*found[0], [dict(zip(names, t, strict=True)) for t in found], None))
        except (Malformed, struct.error, KeyError, IndexError) as e:
            rows.append((None,) * 6 + (f"{type(e).__name__}: {e}",))
    return pd.DataFrame(rows, columns=["codec", "handler", "duration_s", "n_samples", "keyframes", "tracks", "error"])


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit or (0 if text else unit))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, in a container of its own, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return saved(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary"), "media")


DIGEST = "doc_id {}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, n_samples bigint, n_keyframes bigint"


def digests(media: DataFrame) -> DataFrame:
    """One row per container: what its tables say, and digests of the payload read back through them.

    Null and empty texts have one unit of zero bytes; texts of any length are one container; repeated rows give repeated results;
    an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
    ``feature`` is 'codec/handler:seconds:samples:keyframes:crc32 of the keyframes' offsets and lengths'.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for doc, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    t = tracks(data)[0]
                    payload = read_samples(data, t)
                    seconds = t["ticks"] / t["timescale"]
                    where = zlib.crc32(b"".join(struct.pack(">QQ", *k) for k in t["keyframes"]))
                    feature = f"{t['codec'].strip()}/{t['handler']}:{seconds:.3f}:{t['n_samples']}:{len(t['keyframes'])}:{where:08x}"
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, t["codec"], seconds, t["n_samples"], len(t["keyframes"])))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=schema, preserve_index=False)

    kind = media.schema["doc_id"].dataType.simpleString()
    text = DIGEST.format(kind)
    names = [c.split()[0] for c in text.split(", ")]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in text.split(", ")])
    return media.mapInArrow(run, text)
