"""Substring deduplication by recompression.

A text's words are rewritten round by round: first runs of one word, then pairs of neighbours of which one falls in the left
and one in the right half of an alphabet that a hash divides anew in each round. A pair's new name is a hash of the two, so all
tasks name alike, and what becomes of a stretch of words depends on them and a known context only: equal substrings have the
same symbols inside. A symbol of the last round that occurs once in the whole corpus rules out every window that contains its
context: all names are counted by hash range, and each unit of texts gets back a bit for each of its own. The windows that are left are gathered under a symbol they contain, their anchor. Stretches of windows of one anchor
that are the same as a whole are counted first; only where an anchor has several stretches are windows counted one by one. All
counting is by partial aggregates, so a passage that every document has is never gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import SMALL_GROUP, input_bytes, mix, packed, release, saved, slices, starts_of, trim_worker, unpacked, utf8, word_arrays, workspace

#: Words in a window; pair rounds; words in the context of a symbol that is used (an anchor serves WINDOW - CONTEXT + 1 = 16 windows).
WINDOW, ROUNDS, CONTEXT = 35, 5, 20
REACH = WINDOW - CONTEXT + 1
#: Text that is worked on at a time.
PIECE_BYTES = 4 << 20
#: Odd multipliers of the polynomial hashes of windows.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)


def symbols(words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int = ROUNDS, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Names of the last round's symbols, and where the context of each begins; only those with a context of ``context`` words at most.

    ``doc``: each word's document; ``first``, ``last``: each document's first word and the end. A context that would reach beyond
    its document is not complete, and its symbol isn't used.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    k = np.diff(at, append=n)
    name, own = words[at], doc[at]
    name = np.where(k > 1, mix(name ^ mix(k.astype(np.uint64), 30), 31), name)
    lo, hi = at - 1, at + k
    for r in range(rounds):
        right = (mix(name, 40 + r) >> np.uint64(17) & np.uint64(1)).astype(bool)
        with_next = np.zeros(len(name), bool)
        with_next[:-1] = own[1:] == own[:-1]
        joined = np.zeros(len(name), bool)
        joined[:-1] = ~right[:-1] & right[1:] & with_next[:-1]
        second = np.zeros(len(name), bool)
        second[1:] = joined[:-1]
        next_hi = last[own]
        next_hi[:-1] = np.where(with_next[:-1], hi[1:], next_hi[:-1])
        before_lo = first[own] - 1
        before_lo[1:] = np.where(with_next[:-1], lo[:-1], before_lo[1:])
        hi = np.where(right, hi, next_hi)
        lo = np.where(right & ~second, before_lo, lo)
        new = name.copy()
        new[:-1] = np.where(joined[:-1], mix(mix(name[:-1], 60 + r) ^ name[1:], 61), name[:-1])
        keep = ~second
        name, own, lo, hi = new[keep], own[keep], lo[keep], hi[keep]
    good = (lo >= first[own]) & (hi < last[own]) & (hi - lo < context)
    return name[good], lo[good]


def _placed(words: np.ndarray, counts: np.ndarray):
    """Words with their documents, and each document's first word and end."""
    first = starts_of(counts)
    return words, np.repeat(np.arange(len(counts)), counts), first, first + counts


def _laid(texts: list[bytes]):
    return _placed(*word_arrays(texts))


def _buckets(docs: DataFrame) -> int:
    return 1 << max(3, (input_bytes(docs, "text") // 6 >> 20).bit_length() + 1)


UNITS = "unit bigint, bucket int, names binary, twice binary, keys array<bigint>, prints array<bigint>, texts array<string>"


def asked(docs: DataFrame, buckets: int, window: int, rounds: int) -> DataFrame:
    """Texts by units of about PIECE_BYTES, and their symbols' names by hash range.

    A row without a bucket is a unit itself: its texts with their keys and prints. The other rows are its distinct names, sorted,
    with whether each is there twice. Texts without a whole window have no part in this.
    """
    context = window - REACH + 1
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        trim_worker()
        unit = TaskContext.get().partitionId() << 40
        for batch in batches:
            for whole in slices(batch, "text", PIECE_BYTES):
                words, counts = word_arrays(utf8(whole.column("text")))
                long = counts >= window
                if not long.any():
                    continue
                part = whole.filter(pa.array(long, pa.bool_()))
                unit += 1
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("key", "print", "text")]
                yield pa.record_batch([pa.array([unit]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *lists], names=names_)
                found, counts = np.unique(symbols(*_placed(words[np.repeat(long, counts)], counts[long]), rounds, context)[0], return_counts=True)
                if not len(found):
                    continue
                where = (found >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(where, prepend=-1))
                parts = list(zip(cuts, [*cuts[1:], len(found)], strict=True))
                m = len(parts)
                yield pa.record_batch([pa.array(np.full(m, unit)), pa.array(where[cuts], pa.int32()), pa.array([packed(found[a:b]) for a, b in parts], pa.binary()), pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in parts], pa.binary()), *(pa.nulls(m, x.type) for x in lists)], names=names_)

    names_ = [c.split()[0] for c in UNITS.split(", ")]
    return docs.select("key", "print", F.col("text").cast("string").alias("text")).mapInArrow(run, UNITS)


def answered(rows: DataFrame) -> DataFrame:
    """(unit, bucket, known): for each row of names a bit for each, whether it occurs twice or more over all texts."""

    def run(group: pa.Table) -> pa.Table:
        names = [unpacked(x) for x in group.column("names").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)) for x, t in zip(names, group.column("twice").to_pylist(), strict=True)]
        found, which = np.unique(np.concatenate(names), return_inverse=True)
        known = np.bincount(which, np.concatenate(twice) + 1.0, len(found))[which] > 1
        ends = np.cumsum([len(x) for x in names])[:-1]
        return group.select(["unit", "bucket"]).append_column("known", pa.array([np.packbits(x).tobytes() for x in np.split(known, ends)], pa.binary()))

    return rows.filter("bucket IS NOT NULL").select("unit", "bucket", "names", "twice").groupBy("bucket").applyInArrow(run, "unit bigint, bucket int, known binary")


def _slide(a: np.ndarray, reach: int) -> np.ndarray:
    """The least of each element and the ``reach - 1`` after it."""
    done = 1
    out = a.copy()
    while done < reach:
        step = min(done, reach - done)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _hashed(words: np.ndarray, at: np.ndarray, window: int, multiplier: int) -> np.ndarray:
    """A polynomial hash of the ``window`` words from each place on."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = out * np.uint64(multiplier) + words[at + k]
    return mix(out, 72)


def candidates(texts: list[bytes], known: Callable[[np.ndarray], np.ndarray], window: int, rounds: int):
    """Stretches of windows that may repeat: (anchor, document, first window in it, hashes of the windows, windows in each stretch).

    ``known`` says of symbols' names which occur twice or more. A stretch's windows follow one another and have one anchor, the
    symbol of least hash in reach (the first of equal ones); a window without a symbol in reach is a stretch of its own, under a
    second hash of its words. So two windows count as equal only if two independent 64-bit values are.
    """
    words, doc, first, last = _laid(texts)
    n = len(words)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < window:
        return empty
    names, at = symbols(words, doc, first, last, rounds, window - REACH + 1)
    alone = np.zeros(n + REACH + 1, np.int64)
    alone[1 + at[~known(names)]] = 1
    alone = np.cumsum(alone)
    order = np.lexsort((at, mix(names, 71)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    best = np.full(n, len(order))
    np.minimum.at(best, at, place)
    best = _slide(best, REACH)
    ok = (np.arange(n) + window <= last[doc]) & (alone[REACH : REACH + n] == alone[:n])
    c = np.flatnonzero(ok)
    if not len(c):
        return empty
    hashes = _hashed(words, c, window, MULTIPLIERS[0])
    lonely = best[c] == len(order)
    anchor, anchor_at = np.empty(len(c), np.uint64), np.full(len(c), -1)
    chosen = order[best[c[~lonely]]]
    anchor[~lonely], anchor_at[~lonely] = names[chosen], at[chosen]
    anchor[lonely] = _hashed(words, c[lonely], window, MULTIPLIERS[1])
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1] + 1) | (anchor_at[1:] != anchor_at[:-1]) | lonely[1:] | lonely[:-1] | (doc[c[1:]] != doc[c[:-1]])
    begin = np.flatnonzero(fresh)
    return anchor[begin], doc[c[begin]], (c - first[doc[c]])[begin], hashes, np.diff(begin, append=len(c))


RECORDS = "anchor bigint, content bigint, key bigint, print bigint, start int, mask int, twice int, hashes array<bigint>"


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(key, print, start, mask): windows that start elsewhere too; bit b of the mask is the window at ``start + b``. ``docs`` has
    key, print and text."""
    buckets = _buckets(docs)
    units = saved(asked(docs, buckets, window, rounds), "units", row_group=SMALL_GROUP)
    answers = saved(answered(units), "answers")
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    schema = pa.schema([pa.field(n, {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}[t]) for n, t in (f.split() for f in RECORDS.split(", "))])

    def run(unit: pa.Table, answers: pa.Table) -> pa.Table:
        trim_worker()
        keys, prints, texts = (unit.column(c).combine_chunks().flatten() for c in ("keys", "prints", "texts"))
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("known").to_pylist(), strict=True))

        def known(names: np.ndarray) -> np.ndarray:
            found, which = np.unique(names, return_inverse=True)
            where, sizes = np.unique((found >> shift).astype(np.int64), return_counts=True)
            flags = [np.unpackbits(np.frombuffer(bits[w], np.uint8), count=n) for w, n in zip(where.tolist(), sizes.tolist(), strict=True)]
            return np.concatenate([*flags, np.zeros(0, np.uint8)]).astype(bool)[which]

        anchor, doc, start, hashes, sizes = candidates(utf8(texts), known, window, rounds)
        if not len(anchor):
            return schema.empty_table()
        key, print_ = keys.to_numpy()[doc], prints.to_numpy()[doc]
        begin = starts_of(sizes)
        inside = np.arange(len(hashes)) - np.repeat(begin, sizes)
        with np.errstate(over="ignore"):
            content = mix(anchor, 81) + np.add.reduceat(mix(hashes ^ mix(inside.astype(np.uint64), 82), 83), begin)
        _, where, which, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        # A stretch that is here twice is settled here; one copy goes on, so that others learn of it.
        twice = times[which] > 1
        full = (1 << sizes) - 1
        at = np.flatnonzero(twice)
        m = len(at)
        done = pa.table([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(key[at]), pa.array(print_[at]), pa.array(start[at], pa.int32()), pa.array(full[at], pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, schema.field("hashes").type)], schema=schema)
        where = np.sort(where)
        take = np.repeat(np.isin(np.arange(len(sizes)), where, assume_unique=True), sizes)
        body = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[where])]), pa.int32()), pa.array(hashes[take].view(np.int64)))
        return pa.concat_tables([done, pa.table([pa.array(anchor[where].view(np.int64)), pa.array(content[where].view(np.int64)), pa.array(key[where]), pa.array(print_[where]), pa.array(start[where], pa.int32()), pa.array(full[where], pa.int32()), pa.array(twice[where].astype(np.int32)), body], schema=schema)])

    left = units.filter("bucket IS NULL").select("unit", "keys", "prints", "texts").groupBy("unit")
    records = saved(left.cogroup(answers.groupBy("unit")).applyInArrow(run, RECORDS), "records", "lz4", row_group=SMALL_GROUP)
    release(units, answers)
    settled = records.filter("anchor IS NULL").select("key", "print", "start", "mask")
    open_ = records.filter("anchor IS NOT NULL")
    # Stretches that are the same as a whole become one row with its number.
    whole = saved(open_.groupBy("anchor", "content", "mask", "hashes").agg((F.count(F.lit(1)) + F.sum("twice")).alias("weight")), "stretches", "lz4", row_group=SMALL_GROUP)
    # Equal windows have one anchor, so windows are counted only under anchors that have several stretches.
    several = whole.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo <> hi").select("anchor")
    windows = saved(whole.join(several, "anchor", "left_semi").select("anchor", "content", "weight", F.posexplode("hashes").alias("at", "hash")), "windows", "lz4", row_group=SMALL_GROUP)
    again = windows.groupBy("anchor", "hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor", "hash")
    some = windows.filter("weight = 1").join(again, ["anchor", "hash"]).groupBy("anchor", "content").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("mask"))
    masks = saved(whole.filter("weight > 1").select("anchor", "content", "mask").unionByName(some), "masks", "lz4")
    left = open_.filter("twice = 0").select("anchor", "content", "key", "print", "start")
    places = saved(settled.unionByName(left.join(masks, ["anchor", "content"]).select("key", "print", "start", "mask")).distinct(), "repeated-windows")
    release(records, whole, windows, masks)
    return places


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (and the kept text).

    A word goes if a window that covers it has the same words as one that starts elsewhere. Null and empty texts have no words;
    texts shorter than a window keep all; texts of any length are one sequence of words. Repeated rows repeat each other, so rows
    that are the same in doc_id (null or not) and text get the same result; rows that share a doc_id but not a text are told
    apart. Columns other than doc_id and text are ignored, whatever their names; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"), F.xxhash64(F.lit(1), text).alias("print"))
    with workspace():
        marks = repeated_windows(keyed.select("key", "print", "text"), window, rounds)
        places = saved(marks.groupBy("key", "print").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks")), "places", keep=True)
    both = keyed.join(places, ["key", "print"], "left").select("doc_id", "text", "starts", "masks")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_gone, digests, kept_texts = [], [], [], []
                for text, starts, masks in zip(utf8(part.column("text")), part.column("starts").to_pylist(), part.column("masks").to_pylist(), strict=True):
                    words = text.split()
                    kept = words
                    if starts:
                        bits = np.array(masks)[:, None] >> np.arange(REACH) & 1
                        at = (np.array(starts)[:, None] + np.arange(REACH))[bits == 1]
                        edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
                        keep = np.cumsum(edge)[: len(words)] == 0
                        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    body = b" ".join(kept)
                    n_words.append(len(words))
                    n_gone.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        kept_texts.append(body.decode("utf-8", "replace"))
                out = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.record_batch([*out, pa.array(kept_texts, pa.string())] if with_text else out, names=fields)

    fields = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else ""))
