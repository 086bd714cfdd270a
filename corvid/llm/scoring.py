"""Language-model scores from a log-frequency Bloom filter.

N-gram counts of the training documents are quantised on a logarithmic scale; an n-gram of level q is put into the filter q
times, as (n-gram, 1) to (n-gram, q). Asking for level 1, 2, ... until one is missing gives the level back. The filter grows
with its entries, so it isn't broadcast: it is made by hash range, and the n-grams of the texts are sent there and asked. A level
stands for the mean count of the training n-grams that have it, so all unigrams together have exactly the mass of the corpus. A
word's probability mixes its bigram with its unigram, both from the filter; after a history that was never seen it is the
unigram's alone.

Beside it every text gets its exact smoothed unigram score. The counts that needs come from a bounded table of the most
frequent words, and for all other words from a join with the table of counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import bloom
from corvid.llm.common import input_bytes, mix, packed, release, saved, slices, starts_of, unpacked, utf8, word_arrays

FOLDS, HELD_OUT = 5, 1
#: Quantisation of the counts of words and of bigrams: each level begins this many times higher than the one before, and one
#: higher at least. Weight of the bigram (the best of 0.25, 0.5 and 0.75 on held-out text). Most levels that are asked for.
BASES, PAIR_WEIGHT, LEVELS = {1: 1.15, 2: 1.5}, 0.5, 200
#: Most words in the broadcast table of exact counts (16 bytes each); tokens of a unit, which are asked for together.
HEAD_WORDS, UNIT_TOKENS = 1 << 19, 1_250_000
#: Fixed keys of the start of a text and of its end.
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)


def floors(kind: int) -> np.ndarray:
    """The least count of every level, from level 1 on."""
    out = [1]
    while len(out) < LEVELS and out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BASES[kind]))))
    return np.array(out)


FLOORS = {kind: floors(kind) for kind in BASES}


def level(count: np.ndarray, kind: int) -> np.ndarray:
    """The level of each count; 0 for 0."""
    return np.searchsorted(FLOORS[kind], count, "right")


def usual(kind: int) -> np.ndarray:
    """A count for each level from 0 on where no training n-gram has it: the geometric mean of its least and greatest."""
    low = FLOORS[kind].astype(float)
    return np.concatenate([[0.0], np.sqrt(low * np.append(low[1:] - 1, low[-1])), np.full(255 - len(low), low[-1])])


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first, 11) ^ second, 12) >> np.uint64(16)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys of all texts, one end each; the keys before them; tokens in each text."""
    words, counts = word_arrays(texts, lower=True)
    sizes = counts + 1
    starts = starts_of(sizes)
    keys = np.full(int(sizes.sum()), END)
    inside = np.ones(len(keys), bool)
    inside[starts + counts] = False
    keys[inside] = words
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[starts] = START
    return keys, before, sizes


def _planes(codes: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all the next, ...: the high ones are mostly 0 and take little room compressed."""
    return codes.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").ravel()


def asked(docs: DataFrame, buckets: int) -> DataFrame:
    """What documents (doc_id, text, learn) ask of the filter, by units of about UNIT_TOKENS tokens.

    A row of kind 0 is a unit itself: its words as keys, its tokens as places among them, its texts' sizes and doc_ids. Rows of
    kind 1 and 2 are its distinct words and bigrams by hash range, sorted, with how often each occurs in texts that are learned.
    """

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        n = 0

        def flush():
            nonlocal row
            keys, before, sizes, learn = (np.concatenate([h[i] for h in held]) for i in range(4))
            ids = pa.concat_arrays([h[4] for h in held])
            held.clear()
            unit, row = row, row + len(sizes)
            words, codes = np.unique(keys, return_inverse=True)
            none = pa.nulls(1, pa.binary())
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.record_batch([pa.array([unit]), pa.array([0], pa.int32()), pa.nulls(1, pa.int32()), pa.array([packed(words)], pa.binary()), pa.array([_planes(codes)], pa.binary()), pa.array([sizes.astype("<u4").tobytes()], pa.binary()), whole], names=names)
            learned = np.repeat(learn, sizes)
            for kind in (1, 2):
                found, places = (words, codes) if kind == 1 else np.unique(_pair(before, keys), return_inverse=True)
                counts = np.bincount(places[learned], minlength=len(found))
                shift = np.uint64((64 if kind == 1 else 48) - (buckets.bit_length() - 1))
                where = (found >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(where, prepend=-1))
                parts = list(zip(cuts, [*cuts[1:], len(found)], strict=True))
                cut = [(packed(found[a:b]), np.minimum(counts[a:b], 255).astype("u1").tobytes(), counts[a:b][counts[a:b] >= 255].astype("<u4").tobytes()) for a, b in parts]
                m = len(parts)
                yield pa.record_batch([pa.array(np.full(m, unit)), pa.array([kind] * m, pa.int32()), pa.array(where[cuts], pa.int32()), *(pa.array([p[i] for p in cut], pa.binary()) for i in range(3)), pa.nulls(m, whole.type)], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                keys, before, sizes = tokens_of(utf8(part.column("text")))
                held.append((keys, before, sizes, part.column("learn").to_numpy(zero_copy_only=False).astype(bool), part.column("doc_id")))
                n += len(keys)
                if n >= UNIT_TOKENS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    names = ["unit", "kind", "bucket", "keys", "counts", "large", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"unit bigint, kind int, bucket int, keys binary, counts binary, large binary, ids array<{kind}>")


def answered(rows: DataFrame) -> DataFrame:
    """(unit, kind, bucket, levels): for each row of kind 1 and 2 its keys' levels, a byte each. Also (key, count) of the learned
    words, and rows of kind -1 and -2 with a level as bucket, how many n-grams have it (key) and their counts' sum.

    A hash range's counts are added up, put into a filter of their own and asked there, so that the filter as a whole may be of
    any size and has the same bits for an entry at each.
    """

    def run(group: pa.Table) -> pa.Table:
        kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
        keys, counts = [], []
        for k, c, large in zip(*(group.column(x).to_pylist() for x in ("keys", "counts", "large")), strict=True):
            keys.append(unpacked(k))
            n = np.frombuffer(c, "u1").astype(np.int64)
            n[n == 255] = np.frombuffer(large, "<u4")
            counts.append(n)
        ends = np.cumsum([len(k) for k in keys])
        found, places = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(places, np.concatenate(counts), len(found)).astype(np.int64)
        learned = total > 0
        salted = mix(found, 20 + kind)
        own = level(total, kind)
        levels = bloom.of(salted[learned], own[learned]).levels(salted).astype("u1")[places]
        many = np.bincount(own[learned])
        sums = np.bincount(own[learned], total[learned])
        used = np.flatnonzero(many)

        def part(n, **columns) -> pa.Table:
            return pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in fields], schema=pa.schema(fields))

        out = [
            part(len(keys), unit=group.column("unit").combine_chunks(), kind=pa.array([kind] * len(keys), pa.int32()), bucket=pa.array([bucket] * len(keys), pa.int32()), levels=pa.array([x.tobytes() for x in np.split(levels, ends[:-1])], pa.binary())),
            part(len(used), kind=pa.array([-kind] * len(used), pa.int32()), bucket=pa.array(used, pa.int32()), key=pa.array(many[used], pa.int64()), count=pa.array(sums[used].astype(np.int64))),
        ]
        if kind == 1:
            out.append(part(int(learned.sum()), key=pa.array(found[learned].astype("<u8").view(np.int64)), count=pa.array(total[learned])))
        return pa.concat_tables(out)

    fields = [pa.field("unit", pa.int64()), pa.field("kind", pa.int32()), pa.field("bucket", pa.int32()), pa.field("levels", pa.binary()), pa.field("key", pa.int64()), pa.field("count", pa.int64())]
    return rows.filter("kind > 0").select("unit", "kind", "bucket", "keys", "counts", "large").groupBy("kind", "bucket").applyInArrow(run, "unit bigint, kind int, bucket int, levels binary, key bigint, count bigint")


@dataclass(frozen=True)
class Model:
    """Of the training documents: tokens, distinct tokens, texts, and the count that each level of words and of bigrams stands for."""

    total: int
    distinct: int
    texts: int
    words: np.ndarray
    pairs: np.ndarray

    def log10(self, words: np.ndarray, codes: np.ndarray, before: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it; levels are those of distinct words and of each bigram.

        Over the vocabulary and one word that is not in it, the unigram part sums to 1, and so does the bigram part of a history
        whose counts the levels give exactly; for others it does up to the width of the levels.
        """
        single = self.words[word_levels]
        single[words == END] = self.texts
        unigram = ((single + 0.5) / (self.total + 0.5 * (self.distinct + 1)))[codes]
        history = np.empty(len(codes))
        history[1:] = single[codes][:-1]
        history[before == START] = self.texts
        pair = self.pairs[pair_levels]
        weight = np.where(history > 0, PAIR_WEIGHT, 0.0)
        return np.log10(weight * pair / np.maximum(np.maximum(history, pair), 1) + (1 - weight) * unigram)


def scored(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Null and empty texts have the end token alone; texts of any length are scored whole, and equal texts score the same. Repeated
    rows are scored (and learned) as often as they occur; a null doc_id is learned from. Without any training text, counts are 0
    and all tokens share one probability. Columns other than doc_id and text are ignored, whatever their names; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(False))
    buckets = 1 << max(2, (input_bytes(docs, "text") // 6 >> 20).bit_length())
    rows = saved(asked(docs.select("doc_id", F.col("text").cast("string"), (~held).alias("learn")), buckets), "asked")
    answers = saved(answered(rows), "answers")
    words = answers.filter("key IS NOT NULL AND kind IS NULL").select("key", "count")
    values = {kind: usual(kind) for kind in BASES}
    for r in answers.filter("kind < 0").groupBy("kind", "bucket").agg(F.sum("key").alias("many"), F.sum("count").alias("sum")).collect():
        values[-r["kind"]][r["bucket"]] = r["sum"] / r["many"]
    total, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    end = words.filter(F.col("key") == int(END.astype(np.int64))).first()
    model = Model(total, distinct, end["count"] if end else 0, values[1], values[2])
    # The least power of two from which on the words' number is within the bound.
    powers = words.groupBy(F.floor(F.log2("count")).alias("p")).count().collect()
    least, room = 0, head_words
    for p, n in sorted(((r["p"], r["count"]) for r in powers), reverse=True):
        room -= n
        if room < 0:
            least = p + 1
            break
    head = words.filter(F.col("count") >= 1 << least).toArrow().sort_by("key")
    table = spark.sparkContext.broadcast((head.column("key").to_numpy(), head.column("count").to_numpy()))
    del head
    space = total + 0.5 * (distinct + 1)

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        known_keys, known_counts = table.value
        keys, sizes = unpacked(units.column("keys")[0].as_py()), np.frombuffer(units.column("large")[0].as_py(), "<u4")
        codes = _unplanes(units.column("counts")[0].as_py())
        ids, row = units.column("ids").combine_chunks().flatten(), units.column("unit")[0].as_py()
        sizes, n = sizes.astype(np.int64), len(sizes)
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        levels = [np.frombuffer(b"".join(answers.filter(pa.compute.equal(answers.column("kind"), k)).column("levels").to_pylist()), "u1").astype(np.int64) for k in (1, 2)]
        tokens = keys[codes]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[starts_of(sizes)] = START
        places = np.unique(_pair(before, tokens), return_inverse=True)[1]
        owner = np.repeat(np.arange(n), sizes)
        signed = keys.view(np.int64)
        at = np.searchsorted(known_keys, signed)
        at[at == len(known_keys)] = 0
        hit = known_keys[at] == signed if len(known_keys) else np.zeros(len(signed), bool)
        value = np.where(hit, np.log10((known_counts[at] + 0.5) / space) if len(known_keys) else 0.0, 0.0)
        hits = hit[codes]
        base = np.bincount(owner, value[codes], n)
        known = np.bincount(owner, hits, n).astype(np.int64)
        score = np.bincount(owner, model.log10(keys, codes, before, levels[0], levels[1][places]), n)
        first = pa.table([pa.array(np.arange(row, row + n)), ids, pa.nulls(n, pa.int64()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=names)
        # Every other word with its number in each text.
        rest = pd.DataFrame({"row": owner[~hits] + row, "word": tokens[~hits].view(np.int64)}).value_counts(sort=False).reset_index()
        m = len(rest)
        second = pa.table([pa.array(rest["row"].to_numpy(np.int64)), pa.nulls(m, ids.type), pa.array(rest["word"].to_numpy(np.int64)), pa.array(rest["count"].to_numpy(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)
        return pa.concat_tables([first, second])

    names = ["row", "doc_id", "word", "n", "known", "base", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = rows.filter("kind = 0").select("unit", "keys", "counts", "large", "ids").groupBy("unit")
    levels = answers.filter("unit IS NOT NULL").select("unit", "kind", "bucket", "levels").groupBy("unit")
    both = saved(units.cogroup(levels).applyInArrow(run, f"row bigint, doc_id {kind}, word bigint, n bigint, known bigint, base double, score double"), "scores")
    release(rows)
    table.destroy()
    tail = words.filter(F.col("count") < 1 << least).withColumnRenamed("key", "word")
    rest = both.filter("word IS NOT NULL").select("row", "word", "n").join(tail, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.log10((F.col("count") + 0.5) / F.lit(float(space)))).alias("more"), F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("also"))
    out = both.filter("word IS NULL").join(rest, "row", "left")
    return out.select("doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
