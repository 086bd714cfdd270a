"""Token ids of public tokenizers, with a bounded cache of words."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvid.llm.common import lean_worker, mix, worker_caches

#: Distinct words whose ids one Python worker remembers.
CACHED_WORDS = 600_000
#: Bytes of a word that is remembered, at most.
LONG = 64
#: Punctuation after a word's letters that is encoded by itself.
TAIL = b".,;:!?*#$%&|"
IN_TAIL = np.isin(np.arange(256), list(TAIL))
PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: Words of letters that lower case takes to one letter each, and that have one form only.
LATIN = "^[a-zß-öø-ÿÀ-ÖØ-Þ]+$"
#: Masks of the first 0 to 8 bytes.
BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known:
    """Token ids of words, all in arrays: a fraction of the room of a dictionary of objects, and looked up many at a time. A word is
    found by a 64-bit hash, then compared byte by byte; words are of LONG bytes at most."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.calls, self.size = dtype, 0, 0
        self._fill(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint8), np.zeros(1, np.int32), np.zeros(0, dtype))

    def _fill(self, hashes, used, text_at, text, ids_at, ids) -> None:
        self.hashes, self.used, self.text_at, self.text, self.ids_at, self.ids = hashes, used, text_at, text, ids_at, ids
        self.size = len(hashes)
        self.table = np.full(max(1 << 12, 1 << (2 * self.size).bit_length()), -1, np.int32)
        self._place(np.arange(self.size))

    def _place(self, rows: np.ndarray) -> None:
        """Enter rows into the table: each goes to the first free place from that of its hash on."""
        last = np.uint64(len(self.table) - 1)
        at = self.hashes[rows] & last
        while len(rows):
            free = self.table[at] < 0
            self.table[at[free]] = rows[free]
            out = self.table[at] != rows
            rows, at = rows[out], (at[out] + np.uint64(1)) & last

    @staticmethod
    def _blocks(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Eight bytes of each word at a time, zeros after its end: which words, and their numbers. ``text`` goes on for 8 bytes."""
        eights = np.ndarray((max(len(text) - 7, 0),), "<u8", text, strides=(1,))
        which = np.arange(len(starts))
        while len(which):
            yield which, eights[starts] & BYTES[np.minimum(sizes, 8)]
            more = sizes > 8
            which, starts, sizes = which[more], starts[more] + 8, sizes[more] - 8

    def find(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's hash, and its row or -1."""
        self.calls += 1
        hashes = mix(sizes.astype(np.uint64))
        for which, eight in self._blocks(text, starts, sizes):
            hashes[which] = mix(hashes[which] ^ eight)
        rows = np.full(len(starts), -1)
        which, last = np.arange(len(starts)), np.uint64(len(self.table) - 1)
        at = hashes & last
        while len(which):
            row = self.table[at]
            held = row >= 0
            which, row, at = which[held], row[held], at[held]
            same = self.hashes[row] == hashes[which]
            rows[which[same]] = row[same]
            which, at = which[~same], (at[~same] + np.uint64(1)) & last
        own = self.text_at[rows].astype(np.int64)
        rows[self.text_at[rows + 1] - own != sizes] = -1
        hit = np.flatnonzero(rows >= 0)
        for (which, ours), (_, theirs) in zip(self._blocks(self.text, own[hit], sizes[hit]), self._blocks(text, starts[hit], sizes[hit]), strict=True):
            rows[hit[which[ours != theirs]]] = -1
        self.used[rows[rows >= 0]] = self.calls
        return hashes, rows

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        """Add words that were not found, with the bytes of their ids; their rows follow the others."""

        def grown(array: np.ndarray, size: int, more: np.ndarray, spare: int = 0) -> np.ndarray:
            if size + len(more) + spare > len(array):
                array = np.concatenate([array[:size], np.zeros((size >> 1) + len(more) + spare, array.dtype)])
            array[size : size + len(more)] = more
            return array

        if not words:
            return
        size, text, new = self.size, np.frombuffer(b"".join(words), np.uint8), np.frombuffer(b"".join(ids), self.dtype)
        text_to, ids_to = self.text_at[size], self.ids_at[size]
        self.hashes, self.used = grown(self.hashes, size, hashes), grown(self.used, size, np.full(len(words), self.calls, np.int32))
        self.text, self.ids = grown(self.text, text_to, text, 8), grown(self.ids, ids_to, new)
        self.text_at = grown(self.text_at, size + 1, text_to + np.cumsum(np.fromiter(map(len, words), np.int32, len(words))))
        self.ids_at = grown(self.ids_at, size + 1, ids_to + np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize))
        self.size += len(words)
        if 2 * self.size > len(self.table):
            self.table, size = np.full(1 << (2 * self.size).bit_length(), -1, np.int32), 0
        self._place(np.arange(size, self.size))

    def keep(self, most: int) -> None:
        """Forget all but the words that were asked for last, ``most`` at most."""
        used = self.used[: self.size]
        kept = used > np.partition(used, self.size - most - 1)[self.size - most - 1] if most < self.size else np.ones(self.size, bool)

        def those(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wide = np.int32(data.dtype.itemsize)
            array = pa.BinaryArray.from_buffers(pa.binary(), self.size, [None, pa.py_buffer(ends[: self.size + 1] * wide), pa.py_buffer(data)]).filter(pa.array(kept))
            _, ends, data_ = array.buffers()
            at = np.frombuffer(ends, np.int32)[: len(array) + 1] // wide
            return at, np.frombuffer(data_, data.dtype)[: at[-1]].copy() if at[-1] else np.zeros(0, data.dtype)

        (text_at, text), (ids_at, ids) = those(self.text_at, self.text), those(self.ids_at, self.ids)
        self._fill(self.hashes[: self.size][kept], used[kept], text_at, np.concatenate([text, np.zeros(8, np.uint8)]), ids_at, ids)


class WordTokenizer:
    """Ids of whole texts, looked up word by word.

    It needs a tokenizer that lower-cases, drops white space, never lets a token cross it and marks word ends, as
    ``word_bpe_49k.json`` does: then a text's ids are its words' ids one after another, and each distinct word is encoded once.
    Punctuation after a word's last letter or number has ids of its own, so it is looked up apart; many new words of letters are
    encoded at once, and the ends of words in the result tell them apart.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.closing: dict[str, bool] = {}
        self.cached = cached
        self.known = Known(self.dtype)

    def _closes(self, char: str) -> bool:
        """Whether the tokenizer cuts punctuation off this character (not where lower case ends it with a mark)."""
        if char not in self.closing:
            self.closing[char] = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(char + "."))[-1][0] == "."
        return self.closing[char]

    def _pieces(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words, with punctuation after a letter or number cut off their ends, and the numbers of those cut."""
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        if bounds[-1] == bounds[0]:
            return words, np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        cut = np.flatnonzero(IN_TAIL[raw[bounds[1:] - 1]])
        cores = pc.ascii_rtrim(words.take(pa.array(cut)), TAIL.decode())
        stops = bounds[cut] + pc.binary_length(cores).to_numpy()
        last = raw[stops - 1]
        closed = PLAIN[last] & (stops > bounds[cut])
        if len(wide := np.flatnonzero(last > 127)):
            chars = pc.utf8_slice_codeunits(cores.take(pa.array(wide)), -1).dictionary_encode()
            closed[wide] = np.array([c != "" and self._closes(c) for c in chars.dictionary.to_pylist()], bool)[chars.indices.to_numpy()]
        cut, stops = cut[closed], stops[closed]
        bounds = np.insert(bounds, cut + 1, stops)
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), data), cut

    def _alone(self, words: list[bytes], to: dict[bytes, bytes]) -> None:
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                to[word] = np.array(got.ids, self.dtype).tobytes()

    def _together(self, words: list[bytes], to: dict[bytes, bytes], bare: bool = False) -> list[bytes]:
        """Encode words of letters only, a few thousand at once: as one text or, ``bare``, as words that are cut already. Gives back
        those that can't be told apart."""
        left = []
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            text = b" ".join(part).decode()
            (got,) = self.tokenizer.encode_batch_fast([text.lower().split(" ") if bare else text], is_pretokenized=bare, add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                left += part
                continue
            raw, wide = ids.tobytes(), self.dtype.itemsize
            bounds = (ends * wide).tolist()
            to.update(zip(part, (raw[a:b] for a, b in zip([0, *bounds], bounds, strict=False)), strict=True))
        return left

    def _bare(self, words: list[bytes], to: dict[bytes, bytes], cutter) -> list[bytes]:
        """Encode words without the tokenizer's normalizer, and with ``cutter`` for what cuts texts."""
        whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, cutter
        try:
            return self._together(words, to, bare=True)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = whole

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of words. Those of a-z need no normalizer and nothing that cuts texts, those of Latin-1 letters lower case and the
        letters that stand for bytes; other letters and all else take the whole way."""
        to: dict[bytes, bytes] = {}
        small = [w for w in words if w.isalpha() and w.islower()]
        rest = pa.array([w for w in words if not (w.isalpha() and w.islower())], pa.binary())
        plain = pa.StringArray.from_buffers(len(rest), *rest.buffers()[1:])
        latin = pc.match_substring_regex(plain, LATIN)
        letters = pc.and_not(pc.utf8_is_alpha(plain), latin)

        def those(mask: pa.Array) -> list[bytes]:
            return rest.filter(mask).to_numpy(zero_copy_only=False).tolist()

        left = [*self._bare(small, to, None), *self._bare(those(latin), to, self.bytes), *self._together(those(letters), to)]
        self._alone([*left, *those(pc.invert(pc.or_(latin, letters)))], to)
        return list(map(to.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids, as the bytes of little-endian integers of ``dtype``.

        The texts' pieces are numbered by Arrow; only distinct ones are looked up, and their ids are laid out by number.
        """
        raw = pa.array(texts, pa.binary())
        _, offsets, data = raw.buffers()
        plain = pa.StringArray.from_buffers(len(raw), offsets, data if data is not None else pa.py_buffer(b""))
        # Lower case comes first so that fewer words are distinct; not where a special token's name might come of it.
        special = pc.match_substring(plain, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, plain, pc.ascii_lower(plain)))
        parts, cut = self._pieces(lists.flatten())
        numbered = parts.dictionary_encode()
        first, sizes, flat = self._looked_up(numbered.dictionary)
        which = numbered.indices.to_numpy()
        times = sizes[which]
        ends = np.concatenate([[0], np.cumsum(times)])
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], times)] if len(flat) else flat
        words = lists.offsets.to_numpy()
        cuts = ends[words + np.searchsorted(cut, words)].tolist()
        if self.known.size > self.cached:
            self.shrink()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _looked_up(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids are in the array that comes last, and how many. Words of over LONG bytes are encoded each time."""
        _, offsets, data = distinct.buffers()
        bounds = np.frombuffer(offsets, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64) if len(distinct) else np.zeros(1, np.int64)
        starts, lengths = bounds[:-1], np.diff(bounds)
        text = np.concatenate([np.frombuffer(data, np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
        known, short = self.known, np.flatnonzero((lengths > 0) & (lengths <= LONG))
        hashes, rows = known.find(text, starts[short], lengths[short])
        new, long = short[rows < 0], np.flatnonzero(lengths > LONG)
        words = distinct.take(pa.array(np.concatenate([new, long]))).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        fresh = self._encoded(words)
        rows[rows < 0] = known.size + np.arange(len(new))
        known.add(hashes[rows >= known.size], words[: len(new)], fresh[: len(new)])
        first, sizes, flat = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), known.ids
        first[short] = known.ids_at[rows]
        sizes[short] = known.ids_at[rows + 1] - known.ids_at[rows]
        if len(long):
            sizes[long] = [len(x) // self.dtype.itemsize for x in fresh[len(new) :]]
            first[long] = len(flat) + np.cumsum(sizes[long]) - sizes[long]
            flat = np.concatenate([flat, np.frombuffer(b"".join(fresh[len(new) :]), self.dtype)])
        return first, sizes, flat

    def shrink(self) -> None:
        """Forget all but the words that came last."""
        self.known.keep(self.cached // 3)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, whose other memory is kept small."""
    if path not in _tokenizers:
        lean_worker()
        _tokenizers[path] = WordTokenizer(path)
        worker_caches.append(_tokenizers[path].shrink)
    return _tokenizers[path]
