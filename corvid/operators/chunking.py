"""Splitting Markdown documents into token-bounded chunks, and storing chunks as recipes of spans instead of text.

A document's layout decides how it is cut: whole if small, by second- and third-level headings, by paragraphs, or as tables whose
header row is repeated. One Arrow batch is one Python call; documents never meet, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T

#: Tokens in a chunk, in a whole section, shared by neighbouring chunks.
MAX_TOKENS, SECTION_TOKENS, OVERLAP = 800, 880, 50
Counter = Callable[[str], int]

_BOILERPLATE = re.compile(r"^#{1,6}\s+(?:" + "|".join(T.BOILERPLATE) + ")", re.M | re.I)
_IMAGE = re.compile(r"<!--\s*IMAGE_DESCRIPTION:\s*([^\n]+)\n(.*?)\n?-->\n?", re.S | re.I)
_HAS_IMAGE = re.compile(r"<!-- IMAGE_DESCRIPTION:", re.I)
_BOLD_LINE = re.compile(r"^\*\*([A-ZÁÉÍÓÚÑ][^*]{5,80})\*\*\s*$", re.M)
_GAP = re.compile(r"\n{2,}")


def default_count(text: str) -> int:
    return max(1, len(text) // 3)


@dataclass
class Piece:
    text: str
    path: list[str] = field(default_factory=list)
    image: bool | None = None

    def row(self, i: int) -> dict:
        return {"chunk_index": i, "text": self.text, "heading_path": self.path, "has_image": bool(_HAS_IMAGE.search(self.text)) if self.image is None else self.image}


class Pack:
    """Collects parts up to a budget; when one more would not fit, what is held becomes a chunk and its tail may stay on."""

    def __init__(self, budget: int, count: Counter, overlap: int = 0):
        self.budget, self.count, self.overlap = budget, count, overlap
        self.held: list[tuple[str, int]] = []
        self.done: list[str] = []

    def total(self) -> int:
        return sum(n for _, n in self.held)

    def close(self, glue: str) -> None:
        if not self.held:
            return
        self.done.append(glue.join(t for t, _ in self.held))
        stay = 0
        while stay < len(self.held) and sum(n for _, n in self.held[len(self.held) - stay - 1 :]) <= self.overlap:
            stay += 1
        self.held = self.held[len(self.held) - stay :]

    def add(self, part: str, glue: str = "\n\n") -> None:
        n = self.count(part)
        if self.held and self.total() + n > self.budget:
            self.close(glue)
        self.held.append((part, n))

    def finish(self, glue: str = "\n\n") -> list[str]:
        self.overlap = -1
        self.close(glue)
        return self.done


def forced(text: str, budget: int, count: Counter) -> Iterator[str]:
    """Prefixes as long as the budget lets them be; white space at a cut goes."""
    while text:
        n = len(text) if count(text) <= budget else max(1, bisect_right(range(1, len(text) + 1), budget, key=lambda k: count(text[:k])))
        yield text[:n]
        text = text[n:].lstrip()


def by_tokens(text: str, budget: int, count: Counter, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed to the budget; a paragraph over it falls into lines, a line over it is cut."""
    pack = Pack(budget, count, overlap)
    for paragraph in _GAP.split(text):
        for part in paragraph.splitlines() if count(paragraph) > budget else [paragraph]:
            if not part.strip():
                continue
            if count(part) > budget:
                for cut in forced(part, budget, count):
                    pack.add(cut, "\n")
            else:
                pack.add(part)
    return pack.finish()


def merged(parts: Iterable[str], count: Counter) -> list[str]:
    """Stripped parts packed without overlap; a part over the budget is split by itself."""
    pack = Pack(MAX_TOKENS, count, -1)
    for part in filter(None, (p.strip() for p in parts)):
        if count(part) > MAX_TOKENS:
            pack.close("\n\n")
            pack.done += by_tokens(part, MAX_TOKENS, count)
        else:
            pack.add(part)
    return pack.finish()


def sections(text: str, marks: str) -> list[tuple[str, str]]:
    """(heading, content) for each heading of that level; what stands before the first is not part of any."""
    found = list(re.finditer(rf"^{marks} (.+)$", text, re.M))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m[1], text[min(m.end() + 1, len(text)) : end]) for m, end in zip(found, ends, strict=False)]


def _whole_or(text: str, path: list[str], image: bool, count: Counter, split: Callable[[], list[str]]) -> list[Piece]:
    if count(text) <= MAX_TOKENS:
        return [Piece(text, path, image)]
    return [Piece(t, path) for t in split()]


def _by_headings(text: str, count: Counter) -> list[Piece]:
    out = []
    for heading, content in sections(text, "##"):
        if not content.strip():
            continue
        content = _BOILERPLATE.sub("", content)
        whole = f"## {heading}\n\n{content}"
        if count(whole) <= SECTION_TOKENS:
            out.append(Piece(whole, [heading], bool(_HAS_IMAGE.search(content))))
            continue
        below = sections(content, "###")
        for sub, body in below or [(None, content)]:
            body = _BOILERPLATE.sub("", body)
            if not body.strip():
                continue
            prefix = f"## {heading}\n" + (f"### {sub}\n\n" if sub is not None else "\n")
            budget = max(1, MAX_TOKENS - count(prefix))
            path = [heading] if sub is None else [heading, sub]
            out += [Piece(prefix + t, path, bool(_HAS_IMAGE.search(t))) for t in by_tokens(body, budget, count, min(OVERLAP, budget - 1))]
    return out


def is_table_line(line: str) -> bool:
    line = line.strip()
    return line.startswith("|") or line.startswith("+") and not line.startswith("+ ")


def is_table_separator(line: str) -> bool:
    line = line.strip()
    return bool(re.fullmatch(r"[|+][-:+| \t]*[|+]", line)) and any(c in "-:" for c in line[1:-1])


def _table(lines: list[str], path: list[str], count: Counter) -> list[Piece]:
    head, rows = "", lines
    if len(lines) > 1 and is_table_separator(lines[1]):
        top = "\n".join(lines[:2]) + "\n"
        if count(top) < MAX_TOKENS:
            head, rows = top, lines[2:]
    room = MAX_TOKENS - (count(head) if head else 0)
    pack = Pack(room, count, -1)
    for row in rows:
        if count(row) > room:
            pack.close("\n")
            pack.done += forced(row, room, count)
        else:
            pack.add(row, "\n")
    return [Piece(head + t, path, False) for t in pack.finish("\n")]


def _by_tables(text: str, count: Counter) -> list[Piece]:
    out: list[Piece] = []
    path: list[str] = []
    kind, held = "", ""

    def flush() -> None:
        nonlocal held, kind
        if kind == "table":
            body = held.strip("\n").splitlines()
            if body:
                out.extend(_table(body, path, count))
        elif held.strip():
            out.extend(Piece(t, path) for t in by_tokens(held.strip(), MAX_TOKENS, count))
        held, kind = "", ""

    pending = ""  # empty lines between tables belong to no table and no text yet
    for line in text.splitlines(keepends=True):
        if re.match(r"#{1,6} ", line) and not _BOILERPLATE.match(line):
            flush()
            pending, path = "", [line.strip().lstrip("#").strip()]
            continue
        now = "table" if is_table_line(line) else "text" if line.strip() else ""
        if not now:
            if kind == "text":
                held += line
            else:
                pending += line
            continue
        if now != kind:
            flush()
            held, kind = (pending if now == "text" else ""), now
        pending = ""
        held += line
    flush()
    return out


def layout(text: str, size: int) -> str:
    """The layout of a text, its images inlined; the same rule as ``functions.text.pattern``."""
    if size < T.SMALL_BYTES:
        return "small"
    full = [x for x in map(str.strip, text.splitlines()) if x]
    if full and sum(x.startswith("|") for x in full) / len(full) > T.TABLE_SHARE or size > T.GIANT_BYTES:
        return "giant_table"
    if len(re.findall(r"^## .+$", text, re.M)) >= 2:
        return "h2_compound"
    return "bold_headers" if len(_BOLD_LINE.findall(text)) >= 2 else "plain"


def inlined(text: str) -> str:
    return _IMAGE.sub(lambda m: f"[Imagen: {m[1].strip()}] {m[2].strip()}\n\n", text)


def split(text: str, size: int | None = None, count: Counter = default_count) -> tuple[str, list[dict]]:
    """(layout, chunks) of one document."""
    size = len(text.encode()) if size is None else size
    text = inlined(text)
    kind = layout(text, size)
    image = bool(_HAS_IMAGE.search(text))
    bare = _BOILERPLATE.sub("", text)
    if kind == "small":
        top = re.search(r"^# (.+)$", text, re.M)
        body = bare.strip()
        pieces = _whole_or(body, [top[1]] if top else [], image, count, lambda: by_tokens(body, MAX_TOKENS, count))
        for p in pieces:
            p.image = image
    elif kind == "h2_compound":
        pieces = _by_headings(text, count)
    elif kind == "giant_table":
        pieces = _by_tables(text, count)
    else:
        body = bare if kind == "bold_headers" else bare.strip()
        path = _BOLD_LINE.findall(text)[:2] if kind == "bold_headers" else []
        pieces = _whole_or(body, path, image, count, lambda: merged(_GAP.split(body), count))
    return kind, [p.row(i) for i, p in enumerate(pieces)]


CHUNKS = "pattern string, chunk_index int, text string, heading_path array<string>, has_image boolean, token_count int, chunk_hash string"
SPANS = "array<struct<start:int,end:int,lit:string>>"


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: Counter = default_count, recipes: bool = False) -> DataFrame:
    """One row per chunk. Documents with null text have none. With ``recipes`` each has its spans of the document's text (images
    inlined), which are made where the two are at hand, so no text is moved for them."""
    fields = {"pattern": pa.string(), "chunk_index": pa.int32(), "text": pa.string(), "heading_path": pa.list_(pa.string()), "has_image": pa.bool_(), "token_count": pa.int32(), "chunk_hash": pa.string()}
    if recipes:
        fields["spans"] = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lit", pa.string())]))

    def run(batches):
        import hashlib

        for batch in batches:
            for doc, text in zip(batch.column(id_col), batch.column(text_col).to_pylist(), strict=True):
                if text is None:
                    continue
                kind, rows = split(text, count=count)
                if not rows:
                    continue
                for r in rows:
                    r |= {"pattern": kind, "token_count": count(r["text"]), "chunk_hash": hashlib.sha256(r["text"].encode()).hexdigest()}
                if recipes:
                    source = inlined(text)
                    for r in rows:
                        r["spans"] = recipe(r["text"], source)
                owner = pa.array([doc.as_py()] * len(rows), doc.type)
                yield pa.record_batch([owner, *(pa.array([r[k] for r in rows], t) for k, t in fields.items())], names=[id_col, *fields])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {CHUNKS}" + (f", spans {SPANS}" if recipes else ""))


#: Characters that a stretch of the source must share with a chunk to be found.
ANCHOR = 24


def spans(chunk: str, source: str, anchor: int = ANCHOR) -> list[dict]:
    """A recipe for ``chunk``: stretches of ``source`` as (start, end), anything else as literals.

    A stretch is looked for where the last one ended, then further on, then from the beginning (as for a table's header that is
    repeated); where there is none the chunk goes on to its next line or word as a literal.
    """
    out: list[dict] = []
    at = cursor = 0
    literal = ""

    def say(text: str) -> None:
        if text:
            out.append({"start": None, "end": None, "lit": text})

    while at < len(chunk):
        key = chunk[at : at + anchor]
        where = cursor if source.startswith(key, cursor) else source.find(key, cursor)
        if where < 0:
            where = source.find(key, 0, cursor + anchor)
        if where < 0 or len(key) < min(anchor, 4):
            step = 1
            while at + step < len(chunk) and step < anchor and chunk[at + step - 1] not in " \n":
                step += 1
            literal += chunk[at : at + step]
            at += step
            continue
        n, step = len(key), 1 << 12
        while step:
            a, b = chunk[at + n : at + n + step], source[where + n : where + n + step]
            if a and a == b:
                n += len(a)
            else:
                step >>= 1
        say(literal)
        literal = ""
        out.append({"start": where, "end": where + n, "lit": None})
        at, cursor = at + n, where + n
    say(literal)
    return out


def recipe(chunk: str, source: str) -> list[dict]:
    """The chunk's spans, or the chunk as one literal if they don't give it back."""
    got = spans(chunk, source)
    back = "".join(x["lit"] if x["lit"] is not None else source[x["start"] : x["end"]] for x in got)
    return got if back == chunk else [{"start": None, "end": None, "lit": chunk}]


def with_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: Counter = default_count) -> DataFrame:
    """Chunks with their recipes instead of their texts."""
    return chunked(docs, id_col, text_col, count, recipes=True).drop("text")


def reconstructed(recipe: Column, source: Column) -> Column:
    """The chunk's text from its recipe and the document's text with images inlined."""
    return F.array_join(F.transform(recipe, lambda s: F.coalesce(s["lit"], F.substr(source, (s["start"] + 1).cast("int"), s["end"] - s["start"]))), "")


# Other ways to split, for comparison.


def windows(text: Column, size: int | Column, overlap: int | Column) -> Column:
    """Windows of ``size`` words that share ``overlap`` words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    size, overlap = (F.lit(x) if isinstance(x, int) else x for x in (size, overlap))
    last = F.greatest(F.lit(1), F.size(words) - overlap)
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last, size - overlap), lambda i: F.array_join(F.slice(words, i, size), " ")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


#: What a text is split at, coarsest first, and what the parts are joined by again; a sentence keeps its stop.
MARKS = ((r"\n\n", "\n\n"), (r"\n", "\n"), (r"(?<=\.) ", " "), (r" ", " "))


def recursive(text: str, budget: int, count: Counter = default_count, marks: tuple[tuple[str, str], ...] = MARKS) -> list[str]:
    """Split at the coarsest mark that gives parts within the budget, and at finer ones where they are not."""
    if count(text) <= budget:
        return [text] if text.strip() else []
    if not marks:
        return list(forced(text, budget, count))
    (mark, glue), finer = marks[0], marks[1:]
    pack = Pack(budget, count, -1)
    for part in re.split(mark, text):
        if count(part) > budget:
            pack.close(glue)
            pack.done += recursive(part, budget, count, finer)
        elif part.strip():
            pack.add(part, glue)
    return pack.finish(glue)


def offsets(text: str, budget: int = MAX_TOKENS, count: Counter = default_count) -> list[tuple[int, int]]:
    """Paragraphs merged up to a budget, as (start, end) in the text; a paragraph over the budget is cut into pieces of its own."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    used = 0

    def close() -> None:
        if held:
            out.append((held[0][0], held[-1][1]))
            held.clear()

    ends = [m.span() for m in _GAP.finditer(text)] + [(len(text), len(text))]
    start = 0
    for end, following in ends:
        paragraph = text[start:end]
        n = count(paragraph) if paragraph.strip() else 0
        if n > budget:
            close()
            used, at = 0, start
            for piece in forced(paragraph, budget, count):
                begin = max(at, text.find(piece, at))
                out.append((begin, begin + len(piece)))
                at = begin + len(piece)
        elif n:
            if used + n > budget:
                close()
                used = 0
            held.append((start, end))
            used += n
        start = following
    close()
    return out


#: Characters in a chunk and shared by neighbours, and what a text is cut at, coarsest first: headings, code, lists, paragraphs,
#: lines, sentences, words.
STRUCTURE_CHARS, STRUCTURE_SHARED = 2000, 500
STRUCTURE = tuple(re.compile(p, re.M) for p in (r"^(?=#{1,6} )", r"^(?=```)", r"^(?=(?:[-*+]|\d+\.) )", r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?] )", r"(?<= )"))


def structural(text: str, size: int = STRUCTURE_CHARS, shared: int = STRUCTURE_SHARED) -> list[tuple[int, str]]:
    """(number, chunk): a text cut at its coarsest marks into chunks of ``size`` characters at most, each of which begins with up to
    ``shared`` characters of the one before. Blank chunks are left out and keep their number."""

    def parts(piece: str, level: int) -> list[str]:
        if len(piece) <= size - shared:
            return [piece]
        if level == len(STRUCTURE):
            step = max(1, size - shared)
            return [piece[i : i + step] for i in range(0, len(piece), step)]
        cuts = [0, *(m.start() for m in STRUCTURE[level].finditer(piece) if m.start()), len(piece)]
        return [x for a, b in zip(cuts, cuts[1:], strict=False) if a < b for x in parts(piece[a:b], level + 1)]

    chunks: list[str] = []
    held: list[str] = []
    fresh = False
    for part in parts(text, 0):
        if held and sum(map(len, held)) + len(part) > size:
            chunks.append("".join(held))
            while held and sum(map(len, held)) > shared:
                held.pop(0)
            fresh = False
        held.append(part)
        fresh = True
    if fresh:
        chunks.append("".join(held))
    return [(i, c) for i, c in enumerate(chunks, 1) if c.strip()]


def structural_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = STRUCTURE_CHARS, shared: int = STRUCTURE_SHARED) -> DataFrame:
    """(id, number, text) of all documents."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(id_col), batch.column(text_col).to_pylist(), strict=True):
                if found := structural(text or "", size, shared):
                    yield pa.record_batch([pa.array([doc.as_py()] * len(found), doc.type), pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found])], names=[id_col, "number", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, number int, text string")


def by_sections(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
    """Second-level sections, and what stands before the first; one over the budget is cut further."""
    cuts = [0, *(m.start() for m in re.finditer(r"^## .+$", text, re.M) if m.start()), len(text)]
    parts = [text[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x for p in parts if p for x in ([p] if count(p) <= budget else recursive(p, budget, count))]


def by_tables(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
    """Tables apart from the text around them, neither cut further."""
    out: list[str] = []
    kind: bool | None = None
    for line in text.splitlines(keepends=True):
        now = is_table_line(line) if line.strip() else kind
        if now != kind or not out:
            out.append("")
        kind = now
        out[-1] += line
    return [x.strip("\n") for x in out if x.strip()]


def token_windows(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
    """Words packed up to the budget, whatever the layout."""
    return [x for x in forced(text, budget, count) if x.strip()]


def sentence_packs(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
    """Sentences packed up to the budget; a sentence over it is cut."""
    pack = Pack(budget, count, -1)
    for sentence in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        if count(sentence) > budget:
            pack.close(" ")
            pack.done += forced(sentence, budget, count)
        else:
            pack.add(sentence, " ")
    return pack.finish(" ")


def piped(*steps: Callable[..., list[str]]) -> Callable[..., list[str]]:
    """One way to split after another, each on what the one before gave."""

    def run(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
        parts = [text]
        for step in steps:
            parts = [x for p in parts for x in step(p, count=count, budget=budget)]
        return parts

    return run


def _recursive(text: str, count: Counter = default_count, budget: int = MAX_TOKENS) -> list[str]:
    return recursive(text, budget, count)


#: Ways to split that can be compared with the layouts' own.
VARIANTS: dict[str, Callable[..., list[str]]] = {
    "recursive": _recursive,
    "sections": by_sections,
    "tables": by_tables,
    "tokens": token_windows,
    "sentences": sentence_packs,
    "tables_recursive": piped(by_tables, _recursive),
    "recursive_tables": piped(_recursive, by_tables),
}


def compared(docs: DataFrame, variants: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", count: Counter = default_count, budget: int = MAX_TOKENS) -> DataFrame:
    """(variant, id, chunks, tokens, longest): what each way to split makes of each document, all in one scan."""
    chosen = {v: VARIANTS[v] for v in variants or VARIANTS}

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                for name, split_ in chosen.items():
                    sizes = [count(x) for x in split_(text or "", count=count, budget=budget)]
                    rows.append((name, doc, len(sizes), sum(sizes), max(sizes, default=0)))
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c[0], pa.string()), pa.array(c[1], batch.schema.field(id_col).type), *(pa.array(x, pa.int64()) for x in c[2:])], names=["variant", id_col, "chunks", "tokens", "longest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"variant string, {id_col} {kind}, chunks bigint, tokens bigint, longest bigint")
