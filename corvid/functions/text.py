"""Text expressions: folding, tokens, Markdown patterns, snippets. All run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by the rule of canonical decomposition."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(base) > 1 and unicodedata.category(base[0])[0] == "L" and all(unicodedata.combining(x) for x in base[1:]):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def fold(text: Column | str) -> Column:
    """Lower case, sharp s as ss, Latin marks dropped."""
    text = F.col(text) if isinstance(text, str) else text
    folded = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)
    # Text of ASCII characters only, told by its size, has nothing to fold but case.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def tokens(text: Column | str) -> Column:
    """The folded words of a text, in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(text: Column | str) -> Column:
    """The words of a question as the reader of titles and headings sees them: word characters with the underscore, folded."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column | str) -> Column:
    """The stand-in token count: a third of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


#: Headings that carry no content.
BOILERPLATE = ("Al margen", "Escudo Nacional", "Sufragio Efectivo", "Lo que comunico", "Dado en la Ciudad", "En fe de lo cual", "Atentamente", "Rúbrica")
BOILERPLATE_PATTERN = r"(?im)^#{1,6}[ \t]+(" + "|".join(BOILERPLATE) + ")"
IMAGE_COMMENT = r"(?is)<!--\s*IMAGE_DESCRIPTION:\s*([^\n]+)\n(.*?)\n?-->\n?"
#: Sizes at which documents are treated differently.
SMALL_BYTES, GIANT_BYTES, TABLE_SHARE = 6_000, 1_000_000, 0.40


def without_boilerplate(text: Column | str) -> Column:
    """The matched heading start goes, the rest of its line stays."""
    return F.regexp_replace(text, BOILERPLATE_PATTERN, "")


def inlined_images(text: Column | str) -> Column:
    """Image description comments become paragraphs."""
    return F.regexp_replace(text, IMAGE_COMMENT, "[Imagen: $1] $2\n\n")


def matches(text: Column | str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def table_share(text: Column) -> Column:
    """Of the non-empty lines, the part that begins with a bar."""
    full = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.filter(full, lambda x: x.startswith("|"))
    return F.when(F.size(full) > 0, F.size(rows) / F.size(full)).otherwise(F.lit(0.0))


def pattern(text: Column, size: Column | None = None) -> Column:
    """How a Markdown document is laid out: small, giant_table, h2_compound, bold_headers or plain."""
    size = F.octet_length(text) if size is None else size
    bold = r"(?m)^\*\*[A-ZÁÉÍÓÚÑ][^*]{5,80}\*\*[ \t]*$"
    return (
        F.when(size < SMALL_BYTES, "small")
        .when((table_share(text) > TABLE_SHARE) | (size > GIANT_BYTES), "giant_table")
        .when(matches(text, r"(?m)^## .+$") >= 2, "h2_compound")
        .when(matches(text, bold) >= 2, "bold_headers")
        .otherwise("plain")
    )


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading line, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1))


def separator(line: Column) -> Column:
    """A long line of table rules becomes a short one with as many columns; any other line stays."""
    plus, bars = F.length(line) - F.length(F.replace(line, F.lit("+"), F.lit(""))), F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    columns = F.when(plus > 0, plus - 1).when(bars > 0, bars - 1).otherwise(1)
    short = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.greatest(F.lit(1), columns).cast("int")))
    return F.when(line.rlike(r"^[ \t|+\-:=]{10,}$"), short).otherwise(line)


def clean(text: Column) -> Column:
    """Rows of escaped underscores, long table rules, three or more blanks, three or more line ends."""
    out = F.regexp_replace(text, r"(?:\\_){2,}", " __________ ")
    out = F.array_join(F.transform(F.split(out, "\n"), separator), "\n")
    return F.regexp_replace(F.regexp_replace(out, r" {3,}", " "), r"\n{3,}", "\n\n")


#: Beginnings of titles that are parts of a document.
FRAGMENT = r"(?i)^(?:[IVXLCDM]{1,6}\.|[A-Z]\.|secci[oó]n\b|cap[ií]tulo\b|apartado\b|numeral\b|transitorio)"


def is_fragment_title(title: Column) -> Column:
    return F.coalesce((F.length(F.trim(title)) < 20) | F.trim(title).rlike(FRAGMENT), F.lit(True))


#: How files are named that have no title of their own.
SLUG = r"^\d{3}_(AVISO|DOC|DOF|ACUERDO)_\d{8}_"


def is_slug(title: Column) -> Column:
    """Whether a title is but a file's name."""
    return title.rlike(SLUG)


def snippet(text: Column, at: Column, most: int = 200) -> Column:
    """At most ``most`` characters that begin a quarter before position ``at`` (from 1), with ellipses where text is left out."""
    short = F.length(text) <= most
    start = F.greatest(F.lit(1), F.least(at - most // 4, F.length(text) - most + 1))
    body = F.substr(text, start.cast("int"), F.lit(most))
    return F.when(short, text).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + most - 1 < F.length(text), "…").otherwise("")))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, as strings."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngram_rows(text: Column | str, n: int) -> Column:
    """A text's distinct n-grams of folded words. The words are shifted against each other once, not sliced for each place."""
    return F.transform(F.array(tokens(text)), lambda w: F.array_distinct(_shifted(w, n)))[0]


def _shifted(words: Column, n: int) -> Column:
    parts = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.lit(0), F.size(words) - n + 1)).alias(f"w{k}") for k in range(n)))
    return F.transform(parts, lambda p: F.concat_ws(" ", *(p[f"w{k}"] for k in range(n))))


def heading_path(value: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def first_json_array(text: Column) -> Column:
    """The widest [ ... ] of a text as an array of strings, null where it isn't one."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")


#: Spanish month names in order.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def spanish_date(date: Column) -> Column:
    """A date in words, as 5 de marzo de 2020."""
    return F.concat_ws(" de ", F.dayofmonth(date).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date)), F.year(date).cast("string"))


def resolved_title(own: Column, text: Column, key: Column) -> Column:
    """A record's own title, else the text's first first-level heading, else its id."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(heading, F.lit("")), key.cast("string"))
