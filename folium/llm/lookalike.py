"""Problem 3: visually identical text with different characters.

Arrow batches go through an embedded DuckDB. Its SQL composes letters
(nfc_normalize), folds width, spaces and hyphens (translate), drops invisible
signs (regular expressions) and writes every word of two or more letters in one
alphabet: the one its letters without a twin show, else the one in which it is a
word of the caption table, else that of most of its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.runtime import collect_bounded

# Letters that look the same in Latin, Cyrillic and Greek; a space where an alphabet has no twin.
LATIN = "ABCEHIJKMNOPSTXYZaceijopsxyËÏëï"
CYRILLIC = "АВСЕНІЈКМ ОРЅТХУ асеіјорѕхуЁЇёї"
GREEK = "ΑΒ ΕΗΙ ΚΜΝΟΡ ΤΧΥΖ     ο        "
# Spaces and hyphens with a plain form, and signs without a form of their own.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63"
INVISIBLE = r"[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
SCRIPTS = ("Latin", "Cyrillic", "Greek")
BATCH_CHARS = 2_000_000
_CON: dict = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def widths() -> tuple[str, str]:
    """Full- and half-width forms with the ordinary letters they stand for, by their own decomposition."""
    wide = [chr(c) for c in [*range(0xFF01, 0xFFA0), *range(0xFFA1, 0xFFEF)] if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))]
    plain = [unicodedata.normalize("NFKC", c) for c in wide]
    kept = [(a, b) for a, b in zip(wide, plain) if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def twins(into: str) -> tuple[str, str]:
    """Letters of the other alphabets and their twins in one alphabet."""
    rows = {"Latin": LATIN, "Cyrillic": CYRILLIC, "Greek": GREEK}
    pairs = {}
    for name, row in rows.items():
        if name != into:
            pairs |= {a: b for a, b in zip(row, rows[into]) if a != " " and b != " "}
    return "".join(pairs), "".join(pairs.values())


def disguises(word: str) -> str:
    """A pattern of a word with any of its letters replaced by twins."""
    rows = (LATIN, CYRILLIC, GREEK)
    return "".join("[" + "".join(dict.fromkeys(y for row in rows for k, x in enumerate(row) if x == c for y in (r[k] for r in rows) if y != " ")) + "]" for c in word)


def two_sided() -> str:
    """Every letter that has a twin somewhere."""
    return "".join(sorted(set(LATIN + CYRILLIC + GREEK) - {" "}))


def sql(captions: list[str]) -> str:
    """The query that adds the column clean to the view batch(text)."""
    wide, plain = widths()
    froms, tos = wide + SPACES + HYPHENS, plain + " " * len(SPACES) + "-" * len(HYPHENS)
    words = sorted({w for c in captions for w in "".join(x if x.isalpha() else " " for x in unicodedata.normalize("NFC", c)).split() if len(w) > 1 and all(x in two_sided() for x in w)})
    listed = f"[{', '.join(map(quoted, words))}]::VARCHAR[]"
    seen = f"regexp_replace(text, '{INVISIBLE}', '', 'g')"
    # translate sets up its whole table for every row: only rows that need it go through
    step = f"nfc_normalize(CASE WHEN regexp_matches(text, {quoted('[' + froms + ']')}) THEN translate({seen}, {quoted(froms)}, {quoted(tos)}) ELSE {seen} END)"
    mixed = "|".join(rf"\p{{{a}}}\p{{M}}*\p{{{b}}}" for a in SCRIPTS for b in SCRIPTS if a != b)
    alike = f"[{two_sided()}]"
    shown = {s: rf"length(regexp_replace(w, '[^\p{{{s}}}]|{alike}', '', 'g'))" for s in SCRIPTS}
    most = {s: rf"length(regexp_replace(w, '[^\p{{{s}}}]', '', 'g'))" for s in SCRIPTS}
    turn = {s: f"translate(w, {quoted(twins(s)[0])}, {quoted(twins(s)[1])})" for s in SCRIPTS}
    rank = lambda by: " ".join(f"WHEN {' AND '.join(f'{by[s]} > {by[o]}' for o in SCRIPTS if o != s)} THEN {turn[s]}" for s in SCRIPTS)
    dressed = "|".join(map(disguises, words)) or "[^\\x{00}-\\x{10FFFF}]"
    as_caption = " ".join(f"WHEN list_contains({listed}, {turn[s]}) THEN {turn[s]}" for s in ("Cyrillic", "Latin", "Greek"))
    is_mixed, no_sign = f"regexp_matches(w, '{mixed}')", f"regexp_full_match(w, '{alike}{{2,}}')"
    word = f"CASE WHEN length(w) < 2 THEN w WHEN {no_sign} THEN CASE WHEN list_contains({listed}, w) THEN w WHEN regexp_full_match(w, '{dressed}') THEN CASE {as_caption} ELSE w END WHEN {is_mixed} THEN CASE {rank(most)} ELSE w END ELSE w END WHEN {is_mixed} THEN CASE {rank(shown)} ELSE w END ELSE w END"
    suspect = rf"(regexp_matches(plain, '{mixed}') OR regexp_matches(plain, '(^|[^\p{{L}}\p{{M}}])(?:{dressed})($|[^\p{{L}}\p{{M}}])'))"
    parts = r"regexp_extract_all(plain, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+')"
    return f"WITH folded AS MATERIALIZED (SELECT *, {step} AS plain FROM batch) SELECT * EXCLUDE (plain), CASE WHEN {suspect} THEN nfc_normalize(array_to_string(list_transform({parts}, lambda w: {word}), '')) ELSE plain END AS clean FROM folded"


def connection() -> duckdb.DuckDBPyConnection:
    if "con" not in _CON:
        _CON["con"] = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _CON["con"]


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most BATCH_CHARS bytes of text or one row, so that the query's memory has a bound."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    whole = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = whole[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(whole, done + BATCH_CHARS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def consistent(df: DataFrame, captions: DataFrame, changed_only: bool = True, max_captions: int = 20_000) -> DataFrame:
    """Every row of df with its text in one consistent form in the column ``clean``.

    df: any columns with text among them (clean must not be one); captions:
    caption_text, a fixed small table. Null texts stay null and are left out with
    ``changed_only``; the empty text is consistent. Line ends and the number of
    spaces are kept; signs that look different stay; a word of one letter stays.
    """
    listed = sorted({r[0] for r in collect_bounded(captions.select("caption_text").dropna(), max_captions, "the captions")})
    query = f"SELECT * FROM ({sql(listed)}) WHERE clean <> text" if changed_only else sql(listed)

    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in (part for b in batches for part in sliced(b, at)):
            con.register("batch", pa.Table.from_batches([batch]))
            out = con.sql(query).to_arrow_table()
            con.unregister("batch")
            yield from out.combine_chunks().to_batches()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", clean string"
    return df.mapInArrow(run, shape)


def text_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id and text of the text objects of templates."""
    return nodes.where("tag = 'TextObject' and doc_id is not null and node_id is not null").select("doc_id", F.col("node_id").cast("int").alias("node_id"), F.col("attrs")["Text"].alias("text")).where("text <> ''")
