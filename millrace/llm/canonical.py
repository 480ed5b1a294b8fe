"""One consistent form of texts that look the same.

DuckDB runs inside each Arrow partition: a table of the batch goes in, one SQL
expression maps invisible characters, compatibility forms (wider, narrower, joined),
look-alikes and composition, and the result goes back. Nothing is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.lookalikes import lookalikes
from millrace.plans.lineage import cut

# Kinds of compatibility decomposition whose forms look like the plain character.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
# Invisible characters, but for the joiners.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}"
# Scripts in which a joiner between letters changes the look.
JOINING = r"\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}"

# Characters that stand for several and are so usual in texts that a test for them does not pay.
USUAL = "…‥ำ"


@lru_cache(maxsize=2)
def tables(alike: tuple[tuple[str, str], ...]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that one character stands for, and those that several do, by rule from the character database and the look-alikes."""
    drawn = dict(alike)
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for code in (*range(0xA0, 0x2100), *range(0x2160, 0x2180), 0x3000, *range(0xFB00, 0x10000)):  # not letter-like symbols, squares and bracketed numbers
        c = chr(code)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if kind in SAME_LOOK and code not in (0x3164, 0xFFA0):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1:
                one[c] = plain
            elif " " not in plain and unicodedata.category(c) != "No":
                many[c] = plain
        elif unicodedata.category(c) == "Zs":
            one[c] = " "
    one |= drawn
    for code in range(0x370, 0x530):  # accented look-alikes: the accent stays, the letter changes
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in drawn:
            plain = unicodedata.normalize("NFC", drawn[parts[0]] + parts[1:])
            (one if len(plain) == 1 else many)[chr(code)] = plain
    for line in "\u0085  ":
        one[line] = "\n"
    return one, {k: "".join(one.get(x, x) for x in v) for k, v in many.items()}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str, many: dict[str, str]) -> str:
    for c, plain in many.items():
        column = f"replace({column}, {_quoted(c)}, {_quoted(plain)})"
    return column


@lru_cache(maxsize=8)
def canonical_sql(column: str, select: str, alike: tuple[tuple[str, str], ...]) -> str:
    """The DuckDB query that gives ``select`` over the batch, with the canonical form of ``column`` as canonical.

    Each step is a materialized table, as its result is used several times; the costly mappings run
    only on texts that a test, which costs little, has shown to need them.
    """
    one, many = tables(alike)
    usual = {c: many[c] for c in USUAL if c in many}
    rare = {c: plain for c, plain in many.items() if c not in usual}
    unjoined = _replaced("mapped", rare)
    joiner = "[\\x{200C}\\x{200D}]"
    mapping = f"{_quoted(''.join(one))}, {_quoted(''.join(one.values()))}"
    return f"""
        WITH visible AS MATERIALIZED (
            SELECT *, regexp_replace({column}, '[{INVISIBLE}]+', '', 'g') AS seen FROM batch
        ), lines AS MATERIALIZED (
            SELECT * EXCLUDE (seen), CASE WHEN regexp_matches(seen, '{joiner}|\\r') THEN
                regexp_replace(regexp_replace(regexp_replace(seen, '(^|[^{JOINING}]){joiner}+', '\\1', 'g'), '{joiner}+($|[^{JOINING}])', '\\1', 'g'), '\\r\\n?', chr(10), 'g')
                ELSE seen END AS seen FROM visible
        ), plain AS MATERIALIZED (
            SELECT * EXCLUDE (seen), CASE WHEN regexp_matches(seen, {_quoted("[" + "".join(sorted(one)) + "]")}) THEN translate(seen, {mapping}) ELSE seen END AS single FROM lines
        ), common AS MATERIALIZED (
            SELECT * EXCLUDE (single), {_replaced("single", usual)} AS mapped FROM plain
        ), parted AS MATERIALIZED (
            SELECT * EXCLUDE (mapped), CASE WHEN regexp_matches(mapped, {_quoted("[" + "".join(sorted(rare)) + "]")}) THEN {unjoined} ELSE mapped END AS mapped FROM common
        ), composed AS MATERIALIZED (
            SELECT * EXCLUDE (mapped), nfc_normalize(mapped) AS canonical FROM parted
        )
        SELECT {select} FROM composed"""


def _alike(df: DataFrame) -> tuple[tuple[str, str], ...]:
    return tuple(sorted(lookalikes(df.sparkSession).items()))


def _run(batches: Iterator[pa.RecordBatch], column: str, select: str, alike: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    import duckdb

    # a batch is a bounded number of rows: nothing is spilled to a folder of the worker's own
    connection = duckdb.connect(config={"threads": "1", "temp_directory": ""})
    query = canonical_sql(f'"{column}"', select, alike)
    for record in batches:
        connection.register("batch", pa.Table.from_batches([record]))
        table = connection.sql(query).to_arrow_table()
        connection.unregister("batch")
        yield from table.to_batches()


def canonical_text(df: DataFrame, text: str = "text", output: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text`` in ``output``.

    Full-width, half-width and joined forms, spaces of any width, composed letters, invisible
    characters and look-alike letters become one form; letter case, accents, digits, words and
    marks stay. Null gives null, empty gives empty. A column named ``output`` is replaced.
    """
    kept = [c for c in df.columns if c != output]
    given = [f"c{i}" for i in range(len(kept))]  # DuckDB's names are case-insensitive, and its steps have names of their own
    plain = df.select(*(F.col(f"`{c}`").alias(g) for c, g in zip(kept, given)), F.col(f"`{text}`").alias("body"))
    schema = T.StructType([*(T.StructField(g, df.schema[c].dataType) for c, g in zip(kept, given)), T.StructField("canonical", T.StringType())])

    alike = _alike(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run(batches, "body", ", ".join([*given, "canonical"]), alike)

    out = plain.mapInArrow(run, schema)
    return out.select(*(F.col(g).alias(c) for c, g in zip(kept, given)), F.col("canonical").alias(output))


def _digests(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """record_kind, look, body (128-bit digests of the canonical form and of the text), id: each once."""
    rows = df.select(F.col(kind).cast("string").alias("record_kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("body")).filter(F.col("body").isNotNull() & F.col("id").isNotNull())
    schema = "record_kind string, id string, look binary, body binary"
    alike = _alike(df)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the blank test comes after the mapping, which leaves only plain spaces and line breaks
        return _run(batches, "body", "record_kind, id, CASE WHEN regexp_matches(canonical, '[^\\s]') THEN unhex(md5(canonical)) END AS look, unhex(md5(body)) AS body", alike)

    digests = rows.mapInArrow(digest, schema).filter(F.col("look").isNotNull())
    # repeated rows of an id carry the same text: grouping by all columns combines them on the map side
    return cut(digests.groupBy("record_kind", "look", "body", "id").agg(F.count(F.lit(1)).alias("n")).drop("n"))


def look_alike_pairs(df: DataFrame, kind: str, key: str, text: str = "text") -> DataFrame:
    """Pairs id_a < id_b of one kind whose texts look the same but differ in their characters.

    Repeated rows of a key count once; null and blank texts (of white space or invisible
    characters) take no part. Only keys and 128-bit digests of both forms are shuffled. A pair of
    equal texts is none, so that groups of exact copies make no pairs among themselves.
    """
    distinct = _digests(df, kind, key, text)
    varied = distinct.groupBy("record_kind", "look").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter(F.col("least") != F.col("most")).select("record_kind", "look")
    members = distinct.join(varied, ["record_kind", "look"], "left_semi")
    a = members.select("record_kind", "look", F.col("id").alias("id_a"), F.col("body").alias("body_a"))
    b = members.select("record_kind", "look", F.col("id").alias("id_b"), F.col("body").alias("body_b"))
    pairs = a.join(b, ["record_kind", "look"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("body_a") != F.col("body_b")))
    return pairs.select("record_kind", "id_a", "id_b").distinct()


def look_alike_classes(df: DataFrame, kind: str, key: str, text: str = "text") -> DataFrame:
    """record_kind, id, class_id, links of each record with a text that is not blank: those of one class look the same, and
    links is the number of records of the class whose text differs in its characters. A row a record however large the classes are:
    all that is shuffled is counted on the map side first. A record given with two texts has a row for each.
    """
    distinct = _digests(df, kind, key, text)
    bodies = distinct.groupBy("record_kind", "look", "body").agg(F.count(F.lit(1)).alias("same"))
    sizes = bodies.groupBy("record_kind", "look").agg(F.sum("same").alias("size"))
    links = bodies.join(sizes, ["record_kind", "look"]).select("record_kind", "look", "body", (F.col("size") - F.col("same")).alias("links"))
    # a hot class or text is one row on the right: the join is split by the engine where the left side is skewed
    return distinct.join(links, ["record_kind", "look", "body"]).select("record_kind", "id", F.hex("look").alias("class_id"), "links")
