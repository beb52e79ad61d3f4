"""Lines, delimiters, base64 and CSV text as expressions over string and binary columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.functions.values import escape_reg_exp
from rillspark.plans.index import PART, PARTS, RANGE, offsets, ranged, sort_columns, with_sum

LINES = r"\r?\n"
#: Bytes of chunks that are put together to be hashed, or one chunk if that is longer.
BLOCK = 1 << 20


def pieces(column: Column, delimiter: str | re.Pattern = re.compile(LINES)) -> Column:
    """The parts of a text between delimiters, the last one too, be it empty; an empty text has one empty part. A string is literal."""
    pattern = delimiter.pattern if isinstance(delimiter, re.Pattern) else escape_reg_exp(delimiter)
    return F.split(column, pattern, -1)


def joined_chunks(df: DataFrame, order: list[str], column: str = "value") -> DataFrame:
    """One row: all chunks of text or bytes, cut anywhere, in order. Bytes are joined before they are decoded."""
    chunk = F.col(column).cast("binary")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.hex(chunk).alias("__chunk"))))
    return df.agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["__chunk"]), "")).cast("string").alias(column))


def to_base64(column: Column) -> Column:
    """Base64 without line breaks; text is taken as UTF-8."""
    return F.regexp_replace(F.base64(column.cast("binary")), r"[\r\n]", "")


def from_base64(column: Column) -> Column:
    """The bytes of base64; a missing padding at the end is allowed, and what is no base64 gives null."""
    bare = F.rtrim(F.regexp_replace(column, r"[\r\n]", ""), F.lit("="))
    good = bare.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1)
    return F.unbase64(F.when(good, F.rpad(bare, F.ceil(F.length(bare) / 4) * 4, F.lit("="))))


def across_chunks(df: DataFrame, order: list[str], column: str, position: str, size: int, change: Callable[[Column], Column]) -> DataFrame:
    """(RANGE, position, column): `change` of groups of `size` bytes of chunks that are one string in order, wherever chunks end.

    A prefix sum of lengths tells where each chunk's groups begin. A chunk keeps the groups that begin in it and takes what
    the last one lacks from the heads of the chunks after it, so the text itself is dealt once, by range of the order, and
    what is made of it lies in the same ranges. Ranges pass one another a sum and a head. RANGE and position are ascending.
    """
    chunk, none = F.col(f"`{column}`").cast("binary"), F.lit(b"")
    n, head = F.col("__n"), lambda c: F.substring(c, 1, size - 1)
    rows = df.where(F.length(chunk) > 0).withColumns({"__b": chunk, "__n": F.length(chunk).cast("bigint"), "__head": head(chunk)})
    own = Window.partitionBy(PART).orderBy(*sort_columns(order))
    after = lambda c, w: F.concat(*(F.coalesce(F.lead(c, i).over(w), none) for i in range(1, size)))
    rows = ranged(rows, order).withColumns({"__own": F.sum("__n").over(own.rowsBetween(Window.unboundedPreceding, 0)), "__after": after("__head", own)})
    first = F.max(F.when(F.col("__own") == n, head(F.concat("__head", "__after"))))
    each = rows.groupBy(PART).agg(F.sum("__n").alias("__n"), first.alias("__head")).withColumn("__beyond", after("__head", Window.orderBy(PART)))
    edges = offsets(each, "__n", "__beyond")
    at = F.col("__before") + F.col("__own") - n
    rows = rows.join(edges, F.col(PART) == F.col("__p")).withColumns({"__skip": F.pmod(-at, F.lit(size)), "__lacks": F.pmod(-at - n, F.lit(size))})
    groups = F.concat(F.substring("__b", (F.col("__skip") + 1).cast("int"), n.cast("int")), F.substring(F.concat("__after", "__beyond"), F.lit(1), F.col("__lacks").cast("int")))
    return rows.where(F.col("__skip") < n).select(F.col(PART).alias(RANGE), (at + F.col("__skip")).alias(position), change(groups).alias(column))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (part, end, data), in order, as compressed blocks (part, start, size, data). Chunks that are empty or null are left out."""
    now, start, held, size = None, 0, [], 0

    def block() -> pa.RecordBatch:
        data = pa.compress(b"".join(held), "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "start", "size", "data"])

    for b in batches:
        for part, end, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = chunk.as_py()
            if not data:
                continue
            if held and (part != now or size >= BLOCK):
                yield block()
                held, size = [], 0
            if not held:
                now, start = part, end - len(data)
            held.append(data)
            size += len(data)
    if held:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch], column: str, algorithm: str) -> Iterator[pa.RecordBatch]:
    """The hex digest of the blocks that _packed() made. A range's blocks are in order, after a mark of start -1 that each range has; ranges come in any order."""
    whole, now, at, due, held = hashlib.new(algorithm), None, 0, 0, {}

    def add(data: bytes, size: int) -> None:
        whole.update(pa.decompress(data, size, "zstd"))

    def turn() -> int:
        """The range whose turn it is once `now` has ended; those that had come before their turn are hashed."""
        after = due + (now == due)
        while after in held:
            for block in held.pop(after):
                add(*block)
            after += 1
        return after

    for b in batches:
        for part, start, size, data in zip(*(c.to_pylist() for c in b.columns)):
            if start < 0:
                due, now, at = turn(), part, 0
                if now != due:
                    held[now] = []
                continue
            if part != now or start != at:
                raise RuntimeError(f"digest: byte {at} of range {now} is not where it belongs")
            at += size
            if now == due:
                add(data, size)
            else:
                held[now].append((data, size))
    due = turn()
    if due != PARTS:
        raise RuntimeError(f"digest: range {due} of {PARTS} is missing")
    yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()])], names=[column])


def digest(df: DataFrame, order: list[str], column: str = "value", algorithm: str = "md5") -> DataFrame:
    """One row: the hex digest of all chunks of text or bytes, cut anywhere, as one string in order; of the empty one if there are none.

    Such a digest is one sequential pass. Each range of the order is put together in compressed blocks by a task of its own;
    one task hashes the ranges' blocks in order and holds a batch of them. A range that comes before its turn is held compressed.
    """
    rows = ranged(df.withColumn("__b", F.col(f"`{column}`").cast("binary")), order)
    own = Window.partitionBy(PART).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.coalesce(F.length("__b"), F.lit(0)).cast("bigint")).over(own)
    blocks = rows.select(F.col(PART).alias("part"), end.alias("end"), F.col("__b").alias("data")).mapInArrow(_packed, "part int, start bigint, size bigint, data binary")
    marks = df.sparkSession.range(PARTS).selectExpr("CAST(id AS INT) AS part", "-1L AS start", "0L AS size", "X'' AS data")
    dealt = blocks.union(marks).repartitionById(PARTS, F.col("part")).sortWithinPartitions("part", "start")
    return dealt.coalesce(1).mapInArrow(lambda batches: _hashed(batches, column, algorithm), T.StructType().add(column, "string"))


def charset(encoding: str) -> str:
    """The JVM's name of an encoding: utf8, utf16le, latin1 (binary) or ascii; other names pass."""
    return {"utf8": "UTF-8", "utf-8": "UTF-8", "utf16le": "UTF-16LE", "ucs2": "UTF-16LE", "latin1": "ISO-8859-1", "binary": "ISO-8859-1", "ascii": "US-ASCII"}.get(encoding.lower(), encoding)


def csv_cell(column: Column, quote: str = '"', escape: str = '"', separator: str = ",", line_ending: str = "\n", quoted: bool = False, quoted_empty: bool = False) -> Column:
    """A value as a CSV cell: quoted if it holds the quote, separator, line ending or an escape of its own, or if `quoted`. Null prints as null.

    Quotes in it get the escape in front, and so does an escape that is not the quote, so that parse_csv() reads it back.
    """
    text = F.coalesce(column.cast("string"), F.lit("null"))
    inner = F.replace(text, F.lit(escape), F.lit(escape * 2)) if escape != quote else text
    wrapped = F.concat(F.lit(quote), F.replace(inner, F.lit(quote), F.lit(escape + quote)), F.lit(quote))
    special = F.lit(quoted)
    for s in {quote, separator, line_ending, escape}:
        special = special | F.contains(text, F.lit(s))
    return F.when(text == "", F.lit(quote * 2 if quoted_empty else "")).when(special, wrapped).otherwise(text)


def csv_line(df: DataFrame, columns: list[str], separator: str = ",", line_ending: str = "\n", encoding: str = "utf8", **how) -> Column:
    """A row of these columns as CSV text with its line ending, as bytes if the encoding is not utf8; a column that df lacks prints as null."""
    cells = [csv_cell(F.col(f"`{c}`"), separator=separator, line_ending=line_ending, **how) if c in df.columns else F.lit("null") for c in columns]
    line = F.concat(F.concat_ws(separator, *cells), F.lit(line_ending))
    return line if charset(encoding) == "UTF-8" else F.encode(line, charset(encoding))


def _quoted(quote: str, escape: str) -> str:
    """A pattern of a quoted stretch. All its loops are possessive, so that a match needs no stack however long it is."""
    q, e = escape_reg_exp(quote), escape_reg_exp(escape)
    return f"{q}(?:[^{q}]++|{q}{q})*+{q}" if quote == escape else f"{q}(?:[^{q}{e}]++|{e}.)*+{q}"


def csv_cells(record: Column, separator: str = ",", quote: str = '"', escape: str = '"', fast: bool = False) -> Column:
    """The cells of a record: an array of strings. A cell that is quoted loses its quotes and escapes; fast: there are no quotes."""
    if fast:
        return F.split(record, escape_reg_exp(separator), -1)
    q, s = escape_reg_exp(quote), escape_reg_exp(separator)
    plain = f"[^{q}{s}]++" if len(separator) == 1 else f"(?:(?!{s})[^{q}])++"
    raw = F.regexp_extract_all(F.concat(record, F.lit(separator)), F.lit(f"(?s)((?:{_quoted(quote, escape)}|{plain}|{q})*+){s}"), 1)

    def bare(cell: Column) -> Column:
        inner = F.substr(cell, F.lit(2), F.length(cell) - 2)
        inner = F.replace(inner, F.lit(quote * 2), F.lit(quote)) if quote == escape else F.regexp_replace(inner, f"{escape_reg_exp(escape)}([{q}{escape_reg_exp(escape)}])", "$1")
        return F.when((F.length(cell) > 1) & F.startswith(cell, F.lit(quote)) & F.endswith(cell, F.lit(quote)), inner).otherwise(cell)

    return F.transform(raw, bare)


def parse_csv(df: DataFrame, column: str, names: list[str], separator: str = ",", quote: str = '"', escape: str = '"', fast: bool = False) -> DataFrame:
    """One record a row (its quotes may hold line feeds) to string columns; empty cells are empty strings, missing ones null, further ones left out."""
    cells = df.withColumn("__cells", csv_cells(F.col(column), separator, quote, escape, fast))
    return cells.select(*(c for c in df.columns if c != column), *(F.get("__cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def csv_records(column: Column, quote: str = '"', escape: str = '"', fast: bool = False) -> Column:
    """The records of a CSV text: line feeds, returns and both end one unless they stand in quotes; blank lines vanish.

    fast: a line feed ends a record always, and blank lines are records.
    """
    if fast:
        return F.split(F.regexp_replace(column, r"\n\z", ""), "\n", -1)
    q = escape_reg_exp(quote)
    return F.regexp_extract_all(column, F.lit(rf"(?s)((?:{_quoted(quote, escape)}|[^{q}\r\n]++|{q})++)"), 1)


def csv_rows(df: DataFrame, order: list[str], column: str, position: str, quote: str = '"', escape: str = '"', encoding: str = "utf8", fast: bool = False) -> DataFrame:
    """(position, column): the records of chunks, cut anywhere, that are one CSV text in order; positions are ascending.

    Where quotes are escaped by themselves and each control character is a byte, no task sees more than its chunks and the
    pieces of a record: the quotes of the chunks before tell whether a chunk begins within quotes, each chunk is cut at the
    line ends outside quotes, and a record's pieces meet by the count of such line ends before them. Other dialects put the
    text together in one row.
    """
    known, chunk = charset(encoding), F.col(f"`{column}`").cast("binary")
    if fast or quote != escape or known not in ("UTF-8", "ISO-8859-1", "US-ASCII"):
        parts = F.array_sort(F.collect_list(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), F.hex(chunk).alias("__chunk"))))
        whole = df.agg(F.decode(F.unhex(F.array_join(F.transform(parts, lambda p: p["__chunk"]), "")), known).alias(column))
        return whole.where(F.length(column) > 0).select(F.posexplode(csv_records(F.col(column), quote, escape, fast)).alias(position, column))
    # a letter for each byte, so that chunks may be cut within characters
    letters = F.decode(chunk, "ISO-8859-1")
    rows = df.where(chunk.isNotNull()).select(*(F.col(f"`{c}`") for c in order), letters.alias("__t"))
    rows = with_sum(rows, order, F.length("__t") - F.length(F.replace("__t", F.lit(quote), F.lit(""))), "__quotes")
    within = F.col("__quotes") % 2 == 1
    q = escape_reg_exp(quote)
    text = F.when(within, F.concat(F.lit(quote), F.col("__t"))).otherwise(F.col("__t"))
    found = F.regexp_extract_all(text, F.lit(rf"(?s)((?:{q}[^{q}]*+(?:{q}|\z)|[^{q}\r\n]++)*+(?:[\r\n]++|\z))"), 1)
    found = F.filter(found, lambda p: p != "")
    # every piece but the last ends a record
    last = F.element_at("__found", -1)
    open_end = ((F.length(last) - F.length(F.replace(last, F.lit(quote), F.lit("")))) % 2 == 1) | ~last.rlike(r"[\r\n]\z")
    rows = rows.withColumn("__found", found).withColumn("__done", F.when(F.size("__found") > 0, F.size("__found") - open_end.cast("int")).otherwise(0))
    rows = with_sum(rows, order, F.col("__done"), "__first")
    pieces = rows.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), within.alias("__in"), "__first", F.posexplode("__found").alias("__n", "__p"))
    bare = F.when(F.col("__in") & (F.col("__n") == 0), F.substr("__p", F.lit(len(quote) + 1))).otherwise(F.col("__p"))
    made = pieces.select((F.col("__first") + F.col("__n")).alias(position), F.struct(*(f"k{i}" for i in range(len(order))), "__n", bare.alias("piece")).alias("part"))
    joined = made.groupBy(position).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["piece"]), "").alias("__r"))
    record = F.decode(F.encode(F.regexp_replace("__r", r"[\r\n]++\z", ""), "ISO-8859-1"), known)
    return joined.select(position, record.alias(column)).where(F.col(column) != "")
