"""Large files read by many tasks: strict CSV, JSON lines, and XML record by record.

Spark's text source cuts a file into byte ranges (blocks) and lines.  What a
line means may depend on all lines before it: its record's number, and in CSV
whether it stands inside a quoted field.  Both follow from a number and two
states for each block, so a file is read in two passes:

1. Each block is summed up: its lines, and for either state at its start (at a
   record's start, or inside quotes) the state at its end and the number of
   records that start in it.  The sums of the blocks are put together in order.
2. With its start state and first record number known, each block is parsed on
   its own.  A record that runs over the end of a block comes out in pieces,
   which are joined by record number and parsed then.

The parsed rows are stored, and the checks of the strict reader, the numbers of
records and the cells are column expressions over them.  Results and messages
equal those of the whole-file readers in ``readers``.

The driver holds one small row for each block and file, as Spark's own listing
of files does; tables of such rows are what is broadcast here.  A quoted field
is bounded by the CSV module's field limit, so a quote that is never closed is
an error and gathers nothing.

Defined cases: an empty file is a source without content ("source is empty");
blank lines and rows of blank cells are skipped but counted; UTF-16 files,
whose lines Spark cannot tell, are refused here with SourceProblem (the
whole-file reader takes them); repeated rows are records of their own.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcast.plans.store import keep
from loomcast.sources import readers
from loomcast.sources.readers import CELLS, ENCODINGS, SourceProblem

#: Of a quoted field, what follows its opening quote, up to the closing one.
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
ROW = "source_id string, block bigint, number bigint, nth bigint, kind string, part int, cells array<string>, said string"
_FIELDS = [x.split(" ")[0] for x in ROW.split(", ")]
_ARROW = pa.schema([("source_id", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("nth", pa.int64()), ("kind", pa.string()), ("part", pa.int32()), ("cells", pa.list_(pa.string())), ("said", pa.string())])


@dataclass
class FilePlan:
    """What the tasks have to know of one file."""

    encoding: str
    note: str | None
    head: str  # the first line that is not blank
    delimiter: bytes = b","
    starts: dict[int, tuple[bool, int]] = field(default_factory=dict)  # block -> (inside quotes, records before it)


def lines_of(spark: SparkSession, paths, separator: str = "\n") -> DataFrame:
    """``source_id, block, value``: every line as bytes, with the file and the byte at which its block starts."""
    text = spark.read.option("lineSep", separator).text(paths)
    return text.select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), "value")


def _undefined() -> str:
    """A pattern of the bytes that Windows-1252 leaves undefined, as hexadecimal pairs."""
    odd = []
    for b in range(128, 256):
        try:
            bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            odd.append(f"{b:02X}")
    return "^(?:..)*?(?:" + "|".join(odd) + ")"


def survey(lines: DataFrame) -> dict[str, FilePlan]:
    """Encoding and first line of each file; one aggregate, a row for each file."""
    text = F.col("value")
    whole = F.is_valid_utf8(text)
    filled = ~F.coalesce(F.make_valid_utf8(text), F.lit("")).rlike(r"(?U)\A[\s\x1c-\x1f﻿]*\z")
    place = F.struct("block", "at")
    found = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("source_id").agg(
        F.bool_and(whole).alias("utf8"),
        F.bool_or(F.when(~whole, F.hex(text.cast("binary")).rlike(_undefined())).otherwise(F.lit(False))).alias("undefined"),
        F.min_by(F.when(filled, text.cast("binary")), F.when(filled, place)).alias("head"),
        F.min_by(F.substring(text.cast("binary"), 1, 2), place).alias("mark"),
    )
    out = {}
    for r in found.collect():
        if bytes(r.mark or b"") in (b"\xff\xfe", b"\xfe\xff"):
            raise SourceProblem(f"{r.source_id} is UTF-16 encoded; only the whole-file reader takes it")
        names = list(ENCODINGS)
        name = names[0] if r.utf8 else names[2] if r.undefined else names[1]
        out[r.source_id] = FilePlan("utf-8" if r.utf8 else name, ENCODINGS[name], bytes(r.head or b"").decode(name, "replace"))
    return out


def opened_at(line: bytes, inside: bool, delimiter: bytes) -> int:
    """Where in a line the quoted field begins that is open after it: 0 if it was open before, -1 if none is."""
    at = 0
    while True:
        if inside or line[at : at + 1] == b'"':
            closed = _REST.match(line, at if inside else at + 1)
            if not closed:
                return at if inside else at + 1
            at, inside = closed.end(), False
        at = line.find(delimiter, at) + 1
        if not at:
            return -1


def inside_after(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted field is open after a line, given whether one is before it."""
    return opened_at(line, inside, delimiter) >= 0


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, block, its lines) in order; a block lies in one task."""

    def rows() -> Iterator[tuple[str, int, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True)

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        name, block = ahead[:2]

        def own() -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == (name, block):  # noqa: B023
                line = ahead[2]
                ahead = next(source, None)
                yield line

        lines = own()
        yield name, block, lines
        for _ in lines:  # what was not asked for
            pass


def _sum_up(plans):
    """For each block: records that start in it, and the state at its end, for both states at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, lines in _by_block(batches):
            d = plans.value[name].delimiter
            states, counts = [False, True], [0, 0]
            for line in lines:
                quoted = b'"' in line
                for k in (0, 1):
                    counts[k] += not states[k]
                    if quoted:
                        states[k] = inside_after(line, states[k], d)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([block], pa.int64()), *(pa.array([x]) for x in (*states, *counts))], names=["source_id", "block", "end_out", "end_in", "n_out", "n_in"])

    return run


def place_blocks(lines: DataFrame, files: dict[str, FilePlan]) -> None:
    """Give each block its start state and the number of records before it."""
    spark = lines.sparkSession
    sent = spark.sparkContext.broadcast(files)
    sums = lines.mapInArrow(_sum_up(sent), "source_id string, block bigint, end_out boolean, end_in boolean, n_out bigint, n_in bigint").collect()
    state: dict[str, tuple[bool, int]] = {}
    for r in sorted(sums, key=lambda r: (r.source_id, r.block)):
        inside, before = state.get(r.source_id, (False, 0))
        files[r.source_id].starts[r.block] = (inside, before)
        state[r.source_id] = (r.end_in, before + r.n_in) if inside else (r.end_out, before + r.n_out)
    sent.unpersist()


def parse_record(text: str, delimiter: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([text], delimiter=delimiter), [])]


def _parse(plans):
    """Rows of each block: ``row`` (parsed), ``piece`` (part of a record that crosses a block's end), ``invalid``."""

    def of_block(name: str, block: int, lines: Iterator[bytes]) -> Iterator[tuple]:
        plan: FilePlan = plans.value[name]
        inside, number = plan.starts[block]
        d, limit, nth = plan.delimiter.decode(), csv.field_size_limit(), 0
        held: list[bytes] = []
        size = 0  # bytes of the quoted field that is open
        foreign, first, lost = inside, block == 0, False  # foreign: the record at hand began in another block; lost: a field of it is too long

        def piece(part: int) -> tuple:
            return name, block, number, None if part else nth + 1, "piece", part, None, b"\n".join(held).decode(plan.encoding)

        for line in lines:
            if first:
                line, first = line.removeprefix(b"\xef\xbb\xbf") if plan.encoding == "utf-8" else line, False
            if not held and not foreign:
                number += 1
            held.append(line)
            opened = opened_at(line, inside, plan.delimiter) if b'"' in line else 0 if inside else -1
            size = 0 if opened < 0 else size + len(line) + 1 if inside and opened == 0 else len(line) - opened + 1
            inside = opened >= 0
            if inside:
                if size > 4 * limit + 4 and not lost:  # more than the limit in any encoding
                    yield name, block, number, None, "invalid", 0, None, f"source is not valid CSV: field larger than field limit ({limit})"
                    lost = True
                if lost:
                    held = held[:1]
                continue
            if lost:
                foreign = False
            elif foreign:
                yield piece(1)
                foreign = False
            else:
                try:
                    cells = parse_record(b"\n".join(held).decode(plan.encoding) + "\n", d)
                except csv.Error as e:
                    yield name, block, number, None, "invalid", 0, None, f"source is not valid CSV: {e}"
                    cells = []
                if cells:
                    nth += any(cells)
                    yield name, block, number, nth if any(cells) else None, "row", 0, cells, None
            held, lost = [], False
        if held and not lost:
            yield piece(1 if foreign else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for name, block, lines in _by_block(batches):
            for row in of_block(name, block, lines):
                rows.append(row)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in rows], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in rows], schema=_ARROW)

    return run


def _join_pieces(pieces: DataFrame, plans) -> DataFrame:
    """Records that cross the ends of blocks, put together and parsed."""
    each = pieces.groupBy("source_id", "number").agg(
        F.min("block").alias("block"), F.max("nth").alias("nth"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "said"))), lambda p: p["said"]), "\n").alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                kind, cells, said = "row", [], None
                try:
                    cells = parse_record(r["said"] + "\n", plans.value[r["source_id"]].delimiter.decode())
                except csv.Error as e:
                    kind, cells, said = "invalid", None, f"source is not valid CSV: {e}"
                if cells or said:
                    out.append({**r, "kind": kind, "part": 0, "cells": cells, "said": said, "nth": r["nth"] if cells and any(cells) else None})
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in _FIELDS} for r in out], schema=_ARROW)

    return each.mapInArrow(run, ROW)


def parse_csv(spark: SparkSession, paths, delimiter: str | None = None) -> tuple[DataFrame, dict[str, FilePlan]]:
    """Stored rows of strict CSV files (see ``ROW``) and what is known of the files."""
    lines = lines_of(spark, paths)
    files = survey(lines)
    for plan in files.values():
        plan.delimiter = (delimiter or readers.best_delimiter(plan.head)).encode()
    place_blocks(lines, files)
    sent = spark.sparkContext.broadcast(files)
    parsed = keep(lines.mapInArrow(_parse(sent), ROW), "csv_rows")
    joined = _join_pieces(parsed.where("kind = 'piece'"), sent)
    return keep(parsed.where("kind <> 'piece'").unionByName(joined), "csv_records"), files


def _header_plan(header: list[str]) -> tuple[list[str], list[str], list[str] | None, str | None]:
    """(header, problems that it has, the path of each named column in order, why no record can be flattened)."""
    while header and not header[-1]:
        header = header[:-1]
    problems = [f"duplicate column '{h}'" for h in dict.fromkeys(header) if h and header.count(h) > 1]
    try:
        return header, problems, list(readers.flatten({h: "" for h in header if h})), None
    except (ValueError, RecursionError) as e:
        return header, problems, None, str(e)


def read_csv_files(spark: SparkSession, paths, delimiter: str | None = None) -> DataFrame:
    """Cells of strict CSV files of any size; equal to ``readers.read_sources`` with format csv."""
    rows, files = parse_csv(spark, paths, delimiter)
    empty = [n for n, p in files.items() if not p.head]
    firsts = rows.where("kind = 'row'").groupBy("source_id").agg(F.min("number").alias("number"))
    heads = {r.source_id: (r.number, *_header_plan(list(r.cells))) for r in rows.join(F.broadcast(firsts), ["source_id", "number"]).where("kind = 'row'").collect()}
    table = spark.createDataFrame(
        [(n, at, header, paths_, unfit) for n, (at, header, _, paths_, unfit) in heads.items()],
        "source_id string, head_number bigint, header array<string>, paths array<string>, unfit string")
    body = rows.where("kind = 'row' and nth is not null").join(F.broadcast(table), "source_id").where("number > head_number")

    # the strict checks
    width, size, row = F.size("header"), F.size("cells"), F.col("number").cast("string")
    beyond = F.when(F.exists(F.slice("cells", width + 1, F.greatest(size - width, F.lit(0))), lambda v: v != ""), F.concat(F.lit("row "), row, F.lit(": value(s) beyond the "), width.cast("string"), F.lit(" header column(s)")))
    short = F.when(size < width, F.concat(F.lit("row "), row, F.lit(" has "), size.cast("string"), F.lit(" value(s) but the header has "), width.cast("string")))
    lost = F.transform(F.arrays_zip(F.slice("cells", 1, width).alias("v"), F.slice("header", 1, size).alias("h")), lambda x, i: F.when(
        (x["h"] == "") & (x["v"] != ""), F.concat(F.lit("row "), row, F.lit(": value '"), x["v"], F.lit("' in column "), (i + 1).cast("string"), F.lit(", which has no header"))))
    faults = body.select("source_id", "number", F.posexplode(F.array_compact(F.concat(F.array(beyond, short), lost))).alias("seq", "said"))
    ten = faults.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("number", "seq"))).where("place <= 10")
    told: dict[str, list[str]] = {}
    for r in ten.orderBy("source_id", "place").collect():
        told.setdefault(r.source_id, []).append(r.said)
    broken = {r.source_id: r.said for r in rows.where("kind = 'invalid'").groupBy("source_id").agg(F.min_by("said", "number").alias("said")).collect()}
    # numbers of records: those of the block's earlier blocks, and the place in it; the header is the first
    counted = rows.where("nth is not null").groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = {}, []
    for r in sorted(counted, key=lambda r: (r.source_id, r.block)):
        offsets.append((r.source_id, r.block, before.get(r.source_id, 0)))
        before[r.source_id] = before.get(r.source_id, 0) + r.n
    errors = {}
    for n in files:
        problems = (heads[n][2] if n in heads else []) + told.get(n, [])
        errors[n] = (
            "source is empty" if n in empty else broken.get(n) if n in broken else "CSV contains no data rows" if n not in heads else "CSV header row has no column names" if not any(heads[n][1])
            else "CSV would lose or mis-assign data: " + "; ".join(problems[:10]) if problems else "CSV contains no data rows" if before.get(n, 0) < 2 else None)
    numbered = spark.createDataFrame([o for o in offsets if errors[o[0]] is None], "source_id string, block bigint, base bigint")
    sound = body.join(F.broadcast(numbered), ["source_id", "block"]).withColumn("rec", F.col("base") + F.col("nth") - 1)

    # cells
    named = F.filter(F.arrays_zip(F.col("header").alias("h"), F.slice("cells", 1, width).alias("v")), lambda x: x["h"] != "")
    cells = F.arrays_zip(F.col("paths").alias("key"), F.transform(named, lambda x: x["v"]).alias("text"))
    null = lambda t: F.lit(None).cast(t)
    good = sound.where("unfit is null").select("source_id", "rec", F.posexplode(cells).alias("ord", "c")).select(
        "source_id", F.lit("csv").alias("format"), "rec", null("int").alias("line"), "ord", null("string").alias("container"), "c.key", F.lit("string").alias("kind"), "c.text")
    unfit = sound.where("unfit is not null").select(
        "source_id", F.lit("csv").alias("format"), "rec", null("int").alias("line"), F.lit(0).alias("ord"), null("string").alias("container"), null("string").alias("key"), F.lit("record_error").alias("kind"), F.col("unfit").alias("text"))
    return good.unionByName(unfit).unionByName(_file_rows(spark, "csv", files, errors))


def _file_rows(spark: SparkSession, fmt: str, files: dict[str, FilePlan], errors: dict[str, str | None]) -> DataFrame:
    """The cells that say something of whole files."""
    rows = [(n, fmt, 0, None, 0, None, None, "source_error", e) for n, e in errors.items() if e]
    rows += [(n, fmt, 0, None, 1, None, None, "source_note", p.note) for n, p in files.items() if p.note]
    return spark.createDataFrame(rows, CELLS)


# ---- one record a line -------------------------------------------------------------------------------------
def _records(spark: SparkSession, lines: DataFrame, fmt: str, files: dict[str, FilePlan], read: Callable[[str, int, FilePlan], object]) -> DataFrame:
    """Cells of files whose lines (or pieces) are records, numbered from 1; ``read`` makes a record of a line, raises
    ValueError where it cannot, and returns None where there is none."""
    filled = ~F.coalesce(F.make_valid_utf8("value"), F.lit("")).rlike(r"(?U)\A[\s\x1c-\x1f﻿]*\z")
    state: dict[str, int] = {}
    for r in sorted(lines.groupBy("source_id", "block").agg(F.count_if(filled).alias("n")).collect(), key=lambda r: (r.source_id, r.block)):
        files[r.source_id].starts[r.block] = (False, state.get(r.source_id, 0))
        state[r.source_id] = state.get(r.source_id, 0) + r.n
    sent = spark.sparkContext.broadcast(files)
    names = [c.split(" ")[0] for c in CELLS.split(", ")]
    types = pa.schema([("source_id", pa.string()), ("format", pa.string()), ("rec", pa.int64()), ("line", pa.int32()), ("ord", pa.int32()), ("container", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for name, block, own in _by_block(batches):
            plan: FilePlan = sent.value[name]
            number = plan.starts[block][1]
            for raw in own:
                text = raw.decode(plan.encoding).removeprefix("﻿")
                if not text.strip():
                    continue
                number += 1
                try:
                    record = read(text, number, plan)
                except ValueError as e:
                    out.append((name, fmt, number, None, 0, None, None, "source_error", str(e)))
                    continue
                if record is not None:
                    out += [(name, fmt, *map(readers._sound, r)) for r in readers.record_cells(record, number)]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=types)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=types)

    cells = keep(lines.mapInArrow(run, CELLS), f"{fmt}_cells")
    errors = {r.source_id: r.text for r in cells.where("kind = 'source_error'").groupBy("source_id").agg(F.min_by("text", "rec").alias("text")).collect()}
    errors |= {n: "source is empty" for n, p in files.items() if not p.head}
    return cells.where(~F.col("source_id").isin(list(errors))).unionByName(_file_rows(spark, fmt, files, errors))


def read_json_lines(spark: SparkSession, paths) -> DataFrame:
    """Cells of files with one JSON value a line; a line that is no JSON makes its source unreadable."""
    lines = lines_of(spark, paths)

    def read(text: str, number: int, plan: FilePlan) -> object:
        try:
            return json.loads(text)
        except (ValueError, RecursionError) as e:
            raise SourceProblem(f"source is not valid JSON: record {number}: {e}") from e

    return _records(spark, lines, "json", survey(lines), read)


# ---- one XML record a piece ----------------------------------------------------------------------------------
_MARKUP = re.compile(r"<!--.*?-->|<\?.*?\?>", re.S)
_PROLOG = re.compile(r"\A\ufeff?\s*(?:(?:<!--.*?-->|<\?.*?\?>)\s*)*", re.S)
_START = re.compile(r"<([^\s<>/!?]+)((?:\s+[^\s=<>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*>")
_NAMESPACE = re.compile(r"""\sxmlns(?::[^\s=]+)?\s*=\s*(?:"[^"]*"|'[^']*')""")
_DECLARED = re.compile(r"""\A\s*<\?xml\b[^>]*?\bencoding\s*=\s*["'](?!utf-?8["'])""", re.I)


@dataclass
class XmlPlan:
    """How the records of an XML file are found."""

    tag: str
    root: str
    names: str  # the root's namespaces, as written
    plan: FilePlan | None = None


class NotByRecord(ValueError):
    """This XML file is not a plain list of records."""


def xml_plan(spark: SparkSession, path: str, hints: frozenset) -> XmlPlan:
    """The tag of the records, from the start of the file: that of the root's first child."""
    start = lines_of(spark, [path], ">").where("block = 0").select("value").limit(200).collect()
    head = ">".join(str(r.value) for r in start)
    text = head[_PROLOG.match(head).end() :]
    if _DECLARED.match(head) or text[:9].upper() == "<!DOCTYPE":
        raise NotByRecord(path)
    root = _START.match(text)
    first = re.match(r"[^<]*<([^\s<>/!?]+)", _MARKUP.sub("", text[root.end() :])) if root else None
    if not first or _NAMESPACE.sub("", root[2]).strip() or readers.squash_py(root[1].rpartition(":")[2]) in hints:
        raise NotByRecord(path)
    return XmlPlan(first[1], root[1], "".join(_NAMESPACE.findall(root[2])))


def xml_children(piece: str, xml: XmlPlan, hints: frozenset, first: bool) -> tuple[list, bool]:
    """The records in a piece, as the whole-file reader would have them, and whether the root ends with it."""
    if first:
        piece = piece[_PROLOG.match(piece).end() :]
        root = _START.match(piece)
        if not root:
            raise NotByRecord("no root")
        piece = piece[root.end() :]
    body, closed, _ = piece.rpartition(f"</{xml.root}>") if re.search(rf"</{re.escape(xml.root)}\s*>\s*(?:<!--.*?-->\s*)*\Z", piece, re.S) else (piece, "", "")
    if not closed:
        if not piece.strip():
            return [], False
        body = f"{piece}</{xml.tag}>" if re.search(rf"<{re.escape(xml.tag)}[\s>/]", piece) else piece
    parser = readers.ElementTree.XMLParser(target=readers._Values(hints), encoding="utf-8")
    try:
        parser.feed(f"<_{xml.names}>{body}</_>".encode("utf-8", "replace"))
        _, value = parser.close()
    except (readers.ElementTree.ParseError, RecursionError, IndexError, ValueError) as e:
        raise NotByRecord(str(e)) from e
    if isinstance(value, list):
        records = value
    elif isinstance(value, dict) and len(value) == 1:
        (found,) = value.values()
        records = [found]
        if next(iter(value)) != xml.tag.rpartition(":")[2]:
            raise NotByRecord(f"a child other than {xml.tag}")
    elif isinstance(value, str):  # no child at all
        records = []
    else:
        raise NotByRecord(f"children other than {xml.tag}")
    return records, bool(closed)


def read_xml_records(spark: SparkSession, path: str, hints: frozenset = frozenset()) -> DataFrame:
    """Cells of one XML file that is a plain list of records: a root without attributes whose children all bear one name.

    The file is cut at the closing tags of its records and each piece is
    parsed under the root's namespaces.  A file of another form (attributes
    at the root, children of several names, records that hold their own tag,
    a single record, other encodings, document types) raises NotByRecord;
    the whole-file reader says what it is.
    """
    xml = xml_plan(spark, path, hints)
    pieces = lines_of(spark, [path], f"</{xml.tag}>")
    files = survey(pieces)
    (name, plan), = files.items()
    sent = spark.sparkContext.broadcast((xml, plan, hints))
    names = [c.split(" ")[0] for c in CELLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, file, named = sent.value
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["block", *names])

        for source, block, own in _by_block(batches):
            nth, closed = 0, False
            for at, raw in enumerate(own):
                try:
                    if closed and raw.strip():
                        raise NotByRecord("something follows the root")
                    records, ends = xml_children(raw.decode(file.encoding), how, named, at == 0 and block == 0)
                    closed = closed or ends
                except NotByRecord as e:
                    out.append((block, source, "xml", 0, None, 0, None, None, "unfit", str(e)))
                    break
                for record in records:
                    nth += 1
                    out += [(block, source, "xml", *map(readers._sound, r)) for r in readers.record_cells(record, nth)]
                if len(out) >= 10_000:
                    yield batch()
                    out = []
            out.append((block, source, "xml", nth, None, 0, None, None, "counted", str(closed)))
        if out:
            yield batch()

    cells = keep(pieces.mapInArrow(run, "block bigint, " + CELLS), "xml_cells")
    unfit = cells.where("kind = 'unfit'").select("text").limit(1).collect()
    total, bases = 0, []
    blocks = sorted(cells.where("kind = 'counted'").select("block", "rec", "text").collect())
    for r in blocks:
        bases.append((r.block, total))
        total += r.rec
    if unfit or total < 2 or [r.text for r in blocks] != [*["False"] * (len(blocks) - 1), "True"]:
        raise NotByRecord(f"{path}: {unfit[0].text if unfit else 'not several records'}")
    base = spark.createDataFrame(bases, "block bigint, base bigint")
    good = cells.where("kind <> 'counted'").join(F.broadcast(base), "block").withColumn("rec", F.col("rec") + F.col("base")).select(*names)
    return good.unionByName(_file_rows(spark, "xml", {name: plan}, {}))


# ---- which reader ----------------------------------------------------------------------------------------------
def read_paths(spark: SparkSession, path, fmt: str | None = None, delimiter: str | None = None, hints: frozenset = frozenset(), large: int | None = None) -> DataFrame:
    """Cells of every file under ``path``.  Files over ``large`` bytes (one block of Spark's text source) are read by many
    tasks where their form allows it, JSON lines (.jsonl, .ndjson) always; the cells are the same either way."""
    if large is None:
        large = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    lines = [p for p, _ in files if fmt in (None, "json") and p.lower().endswith((".jsonl", ".ndjson"))]
    big = [p for p, n in files if n > large and p not in lines]
    csvs = [p for p in big if fmt == "csv" or (fmt is None and p.lower().endswith(".csv"))]
    parts = [read_json_lines(spark, lines)] if lines else []
    if csvs:
        try:
            parts.append(read_csv_files(spark, csvs, delimiter))
        except SourceProblem:  # UTF-16 among them
            csvs = []
    done = {*lines, *csvs}
    for p in (p for p in big if fmt == "xml" or (fmt is None and p.lower().endswith(".xml"))):
        try:
            parts.append(read_xml_records(spark, p, hints))
            done.add(p)
        except (NotByRecord, SourceProblem):
            pass
    rest = [p for p, _ in files if p not in done]
    if rest or not parts:
        parts.append(readers.read_sources(spark, path if len(rest) == len(files) else rest, fmt, delimiter, hints))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
