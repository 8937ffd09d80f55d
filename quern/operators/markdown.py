"""Markdown read into blocks: front matter, headings with their sections, and where each block stands.

Lines are read once by a state machine; headings are kept on a stack, so the end of a section (the next heading of the
same or a higher rank, or the end of the text) and the path of titles above a block follow in the same pass. Blocks are
spans of the text, from 0, in code points; lines end at line feeds, a carriage return before one belongs to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r" {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|$)")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
SETTING = re.compile(r"([A-Za-z_][\w.-]*)[ \t]*:(?:[ \t]+(.*))?$")

#: (kind, level, title, start, end): kinds are heading, paragraph, code, table, list, quote and rule.
Block = tuple[str, int, str, int, int]


def _plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def front_matter(text: str) -> tuple[dict[str, list[str]], int]:
    """Settings between lines of three hyphens at the start of a text, and where the text goes on; none: nothing and 0.

    A value is a list of strings: one, those in brackets, or those of the items below its name. Without the closing
    line there is no front matter; lines of another form are left out.
    """
    lines = text.splitlines(keepends=True) if text.startswith("---") else []
    if not lines or lines[0].strip() != "---":
        return {}, 0
    found: dict[str, list[str]] = {}
    at, name = len(lines[0]), None
    for line in lines[1:]:
        at += len(line)
        said = line.strip()
        if said in ("---", "..."):
            return found, at
        if said.startswith("- ") and name is not None:
            found[name].append(_plain(said[2:]))
        elif m := SETTING.match(line.rstrip()):
            name, value = m[1], (m[2] or "").strip()
            if value.startswith("[") and value.endswith("]"):
                found[name] = [_plain(v) for v in value[1:-1].split(",") if v.strip()]
            else:
                found[name] = [_plain(value)] if value else []
    return {}, 0


def _title(said: str) -> str:
    return re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", said.strip()).strip()


def blocks(text: str, start: int = 0) -> list[Block]:
    """Blocks of a text from a place on, in order; blank lines between them belong to none."""
    out: list[Block] = []
    kind, begun, ended = "", 0, 0  # of the block that is open
    fence = ""

    def close() -> None:
        nonlocal kind
        if kind:
            out.append((kind, 0, "", begun, ended))
        kind = ""

    def single(block: str, level: int, title: str, s: int, e: int) -> None:
        close()
        out.append((block, level, title, s, e))

    at, lines = start, text[start:].split("\n")
    for i, line in enumerate(lines):
        here, at = at, at + len(line) + 1
        line = line.removesuffix("\r")
        end = here + len(line)
        if fence:
            ended = end
            closing = FENCE.match(line)
            if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence) and not closing[2].strip():
                fence = ""
                close()
            continue
        blank = not line.strip()
        if kind == "list" and (blank or line[:1] in " \t"):
            # What is indented goes on with the list, also after blank lines.
            ended = ended if blank else end
            continue
        if blank:
            close()
        elif m := FENCE.match(line):
            close()
            kind, begun, ended, fence = "code", here, end, m[1]
        elif m := HEADING.match(line):
            single("heading", len(m[1]), _title(m[2] or ""), here, end)
        elif kind == "paragraph" and (m := UNDERLINE.match(line)):
            title = " ".join(text[begun:ended].split())
            kind = ""
            single("heading", 1 if m[1][0] == "=" else 2, title, begun, end)
        elif RULE.match(line):
            single("rule", 0, "", here, end)
        elif line.lstrip().startswith(">"):
            if kind != "quote":
                close()
                kind, begun = "quote", here
            ended = end
        elif ITEM.match(line):
            if kind != "list":
                close()
                kind, begun = "list", here
            ended = end
        elif kind == "table" and "|" in line:
            ended = end
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and TABLE_RULE.match(lines[i + 1].removesuffix("\r")):
            close()
            kind, begun, ended = "table", here, end
        else:
            if kind not in ("paragraph", "list", "quote"):  # these two go on in a lazy line
                close()
                kind, begun = "paragraph", here
            ended = end
    close()
    return out


def sections(found: list[Block], size: int) -> list[tuple[int, list[str]]]:
    """For each block the end of its section (of a heading; else of the block) and the titles above it, outermost first."""
    ends = [end for *_, end in found]
    paths: list[list[str]] = []
    open_: list[int] = []
    for i, (kind, level, _, start, _) in enumerate(found):
        if kind == "heading":
            while open_ and found[open_[-1]][1] >= level:
                ends[open_.pop()] = start
        paths.append([found[j][2] for j in open_])
        if kind == "heading":
            open_.append(i)
    for i in open_:
        ends[i] = size
    return list(zip(ends, paths))


_ROW = pa.struct([
    ("position", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("title", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()),
    ("section_end", pa.int64()), ("path", pa.list_(pa.string())), ("chunk", pa.string()),
])
ROW = "array<struct<position: long, kind: string, level: int, title: string, char_start: long, char_end: long, section_end: long, path: array<string>, chunk: string>>"


def _rows(texts: list[str | None]) -> pa.Array:
    """Lists of rows of ROW, one for each text, column by column."""
    columns: list[list] = [[] for _ in _ROW]
    position, kind, level, title, start, end, until, path, chunk = columns
    ends = [0]
    for t in texts:
        found = blocks(t, front_matter(t)[1]) if t else []
        if found:
            for own, values in zip((kind, level, title, start, end), zip(*found)):
                own += values
            for own, values in zip((until, path), zip(*sections(found, len(t)))):
                own += values
            position += range(len(found))
            chunk += [t[s:e] for _, _, _, s, e in found]
        ends.append(len(position))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW)], fields=list(_ROW)))


def outline(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each block of a text: df's other columns and those of ROW; columns of df with these names are replaced.

    Front matter is no block. Null and blank texts have no rows; unclosed fences end with the text.
    """

    @F.arrow_udf(ROW)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield _rows(batch.slice(at, 256).to_pylist())

    names = {f.name for f in _ROW}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names and c != text]
    # Else explode's filter on the size would read each text once more.
    read = read.asNondeterministic()
    return df.select(*kept, read(F.col(text)).alias("__blocks")).select(*kept, F.explode("__blocks").alias("__block")).select(*kept, "__block.*")


def settings(df: DataFrame, text: str = "text", name: str = "settings") -> DataFrame:
    """df with a map of its front matter; empty without one. A column of that name is replaced."""

    @F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([list(front_matter(t)[0].items()) if t else [] for t in batch.to_pylist()], pa.map_(pa.string(), pa.list_(pa.string())))

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    return df.select(*kept, read(F.col(text)).alias(name))
