"""The text of PDF files. A task reads a file's text runs with their places; lines and pages are put together by Spark.

Read are plain and Flate streams, object streams, pages in the order of their tree, the text operators with their matrices,
one-byte fonts (as Latin text) and fonts that tell their characters (ToUnicode). A file without text, that is encrypted or that
can't be read is a row with its problem.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X

NO_TEXT = "The selected PDF does not appear to contain extractable text. If it is a scanned PDF, run OCR before importing it."
#: Widths of a character that isn't told, and of the gaps that part words and lines, as shares of the font's size.
CHARACTER, WORD_GAP, LINE_GAP = 0.5, 0.2, 0.5
#: Bytes that a stream may unpack to.
MOST_BYTES = 1 << 28

_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})\s+[0-9]{1,5}\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:(\((?:[^()\\]++|\\[\s\S]|\([^()]*+\))*+\))|<<|>>|(<[0-9A-Fa-f\s]*+>)|(/[^\s<>\[\]()/%]*+)|([+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++))|([\[\]])|([A-Za-z'\"*][A-Za-z0-9*]*+)|%[^\r\n]*+|\S)")
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}


def _objects(data: bytes) -> dict[int, bytes]:
    """Number to body of all objects, those in object streams too; of a number that repeats the last one counts."""
    starts = [(int(m[1]), m.end(), m.start()) for m in _OBJECT.finditer(data)]
    found = {}
    for k, (number, begin, _) in enumerate(starts):
        end = starts[k + 1][2] if k + 1 < len(starts) else len(data)
        found[number] = data[begin:end]
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body.partition(b"stream")[0]):
            inner = _stream(body)
            first = int((re.search(rb"/First\s+(\d+)", body) or [0, 0])[1])
            numbers = list(map(int, re.findall(rb"\d+", inner[:first])))
            offsets = [first + o for o in numbers[1::2]] + [len(inner)]
            for number, a, b in zip(numbers[::2], offsets, offsets[1:]):
                found.setdefault(number, inner[a:b])
    return found


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    raw = body[m.end() : (body.rfind(b"endstream") if b"endstream" in body else len(body))]
    if re.search(rb"/FlateDecode\b", body[: m.start()]):
        return zlib.decompressobj().decompress(raw, MOST_BYTES)
    return raw


def _refs(key: bytes, body: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[int]:
    """The pages in the order of their tree; without one as they are numbered."""
    is_page = lambda b: re.search(rb"/Type\s*/Page(?![A-Za-z])", b)
    kids = {n: _refs(b"Kids", b) for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b)}
    below = {k for ks in kids.values() for k in ks}
    out, todo, seen = [], [n for n in reversed(sorted(kids)) if n not in below], set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in kids:
            todo += reversed(kids[n])
        elif n in objects and is_page(objects[n]):
            out.append(n)
    return out or sorted(n for n, b in objects.items() if is_page(b))


def _cmap(data: bytes) -> dict[int, str]:
    """Code to characters of a ToUnicode table."""
    chars = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): chars(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            start, low = int(a, 16), chars(c)
            out |= {start + k: low[:-1] + chr(ord(low[-1]) + k) for k in range(min(int(b, 16) - start + 1, 1 << 16))}
    return out


def _fonts(objects: dict[int, bytes], page: bytes) -> dict[bytes, dict[int, str]]:
    """The characters of each font of a page that tells them."""
    places = [page, *(objects.get(n, b"") for n in _refs(b"Resources", page))]
    places += [objects.get(n, b"") for p in list(places) for n in _refs(b"Font", p)]
    fonts = {}
    for p in places:
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", p):
            for to in _refs(b"ToUnicode", objects.get(int(n), b"")):
                fonts[name] = _cmap(_stream(objects.get(to, b"")))
    return fonts


def _literal(token: bytes) -> bytes:
    out = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    out = re.sub(rb"\\\r?\n", b"", out)
    return re.sub(rb"\\([\s\S])", lambda m: _ESCAPES.get(m[1], m[1].decode("latin-1")).encode("latin-1"), out)


def _shown(raw: bytes, font: dict[int, str] | None) -> str:
    if not font:
        return raw.decode("cp1252", "replace")
    wide = max(font) > 255
    codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)] if wide else raw
    return "".join(font.get(c, "") for c in codes)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def runs(content: bytes, fonts: dict[bytes, dict[int, str]]) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of the text that a content stream shows."""
    ctm, saved, stack = (1, 0, 0, 1, 0, 0), [], []
    tm = line = (1, 0, 0, 1, 0, 0)
    size, leading, font = 1.0, 0.0, None
    listed: list | None = None
    for m in _TOKEN.finditer(content):
        literal, hexed, name, number, bracket, op = m.groups()
        if bracket:
            if bracket == b"[":
                listed = []
            elif listed is not None:
                stack.append(listed)
                listed = None
            continue
        if op is None:
            value = _literal(literal) if literal else bytes.fromhex(re.sub(rb"\s", b"", hexed[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", hexed[1:-1])) % 2)) if hexed else name[1:] if name else float(number) if number else None
            if value is not None:
                (stack if listed is None else listed).append(value)
            continue
        numbers = [x for x in stack if isinstance(x, float)]
        if op == b"q":
            saved.append(ctm)
        elif op == b"Q" and saved:
            ctm = saved.pop()
        elif op == b"cm" and len(numbers) >= 6:
            ctm = _times(tuple(numbers[-6:]), ctm)
        elif op == b"BT":
            tm = line = (1, 0, 0, 1, 0, 0)
        elif op == b"Tf" and numbers:
            size, font = numbers[-1], fonts.get(next((x for x in stack if isinstance(x, bytes)), b""))
        elif op == b"TL" and numbers:
            leading = numbers[-1]
        elif op == b"Tm" and len(numbers) >= 6:
            tm = line = tuple(numbers[-6:])
        elif op in (b"Td", b"TD") and len(numbers) >= 2:
            leading = -numbers[-1] if op == b"TD" else leading
            tm = line = _times((1, 0, 0, 1, *numbers[-2:]), line)
        elif op in (b"T*", b"'", b'"'):
            tm = line = _times((1, 0, 0, 1, 0, -leading), line)
        if op in (b"Tj", b"'", b'"', b"TJ") and stack:
            parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
            text = "".join(_shown(p, font) if isinstance(p, bytes) else " " if p < -1000 * WORD_GAP else "" for p in parts)
            at = _times(tm, ctm)
            height = size * (abs(at[3]) or abs(at[1]) or 1)
            if text.strip():
                yield at[4], at[5], height, text
            moved = len(text) * CHARACTER * size
            tm = _times((1, 0, 0, 1, moved, 0), tm)
        stack = []


def _read(content: bytes) -> list[tuple[int, float, float, float, str]]:
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    objects = _objects(content)
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content[-4096:]):
        raise ValueError("the PDF is encrypted")
    out = []
    for k, n in enumerate(_pages(objects)):
        page = objects[n]
        text = b"\n".join(_stream(objects.get(c, b"")) for c in _refs(b"Contents", page))
        out += [(k, *r) for r in runs(text, _fonts(objects, page))]
    return out


def text_runs(files: DataFrame) -> DataFrame:
    """path, page (from 0), x, y, size, text of the runs in files (path, content); of a file without any one row with its problem."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    found, problem = _read(bytes(content or b"")), NO_TEXT
                except (ValueError, zlib.error, IndexError) as e:
                    found, problem = [], f"The selected PDF could not be read: {e}."
                rows = [(path, *r, None) for r in found] or [(path, None, None, None, None, None, problem)]
                yield pd.DataFrame(rows, columns=["path", "page", "x", "y", "size", "text", "problem"]).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, page long, x double, y double, size double, text string, problem string")


def pdf_texts(files: DataFrame) -> DataFrame:
    """Path, text, problem of files (path, content): lines from top to bottom, each from left to right; pages parted by a form feed."""
    found = text_runs(files).withColumn("text", F.replace("text", F.lit("\0"), F.lit("")))
    down = Window.partitionBy("path", "page").orderBy(F.desc("y"), "x")
    starts = F.coalesce(F.lag("y").over(down) - F.col("y") > LINE_GAP * F.col("size"), F.lit(False)).cast("int")
    lines = found.where("problem is null").withColumn("starts", starts).withColumn("line", F.sum("starts").over(down))
    across = Window.partitionBy("path", "page", "line").orderBy("x")
    end = F.col("x") + F.length("text") * CHARACTER * F.col("size")
    apart = F.col("x") - F.lag(end).over(across) > WORD_GAP * F.col("size")
    spaced = lines.withColumn("text", F.concat(F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), "text"))
    in_order = lambda *keys: F.array_sort(F.collect_list(F.struct(*keys, "text")))
    joined = lambda rows, sep: F.array_join(F.transform(rows, lambda r: r["text"]), sep)
    by_line = spaced.groupBy("path", "page", "line").agg(X.collapse(joined(in_order("x"), "")).alias("text"))
    by_page = by_line.groupBy("path", "page").agg(joined(in_order("line"), "\n").alias("text"))
    whole = by_page.groupBy("path").agg(X.strip(joined(in_order("page"), "\n\f")).alias("text"))
    good = whole.select("path", "text", F.when(F.col("text") == "", NO_TEXT).alias("problem"))
    return good.unionByName(found.where("problem is not null").select("path", F.lit(None).cast("string").alias("text"), "problem"))
