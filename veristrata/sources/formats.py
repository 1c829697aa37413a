"""Ledger files and annotated image sets as Spark data sources, to read and to write by short name.

``register(spark)`` makes them known; then ``spark.read.format("sealed_jsonl")
.load(folder)`` and ``df.write.format("sealed_jsonl").save(folder)``.

Reading is planned in partitions whose work is bounded: ranges of bytes of a
JSON-lines ledger (a line belongs to the range that it begins in), ranges of
row ids of a SQLite ledger, sections of a COCO manifest, and groups of files of
the formats that keep a file an image, whose names are packed. No file is held
whole but those of one image. What can't be read gives a row with a ``problem``, never none.

Writing is by tasks and commits: every task writes files in a staging folder of
its own and hands that folder's name to the driver, however many files it holds;
only the commit moves them to their place, and counts them in ``_SUCCESS``. A task
that fails or runs twice leaves nothing behind, and a save that fails leaves the
folder as it was. No writer of ledgers, payloads or manifests holds a task's rows.

Paths are those of a folder that driver and executors share: plain, ``file:``, or
any other that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import os
import sqlite3
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veristrata.sources.datasets import IMAGES, header_size

#: Bytes of a range of a JSON-lines ledger, row ids of a range of a SQLite ledger, and files of a group.
RANGE_BYTES, RANGE_ROWS, GROUP_FILES = 32 << 20, 200_000, 500
#: Bytes of payload lines that are sorted at once, each time into a file of their own.
SORTED_BYTES = 8 << 20
#: Bytes of an image's own file at most (annotations), and of a file's head that tells an image's size.
MOST_BYTES, HEAD = 1 << 20, 1 << 16
DONE = "_SUCCESS"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file:///") else f"file://{path[5:]}")
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(root: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files under a folder by name, with their sizes; hidden ones and those being written are left out."""
    store, at = opened(root)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    inner = [(f.path, f.size, f.path[len(at) :]) for f in found if f.type == fs.FileType.File]
    return sorted((p, n) for p, n, rel in inner if rel.lower().endswith(endings) and not any(part.startswith(("_", ".")) for part in rel.strip("/").split("/")))


def walked(store: fs.FileSystem, at: str) -> Iterator[str]:
    """Paths of the files under a folder, in no order. A local folder is read entry by entry, one of another store at once."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as entries:
            for e in entries:
                if e.is_dir():
                    yield from walked(store, f"{at}/{e.name}")
                elif e.is_file():
                    yield f"{at}/{e.name}"
    else:
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.type == fs.FileType.Directory:
                yield from walked(store, f.path)
            elif f.type == fs.FileType.File:
                yield f.path


def grouped(root: str, endings: tuple[str, ...]) -> list[InputPartition]:
    """The files that ``listed`` gives, in groups of ``GROUP_FILES``, none of them held but as its packed name. Names follow each other inside a group."""
    store, at = opened(root)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return [Piece([info.path])]
    names = (p[len(at) :].lstrip("/") for p in walked(store, at))
    seen = (n for n in names if n.lower().endswith(endings) and not any(part.startswith(("_", ".")) for part in n.split("/")))
    return [Group.of(at, some) for some in iter(lambda: list(itertools.islice(seen, GROUP_FILES)), [])] or [Piece([])]


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class Piece(InputPartition):
    """What one task reads: files, or a range of one file (of one array of a manifest)."""

    files: list[str]
    lo: int = 0
    hi: int = 0
    array: str | None = None


@dataclass
class Group(InputPartition):
    """Files that one task reads: the driver holds all groups, so names are packed, a few bytes each."""

    folder: str
    names: bytes

    @classmethod
    def of(cls, folder: str, names: list[str]) -> Group:
        return cls(folder, zlib.compress("\0".join(sorted(names)).encode("utf-8", "surrogateescape")))

    @property
    def files(self) -> list[str]:
        return [f"{self.folder}/{n}" for n in zlib.decompress(self.names).decode("utf-8", "surrogateescape").split("\0")]


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task, how many files it holds, and how many rows they do; ``cuts``: places inside a file where a section of it begins."""

    task: str
    files: int = 0
    rows: int = 0
    cuts: dict[str, list[int]] = field(default_factory=dict)


class _Reader(DataSourceReader):
    endings: tuple[str, ...] = ()

    def __init__(self, root: str):
        self.root = root
        self.store = opened(root)[0]

    def partitions(self) -> list[InputPartition]:
        return grouped(self.root, self.endings)

    def content(self, path: str, most: int) -> bytes | None:
        """A file's bytes, or None if it is larger than allowed."""
        with self.store.open_input_stream(path) as f:
            data = f.read(most + 1)
        return data if len(data) <= most else None


class _Writer(DataSourceWriter):
    """Tasks stage, the commit publishes."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.at = opened(root)[1]
        self.staging = f"{self.at}/_staging-{uuid.uuid4().hex}"

    def rows_to_files(self, rows: Iterator[Any], put: Any) -> int:
        """Writes a task's rows by ``put(name, bytes)``, or into what ``put(name)`` opens, and says how many there were."""
        raise NotImplementedError

    def cuts(self) -> dict[str, list[int]]:
        return {}

    def write(self, iterator: Iterator[Any]) -> Written:
        store = opened(self.root)[0]
        out = Written(uuid.uuid4().hex)  # of this attempt alone
        made = set()

        def put(name: str, data: bytes | None = None) -> Any:
            path = f"{self.staging}/{out.task}/{name}"
            if (folder := os.path.dirname(path)) not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            out.files += 1
            f = store.open_output_stream(path)
            if data is None:
                return f
            with f:
                f.write(data)
            return None

        out.rows = self.rows_to_files(iterator, put)
        out.cuts = self.cuts()
        return out

    def staged(self, store: fs.FileSystem, message: Written) -> list[str]:
        """Names of a task's files, below its folder."""
        at = f"{self.staging}/{message.task}"
        if not message.files:
            return []
        names = [p[len(at) + 1 :] for p in walked(store, at)]
        if len(names) != message.files:
            raise OSError(f"a task wrote {message.files} files, {len(names)} are there")
        return names

    def clash(self, store: fs.FileSystem, messages: list[Written]) -> bool:
        """Have two tasks written one file? Names are compared by eight bytes each, and by themselves where those agree."""
        marks = lambda m: np.frombuffer(b"".join(hashlib.blake2b(n.encode("utf-8", "surrogateescape"), digest_size=8).digest() for n in self.staged(store, m)), dtype=np.uint64)
        seen, at = np.empty(sum(m.files for m in messages), np.uint64), 0
        for m in messages:
            seen[at : at + m.files] = marks(m)
            at += m.files
        seen.sort()
        twice = set(seen[1:][seen[1:] == seen[:-1]].tolist())
        if not twice:
            return False
        names = [n for m in messages for n, k in zip(self.staged(store, m), marks(m).tolist(), strict=True) if k in twice]
        return len(set(names)) < len(names)

    def commit(self, messages: list[Written | None]) -> None:
        store = opened(self.root)[0]
        done = [m for m in messages if m is not None]
        store.create_dir(self.at, recursive=True)
        others = [f.path for f in store.get_file_info(fs.FileSelector(self.at)) if f.path != self.staging]
        if self.clash(store, done):
            self.abort(messages)
            raise ValueError("two tasks wrote one file: rows of an image must be in one partition")
        if others and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.root)
        for path in others:
            store.delete_dir(path) if store.get_file_info(path).type == fs.FileType.Directory else store.delete_file(path)
        made = set()
        for m in done:
            for name in self.staged(store, m):
                to = f"{self.at}/{name}"
                if (folder := os.path.dirname(to)) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(f"{self.staging}/{m.task}/{name}", to)
        self._drop(store)
        with store.open_output_stream(f"{self.at}/{DONE}") as f:
            f.write(json.dumps({"files": sum(m.files for m in done), "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(opened(self.root)[0])

    def _drop(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self.staging).type != fs.FileType.NotFound:
            store.delete_dir(self.staging)


class _Source(DataSource):
    short = ""
    columns = ""
    reading: type[_Reader] = _Reader
    writing: type[_Writer] = _Writer

    @classmethod
    def name(cls) -> str:
        return cls.short

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: Any) -> DataSourceReader:
        return self.reading(self.options["path"])

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return self.writing(self.options["path"], overwrite)


# ---- ledgers ----


class JsonlReader(_Reader):
    """Every line with its exact bytes and its place; blank and unterminated lines have a ``problem``."""

    endings = (".jsonl",)

    def partitions(self) -> list[InputPartition]:
        return [Piece([p], lo, min(lo + RANGE_BYTES, n)) for p, n in listed(self.root, self.endings) for lo in range(0, n, RANGE_BYTES)] or [Piece([])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        for path in piece.files:
            with io.BufferedReader(self.store.open_input_file(path), HEAD) as f:
                at = piece.lo
                if at:  # the line that goes on here is read with the range that it begins in
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                f.seek(at)
                while at < piece.hi:
                    line = f.readline()
                    if not line:
                        break
                    ended = line.endswith(b"\n")
                    rec = line[:-1] if ended else line
                    yield os.path.basename(path), at, rec, None if ended and rec.strip() else "unterminated line" if not ended else "blank line"
                    at += len(line)


class JsonlWriter(_Writer):
    """A task's records, in its order, one a line. The parts' names follow the first record's ``seq``."""

    def rows_to_files(self, rows, put):
        n, out = 0, None
        try:
            for row in rows:
                rec = bytes(row["rec"])
                if b"\n" in rec:
                    raise ValueError("a record holds a line end")
                if out is None:
                    out = io.BufferedWriter(put(f"part-{row['seq']:020d}.jsonl"), 1 << 20)
                out.write(rec + b"\n")
                n += 1
        finally:
            if out is not None:
                out.close()
        return n


class SealedJsonl(_Source):
    short, columns, reading, writing = "sealed_jsonl", "file string, at long, rec binary, problem string", JsonlReader, JsonlWriter


class SqliteReader(_Reader):
    """Rows of ``records`` in row order, with the file's own derived columns. Files are opened where they lie, read-only."""

    endings = (".db", ".sqlite")

    @staticmethod
    def _open(path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, _ in listed(self.root, self.endings):
            db = self._open(path)
            lo, hi = db.execute("select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from records").fetchone()
            db.close()
            out += [Piece([path], at, min(at + RANGE_ROWS, hi + 1)) for at in range(lo, hi + 1, RANGE_ROWS)]
        return out or [Piece([])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        for path in piece.files:
            db = self._open(path)
            raw = lambda x: x if isinstance(x, bytes) else None if x is None else str(x).encode()
            for at, seq, kind, nonce, digest, rec in db.execute("select rowid, seq, type, nonce, rec_hash, rec from records where rowid >= ? and rowid < ? order by rowid", (piece.lo, piece.hi)):
                yield os.path.basename(path), at, raw(rec), seq, kind, nonce, raw(digest)
            db.close()


class SqliteWriter(_Writer):
    """A task's records as databases of ``RANGE_ROWS`` rows at most, named by their first record's ``seq``."""

    def rows_to_files(self, rows, put):
        n = 0
        while some := list(itertools.islice(rows, RANGE_ROWS)):
            db = sqlite3.connect(":memory:")
            db.execute("create table records(seq integer primary key, type text not null, nonce text, rec_hash blob, rec blob not null)")
            db.executemany("insert into records values (?, ?, ?, ?, ?)", ((r["seq"], r["type"], r["nonce"], bytes(r["rec_hash"]), bytes(r["rec"])) for r in some))
            db.commit()
            put(f"part-{some[0]['seq']:020d}.db", bytes(db.serialize()))
            db.close()
            n += len(some)
        return n


class SealedSqlite(_Source):
    short, columns, reading, writing = "sealed_sqlite", "file string, at long, rec binary, seq long, type string, nonce string, rec_hash binary", SqliteReader, SqliteWriter


class PayloadReader(JsonlReader):
    """Payload lines: ``address`` and ``data``, or a ``problem`` where the line isn't exactly that or its bytes don't hash to it."""

    def read(self, piece: Piece) -> Iterator[tuple]:
        from veristrata.sources.ledgers import strict_payload

        for _, at, rec, problem in super().read(piece):
            try:
                found = None if problem else strict_payload(rec.decode("utf-8"))
            except UnicodeDecodeError:
                found = None
            yield (*found, None) if found else (None, None, problem or f"no payload at {at}")


class PayloadWriter(_Writer):
    """A task's payloads, sorted by address in files of about ``SORTED_BYTES``."""

    def rows_to_files(self, rows, put):
        n, k, size, lines = 0, 0, 0, []

        def flush() -> None:
            nonlocal k, size
            lines.sort()
            put(f"part-{lines[0][0]}{f'-{k}' if k else ''}.jsonl", b"".join(b'{"address":"%b","b64":"%b"}\n' % (a.encode(), b) for a, b in lines))
            k, size = k + 1, 0
            lines.clear()

        for row in rows:
            lines.append((row["address"], base64.b64encode(bytes(row["data"]))))
            n, size = n + 1, size + len(lines[-1][1])
            if size >= SORTED_BYTES:
                flush()
        if lines:
            flush()
        return n


class Payloads(_Source):
    short, columns, reading, writing = "sealed_payloads", "address string, data binary, problem string", PayloadReader, PayloadWriter


# ---- image sets ----


class CocoReader(_Reader):
    """The manifest's arrays, element by element; an element that isn't an object ends its array with a ``problem``.

    A manifest that was written here is read in the sections that its writer
    noted, each a task, as long as it is the same file; of any other an array is
    a task. With the option ``kind`` only that one's array is read.
    """

    KINDS = {"image": "images", "annotation": "annotations", "category": "categories"}

    def __init__(self, root: str, kind: str | None = None):
        super().__init__(root)
        self.kinds = list(self.KINDS.values()) if kind is None else [self.KINDS[kind]]

    def partitions(self) -> list[InputPartition]:
        from veristrata.sources.datasets import COCO_NAMES

        store, at = opened(self.root)
        if store.get_file_info(at).type == fs.FileType.Directory:
            names = [f"{at}/{d}{n}" for d in ("", "annotations/") for n in COCO_NAMES]
            at = next((n for n in names if store.get_file_info(n).type == fs.FileType.File), None)
            if at is None:
                raise FileNotFoundError(f"no manifest in {self.root}")
        noted = f"{os.path.dirname(at)}/{SECTIONS}"
        if store.get_file_info(noted).type == fs.FileType.File:
            with store.open_input_stream(noted) as f:
                known = json.loads(f.read())
            if known["of"] == _same(store, at):
                return [Piece([at], lo, hi, name) for name, lo, hi in known["sections"] if name in self.kinds] or [Piece([])]
        return [Piece([at], array=name) for name in self.kinds]

    def elements(self, path: str, name: str) -> Iterator[dict]:
        """Objects of one array of the document, read in blocks. The array is found by the document's own structure."""
        decoder = json.JSONDecoder()
        with self.store.open_input_stream(path) as f:
            text, rest, over = "", b"", False

            def more() -> bool:
                nonlocal text, rest, over
                data = rest + f.read(1 << 20)
                over = over or len(data) == len(rest)
                cut = len(data)
                while cut and not over and data[cut - 1] & 0xC0 == 0x80:
                    cut -= 1
                if cut and not over and data[cut - 1] & 0xC0 == 0xC0:
                    cut -= 1
                text, rest = text + data[:cut].decode("utf-8"), data[cut:]
                return not over

            def skip(at: int, chars: str = " \t\r\n") -> int:
                while True:
                    while at < len(text) and text[at] in chars:
                        at += 1
                    if at < len(text) or not more():
                        return at

            def value(at: int) -> tuple[Any, int]:
                while True:
                    try:
                        found, end = decoder.raw_decode(text, at)
                        # a number may go on in the next block
                        if over or end < len(text) and (text[end] not in "0123456789.eE+-" or isinstance(found, (str, list, dict))):
                            return found, end
                    except json.JSONDecodeError:
                        if over:
                            raise
                    more()

            at = skip(0)
            if text[at : at + 1] != "{":
                raise ValueError("the manifest is no object")
            at = skip(at + 1, " \t\r\n,")
            while text[at : at + 1] not in ("}", ""):
                key, at = value(at)
                at = skip(skip(at), " \t\r\n:")
                if text[at : at + 1] != "[":
                    at = value(at)[1]
                else:
                    at = skip(at + 1, " \t\r\n,")
                    while text[at : at + 1] not in ("]", ""):
                        found, at = value(at)
                        if key == name:
                            yield found
                        at = skip(at, " \t\r\n,")
                        if at >= HEAD:  # not for each element: that would copy a block each time
                            text, at = text[at:], 0
                    if at >= len(text):
                        break
                    at += 1
                at = skip(at, " \t\r\n,")
            if at >= len(text):
                raise ValueError("the manifest ends early")

    def lines(self, path: str, lo: int, hi: int) -> Iterator[dict]:
        """Objects of one section, each on a line of its own."""
        with io.BufferedReader(self.store.open_input_file(path), HEAD) as f:
            f.seek(lo)
            while lo < hi and (line := f.readline()):
                yield json.loads(line[: hi - lo].rstrip(b",\n"))
                lo += len(line)

    def read(self, piece: Piece) -> Iterator[tuple]:
        kind = piece.array
        whole = lambda x: x if type(x) is int else None
        text = lambda x: None if x is None else str(x)
        for path in piece.files:
            try:
                for e in self.lines(path, piece.lo, piece.hi) if piece.hi else self.elements(path, kind):
                    if not isinstance(e, dict):
                        raise ValueError(f"an element of {kind} is no object")
                    box = [float(x) for x in e["bbox"]] if isinstance(e.get("bbox"), list) and all(type(x) in (int, float) for x in e["bbox"]) else None
                    yield kind[:-1] if kind != "categories" else "category", text(e.get("id")), text(e.get("image_id")), text(e.get("category_id")), text(e.get("file_name", e.get("name"))), whole(e.get("width")), whole(e.get("height")), text(e.get("source")), text(e.get("batch")), box, bool(e.get("iscrowd")), None
            except (ValueError, KeyError, TypeError) as why:
                yield (kind[:-1] if kind != "categories" else "category", *[None] * 10, str(why)[:200])


#: Where a manifest's writer notes its sections.
SECTIONS = "_sections.json"


def _same(store: fs.FileSystem, path: str) -> list:
    """What tells a file from one that was put in its place: size and time."""
    info = store.get_file_info(path)
    return [info.size, info.mtime_ns]


class CocoWriter(_Writer):
    """Tasks write elements, one a line, as they come; the commit strings their files together into one manifest, block by block."""

    KINDS = CocoReader.KINDS

    def cuts(self):
        return self.found

    def rows_to_files(self, rows, put):
        self.found: dict[str, list[int]] = {}
        out: dict[str, Any] = {}
        n, at = 0, dict.fromkeys(self.KINDS, 0)
        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else x
        pairs = {
            "image": lambda r: (("id", number(r["id"])), ("file_name", r["name"]), ("width", r["width"]), ("height", r["height"]), ("source", r["source"]), ("batch", r["batch"])),
            "annotation": lambda r: (("id", number(r["id"])), ("image_id", number(r["image_id"])), ("category_id", number(r["category_id"])), ("bbox", r["bbox"]), ("iscrowd", int(bool(r["iscrowd"])))),
            "category": lambda r: (("id", number(r["id"])), ("name", r["name"])),
        }
        encode = json.JSONEncoder(separators=(",", ":")).encode
        try:
            for r in rows:
                kind = r["kind"]
                line = encode({k: v for k, v in pairs[kind](r) if v is not None}).encode()
                name = self.KINDS[kind]
                if kind not in out:
                    out[kind] = io.BufferedWriter(put(name), 1 << 20)
                    self.found[name] = [0]
                else:
                    out[kind].write(b",\n")
                    at[kind] += 2
                    if at[kind] - self.found[name][-1] >= RANGE_BYTES:
                        self.found[name].append(at[kind])
                out[kind].write(line)
                at[kind] += len(line)
                n += 1
        finally:
            for f in out.values():
                f.close()
        return n

    def commit(self, messages):
        store = opened(self.root)[0]
        done = [m for m in messages if m is not None]
        rows, at, sections = sum(m.rows for m in done), 0, []
        store.create_dir(f"{self.staging}/whole", recursive=True)
        with store.open_output_stream(f"{self.staging}/whole/instances.json") as out:

            def add(data: bytes) -> None:
                nonlocal at
                out.write(data)
                at += len(data)

            for i, name in enumerate(self.KINDS.values()):
                add(f'{"{" if i == 0 else ","}"{name}":['.encode())
                first = True
                for m in sorted((m for m in done if name in m.cuts), key=lambda m: m.task):
                    add(b"\n" if first else b",\n")
                    first, begun = False, at
                    with store.open_input_stream(f"{self.staging}/{m.task}/{name}") as f:
                        while data := f.read(8 << 20):
                            add(data)
                    starts = [begun + c for c in m.cuts[name]]
                    sections += [(name, lo, hi) for lo, hi in zip(starts, [*starts[1:], at], strict=True)]
                add(b"]")
            add(b"}")
        super().commit([Written("whole", 1, rows)])
        known = {"of": _same(store, f"{self.at}/instances.json"), "sections": sections}
        with store.open_output_stream(f"{self.at}/{SECTIONS}") as f:
            f.write(json.dumps(known).encode())


class Coco(_Source):
    short, columns, reading, writing = "coco", "kind string, id string, image_id string, category_id string, name string, width int, height int, source string, batch string, bbox array<double>, iscrowd boolean, problem string", CocoReader, CocoWriter

    def reader(self, schema: Any) -> DataSourceReader:
        return CocoReader(self.options["path"], self.options.get("kind"))


class YoloReader(_Reader):
    """Boxes of ``labels``, in shares of the image; lines that are too short or hold no numbers have a ``problem``."""

    endings = (".txt",)

    def partitions(self):
        return grouped(f"{self.root.rstrip('/')}/labels", self.endings)

    def read(self, piece: Piece) -> Iterator[tuple]:
        for path in piece.files:
            with io.BufferedReader(self.store.open_input_file(path), HEAD) as f:
                k = 0
                while line := f.readline():
                    k, parts = k + 1, line.split()
                    try:
                        if len(parts) < 5:
                            raise ValueError("too short")
                        yield stem(path), k, int(parts[0]), *map(float, parts[1:5]), None
                    except ValueError as why:
                        if parts:
                            yield stem(path), k, None, None, None, None, None, str(why)[:100]


class YoloWriter(_Writer):
    """A file an image; an image's rows must be in one partition, in the order that its lines shall have."""

    def rows_to_files(self, rows, put):
        of: dict[str, list[str]] = {}
        n = 0
        for r in rows:
            of.setdefault(r["stem"], []).append(f"{r['class_id']} {r['xc']:.6f} {r['yc']:.6f} {r['w']:.6f} {r['h']:.6f}\n")
            n += 1
        for name, lines in of.items():
            put(f"labels/{name}.txt", "".join(lines).encode())
        return n


class Yolo(_Source):
    short, columns, reading, writing = "yolo", "stem string, line int, class_id long, xc double, yc double, w double, h double, problem string", YoloReader, YoloWriter


class VocReader(_Reader):
    """A row an annotation file, boxes 0-based from the top left. Files that are too large, declare types or entities, or don't parse have a ``problem``."""

    endings = (".xml",)

    def partitions(self):
        return grouped(f"{self.root.rstrip('/')}/Annotations", self.endings)

    def parsed(self, data: bytes | None) -> tuple:
        if data is None:
            raise ValueError(f"over {MOST_BYTES} bytes")
        text = data.decode("utf-8")
        if "<!DOCTYPE" in text or "<!ENTITY" in text:
            raise ValueError("declares types or entities")
        top = ET.fromstring(text)
        number = lambda x: None if x is None else int(float(x))
        boxes = []
        for o in top.findall("object"):
            x1, y1, x2, y2 = (float(o.findtext(f"bndbox/{c}") or "nan") for c in ("xmin", "ymin", "xmax", "ymax"))
            if x1 == x1 and y1 == y1 and x2 == x2 and y2 == y2:
                boxes.append((o.findtext("name"), x1 - 1, y1 - 1, x2 - x1 + 1, y2 - y1 + 1))
        return top.findtext("filename"), number(top.findtext("size/width")), number(top.findtext("size/height")), boxes

    def read(self, piece: Piece) -> Iterator[tuple]:
        for path in piece.files:
            try:
                yield stem(path), *self.parsed(self.content(path, MOST_BYTES)), None
            except (ValueError, ET.ParseError, UnicodeDecodeError) as why:
                yield stem(path), None, None, None, None, str(why)[:200]


class VocWriter(_Writer):
    def rows_to_files(self, rows, put):
        n = 0
        for r in rows:
            top = ET.Element("annotation")
            if r["name"] is not None:
                ET.SubElement(top, "filename").text = r["name"]
            size = ET.SubElement(top, "size")
            for c in ("width", "height"):
                if r[c] is not None:
                    ET.SubElement(size, c).text = str(r[c])
            for o in r["objects"] or []:
                one = ET.SubElement(top, "object")
                ET.SubElement(one, "name").text = o["name"]
                box = ET.SubElement(one, "bndbox")
                for c, v in (("xmin", o["x"] + 1), ("ymin", o["y"] + 1), ("xmax", o["x"] + o["w"]), ("ymax", o["y"] + o["h"])):
                    ET.SubElement(box, c).text = repr(v)
            put(f"Annotations/{r['sample_id']}.xml", ET.tostring(top))
            n += 1
        return n


class Voc(_Source):
    short, columns, reading, writing = "voc", "sample_id string, name string, width int, height int, objects array<struct<name:string,x:double,y:double,w:double,h:double>>, problem string", VocReader, VocWriter


class FolderReader(_Reader):
    """A row an image: its folder is its class, its size is that of the file's header; a size that can't be read is a ``problem``."""

    endings = IMAGES

    def read(self, piece: Piece) -> Iterator[tuple]:
        import hashlib

        for path in piece.files:
            digest, length, head = hashlib.sha256(), 0, b""
            with self.store.open_input_stream(path) as f:
                while data := f.read(HEAD):
                    head = head or data
                    digest.update(data)
                    length += len(data)
            found = header_size(head)
            yield stem(path), os.path.basename(os.path.dirname(path)), length, digest.hexdigest(), *(found or (None, None)), None if found else "no size in the header"


class FolderWriter(_Writer):
    def rows_to_files(self, rows, put):
        n = 0
        for r in rows:
            put(f"{r['category']}/{r['name']}", bytes(r["content"]))
            n += 1
        return n


class Folder(_Source):
    short, columns, reading, writing = "image_folder", "sample_id string, category string, length long, content_sha256 string, width int, height int, problem string", FolderReader, FolderWriter


SOURCES = (SealedJsonl, SealedSqlite, Payloads, Coco, Yolo, Voc, Folder)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
