"""Directory trees as tables: listing with rules applied before a file is read, decoding in Arrow batches."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalogue import BINARY_EXTENSIONS, DEFAULT_EXCLUDES, GENERATED_EXCLUDES
from ..functions.exprs import glob_regex
from .shared import workers_find_package

SNIFF = 8192


@dataclass
class ScanOptions:
    severity: str = "medium"
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    include_generated: bool = False
    follow_symlinks: bool = False
    high_entropy: bool = False
    include_pii: bool = False
    max_file_size: int = 5 << 20
    max_files: int | None = None


def walk(root: str, o: ScanOptions, folder: str = "", deep: bool = True) -> Iterator[tuple[str, str, int]]:
    """(full path, path from root with /, bytes) of files in scope. Folders that cannot be read are skipped; a missing root is empty.

    folder: where to begin below root; deep: whether to go on into the folders there. A single
    file is in scope whatever the globs say; links, size and extension still count.
    """
    wanted = [re.compile(glob_regex(g)) for g in o.include or ("**/*",)]
    dropped = [re.compile(glob_regex(g)) for g in (*DEFAULT_EXCLUDES, *(() if o.include_generated else GENERATED_EXCLUDES), *o.exclude)]

    def fits(full: str) -> int | None:
        name = os.path.basename(full)
        if (os.path.islink(full) and not o.follow_symlinks) or os.path.splitext(name)[1].lower() in BINARY_EXTENSIONS:
            return None
        try:
            size = os.stat(full).st_size
        except OSError:
            return None
        return size if size <= o.max_file_size else None

    if os.path.isfile(root):
        if (size := fits(root)) is not None:
            yield root, os.path.basename(root), size
        return
    pending, seen = [os.path.join(root, folder) if folder else root], set()
    while pending:
        folder = pending.pop()
        if os.path.abspath(folder).lower() in seen:
            continue
        seen.add(os.path.abspath(folder).lower())
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=o.follow_symlinks):
                if deep:
                    pending.append(e.path)
            elif e.is_file(follow_symlinks=True):
                path = os.path.relpath(e.path, root).replace(os.sep, "/")
                if any(r.match(path) for r in wanted) and not any(r.match(path) for r in dropped) and (size := fits(e.path)) is not None:
                    yield e.path, path, size


def decode(data: bytes) -> str | None:
    """Text, or None for binary. A byte-order mark settles the charset; else UTF-8, then Windows-1252."""
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
    for mark, charset in marks:
        if data.startswith(mark):
            return data[len(mark) :].decode(charset, "replace")
    if b"\0" in data[:SNIFF]:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(charset_of(data), "replace")


def decoded(data: Column) -> Column:
    """decode as a column."""
    workers_find_package()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x) for x in column.to_pylist()], pa.string())

    return run(data)


# Charsets of several bytes a character, and the writing that each is for, as a class of characters
CHARSETS = (
    ("shift_jis", "[\u3040-\u30ff]"),
    ("euc_jp", "[\u3040-\u30ff]"),
    ("euc_kr", "[\uac00-\ud7a3]"),
    ("gb18030", "[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"),
    ("big5", "[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"),
)
#: Characters beyond ASCII that have to be of a charset's own writing.
SHARE, FEWEST = {"euc_kr": 0.8, "gb18030": 0.95, "big5": 0.95}, 4
# Charsets of one byte a character with Cyrillic letters, and the letters that two of three in Russian, Ukrainian or Bulgarian text are
CYRILLIC = ("cp1251", "koi8-r", "iso8859-5", "cp866")
FREQUENT = "оеаинтсрвлкмдпу"
#: Shares: of beyond-ASCII letters that have one beside them, of the frequent ones among them, and of capitals behind small letters.
BESIDE, OFTEN, RAISED = 0.7, 0.55, 0.05
# Fixed values, bytes of Windows-1250: letters where Windows-1252 has signs; s and z with caron; other letters of Czech and Slovak; long o and u of Hungarian
SIGNS, CARON, CZECH, HUNGARIAN = b"\xa3\xa5\xaf\xb3\xb9\xbf\x8c\x8f\x9c\x9f\xbe\xbc\x9d\x8d", b"\x9a\x9e\x8a\x8e", b"\xec\xf8\xe8\xf9\xf2\xef", b"\xf5\xfb"


def charset_of(data: bytes) -> str:
    """Of text that is not UTF-8, from all its lines beyond ASCII: a charset in which it is valid and mostly of its own writing; else Windows-1252."""
    beyond = b"\n".join(x for x in data.split(b"\n") if not x.isascii())
    for name, own in CHARSETS:
        try:
            text = beyond.decode(name)
        except UnicodeDecodeError:
            continue
        wide = len(text) - len(text.encode("ascii", "ignore"))
        together = sum(map(len, re.findall("[^\x00-\x7f]{2,}", text)))
        # Accents among Latin letters stand alone. Common hanzi have two high bytes, the first below 0xF8 in GB 2312
        if together >= 0.5 * wide and wide >= FEWEST and len(re.findall(own, text)) >= SHARE.get(name, 0.3) * wide and (name != "gb18030" or simplified(beyond)):
            return name
    return cyrillic(beyond) or ("cp1250" if central(beyond) else "cp1252")


def simplified(data: bytes) -> bool:
    """Whether both bytes of nearly all pairs are high, as in GB 2312; Big5 has low second bytes."""
    pairs = re.findall(rb"[\x80-\xff][\x00-\xff]", data)
    return sum(x[1] < 0xA1 for x in pairs) <= 0.05 * len(pairs)


def cyrillic(data: bytes) -> str | None:
    """The charset in which most letters beyond ASCII stand side by side, are frequent ones, and hardly a capital follows a small letter."""
    best, name = OFTEN, None
    for charset in CYRILLIC:
        text = data.decode(charset, "replace")
        letters = re.findall("[\u0400-\u045f\u0490\u0491]", text)
        if len(letters) < FEWEST or len(letters) < BESIDE * (len(text) - len(text.encode("ascii", "ignore"))):
            continue
        runs = sum(map(len, re.findall("[\u0400-\u045f\u0490\u0491]{2,}", text)))
        raised = len(re.findall("[\u0430-\u045f][\u0400-\u042f]", text))
        often = sum(c in FREQUENT for c in "".join(letters).lower()) / len(letters)
        if runs >= BESIDE * len(letters) and raised <= RAISED * len(letters) and often > best:
            best, name = often, charset
    return name


def central(data: bytes) -> bool:
    """Whether what Windows-1252 has for signs stands within words, or letters are there that only Czech, Slovak or Hungarian has together."""
    n = len(re.findall(rb"[\x80-\xff]", data))
    share = lambda some: len(re.findall(rb"[%s]" % some, data)) / n
    if n < FEWEST:
        return False
    within = len(re.findall(rb"(?<=[A-Za-z\xc0-\xff])[%s]|[%s](?=[a-z\xe0-\xff])" % (SIGNS, SIGNS), data)) / n
    czech = share(CARON) >= 0.05 and share(CZECH) >= 0.05
    hungarian = share(HUNGARIAN) >= 0.05 and share(b"\xf6\xfc") > 0 and share(b"\xe1\xe9") > 0
    return within >= 0.15 or czech or hungarian


#: Folders above this depth are a task of their own; deeper ones go with the one above.
DEPTH = 2


def folders(root: str, o: ScanOptions) -> list[tuple[str, bool]]:
    """(folder below root, whether what is in its folders goes with it): the tasks of a listing."""
    if not os.path.isdir(root):
        return [("", False)]
    out, level = [], [""]
    for depth in range(DEPTH + 1):
        out += [(folder, depth == DEPTH) for folder in level]
        below = []
        for folder in level if depth < DEPTH else ():
            try:
                below += [os.path.join(folder, e.name) for e in os.scandir(os.path.join(root, folder)) if e.is_dir(follow_symlinks=o.follow_symlinks)]
            except OSError:
                continue
        level = below
    return out


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class ListingReader(DataSourceReader):
    """Folders are listed by tasks; what is planned is the folders of the upper levels."""

    def __init__(self, options: dict[str, str]):
        split = lambda name: tuple(filter(None, options.get(name, "").split("|")))
        self.root = options["path"]
        self.options = ScanOptions(include=split("include") or ("**/*",), exclude=split("exclude"), include_generated=options.get("includegenerated") == "true", follow_symlinks=options.get("followsymlinks") == "true", max_file_size=int(options.get("maxfilesize", 5 << 20)))

    def partitions(self):
        return [Folder(path, deep) for path, deep in folders(self.root, self.options)]

    def read(self, partition):
        files = walk(self.root, self.options, partition.path, partition.deep)
        while some := list(islice(files, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in some], pa.string()), pa.array([f[2] for f in some], pa.int64())], names=["path", "size"])


class ListingSource(DataSource):
    @classmethod
    def name(cls):
        return "keelson_listing"

    def schema(self):
        return "path string, size long"

    def reader(self, schema):
        return ListingReader({k.lower(): v for k, v in self.options.items()})


def contents(full: str) -> str | None:
    try:
        with open(full, "rb") as f:
            return decode(f.read())
    except OSError:
        return None


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "content", "size"])


def list_tree(spark: SparkSession, root: str, o: ScanOptions | None = None) -> DataFrame:
    """(path, size) of the files in scope; none is opened."""
    o = o or ScanOptions()
    workers_find_package(spark)
    spark.dataSource.register(ListingSource)
    r = spark.read.format("keelson_listing").option("include", "|".join(o.include)).option("exclude", "|".join(o.exclude))
    r = r.option("includeGenerated", str(o.include_generated).lower()).option("followSymlinks", str(o.follow_symlinks).lower()).option("maxFileSize", str(o.max_file_size))
    return r.load(root)


def open_files(files: DataFrame, root: str, deadline: float | None = None) -> DataFrame:
    """(path, content, size) of listed files, read where their rows are; content is null for binary or unreadable files.

    deadline: seconds since the epoch; a file whose turn comes later is not read and has the size -1.
    """
    workers_find_package(files.sparkSession)
    alone = os.path.isfile(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path, n in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), strict=True):
                late = deadline is not None and time.time() > deadline
                rows.append((path, None if late else contents(root if alone else os.path.join(root, path)), -1 if late else n))
                held += 0 if late else n
                if held >= 4 << 20 or len(rows) == 1024:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.select("path", "size").mapInArrow(run, "path string, content string, size long")


def read_tree(spark: SparkSession, root: str, o: ScanOptions | None = None, deadline: float | None = None) -> DataFrame:
    """Lists a tree and opens its files, dealt over all cores."""
    return open_files(dealt(list_tree(spark, root, o), root, o or ScanOptions()), root, deadline)


def dealt(files: DataFrame, root: str, o: ScanOptions) -> DataFrame:
    """Listed files one by one over at least all cores, and as many tasks as folders."""
    return files.repartition(max(2 * files.sparkSession.sparkContext.defaultParallelism, len(folders(root, o))))
