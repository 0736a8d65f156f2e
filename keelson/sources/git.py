"""A repository's commits, refs and changes as tables, by way of the git program."""

from __future__ import annotations

import codecs
import glob
import os
import subprocess
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.history import History
from ..schemas import FILE_DIFFS, REFS
from .shared import workers_find_package
from .tree import ScanOptions, decode, read_tree

#: What a first commit is compared with.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def git(repo: str, *args: str, asked: str | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=None if asked is None else asked.encode(), capture_output=True, check=True).stdout


def toplevel(repo: str) -> str | None:
    try:
        return git(repo, "rev-parse", "--show-toplevel").decode().strip()
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None


class Ids(InputPartition):
    """Ids of objects in one pack, from one first byte to another, or in the loose folders of one object store."""

    def __init__(self, folder: str, pack: str | None, low: int = 0, high: int = 256):
        self.folder, self.pack, self.low, self.high = folder, pack, low, high


#: Objects of a pack that one task looks at, and ids that are asked for at a time.
OBJECTS, ASKED = 200_000, 10_000
#: Bytes of a pack's index for each object, beside a fixed table.
ENTRY, TABLE = 28, 1072


class CommitReader(DataSourceReader):
    """Reads the commits of the object store where the partition is; what is planned is the names of packs.

    An id may come from two packs, and from a pack and its own file.
    """

    def __init__(self, repo: str, cores: int):
        self.repo, self.cores = repo, cores

    def stores(self) -> list[str]:
        """The repository's own folder of objects and those that it borrows from."""
        own = git(self.repo, "rev-parse", "--git-path", "objects").decode().strip()
        lent = [x.removeprefix("alternate: ") for x in git(self.repo, "count-objects", "-v").decode().splitlines() if x.startswith("alternate: ")]
        return [os.path.join(self.repo, own), *lent]

    def partitions(self):
        out = []
        for store in self.stores():
            for index in sorted(glob.glob(os.path.join(glob.escape(store), "pack", "*.idx"))):
                n = max(1, (os.path.getsize(index) - TABLE) // ENTRY)
                pieces = min(256, max(-(-n // OBJECTS), min(self.cores, n // 1000)))
                cuts = [256 * i // pieces for i in range(pieces + 1)] if pieces else [0, 256]
                out += [Ids(store, index, low, high) for low, high in zip(cuts, cuts[1:], strict=False)]
            if any(len(x) == 2 for x in os.listdir(store)):
                out.append(Ids(store, None))
        return out or [Ids("", None)]

    def ids(self, part: Ids) -> Iterator[str]:
        if part.pack:
            with open(part.pack, "rb") as f, subprocess.Popen(["git", "-C", self.repo, "show-index"], stdin=f, stdout=subprocess.PIPE) as shown:
                for line in shown.stdout:
                    name = line.split()[1].decode()
                    if part.low <= int(name[:2], 16) < part.high:
                        yield name
        elif part.folder:
            for folder in os.listdir(part.folder):
                if len(folder) == 2:
                    yield from (folder + x for x in os.listdir(os.path.join(part.folder, folder)) if not x.startswith("tmp"))

    def read(self, partition):
        import pyarrow as pa

        ids = self.ids(partition)
        while some := list(islice(ids, ASKED)):
            kinds = git(self.repo, "cat-file", "--batch-check=%(objectname) %(objecttype)", asked="\n".join(some)).decode().split("\n")
            own = [x.removesuffix(" commit") for x in kinds if x.endswith(" commit")]
            if not own:
                continue
            # A message holds no NUL; each record ends with one and a line feed
            facts = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x00%P%x00%at%x00%an%x00%B%x00", asked="\n".join(own)).decode("utf-8", "replace").split("\0")
            rows = [(facts[i].lstrip("\n"), facts[i + 1].split(), int(facts[i + 2]), facts[i + 3] or None, facts[i + 4].rstrip("\n")) for i in range(0, len(facts) - 4, 5)]
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["sha", "parents", "at", "author_name", "message"])


class CommitSource(DataSource):
    @classmethod
    def name(cls):
        return "keelson_commits"

    def schema(self):
        return "sha string, parents array<string>, at long, author_name string, message string"

    def reader(self, schema):
        return CommitReader(self.options["path"], int(self.options.get("cores", "1")))


def commits(spark: SparkSession, repo: str) -> DataFrame:
    """All commits of the object store, those that no ref leads to as well. Read by tasks, pack by pack."""
    workers_find_package(spark)
    spark.dataSource.register(CommitSource)
    rows = spark.read.format("keelson_commits").option("cores", str(spark.sparkContext.defaultParallelism)).load(os.path.abspath(repo))
    return rows.dropDuplicates(["sha"]).select("sha", "parents", F.timestamp_seconds("at").alias("author_when"), "author_name", "message")


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """Local branches and tags, tags peeled to their commits."""
    rows = []
    for line in git(repo, "for-each-ref", "--format=%(refname)%00%(objectname)%00%(*objectname)", "refs/heads", "refs/tags").decode().splitlines():
        name, sha, peeled = line.split("\0")
        kind = "branch" if name.startswith("refs/heads/") else "tag"
        rows.append((name.split("/", 2)[2], kind, peeled or sha))
    return spark.createDataFrame(rows, REFS)


def history(spark: SparkSession, repo: str, options: ScanOptions) -> History:
    """A repository: its commits, refs and changes, and the files of its working tree."""
    top = toplevel(repo)
    tree = read_tree(spark, top, options).where("content is not null") if top else spark.createDataFrame([], "path string, content string")
    return History(commits(spark, repo), refs(spark, repo), tree, lambda some, n: file_diffs(repo, some, n))


#: Commits that one task compares, at most on average.
COMPARED = 200


def file_diffs(repo: str, shas: DataFrame, n: int | None = None) -> DataFrame:
    """Changes of each commit against its first parent, with patch and the text after it; binaries and deletions have none.

    shas: sha and parents; n: how many there are, if known. The program runs where the partition is, so
    the repository must be there: two processes for each partition, which are asked commit by commit and
    blob by blob. Commits are dealt by number, over all cores at least: the size of their rows says
    nothing of the work behind them.
    """
    spark = shas.sparkSession
    workers_find_package(spark)
    tasks = max(spark.sparkContext.defaultParallelism, -(-(n or 0) // COMPARED))
    shas = shas.repartition(tasks)

    def run(batches):
        import pyarrow as pa

        names = ["sha", "path", "status", "patch", "content"]
        with Changes(repo) as changes:
            for batch in batches:
                for sha, parents in zip(batch.column("sha").to_pylist(), batch.column("parents").to_pylist(), strict=True):
                    rows = changes.of(sha, parents[0] if parents else None)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return shas.select("sha", "parents").mapInArrow(run, FILE_DIFFS)


class Changes:
    """Two processes of the git program: one compares commits, the other gives texts."""

    STOP = b"no more of this commit\n"

    def __init__(self, repo: str):
        start = lambda *args: subprocess.Popen(["git", "-C", repo, "-c", "core.quotePath=false", *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.trees = start("diff-tree", "--stdin", "--root", "-r", "-M", "--no-abbrev", "--raw", "-p", "--no-ext-diff", "--no-textconv", "--no-color")
        self.blobs = start("cat-file", "--batch")

    def __enter__(self) -> Changes:
        return self

    def __exit__(self, *_) -> None:
        for p in (self.trees, self.blobs):
            p.stdin.close()
            p.stdout.close()
            p.wait()

    def of(self, sha: str, parent: str | None) -> list[tuple[str, str, str, str, str]]:
        # A line that names no object comes back as it is, which ends the answer
        self.trees.stdin.write(f"{sha} {parent}\n".encode() if parent else f"{sha}\n".encode())
        self.trees.stdin.write(self.STOP)
        self.trees.stdin.flush()
        files, patches = [], []
        for line in iter(self.trees.stdout.readline, self.STOP):
            if not line:
                raise OSError("git ended")
            if line.startswith(b"diff --git "):
                patches.append([line])
            elif patches:
                patches[-1].append(line)
            elif line.startswith(b":"):
                facts, *paths = line.rstrip(b"\n").split(b"\t")
                _, _, _, blob, status = facts.split(b" ")
                files.append((unquoted(paths[-1]), blob, status[:1].decode()))
        out, at = [], 0
        for path, blob, status in files:
            # A change of type is two patches: one takes away, one adds
            own = patches[at : at + (2 if status == "T" else 1)]
            at += 2 if status == "T" else 1
            if status == "D":
                out.append((sha, path, "deleted", "", ""))
            else:
                patch = b"".join(x for p in own for x in p).decode("utf-8", "replace")
                out.append((sha, path, {"R": "renamed", "C": "renamed", "A": "added"}.get(status, "modified"), patch, self.text(blob)))
        return out

    def text(self, blob: bytes) -> str:
        self.blobs.stdin.write(blob + b"\n")
        self.blobs.stdin.flush()
        head = self.blobs.stdout.readline().split()
        if len(head) < 3:
            return ""
        data = self.blobs.stdout.read(int(head[2]) + 1)[:-1]
        return (decode(data) or "") if head[1] == b"blob" else ""


def unquoted(path: bytes) -> str:
    """A path as git prints it: in quotes and with escapes where it holds quotes, tabs or the like."""
    if path.startswith(b'"'):
        path = codecs.escape_decode(path[1:-1])[0]
    return path.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
