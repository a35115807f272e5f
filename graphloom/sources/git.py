"""Git repositories as tables: the files of a commit, their contents, and when each was last changed.

The repository must lie where the driver and all executors can read it; a clone goes to a folder that the caller names.
Listings are as long as the repository has files and are made on the driver; contents are read by the tasks.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20


class NoRepository(ValueError):
    """The source is neither a repository here nor an address of one, or git can't read it."""


def address(source: str) -> str:
    """A local folder as it is; URLs and user@host:path as they are; host/owner/name as an https URL."""
    text = source.strip()
    if not text or text.startswith("-") or re.search(r"[\x00-\x1f]", text):
        raise NoRepository(f"no source: {source!r}")
    if os.path.isdir(text) or re.match(r"(?:https?|ssh|git|file)://|[\w.-]+@[\w.-]+:", text):
        return text
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)+/[\w.-]+/[\w.-]+", text):
        return f"https://{text.removesuffix('/').removesuffix('.git')}.git"
    raise NoRepository(f"no source: {source!r}")


def _git(repo: str, *args: str) -> bytes:
    env = {**os.environ, "GIT_TERMINAL_PROMPT": "0"}
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, env=env)
    if done.returncode:
        raise NoRepository(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def resolve(source: str, work_dir: str, depth: int | None = 1) -> str:
    """The folder of the repository: the source itself if it is one, else a clone below work_dir.

    A depth of None takes the whole history, which `commit_times` needs.
    """
    where = address(source)
    if os.path.isdir(where):
        _git(where, "rev-parse", "--git-dir")
        return where
    name = re.sub(r"[^\w.-]+", "_", where.removesuffix(".git"))
    target = os.path.join(work_dir, name)
    if not os.path.isdir(target):
        shallow = [] if depth is None else ["--depth", str(depth)]
        _git(work_dir, "clone", "--quiet", *shallow, "--", where, target)
    elif depth is None and _git(target, "rev-parse", "--is-shallow-repository").strip() == b"true":
        _git(target, "fetch", "--quiet", "--unshallow")
    return target


def commit_id(repo: str, commit: str = "HEAD") -> str:
    return _git(repo, "rev-parse", "--verify", "--end-of-options", f"{commit}^{{commit}}").decode().strip()


def tree(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """(path, blob, mode, bytes) of each file, sorted by path; folders and other repositories are no files."""
    out = _git(repo, "ls-tree", "-r", "-z", "-l", "--full-tree", commit_id(repo, commit))
    rows = []
    for line in out.decode("utf-8", "surrogateescape").split("\0"):
        head, _, path = line.partition("\t")
        if path and (part := head.split())[1] == "blob":
            rows.append((path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), part[2], part[0], int(part[3])))
    return spark.createDataFrame(sorted(rows), "path string, blob string, mode string, bytes bigint")


def contents(files: DataFrame, repo: str, most: int | None = None) -> DataFrame:
    """The files with `content`, null for those of more than `most` bytes; one git process a task reads them all."""
    kept = files.columns
    schema = ", ".join([*(f"`{n}` {k}" for n, k in files.dtypes), "content binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(
            ["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE
        ) as git:

            def read(blob: str) -> bytes | None:
                git.stdin.write(blob.encode() + b"\n")
                git.stdin.flush()
                head = git.stdout.readline().split()
                if head[-1:] == [b"missing"]:
                    return None
                body = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                return body

            for batch in batches:
                blobs, sizes = batch.column("blob").to_pylist(), batch.column("bytes").to_pylist()
                got, first, held = [], 0, 0
                for i, (blob, size) in enumerate(zip(blobs, sizes)):
                    got.append(None if blob is None or (most is not None and (size or 0) > most) else read(blob))
                    held += len(got[-1] or b"")
                    if held > BATCH_BYTES or i + 1 == len(blobs):
                        part = batch.slice(first, i + 1 - first)
                        columns = [*part.columns, pa.array(got, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "content"])
                        got, first, held = [], i + 1, 0
            git.stdin.close()

    return files.mapInArrow(run, schema)


def commit_times(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """(path, changed bigint): the epoch second of the newest commit that touched each path.

    The log is read from the newest commit on and the first time seen for a path stays. A shallow clone knows no
    history, so it gives no rows.
    """
    seen: dict[str, int] = {}
    if _git(repo, "rev-parse", "--is-shallow-repository").strip() != b"true":
        command = ["git", "-C", repo, "log", "-z", "--name-only", "--format=%x01%ct", commit_id(repo, commit)]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as log:
            when, rest = 0, b""
            while block := log.stdout.read(1 << 20):
                *whole, rest = (rest + block).split(b"\0")
                for word in whole:
                    when = _note(word, when, seen)
            _note(rest, when, seen)
    return spark.createDataFrame(list(seen.items()), "path string, changed bigint")


def _note(word: bytes, when: int, seen: dict[str, int]) -> int:
    word = word.lstrip(b"\n")
    if word.startswith(b"\x01"):
        head, _, word = word[1:].partition(b"\n")
        when, word = int(head), word.lstrip(b"\n")
    if word:
        seen.setdefault(word.decode("utf-8", "replace"), when)
    return when
