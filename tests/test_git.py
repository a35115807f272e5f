import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.sources import git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")

    def run(*args, when="2024-01-01T00:00:00Z"):
        env = {**os.environ, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when}
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=d, check=True, env=env, capture_output=True)

    run("init", "-q")
    (d / "sub dir").mkdir()
    (d / "a.py").write_text("x = 1\n")
    (d / "sub dir" / "é.txt").write_bytes(b"\x00\xffraw")
    (d / "empty").write_text("")
    run("add", "-A")
    run("commit", "-q", "-m", "one")
    (d / "a.py").write_text("x = 2\n")
    (d / "b.sh").write_text("#!/bin/sh\n")
    os.chmod(d / "b.sh", 0o755)
    run("add", "-A")
    run("commit", "-q", "-m", "two", when="2024-01-02T00:00:00Z")
    return str(d)


def test_tree_and_contents(spark, repo):
    files = git.tree(spark, repo)
    assert [(r.path, r.mode, r.bytes) for r in files.collect()] == [
        ("a.py", "100644", 6), ("b.sh", "100755", 10), ("empty", "100644", 0), ("sub dir/é.txt", "100644", 5)
    ]
    got = {r.path: bytes(r.content) for r in git.contents(files, repo).collect()}
    assert got == {"a.py": b"x = 2\n", "b.sh": b"#!/bin/sh\n", "empty": b"", "sub dir/é.txt": b"\x00\xffraw"}
    small = {r.path: r.content is None for r in git.contents(files, repo, most=6).collect()}
    assert small == {"a.py": False, "b.sh": True, "empty": False, "sub dir/é.txt": False}
    lost = files.limit(1).withColumn("blob", F.lit("0" * 40))
    assert git.contents(lost, repo).first().content is None
    assert git.tree(spark, repo, "HEAD~1").count() == 3


def test_commit_times(spark, repo, tmp_path):
    day = 86_400
    first = 1_704_067_200
    got = {r.path: r.changed for r in git.commit_times(spark, repo).collect()}
    assert got == {"a.py": first + day, "b.sh": first + day, "empty": first, "sub dir/é.txt": first}
    shallow = git.resolve(f"file://{repo}", str(tmp_path))
    assert git.commit_times(spark, shallow).count() == 0 and git.tree(spark, shallow).count() == 4
    whole = git.resolve(f"file://{repo}", str(tmp_path), depth=None)  # the same clone, now with its history
    assert whole == shallow and git.commit_times(spark, whole).count() == 4


def test_addresses(repo):
    assert git.address("example.com/o/n") == "https://example.com/o/n.git"
    assert git.address("git@example.com:o/n.git") == "git@example.com:o/n.git"
    assert git.address(repo) == repo
    for bad in ("", "--upload-pack=x", "no/such", "a\nb"):
        with pytest.raises(git.NoRepository):
            git.address(bad)
    with pytest.raises(git.NoRepository):
        git.commit_id(repo, "--all")
