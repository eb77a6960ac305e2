from __future__ import annotations

import json

import pytest

from citelake.streaming import releases

SCHEMA = "id long, title string, seq long"


@pytest.fixture
def corpus(spark, tmp_path):
    """A table, and a way to write a release's files."""
    path = str(tmp_path / "papers")
    releases.create(spark, path, SCHEMA, ["id"], parts=4)

    def write(name, updates=None, deletes=None):
        folders = []
        for kind, rows in (("updates", updates), ("deletes", deletes)):
            folder = tmp_path / "in" / name / kind
            if rows is not None:
                folder.mkdir(parents=True, exist_ok=True)
                text = rows if isinstance(rows, str) else "\n".join(map(json.dumps, rows))
                (folder / "a.json").write_text(text)
            folders.append(None if rows is None else str(folder))
        return (name, *folders)

    def apply(steps):
        return releases.apply_releases(spark, path, steps, SCHEMA, ["id"], "seq", parts=4)

    def rows():
        return sorted(map(tuple, releases.current(spark, path, SCHEMA).collect()))

    def log():
        return sorted((r["release"], r["status"], r["updated"], r["deleted"]) for r in releases.ledger(spark, path).collect())

    return write, apply, rows, log


def paper(key, title, seq=0):
    return {"id": key, "title": title, "seq": seq}


def test_a_failing_file_stops_the_watermark_and_a_rerun_finishes(corpus):
    write, apply, rows, log = corpus
    one = write("2024-01-02", [paper(1, "a"), paper(2, "b"), paper(2, "b2", 1), paper(4, "d")])
    bad = write("2024-02-06", '{"id": 3, "title": "c", "seq": 0}\nnot json\n', [{"id": 4}])
    three = write("2024-03-05", [paper(1, "a3")], [{"id": 2}])
    assert apply([three, one, bad]) == "2024-01-02"
    assert rows() == [(1, "a3", 0), (4, "d", 0)], "nothing of the failed release, all of the later one"
    assert log() == [("2024-01-02", "applied", 3, 0), ("2024-02-06", "failed", 0, 0), ("2024-03-05", "ahead", 1, 1)]
    mended = write("2024-02-06", [paper(1, "a2"), paper(2, "back"), paper(3, "c")], [{"id": 4}])
    assert apply([one, mended, three]) == "2024-03-05"
    assert rows() == [(1, "a3", 0), (3, "c", 0)], "the later release still counts over the mended one"
    assert log()[-1] == ("2024-03-05", "applied", 1, 1) and len(log()) == 5
    assert apply([one, mended, three]) == "2024-03-05" and len(log()) == 5, "nothing is left to do"


def test_missing_folders_fail_their_release(corpus):
    write, apply, rows, log = corpus
    one = write("1", [paper(1, "a")])
    assert apply([("0", "/nowhere/at/all", None), one]) is None
    assert rows() == [(1, "a", 0)] and [x[1] for x in log()] == ["failed", "ahead"]


def test_deletions_win_and_a_part_may_get_empty(corpus):
    write, apply, rows, _ = corpus
    assert apply([write("1", [paper(1, "a"), paper(None, "no key")]), write("2", [paper(1, "again")], [{"id": 1}, {"id": 9}])]) == "2"
    assert rows() == []
    assert apply([write("3", [paper(1, "new")]), write("4", []), ("5", None, None)]) == "5"
    assert rows() == [(1, "new", 0)]


def test_nothing_to_apply(corpus):
    _, apply, rows, log = corpus
    assert apply([]) is None and rows() == [] and log() == []
