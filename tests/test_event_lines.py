"""The data source of event lines: ranges, batches, and streams that stop and go on."""
import pytest

from winnowry.sources.event_lines import Folder, Range, read_event_lines, stream_event_lines

LINES = ["data: {\"a\": 1}", "", "é日本語 line", "x" * 300, "", "last of one"]


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "segments"
    where.mkdir()
    (where / "0001.log").write_bytes(("\n".join(LINES) + "\n").encode())
    (where / "0002.log").write_bytes(b"two a\r\ntwo b\nopen")
    (where / "_SUCCESS").write_bytes(b"not a segment\n")
    return where


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_ranges_give_each_line_once(folder, split):
    f = Folder({"path": str(folder), "splitBytes": split})
    got = [(r.path[-8:], at, line) for path, size in f.segments() for r in f.ranges(path, 0, size) for at, line in f.lines(r)]
    want = []
    for name in ("0001.log", "0002.log"):
        at = 0
        for line in (folder / name).read_bytes().splitlines(keepends=True):
            want.append((name, at, line))
            at += len(line)
    assert got == want


def test_ended(folder, monkeypatch):
    monkeypatch.setattr("winnowry.sources.event_lines.TAIL_BYTES", 3)
    f = Folder({"path": str(folder)})
    assert [f.ended(p, n) for p, n in f.segments()] == [(folder / "0001.log").stat().st_size, len(b"two a\r\ntwo b\n")]


def test_batch(spark, folder):
    got = [(r["segment"], r["value"]) for r in read_event_lines(spark, str(folder), 16).orderBy("segment", "offset").collect()]
    assert got == [("0001.log", x) for x in LINES] + [("0002.log", x) for x in ("two a", "two b", "open")]
    assert read_event_lines(spark, str(folder / "absent")).count() == 0


def run(spark, folder, out, at, fail=False):
    def write(df, _):
        rows = [tuple(r) for r in df.collect()]
        if fail:
            raise RuntimeError("the sink is down")
        with open(out, "a") as f:
            f.writelines(f"{r[0]} {r[1]} {r[2]}\n" for r in sorted(rows))

    stream_event_lines(spark, str(folder), 16).writeStream.foreachBatch(write).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()


def test_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    out, at = tmp_path / "out.txt", tmp_path / "at"
    run(spark, folder, out, at)
    assert "open" not in out.read_text() and "two b" in out.read_text()
    with open(folder / "0002.log", "ab") as f:
        f.write(b" now ended\nmore\n")
    (folder / "0003.log").write_bytes(b"three\nstill open")
    with pytest.raises(Exception, match="sink is down"):
        run(spark, folder, out, at, fail=True)
    run(spark, folder, out, at)
    run(spark, folder, out, at)
    got = sorted(out.read_text().split("\n")[:-1])
    want = []
    for name in ("0001.log", "0002.log", "0003.log"):
        at_ = 0
        for line in (folder / name).read_bytes().splitlines(keepends=True):
            if line.endswith(b"\n"):
                want.append(f"{name} {at_} {line.decode().rstrip()}")
            at_ += len(line)
    assert got == sorted(want)
