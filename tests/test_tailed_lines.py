"""Line files that grow, shrink and are rewritten: each line is read once."""

import json
from collections import Counter

import pytest

from memloom.sources import tailed_lines, transcripts
from memloom.sources.tailed_lines import TailedLines


@pytest.fixture()
def tail(spark, tmp_path):
    spark.dataSource.register(TailedLines)
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()

    def run():
        """The rows of the next batches: value, place and whether the file was begun anew."""
        spark.createDataFrame([], tailed_lines.SCHEMA).write.mode("append").parquet(out)
        before = Counter(tuple(r) for r in spark.read.schema(tailed_lines.SCHEMA).parquet(out).select("value", "position", "restarted").collect())
        put = lambda batch, _: batch.write.mode("append").parquet(out)
        spark.readStream.format("tailed_lines").option("path", str(folder)).option("glob", "*.jsonl").load().writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start().awaitTermination()
        after = Counter(tuple(r) for r in spark.read.schema(tailed_lines.SCHEMA).parquet(out).select("value", "position", "restarted").collect())
        return sorted((after - before).elements())

    return folder, run


def test_append_cut_and_rewrite(tail):
    folder, run = tail
    a = folder / "a.jsonl"
    a.write_text("one\ntwo\npar")
    (folder / "other.txt").write_text("no\n")
    assert run() == [("one", 0, False), ("two", 4, False)]
    assert run() == []
    a.write_text("one\ntwo\npart\nthree\n")  # as if appended to
    (folder / "b.jsonl").write_text("x\n")
    assert run() == [("part", 8, False), ("three", 13, False), ("x", 0, False)]
    a.write_text("one\n")  # cut
    assert run() == [("one", 0, True)]
    a.write_text("ONE\nfour\n")  # rewritten and grown
    assert run() == [("ONE", 0, True), ("four", 4, True)]
    a.write_text("ONE\nfour\nfive\n")
    assert run() == [("five", 9, False)]


def test_batch_in_parts(spark, tmp_path, monkeypatch):
    """Parts and steps of a few bytes give each line once, long ones too."""
    lines = [f"line {i} " + "é" * (i % 40) for i in range(60)]
    (tmp_path / "f").write_text("\n".join(lines) + "\nrest", encoding="utf-8")
    for name, n in (("STEP_BYTES", 16), ("PART_BYTES", 100)):
        monkeypatch.setattr(tailed_lines, name, n)
    files = tailed_lines.Files(str(tmp_path), "f")
    parts = list(files.parts(f"{tmp_path}/f", 0, files.last_line_end(f"{tmp_path}/f", files.sizes()[f"{tmp_path}/f"]), False))
    got = [v for p in parts for b in files.rows(p) for v in b.column("value").to_pylist()]
    assert got == lines and len(parts) > 10


def test_transcripts_from_tails(spark, tmp_path):
    spark.dataSource.register(TailedLines)
    line = lambda u, content: json.dumps({"type": "user", "sessionId": "s", "uuid": u, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": content}})
    (tmp_path / "a.jsonl").write_text("\n".join([line("1", "hi"), line("2", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]), line("3", "<local-command-caveat> no"), "{broken"]) + "\n")
    lines = transcripts.parsed(spark.read.format("tailed_lines").option("path", str(tmp_path)).load())
    assert lines.where("damaged").count() == 1 and {r.text for r in transcripts.items(lines).collect()} == {"hi", "one\ntwo"}
