import json

import pytest
from lumenguard import cli, sources, streaming


def test_files_of_all_encodings(spark, tmp_path):
    text = "ssn 123-45-6789 é\r\n"
    for name, raw in {
        "a": text.encode(), "b": b"\xef\xbb\xbf" + text.encode(), "c": b"\xff\xfe" + text.encode("utf-16-le"), "d": b"\xfe\xff" + text.encode("utf-16-be"),
        "e": b"\xff\xfe\x00\x00" + text.encode("utf-32-le"), "f": b"\x00\x00\xfe\xff" + text.encode("utf-32-be"), "g": b"", "h": b"ok \xff",
    }.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"][-1]: r["text"] for r in sources.files(spark, [str(tmp_path)]).collect()}
    assert all(got[x] == text for x in "abcdef") and got["g"] == "" and got["h"] == "ok �"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a").write_text("x\nssn 123-45-6789")
    (tmp_path / "b").write_text("plain")
    (tmp_path / "c").write_text("")
    assert cli.main(["scan", "-q", str(tmp_path / "b")]) == 0
    assert cli.main(["scan", "--json", str(tmp_path / "a"), str(tmp_path / "b")]) == 1
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()[1:]]
    found = next(x for x in out if x["source"].endswith("a"))["findings"]
    assert [(f["type"], f["line"], f["column"], f["maskedValue"]) for f in found] == [("SSN", 2, 5, "•••")]
    assert cli.main(["scan", str(tmp_path / "c")]) == 2
    assert cli.main(["scan", str(tmp_path / "none")]) == 2
    assert cli.main(["scan", str(tmp_path / "a")]) == 1
    assert "2:5 SSN" in capsys.readouterr().out


def test_cases_refuse_equal_ids(spark, tmp_path):
    one = {"id": "x", "input": "t", "expect": {"types": [], "verdict": "CLEAN"}}
    (tmp_path / "c.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps(one) + "\n")
    with pytest.raises(ValueError, match="x"):
        sources.cases(spark, str(tmp_path))


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(1, "ssn 123-45-6789"), (2, "plain"), (3, "1 2 3 card 4111 1111 1111 1111")]
    spark.createDataFrame(rows, "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = streaming.classified(stream, "text").select("id", "result.verdict").writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("verdicts").collect()} == {(1, "VIOLATION"), (2, "CLEAN"), (3, "VIOLATION")}
