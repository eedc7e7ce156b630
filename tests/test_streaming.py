from diskloom.streaming import filters


def test_batch_and_stream_agree(spark, tmp_path):
    raw = b"A\x14\x30\xca\xde\r\nB\xff\n\nlast"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    assert b"".join(bytes(r.line) for r in filters.lines(files).orderBy("line_no").collect()) == raw
    for mode in ("pc98-8bit-to-utf8", "pc6001-8bit-to-utf8"):
        want = {(r.line_no, bytes(r.converted)) for r in filters.apply(files, mode).collect()}
        q = filters.stream(spark, str(tmp_path / "in"), mode).writeStream.format("memory").queryName("t" + mode.replace("-", "")).start()
        q.processAllAvailable()
        q.stop()
        assert {(r.line_no, bytes(r.converted)) for r in spark.sql("select * from t" + mode.replace("-", "")).collect()} == want
    back = {bytes(r.converted) for r in filters.apply(spark.createDataFrame([("p", "カ\n".encode())], "path string, content binary"), "utf8-to-pc98-8bit").collect()}
    assert back == {b"\xb6\n"}
