from quillmere.sources import notes


def test_notes_roundtrip(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nvideo_id: BV1xx\ntitle: 'T: x'\n---\nbody\nline")
    (tmp_path / "b.md").write_text("no head https://v/BV2yy?p=1")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in notes.read_notes(spark, str(tmp_path)).collect()}
    assert rows["a.md"].video_id == "BV1xx" and rows["a.md"].head["title"] == "T: x" and rows["a.md"].body == "body\nline"
    assert rows["b.md"].video_id == "BV2yy" and rows["b.md"].body.startswith("no head")


def test_jsonl_skips_comments(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# c\n\n{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    assert {tuple(r) for r in notes.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n long").collect()} == {("a", 1), ("b", 2)}


def test_write_new_skips_known_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "document_id string, text string")
    notes.write_new(rows("a", "b"), path, "document_id")
    notes.write_new(rows("b", "c"), path, "document_id")
    assert sorted(r.document_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
