"""The streamed query on its own rows: the table may be one file or a folder of files."""

from catalogue.queries import QUERIES


def test_documents_are_streamed_from_a_file_or_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} </b>") for i in range(12)], "doc_id bigint, text string")
    folder, single = tmp_path / "folder", tmp_path / "single"
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    single.mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(single / "documents.parquet")
    docs.write.parquet(f"{folder}/more_documents.parquet")  # another table beside it
    found = [sorted(map(tuple, QUERIES["stream_issues"](spark, str(at)).collect())) for at in (folder, single)]
    assert found[0] == found[1] and {row[0] for row in found[0]} >= {1, 4, 7, 10}
    assert len(found[0]) == len(set(found[0]))
