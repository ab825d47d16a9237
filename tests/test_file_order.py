"""Files are read in their order, whatever their sizes."""

from entwine.plans import registry
from entwine.sources import tables


def test_rows_of_a_folder_follow_its_files_by_name(spark, tmp_path):
    header = "\t".join(tables.MATCHING_HEADER)
    for name, rows in (("part-0.txt", [header]), ("part-1.txt", ["S1-0\t"]), ("part-9.txt", [f"S1-{i}\t{'S2-1,' * 9}" for i in (1, 2, 3)]), ("part-10.txt", ["S1-4\tS2-1"])):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    for columns in (tables.MATCHING_HEADER, None):
        rows = tables.read_tsv(spark, str(tmp_path), columns).orderBy("row_ord").collect()
        assert [r.source1_entity_id for r in rows] == [f"S1-{i}" for i in range(5)]


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    path = tmp_path / "source.tsv"
    path.write_text("\t".join(tables.MATCHING_HEADER) + "\n" + "".join(f"S1-{i}\t\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.read_tsv(spark, str(path), tables.MATCHING_HEADER).orderBy("row_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.source1_entity_id for r in rows] == [f"S1-{i}" for i in range(3000)]


def test_result_lists_of_several_files_are_in_order(spark, tmp_path):
    title = lambda i: f"Alba Corso {i % 3}" if i > 90 else f"Brema{i} Dalia{i}"
    rows = [(i, f"http://a.org/{i}", f'<html lang="en"><title>{title(i)}</title>') for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lists = registry.queries()["result_lists"](spark, str(tmp_path)).orderBy("nth").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.source1_entity_id for r in lists] == [f"S1-{i}" for i in range(0, 120, 3)]
