"""Result files are written of pairs that are found once."""

from entwine.plans import registry


def test_result_lists_find_their_pairs_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a.org/{i}", f'<html lang="en"><title>{"Alba Corso" if i % 2 else "Brema Dalia"} {i // 6}</title>') for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    runs, found = spark.sparkContext.accumulator(0), registry.overlap_pairs

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    monkeypatch.setattr(registry, "overlap_pairs", lambda s, d: (lambda df: df.mapInArrow(counted, df.schema))(found(s, d)))
    lists = registry.queries()["result_lists"](spark, str(tmp_path))
    assert lists.count() == 20
    assert runs.value == found(spark, str(tmp_path)).count()
