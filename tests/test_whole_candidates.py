"""The registered queries use the candidates of a whole run."""

import random
from collections import Counter

from entwine.plans import registry


def test_queries_use_every_channel_and_the_whole_budget(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(6))
    words = [word() for _ in range(40)]
    name = lambda: " ".join(rng.choices(words, k=3)) + rng.choice([" gmbh", "", " ltd"])
    rows = [(i, f"http://{rng.choice(words)}.org/{rng.randrange(9)}/{rng.choice(words)}", f'<html lang="{"en" if i % 10 else "fr"}"><title>{name()}</title><article>{i // 3}</article>') for i in range(150)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = registry.queries()
    union = {(r.s1, r.r): r.mask for r in q["all_channels_union"](spark, str(tmp_path)).collect()}
    missed = {bit for m in union.values() for bit in (1, 4, 5, 9) if m >> bit & 1}
    assert {1, 4, 5} <= missed  # tf-idf, address, neighbourhood; no name of these is within another
    pairs = [(r.s1, r.r) for r in q["pair_features_full"](spark, str(tmp_path)).select("s1", "r").collect()]
    assert set(pairs) <= set(union) and any(not union[p] & 0b100001101 for p in pairs)
    assert 20 < max(Counter(s1 for s1, _ in pairs).values())
