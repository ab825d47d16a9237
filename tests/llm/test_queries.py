"""The registered queries and the pipeline's stages on a small folder of tables, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from entwine.llm import bpe, queries

from .test_other_tables import PAGE, vectors
from .test_texts import jaccard_truth, words

CONTRACTS = {
    "op1_": "vec_id n_links component_id kept", "op2_": "doc_id held_out score predicted", "op3_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_": "doc_id class_id n_links kept", "op6_": "page_id url text n_chars", "op7_": "doc_id size source_size target taken",
    "op8_": "doc_id size text_crc32 law shard slot grown_shard", "op9_": "conv_id n_turns copies rendered", "op10_": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


def documents():
    rng = random.Random(8)
    out = []
    for i in range(90):
        text = " ".join(rng.choice(["river", "stone", "cloud", "tree"]) + str(rng.randrange(900)) for _ in range(rng.randrange(55, 140))) + "."
        if i % 6 == 0:
            text += " you awful fool."
        out.append([i, text, "en", f"s{i % 3}", len(text)])
    for i in range(5):
        t = out[i + 1][1].split()
        t[len(t) // 2] = "edited"
        out.append([90 + i, " ".join(t), "en", "s0", 0])
    out += [[95, out[7][1], "en", "s1", 0], [96, None, None, None, None], [97, "", "en", "s2", 0], [98, "### " * 90, "en", "s0", 0], [99, "same words here " * 60, "en", "s1", 0]]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("fool" in (r[1] or ""))) for r in docs if r[0] % 4], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vectors()], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://h.org/{i}", PAGE) for i in range(3)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(c, t, "user", f"t{t}") for c in range(4) for t in range(c + 1)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_every_query_keeps_its_contract(spark, sf_dir):
    known = queries.queries()
    assert [k.split("_")[0] for k in known] == [f"op{i}" for i in range(1, 11)]
    docs = {r[0]: r for r in documents()}
    for prefix, columns in CONTRACTS.items():
        name = next(k for k in known if k.startswith(prefix))
        df = known[name](spark, sf_dir)
        assert df.columns == columns.split(), name
        rows = df.collect()
        if prefix == "op4_":
            enc, _ = bpe.load_encoding(*queries.tokenizer())
            for r in rows:
                ids = enc.encode_ordinary(docs[r.doc_id][1] or "")
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        elif prefix == "op2_":
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
            assert sum(r.predicted == ("fool" in (docs[r.doc_id][1] or "")) for r in rows) >= 97
        elif prefix == "op6_":
            assert {r.text for r in rows} == {"Head & more\n\nOne two three\n\nFish <chips> &am ©"}
        elif prefix == "op7_":
            assert abs(sum(r.taken for r in rows) - sum(1.5 * len(words(r[1])) for r in docs.values())) <= 4
        elif prefix == "op8_":
            assert max(r.shard for r in rows) <= 15 and Counter(r.shard for r in rows)[rows[0].shard] == max(r.slot for r in rows if r.shard == rows[0].shard) + 1
        elif prefix == "op9_":
            assert [(r.conv_id, r.n_turns) for r in rows] == [(3, 4)]
        elif prefix == "op10_":
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.n_tokens == len(words(docs[r.doc_id][1])) + 1 for r in rows)
        assert len(rows) == {"op1_": len(vectors()), "op6_": 3, "op9_": 1}.get(prefix, len(docs))


def test_stages_of_the_pipeline(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "ngram_jaccard", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r[0]: r[1] for r in documents()}
    before = Counter(texts)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        held = {r.doc_id for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        now = Counter(r.doc_id for r in rows)
        if name != "byte_bpe":
            assert docs.columns == columns and set(now) <= held and all(r.text == texts[r.doc_id] for r in rows)
        if name == "toxicity":
            assert not any("fool" in (texts[k] or "") for k in now) and all(k in now for k, t in texts.items() if t is None or "fool" not in t)
        elif name == "quality_rules":
            assert not {96, 97, 98, 99} & set(now) and held - set(now) == {96, 97, 98, 99}
        elif name == "ngram_jaccard":
            kept = {k for k, n, c in jaccard_truth([[k, texts[k]] for k in sorted(held)]) if k == c}
            assert now == Counter(kept)
        elif name == "source_mix":
            assert max(now.values()) <= 2
        else:
            enc, _ = bpe.load_encoding(*queries.tokenizer())
            assert now == before and all(r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.round_trip for r in rows)
        before = now
    assert corpus_pipeline.run(spark, sf_dir).count() == sum(before.values())
