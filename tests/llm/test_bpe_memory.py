"""A task of byte_bpe holds the ids of a bounded number of rows, not of a whole Arrow batch."""

import tracemalloc

import pyarrow as pa

from entwine.llm import bpe


def test_ids_leave_before_the_batch_ends():
    n, texts = 2000, [None, "", *("ab" * 500 for _ in range(1998))]
    codec = bpe.TreeCodec(lambda t: [1000 + ord(c) for c in t], [b""] * 1000 + [bytes([i]) for i in range(128)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    tracemalloc.start()
    rows = [(b.num_rows, b.column("id")[0].as_py(), sum(len(x) for x in b.column("ids"))) for b in bpe.encoded(iter([batch]), codec, "id", True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r[0] for r in rows) == n and sum(r[2] for r in rows) == 1998 * 1000
    assert len(rows) > 4 and [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert peak < 6e6  # the ids of all rows as lists take 16 MB and more


def test_rows_are_as_of_one_batch():
    codec = bpe.TreeCodec(lambda t: [1000 + ord(c) for c in t], [b""] * 1000 + [bytes([i]) for i in range(128)])
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, 5, 5], pa.int64()), pa.array(["ab", "", None, "b"], pa.string())], ["id", "text"])
    get = lambda most, ids: [r for b in bpe.encoded(iter([batch, batch.slice(0, 0)]), codec, "id", ids, most) for r in b.to_pylist()]
    assert get(1, True) == get(99, True) and [r["ids"] for r in get(1, True)] == [[1097, 1098], [], [], [1098]]
    assert get(1, False) == [{k: v for k, v in r.items() if k != "ids"} for r in get(99, True)]
